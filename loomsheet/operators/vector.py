"""Vectors: normalisation, cosine similarity and brute-force nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def nearest(df: DataFrame, query: list[float], k: int, vector: str = "embedding", where: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The ``k`` (1 to 20) rows most similar by cosine; each partition keeps its own top rows only."""
    k = min(max(k, 1), 20)
    size = sum(x * x for x in query) ** 0.5 or 1.0
    unit = F.array(*[F.lit(float(x) / size) for x in query])
    rows = df.filter(where) if where is not None else df
    scored = rows.select(key, F.round(F.try_divide(dot(F.col(vector), unit), norm(F.col(vector))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def nearest_of(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 2_048) -> DataFrame:
    """(query_id, id, score): for each query (id, vector) the ``k`` best rows (id, vector), by cosine or by ``euclidean`` distance.

    Exact: every query meets every row, block against block, so a task holds two blocks of about
    ``block`` vectors whatever the sizes of the tables, and hands on at most ``k`` rows a query and
    block.  Null vectors and, by cosine, zero vectors have no score; ties go to the lower id.
    """

    def blocks(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        parts = max(1, -(-df.count() // block))
        packed = df.filter("vector is not null").groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(name))
        return packed.agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("vector").alias(f"{name}_vectors")), parts

    own, _ = blocks(rows.select("id", "vector"), "r")
    asked, parts = blocks(queries.select("id", "vector"), "q")
    met = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(asked, "q").select("r_ids", "r_vectors", "q_ids", "q_vectors")
    kind = dict(rows.dtypes)["id"]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r_ids, r_vectors, q_ids, q_vectors in batch.itertuples(index=False):
                a, b = np.array([np.asarray(v, float) for v in q_vectors]), np.array([np.asarray(v, float) for v in r_vectors])
                ids = np.asarray(r_ids)
                if metric == "cosine":
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = np.round((a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None], 6)
                    order = -score
                else:
                    score = order = np.round(np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(axis=2)), 6)
                for i, q in enumerate(q_ids):
                    held = np.flatnonzero(np.isfinite(order[i]))
                    top = held[np.lexsort((ids[held], order[i][held]))[:k]]
                    yield pd.DataFrame({"query_id": q, "id": ids[top], "score": score[i][top]})

    found = met.mapInPandas(best, f"query_id {kind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if metric == "cosine" else F.asc("score"), "id")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")

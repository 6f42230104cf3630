"""Envelopes, range joins by grid cells, nearest neighbours, and convex hulls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsheet.session import checkpoint

#: rows of a task, as a power of two, whose ids can meet in one block of the range join
BLOCK_BITS = 16
#: parts of a grid cell at most
COPIES = 8
#: pairs of a batch that the range join returns, and of a row above which it is crowded
PAIRS, CROWDED = 1 << 17, 1 << 12
#: how often the squares of the search for neighbours are halved at most, and their least side
LEVELS, LEAST_SIDE = 20, 1e-4


def contains(a: str, b: str) -> Column:
    """Whether envelope struct ``a`` holds ``b`` (fields min_x, min_y, max_x, max_y)."""
    return F.expr(f"{a}.min_x <= {b}.min_x and {a}.min_y <= {b}.min_y and {a}.max_x >= {b}.max_x and {a}.max_y >= {b}.max_y")


def intersects(a: str, b: str) -> Column:
    return F.expr(f"{a}.min_x <= {b}.max_x and {a}.min_y <= {b}.max_y and {a}.max_x >= {b}.min_x and {a}.max_y >= {b}.min_y")


def intersection(a: str, b: str) -> Column:
    """The common envelope; null where there is none."""
    made = F.expr(f"named_struct('min_x', greatest({a}.min_x, {b}.min_x), 'min_y', greatest({a}.min_y, {b}.min_y), 'max_x', least({a}.max_x, {b}.max_x), 'max_y', least({a}.max_y, {b}.max_y))")
    return F.when(intersects(a, b), made)


def extend(a: str, b: str) -> Column:
    return F.expr(f"named_struct('min_x', least({a}.min_x, {b}.min_x), 'min_y', least({a}.min_y, {b}.min_y), 'max_x', greatest({a}.max_x, {b}.max_x), 'max_y', greatest({a}.max_y, {b}.max_y))")


def _cells(e: str, cell: float) -> Column:
    xs = F.sequence(F.floor(F.col(f"{e}.min_x") / cell), F.floor(F.col(f"{e}.max_x") / cell))
    ys = F.sequence(F.floor(F.col(f"{e}.min_y") / cell), F.floor(F.col(f"{e}.max_y") / cell))
    return F.explode(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y"))))))


def search(df: DataFrame, envelope: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose envelope meets a box; a plain filter, which row-group statistics prune on sorted data."""
    e = F.col(envelope)
    return df.filter((e["min_x"] <= box[2]) & (e["min_y"] <= box[3]) & (e["max_x"] >= box[0]) & (e["max_y"] >= box[1]))


def _blocks(df: DataFrame, side: str) -> DataFrame:
    """(side, side_ids): each envelope with the ids that have it, those of so many rows of a task at a time."""
    place = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    rows = df.select("id", F.col("e").alias(side), place.alias("place"))
    held = rows.groupBy(side, "place").agg(F.collect_list("id").alias("ids"), F.count_if(F.col("id").isNull()).cast("int").alias("nulls"))
    return held.select(side, F.concat("ids", F.array_repeat(F.lit(None), F.col("nulls"))).alias(f"{side}_ids"))


def intersection_join(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs (a_id, b_id) of rows (id, e) whose envelopes meet; ``a`` is best the smaller table.

    Envelopes are put into the grid cells they touch and joined on the cell; a pair counts in the cell
    of its common lower corner only, so nothing needs to be made distinct. Rows of equal envelopes go
    through the join as one row with their ids in blocks, and pairs are made after it, so what is
    shuffled is ids, whatever the number of pairs. They come as runs of a ``b_id``, which columns store
    as a count. Where ``a`` is much smaller, its copies part a crowded cell over several tasks.
    """
    copies = max(1, min(COPIES, b.count() // max(1, 4 * a.count())))
    left = _blocks(a, "a").withColumn("cell", _cells("a", cell)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    right = _blocks(b, "b").withColumn("copy", F.pmod(F.xxhash64("b", F.element_at("b_ids", 1)), F.lit(copies)).cast("int")).withColumn("cell", _cells("b", cell))
    corner_x, corner_y = F.floor(F.greatest("a.min_x", "b.min_x") / cell), F.floor(F.greatest("a.min_y", "b.min_y") / cell)
    met = left.join(right, ["cell", "copy"]).filter(intersects("a", "b"))
    met = met.filter((F.col("cell.x") == corner_x) & (F.col("cell.y") == corner_y)).select("a_ids", "b_ids")
    return met.mapInArrow(_pairs, f"a_id {dict(a.dtypes)['id']}, b_id {dict(b.dtypes)['id']}")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of the ids of a row (a_ids, b_ids), ``PAIRS`` at a time; exploding would hold all pairs of a row at once."""

    def taken(at_a: np.ndarray, at_b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([a.values.take(pa.array(at_a)), b.values.take(pa.array(at_b))], names=["a_id", "b_id"])

    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        from_a, from_b = (x.offsets.to_numpy().astype(np.int64) for x in (a, b))
        many, times = np.diff(from_a), np.diff(from_b)
        # crowded rows one by one: the ids of a again and again, each of b so many times over
        for row in np.flatnonzero(many * times > CROWDED).tolist():
            for start in range(from_a[row], from_a[row + 1], PAIRS):
                own = np.arange(start, min(start + PAIRS, from_a[row + 1]))
                step = max(1, PAIRS // len(own))
                cycle = np.tile(own, min(step, times[row]))
                for first in range(from_b[row], from_b[row + 1], step):
                    others = np.arange(first, min(first + step, from_b[row + 1]))
                    yield taken(cycle[: len(own) * len(others)], np.repeat(others, len(own)))
        # all others together
        few = np.flatnonzero((many * times > 0) & (many * times <= CROWDED))
        ends = np.cumsum((many * times)[few])
        for start in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            pair = np.arange(start, min(start + PAIRS, int(ends[-1])))
            place = np.searchsorted(ends, pair, side="right")
            row = few[place]
            pair -= (ends - (many * times)[few])[place]
            own = many[row]
            at_b = pair // own
            yield taken(pair - at_b * own + from_a[row], at_b + from_b[row])


def nearest(df: DataFrame, x: float, y: float, k: int, envelope: str = "e", farthest: float | None = None, predicate: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to a point (all when k <= 0), within a distance, then by the predicate."""
    e = F.col(envelope)
    dx = F.greatest(e["min_x"] - x, F.lit(0.0), F.lit(x) - e["max_x"])
    dy = F.greatest(e["min_y"] - y, F.lit(0.0), F.lit(y) - e["max_y"])
    rows = df
    if farthest is not None:
        rows = search(rows, envelope, (x - farthest, y - farthest, x + farthest, y + farthest))
    rows = rows.withColumn("distance", F.sqrt(dx * dx + dy * dy))
    if farthest is not None:
        rows = rows.filter(F.col("distance") <= farthest)
    if predicate is not None:
        rows = rows.filter(predicate)
    ordered = rows.orderBy("distance", "id")
    return ordered.limit(k) if k > 0 else ordered


def convex_hull(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, position, x, y) of the hull of each group, counter-clockwise from the least point.

    Points of a group are first cut down to the lowest and highest of each x, by an aggregate, and these
    to partial hulls of x ranges; only hull points of ranges meet in one task.
    """

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        points = sorted(set(zip(pdf.x, pdf.y, strict=True)))

        def chain(ps):
            out: list = []
            for p in ps:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        ring = points if len(points) < 3 else chain(points)[:-1] + chain(points[::-1])[:-1]
        return pd.DataFrame({"g": pdf.g.iloc[0], "position": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    kind = dict(df.dtypes)[group]
    ends = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).alias("g"), F.col(x).cast("double").alias("x")).agg(F.min(F.col(y).cast("double")).alias("lo"), F.max(F.col(y).cast("double")).alias("hi"))
    points = ends.select("g", "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))
    span = points.groupBy("g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    ranged = points.join(span, "g").withColumn("slice", F.least(F.floor(F.when(F.col("x1") > F.col("x0"), (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")) * 64).otherwise(0)), F.lit(63)))
    schema = f"g {kind}, position int, x double, y double"
    partial = ranged.groupBy("g", "slice").applyInPandas(lambda pdf: hull(pdf), schema)
    return partial.groupBy("g").applyInPandas(lambda pdf: hull(pdf), schema).withColumnRenamed("g", group)


def rank_nearest(a: DataFrame, b: DataFrame, k: int, cell: float) -> DataFrame:
    """(a_id, b_id, distance): up to ``k`` rows of ``b`` within a cell's width of each point row (id, x, y) of ``a``."""
    reach = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(reach).alias("o")).select("a_id", "ax", "ay", (F.floor(F.col("ax") / cell) + F.col("o.i")).alias("cx"), (F.floor(F.col("ay") / cell) + F.col("o.j")).alias("cy"))
    right = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    pairs = left.join(right, ["cx", "cy"]).withColumn("distance", d).filter(F.col("distance") <= cell)
    w = Window.partitionBy("a_id").orderBy("distance", "b_id")
    return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("a_id", "b_id", "distance")


def nearest_of(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): for each query (id, x, y) the ``k`` nearest points (id, x, y), by rounded distance, then id.

    Exact at any density. Squares are halved up to ``LEVELS`` times. The smallest square round a query
    that holds ``k`` points bounds the distance of the last of them by its diagonal, so the query meets
    only the points of squares of that size within the diagonal. Of points in one place the ``k`` of
    lowest id can count, so others are left out first. Nulls, NaN and infinities have no distance.
    """

    def placed(df: DataFrame) -> DataFrame:
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        return df.select("id", x.alias("x"), y.alias("y")).filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))

    own, asked = placed(points), placed(queries)
    x0, x1, y0, y1, n = own.select("x", "y").unionByName(asked.select("x", "y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    side = max(x1 - x0, y1 - y0) * (1 + 1e-9) if n else 0.0
    side = side or 1.0
    levels = 0
    while levels < LEVELS and 4**levels < 16 * n and side / 2 ** (levels + 1) > LEAST_SIDE:
        levels += 1
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).filter(F.col("_n") <= k).drop("_n")

    def square(at: Column, start: float, level: Column) -> Column:
        return F.floor((at - F.lit(start)) / (F.lit(side) / F.pow(F.lit(2.0), level)))

    def squares(level: Column) -> list[Column]:
        return [square(F.col("x"), x0 or 0.0, level).alias("cx"), square(F.col("y"), y0 or 0.0, level).alias("cy")]

    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    full = own.select("x", "y", every).groupBy("level", *squares(F.col("level"))).count().filter(F.col("count") >= k).select("level", "cx", "cy")
    inside = asked.select("id", "x", "y", every).select("id", "x", "y", "level", *squares(F.col("level"))).join(full, ["level", "cx", "cy"], "left_semi")
    deepest = inside.groupBy("id", "x", "y").agg(F.max("level").alias("level"))
    chosen = checkpoint(asked.join(deepest, ["id", "x", "y"], "left").withColumn("level", F.coalesce("level", F.lit(0))))
    used = sorted(r.level for r in chosen.select("level").distinct().collect())
    reach = F.lit(side) / F.pow(F.lit(2.0), F.col("level")) * (2**0.5 * (1 + 1e-9)) + 2e-6  # distances that round alike count as well

    def near(at: str, start: float) -> Column:
        return F.explode(F.sequence(square(F.col(at) - reach, start, F.col("level")), square(F.col(at) + reach, start, F.col("level"))))

    left = chosen.select(F.col("id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"), "x", "y", "level").withColumn("cx", near("x", x0 or 0.0)).withColumn("cy", near("y", y0 or 0.0)).drop("x", "y")
    right = own.withColumn("level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).select("id", "x", "y", "level", *squares(F.col("level")))
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    scored = left.join(right, ["level", "cx", "cy"]).select("query_id", "id", F.round(F.sqrt(dx * dx + dy * dy), 6).alias("score"))
    ranked = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.filter(F.col("_n") <= k).drop("_n")

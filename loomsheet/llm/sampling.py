"""Bounded samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 40


def bounded(df: DataFrame, key: str, columns: list[str], rows: int) -> DataFrame:
    """The ``rows`` rows with the lowest hashes of their key, or all if there are fewer; the same at every run.

    A bound on the hash, taken from the number of rows, keeps all but somewhat more than ``rows`` rows
    where they are, so what is sent on doesn't grow with the table or its partitions.
    """
    hashed = df.select(key, *columns).withColumn("_h", F.pmod(F.xxhash64(key), F.lit(_SCALE)))
    share = min(1.0, (1.2 * rows + 100) / max(1, df.count()))
    return hashed.filter(F.col("_h") < int(share * _SCALE)).orderBy("_h", key, *columns).limit(rows).select(*columns)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before a costly map, where its files give fewer partitions, that is, where it is small."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

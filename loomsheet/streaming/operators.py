"""Streaming operators: buffers, running histograms, event-time windows (the windows are an extension).

Each takes a streaming DataFrame and gives one; ``run_once`` drives a stream over what is there to the
end, with its state and progress in a checkpoint folder, so that it goes on after a failure.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomsheet.session import load, scratch


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(load(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parquet*")


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "30 days", slide: str | None = None) -> DataFrame:
    """Counts by event-time window (tumbling, or sliding with ``slide``); later rows than ``late`` are left out."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "1 hour", late: str = "30 days") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def running_histogram(events: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin, added to as rows arrive; the last edge is included, outliers are left out."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("int")
    return events.filter(F.col(x).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))


def ring_buffer(events: DataFrame, by: str, ts: str, x: str, n: int) -> DataFrame:
    """State of a buffer of the last ``n`` values by key after each batch: (key, size, lo, hi, all_lo, all_hi).

    State is the buffer, whose length is bounded, and two numbers; rows of a batch are taken in time order.
    """
    kind = dict(events.dtypes)[by]

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: list[float] = list(state.get[0]) if state.exists else []
        low, high = (state.get[1], state.get[2]) if state.exists else (None, None)
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values([ts, x])
        for value in rows[x]:
            if value is None or value != value:
                continue
            kept.append(float(value))
            low = float(value) if low is None else min(low, float(value))
            high = float(value) if high is None else max(high, float(value))
        kept = kept[-n:]
        state.update((kept, low, high))
        numbers: list[Any] = [min(kept, default=None), max(kept, default=None), low, high]
        made = {"key": [key[0]], "size": [len(kept)]} | {n: pd.Series([x], dtype="float64") for n, x in zip(("lo", "hi", "all_lo", "all_hi"), numbers, strict=True)}
        yield pd.DataFrame(made)

    schema = f"key {kind}, size int, lo double, hi double, all_lo double, all_hi double"
    return events.select(by, ts, x).groupBy(by).applyInPandasWithState(update, schema, "kept array<double>, low double, high double", "update", GroupStateTimeout.NoTimeout)


def append_log(points: DataFrame, path: str, checkpoint: str) -> None:
    """Append-only log of points; the file sink writes each batch exactly once."""
    points.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """What a stream gives for all rows there are, as a table written batch by batch; of updates the last counts."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{base}/out/batch={number:08d}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out").drop("batch")
    if mode == "complete":
        return rows.filter(F.col("_batch") == rows.agg(F.max("_batch")).scalar()).drop("_batch")
    if mode == "update" and keys:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "_batch")]), "_batch").alias("r")).select(*keys, "r.*")
    return rows.drop("_batch")

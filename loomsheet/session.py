"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data directory; columns are pruned by the caller's plan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (local tests) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master + "[").startswith("local["):  # local-cluster is a cluster
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = os.path.join(tempfile.gettempdir(), "loomsheet-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table written between two steps of one job."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

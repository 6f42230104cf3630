"""Queries of the general data-preparation problems (nested records, units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.operators import nested, units
from loomsheet.session import checkpoint, load, scratch


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per object in Slides, Shapes and QualityIssues with the link to its parent."""
    return nested.tagged_rows(load(spark, sf_dir, "raw_records")).select("record_id", "entity", "parent_path", "node_path")


def p1_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of shapes with its schema."""
    return nested.apply_schema(nested.tagged_rows(load(spark, sf_dir, "raw_records")), "shape")


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table by the table of their parent; a parent is found by (record_id, path)."""
    rows = checkpoint(nested.tagged_rows(load(spark, sf_dir, "raw_records")).select("record_id", "entity", "node_path", "parent_path"))  # one emission for both sides
    parents = rows.select("record_id", F.col("node_path").alias("parent_path"), F.col("entity").alias("parent")).filter("parent <> 'quality_issue'")
    return rows.join(parents, ["record_id", "parent_path"], "left").groupBy("entity", "parent").agg(F.count("*").alias("n"))


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of the flat tables, written once partitioned by their tag and read back with their schemas."""
    path = scratch(spark, "tables")
    nested.write_tables(load(spark, sf_dir, "raw_records"), path)
    sizes = []
    for entity in ("slide", "shape", "quality_issue"):
        table = nested.read_table(spark, path, entity)
        sizes.append(table.agg(F.lit(entity).alias("entity"), F.count("*").alias("n"), F.countDistinct("record_id").alias("records"), F.lit(len(table.columns)).alias("columns")))
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values stated in another than the common unit, in the common unit."""
    found = units.common_values(load(spark, sf_dir, "format_infos"), load(spark, sf_dir, "format_sources"))
    return found.select("format_id", "field_name", "common_value").distinct()


def p6_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by field and by the unit they are stated in, with the range of their common values."""
    found = units.common_values(load(spark, sf_dir, "format_infos"), load(spark, sf_dir, "format_sources"))
    return found.distinct().groupBy("field_name", "unit").agg(F.count("*").alias("n"), F.min("common_value").alias("least"), F.max("common_value").alias("most"))


QUERIES = {f.__name__: f for f in (p1_found, p1_shapes, p1_links, p1_tables, p6_found, p6_units)}
SQL: dict[str, str] = {}

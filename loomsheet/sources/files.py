"""File sources and sinks: CSV, JSON, grouped data, packages and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_file(spark: SparkSession, filename: str, format: str | None = None, encoding: str = "utf-8", delimiter: str = ",", header: list[str] | bool = True) -> DataFrame:
    """CSV (all values text; a header line or names) or JSON (an array or lines of documents), by extension."""
    kind = (format or filename.rstrip("/").rpartition(".")[2]).lower()
    if kind == "csv":
        reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("inferSchema", False)
        if isinstance(header, list):
            return reader.schema(T.StructType([T.StructField(h, T.StringType()) for h in header])).option("header", False).csv(filename)
        return reader.option("header", header).csv(filename)
    if kind == "json":
        return spark.read.option("multiLine", True).option("encoding", encoding).json(filename)
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(filename)
    if kind == "parquet":
        return spark.read.parquet(filename)
    raise ValueError(f"unknown format {kind}")


def write_file(df: DataFrame, filename: str, format: str | None = None, overwritten: bool = False, header: bool = True, delimiter: str = ",", encoding: str = "utf-8", pretty: bool = False) -> None:
    """CSV or line-delimited JSON; an existing target is an error unless ``overwritten``."""
    kind = (format or filename.rstrip("/").rpartition(".")[2]).lower()
    writer = df.write.mode("overwrite" if overwritten else "errorifexists").option("encoding", encoding)
    if kind == "csv":
        writer.option("header", header).option("sep", delimiter).csv(filename)
    elif kind in ("json", "jsonl"):
        writer.json(filename)
    elif kind == "parquet":
        writer.parquet(filename)
    else:
        raise ValueError(f"unknown format {kind}")


def grouped_json(df: DataFrame, column: str) -> DataFrame:
    """(label, position, value) of texts like ``{"T1": [1, 2], "T2": [3]}``."""
    parsed = F.from_json(F.col(column), T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))
    groups = df.select(F.explode(parsed).alias("label", "items"))
    return groups.select("label", F.posexplode("items").alias("position", "value"))


def grouped_csv(spark: SparkSession, filename: str) -> DataFrame:
    """(label, value) of lines ``label,value``; other lines are skipped."""
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.DoubleType())])
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(filename).filter("label is not null and value is not null")


def row_means(df: DataFrame, columns: list[str]) -> Column:
    """Mean of the cells of a row that hold numbers; null where none does."""
    cells = F.filter(F.array(*[F.col(c).try_cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(cells) > 0, F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.size(cells))


def workbook_groups(df: DataFrame, group_column: int, value_column: int) -> DataFrame:
    """(label, value) of a sheet read as a table, by 1-based columns; rows without both are skipped."""
    label, value = df.columns[group_column - 1], df.columns[value_column - 1]
    out = df.select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{value}`").try_cast("double").alias("value"))
    return out.filter("label is not null and value is not null")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored files with content and metadata, and a content hash."""
    return spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))


def slice_package(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a package: blocks of content.jsonl (malformed lines skipped) and its format and structure files."""
    out = {"blocks": spark.read.option("mode", "DROPMALFORMED").json(f"{folder}/content.jsonl")}
    for name, file in (("format", "format.json"), ("structure", "structure.json"), ("assets", "assets/manifest.json")):
        try:
            out[name] = spark.read.option("multiLine", True).json(f"{folder}/{file}")
        except Exception:  # the part is optional
            continue
    return out


def virtual_id(text: Column) -> Column:
    """Id of an ingested text: the first 12 hex digits of its SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def literature_list(papers: DataFrame, list_id: str) -> tuple[DataFrame, DataFrame]:
    """A result list as an object: (one row of the list, edges ``contains`` from list to paper)."""
    head = papers.agg(F.count("*").alias("total_papers"), F.max(F.col("normalized_doi") != "").alias("has_doi")).select(F.lit(list_id).alias("id"), "total_papers", "has_doi")
    edges = papers.select(F.lit("list").alias("source_kind"), F.lit(list_id).alias("source_id"), F.lit("contains").alias("kind"), F.lit("paper").alias("target_kind"), F.col("id").alias("target_id"))
    return head, edges


def _bib_safe(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([{}])", r"\\$1")


def export_json(papers: DataFrame) -> DataFrame:
    return papers.select(F.to_json(F.struct(*papers.columns), {"ignoreNullFields": "false"}).alias("value"))


def export_markdown(papers: DataFrame) -> DataFrame:
    """One entry a paper: title, authors, year, journal and DOI."""
    year = F.coalesce(F.col("pub_year").cast("string"), F.lit("n.d."))
    doi = F.when(F.coalesce(F.col("normalized_doi"), F.lit("")) != "", F.concat(F.lit(" doi:"), F.col("normalized_doi"))).otherwise("")
    return papers.select("id", F.concat(F.lit("- **"), F.coalesce("title", F.lit("")), F.lit("** "), F.coalesce("authors", F.lit("")), F.lit(" ("), year, F.lit("). "), F.coalesce("journal", F.lit("")), F.lit("."), doi).alias("value"))


def export_bibtex(papers: DataFrame) -> DataFrame:
    fields = [("title", "title"), ("author", "authors"), ("journal", "journal"), ("year", "pub_year"), ("doi", "normalized_doi")]
    lines = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), _bib_safe(F.col(c).cast("string")), F.lit("}"))) for n, c in fields]
    return papers.select("id", F.concat(F.lit("@article{"), F.col("id"), F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}")).alias("value"))

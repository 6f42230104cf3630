"""Object store: registration by content, edges between objects, runs, and stored papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def register(files: DataFrame, order: str = "registered_at") -> DataFrame:
    """One row a content hash, the first by time; rows without hash are kept."""
    first = files.filter("sha256 is not null").groupBy("sha256").agg(F.min_by(F.struct(*files.columns), F.struct(order, "id")).alias("r")).select("r.*")
    return first.unionByName(files.filter("sha256 is null"))


def find(df: DataFrame, **equal: str) -> DataFrame:
    """Rows by column values, without case; a value ending in ``*`` is a prefix."""
    out = df
    for name, value in equal.items():
        c = F.lower(F.col(name))
        out = out.filter(c.startswith(value[:-1].lower()) if value.endswith("*") else c == value.lower())
    return out


def outgoing(edges: DataFrame, kind: str, key: str) -> DataFrame:
    return edges.filter((F.col("source_kind") == kind) & (F.col("source_id") == key)).distinct()


def incoming(edges: DataFrame, kind: str, key: str) -> DataFrame:
    return edges.filter((F.col("target_kind") == kind) & (F.col("target_id") == key)).distinct()


def new_papers(incoming_papers: DataFrame, stored: DataFrame) -> DataFrame:
    """Papers not yet stored by DOI, one each within the batch; those with blank DOI always."""
    doi = F.lower(F.trim(F.coalesce("normalized_doi", F.lit(""))))
    marked = incoming_papers.withColumn("_doi", doi)
    known = stored.select(doi.alias("_doi")).filter("_doi <> ''").distinct()
    named = marked.filter("_doi <> ''").join(known, "_doi", "left_anti")
    first = named.groupBy("_doi").agg(F.min_by(F.struct(*incoming_papers.columns), "id").alias("r")).select("r.*")
    return first.unionByName(marked.filter("_doi = ''").drop("_doi"))


def list_papers(edges: DataFrame, papers: DataFrame, list_id: str) -> DataFrame:
    """Papers a list contains; ids that lead nowhere are skipped."""
    ids = edges.filter((F.col("source_id") == list_id) & (F.col("kind") == "contains")).select(F.col("target_id").alias("id")).distinct()
    return papers.join(ids, "id", "left_semi")


def begin_run(run_id: str, command: str, subcommand: str, host: str) -> Column:
    return F.struct(F.lit(run_id).alias("id"), F.lit(command).alias("command"), F.lit(subcommand).alias("subcommand"), F.lit(host).alias("host"), F.current_timestamp().alias("started_at"), F.lit("running").alias("status"))


def finish_run(runs: DataFrame, run_id: str, status: str) -> DataFrame:
    mine = F.col("id") == run_id
    end = F.when(mine, F.current_timestamp()).otherwise(F.col("finished_at"))
    spent = F.when(mine, F.unix_millis(F.current_timestamp()) - F.unix_millis("started_at")).otherwise(F.col("duration_ms"))
    return runs.withColumns({"finished_at": end, "duration_ms": spent, "status": F.when(mine, status).otherwise(F.col("status"))})


def latest_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.distinct().orderBy(F.desc_nulls_last("started_at"), "id").limit(n)


def query_papers(papers: DataFrame, title: str | None = None, years: tuple[int, int] | None = None, citations: int | None = None, author: str | None = None, venue: str | None = None, keyword: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    """Stored papers by any of the conditions, most cited first."""
    out = papers
    for column, text in (("title", title), ("authors", author), ("venue_name", venue), ("keywords", keyword)):
        if text:
            out = out.filter(F.lower(column).contains(text.lower()))
    if years:
        out = out.filter(F.col("pub_year").between(*years))
    if citations is not None:
        out = out.filter(F.col("citation_count") >= citations)
    return out.orderBy(F.desc_nulls_last("citation_count"), "id").offset(skip).limit(limit)


def statistics(papers: DataFrame) -> DataFrame:
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return papers.agg(F.count("*").alias("papers"), has("normalized_doi").alias("with_doi"), has("abstract").alias("with_abstract"), has("pdf_url").alias("with_pdf"), F.min("pub_year").alias("first_year"), F.max("pub_year").alias("last_year"))


def by_source(papers: DataFrame) -> DataFrame:
    """Papers by source, out of a comma-separated list."""
    names = F.explode(F.filter(F.transform(F.split(F.coalesce("retrieved_from", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return papers.select(names.alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def most_cited(papers: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` most cited papers of each group, ties by id."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("citation_count"), "id")
    return papers.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")

"""Queries of the text-preparation problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import canonical, language, mixing, mojibake, packing, sentences, splitting, tokens
from loomsheet.llm.sampling import spread
from loomsheet.session import load


def paragraph_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, text) of all paragraphs of paragraph_audits and word_texts."""
    audits = load(spark, sf_dir, "paragraph_audits").select(F.concat(F.lit("a"), F.col("audit_id").cast("string")).alias("key"), "text")
    words = load(spark, sf_dir, "word_texts").select("word_id", F.posexplode("paragraphs").alias("position", "text"))
    return audits.unionByName(words.select(F.concat_ws(".", F.concat(F.lit("w"), F.col("word_id").cast("string")), F.col("position").cast("string")).alias("key"), "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paragraphs that print the same but are different strings."""
    return canonical.equal_looks(paragraph_items(spark, sf_dir))


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_table, rec_id, label, texts) of documents, word_texts (paragraphs) and paragraph_audits."""
    documents = load(spark, sf_dir, "documents").select(F.lit("documents").alias("rec_table"), F.col("doc_id").alias("rec_id"), F.col("lang").alias("label"), F.array("text").alias("texts"))
    words = load(spark, sf_dir, "word_texts").select(F.lit("word_texts").alias("rec_table"), F.col("word_id").alias("rec_id"), F.col("lang").alias("label"), F.col("paragraphs").alias("texts"))
    audits = load(spark, sf_dir, "paragraph_audits").select(F.lit("paragraph_audits").alias("rec_table"), F.col("audit_id").alias("rec_id"), F.col("lang").alias("label"), F.array("text").alias("texts"))
    return documents.unionByName(words).unionByName(audits)


def record_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language and segments of every record, with confidence."""
    models = language.fit(load(spark, sf_dir, "documents"), "doc_id")
    units = sentences.fit(load(spark, sf_dir, "word_texts"), "text", "word_id")
    return language.language_rows(spread(labelled_records(spark, sf_dir)), models, units)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a missing or wrong label (segment 0) and the segments of mixed rows."""
    rows = record_languages(spark, sf_dir)
    return rows.filter("segment_no > 0 or not label_right").select("rec_table", "rec_id", "segment_no", "lang").distinct()


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records and segments each language has, with the mean confidence, by table."""
    rows = record_languages(spark, sf_dir)
    kind = F.when(F.col("segment_no") == 0, "record").otherwise("segment").alias("kind")
    return rows.groupBy("rec_table", kind, "lang").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def sentence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word_id, field_name, item_no, text) of the texts and footnotes of word_texts, copies of a record once."""
    words = load(spark, sf_dir, "word_texts").select("word_id", "text", "footnotes")
    texts = words.select("word_id", F.lit("text").alias("field_name"), F.lit(0).alias("item_no"), "text")
    notes = words.select("word_id", F.lit("footnotes").alias("field_name"), F.posexplode("footnotes").alias("item_no", "text"))
    return texts.unionByName(notes).filter("text is not null")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of the texts and footnotes of word_texts."""
    model = sentences.fit(load(spark, sf_dir, "word_texts"), "text", "word_id")
    return sentences.unit_rows(spread(sentence_items(spark, sf_dir)), model).distinct()


PARAGRAPH_LIMIT, TEXT_LIMIT, OVERLAP = 1_000, 4_000, 100


def oversized_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the paragraphs and texts of word_texts above their limits; copies of a record give copies."""
    words = load(spark, sf_dir, "word_texts").select("word_id", "text", "paragraphs")
    model = sentences.fit(words, "text", "word_id")
    texts = words.select("word_id", F.lit("text").alias("field_name"), F.lit(0).alias("item_no"), "text", F.lit(TEXT_LIMIT).alias("size_limit"))
    paragraphs = words.select("word_id", F.lit("paragraphs").alias("field_name"), F.posexplode("paragraphs").alias("item_no", "text")).withColumn("size_limit", F.lit(PARAGRAPH_LIMIT))
    items = texts.unionByName(paragraphs).filter(F.char_length("text") > F.col("size_limit")).withColumn("overlap", F.lit(OVERLAP))
    return splitting.pieces(items, model)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items above their limit: those that come out in pieces."""
    return oversized_pieces(spark, sf_dir).select("word_id", "field_name", "item_no").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces with their places, each once."""
    return oversized_pieces(spark, sf_dir).dropDuplicates(["word_id", "field_name", "item_no", "piece_no", "piece_end"])


def sized_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return tokens.with_tokens(spread(load(spark, sf_dir, "documents").select("doc_id", *columns, "text")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document, or of each part of a document above the capacity."""
    return packing.pack(sized_documents(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their tokens and how full they are."""
    sums = p7_containers(spark, sf_dir).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return sums.agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count("*") * packing.CAPACITY), 6).alias("fill"),
    )


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: which document is used in which slot."""
    return mixing.mixture(sized_documents(spark, sf_dir, "source"), load(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by the sources in the mixture."""
    return mixing.reached(p8_mixture(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


def repaired_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return mojibake.repaired_rows(spread(documents.select("doc_id", "text")), language.fit_all(documents))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents decoded wrongly, whole or in places."""
    return repaired_documents(spark, sf_dir).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored texts of the documents found."""
    return repaired_documents(spark, sf_dir).distinct()


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_languages, p3_found, p4_found, p5_found, p5_pieces, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found, p9_restored)
}
SQL: dict[str, str] = {}

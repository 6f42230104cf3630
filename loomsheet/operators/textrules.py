"""Rules over text: keyword classes, references and citations, evidence checks, and a scanner for secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify(df: DataFrame, key: str, text: str, rules: dict[str, list[str]]) -> DataFrame:
    """(key, class, score) for every class: 100 times the share of its keywords found, rounded; and its rank."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    scores = []
    for name, words in rules.items():
        hits = sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))
        scores.append(F.struct(F.lit(name).alias("class"), F.round(hits * 100 / max(1, len(words))).cast("int").alias("score")))
    rows = df.select(key, F.explode(F.array(*scores)).alias("s")).select(key, "s.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "class")))


#: fixed values: headings that open a list of references
REFERENCE_HEADING = r"(?im)^\s*(?:\d+[.\s]*)?(?:references|bibliography|literature cited|参考文献)\s*:?\s*$"


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, entry) of numbered entries after the heading of the references; continued lines are joined."""
    block = F.element_at(F.split(F.col(text), REFERENCE_HEADING), -1)
    has = F.col(text).rlike(REFERENCE_HEADING)
    joined = F.regexp_replace(block, r"\n(?!\s*(?:\[\d+\]|\d+[.)]\s))", " ")
    lines = df.filter(has).select(key, F.explode(F.split(joined, "\n")).alias("line"))
    pattern = r"^\s*(?:\[(\d+)\]|(\d+)[.)])\s*(.+?)\s*$"
    number = F.coalesce(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")), F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")))
    return lines.filter(F.col("line").rlike(pattern)).select(key, number.cast("int").alias("number"), F.regexp_extract("line", pattern, 3).alias("entry"))


#: fixed values: forms of citations within text
CITATIONS = {
    "numeric": r"\[\d+(?:\s*[,–-]\s*\d+)*\]",
    "author_year": r"\([\p{Lu}][\p{L}’'-]+(?: et al\.| and [\p{Lu}][\p{L}’'-]+)?,? (?:19|20)\d{2}[a-z]?\)",
    "narrative": r"[\p{Lu}][\p{L}’'-]+(?: et al\.)? \((?:19|20)\d{2}[a-z]?\)",
    "cjk": r"[\p{IsHan}]{2,4} ?等?（(?:19|20)\d{2}）",
}


def citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, form, citation) of the citations within the lines of texts, lines from 1."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")).alias("line", "t"))
    found = F.array(*[F.struct(F.lit(n).alias("form"), F.regexp_extract_all("t", F.lit(f"({p})"), F.lit(1)).alias("all")) for n, p in CITATIONS.items()])
    flat = lines.select(key, (F.col("line") + 1).alias("line"), F.explode(found).alias("f")).select(key, "line", "f.form", F.explode("f.all").alias("citation"))
    return flat


def unmatched(cited: DataFrame, listed: DataFrame, most: int = 8) -> DataFrame:
    """(side, key, number): numbers a text cites but doesn't list, and lists but doesn't cite, the first ones of each text and side.

    ``cited`` has the key first, then ``number`` or the ends ``a`` and ``b`` of ranges.  Of a range no more is
    spelled out than its first ``most`` unlisted numbers can need.
    """
    key = cited.columns[0]
    spans = (cited.select(key, F.col("number").alias("a"), F.col("number").alias("b")) if "number" in cited.columns else cited.select(key, "a", "b")).distinct()
    entries = listed.select(key, "number").distinct()
    sizes = entries.groupBy(key).agg(F.count("*").alias("n"))
    last = F.least(F.col("b").cast("bigint"), F.col("a").cast("bigint") + F.coalesce("n", F.lit(0)) + most - 1)
    numbers = spans.join(sizes, key, "left").select(key, F.explode(F.sequence(F.col("a").cast("bigint"), last)).alias("number")).withColumn("number", F.col("number").cast("int")).distinct()
    within = entries.join(spans, key).filter("number between a and b").select(key, "number").distinct()
    both = numbers.join(entries, [key, "number"], "left_anti").select(F.lit("cited").alias("side"), key, "number").unionByName(entries.join(within, [key, "number"], "left_anti").select(F.lit("listed").alias("side"), key, "number"))
    w = Window.partitionBy("side", key).orderBy("number")
    return both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def cited_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, a, b) of numeric citations before the list of references: ends of ranges, equal for single numbers."""
    body = df.withColumn(text, F.get(F.split(F.col(text), REFERENCE_HEADING), F.lit(0)))
    groups = citations(body, key, text).filter("form = 'numeric'").select(key, F.explode(F.split(F.regexp_replace("citation", r"[\[\]\s]", ""), ",")).alias("part"))
    low = F.regexp_extract("part", r"^(\d+)", 1).try_cast("int")
    high = F.coalesce(F.nullif(F.regexp_extract("part", r"[–-](\d+)$", 1), F.lit("")).try_cast("int"), low)
    return groups.select(key, low.alias("a"), F.greatest(low, high).alias("b")).filter("a is not null")


def cited_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number) of numeric citations before the list of references, ranges of any length spelled out."""
    blocks = cited_spans(df, key, text).select(key, F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).select(key, "b", F.explode(F.sequence("a", "b", F.lit(1_000).cast("bigint"))).alias("a"))
    return blocks.select(key, F.explode(F.sequence("a", F.least("b", F.col("a") + 999))).alias("number")).withColumn("number", F.col("number").cast("int")).distinct()


#: checks of the chain of evidence: name -> any of these words
EVIDENCE = {
    "sample": ["sample", "specimen", "样品", "試料"], "replicates": ["replicate", "repeated", "重复", "くり返"], "control": ["control", "对照", "対照"], "method": ["method", "procedure", "方法", "方法"], "statistics": ["anova", "p <", "p 值", "significant"],
    "units": ["mg/l", "g/kg", "mmol", "%"], "figures": ["fig.", "figure", "图", "図"], "tables": ["tab.", "table", "表"], "references": ["et al", "参考文献", "文献"], "conclusion": ["conclu", "therefore", "结论", "結論"],
}


def evidence(df: DataFrame, key: str, text: str, checks: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, passed, failed, grade): checks of a chain of evidence, and a grade from A to E by those that fail."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    each = {n: F.coalesce(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: low.contains(w)), F.lit(False)) for n, words in (checks or EVIDENCE).items()}
    failed = sum(((~c).cast("int") for c in each.values()), F.lit(0))
    return df.select(key, (F.lit(len(each)) - failed).alias("passed"), failed.alias("failed"))


def grade(failed: Column, score: Column) -> Column:
    """A to E from the number of failed checks and the best class score."""
    return F.when((failed <= 2) & (score >= 50), "A").when(failed <= 4, "B").when(failed <= 7, "C").when(score >= 20, "D").otherwise("E")


#: rules of the scanner: name -> (severity, pattern)
SECRETS: dict[str, tuple[int, str]] = {
    "private_key": (4, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    "cloud_token": (4, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    "hub_token": (4, r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    "api_key": (3, r"(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d)\b\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}"),
    "web_token": (3, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "email": (2, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"),
    "home_path": (2, r"(?:/home/|/Users/|[A-Z]:\\Users\\)[A-Za-z0-9._-]+"),
    "unsafe_shell": (2, r"\brm\s+-rf\s+/|curl[^|\n]*\|\s*(?:ba)?sh\b|\beval\s*\("),
    "plain_http": (1, r"\bhttp://[^\s\"'<>]+"),
}


def scan(df: DataFrame, key: str, text: str, rules: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """(key, rule, severity, line, found): the most severe, then first, finding of each rule in each text."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")).alias("line", "t"))
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.regexp_extract("t", f"({p})", 1).alias("found")) for n, (s, p) in (rules or SECRETS).items()])
    found = lines.select(key, (F.col("line") + 1).alias("line"), F.explode(F.filter(hits, lambda h: h["found"] != "")).alias("h"))
    first = found.groupBy(key, "h.rule").agg(F.min_by(F.struct("h.severity", "line", "h.found"), F.struct(-F.col("h.severity"), "line")).alias("f"))
    return first.select(key, "rule", "f.severity", "f.line", "f.found")

"""Search over paper records: a Boolean and proximity language, merging, ranking.

A query is parsed on the driver and becomes one Column, so filters run where the data is.  Text is
compared lower-case, in compatibility form, with blanks collapsed; line breaks are kept as borders of
paragraphs, so that paragraph operators see them.
"""

from __future__ import annotations

from datetime import datetime, timezone

import re
import unicodedata
from dataclasses import dataclass, field
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsheet.operators.graph import components

#: fixed values: fields of the language and the record columns they read
FIELDS: dict[str, tuple[str, ...]] = {
    "SU": ("title", "title_zh", "abstract", "abstract_zh", "keywords", "keywords_zh", "concepts", "topics"),
    "TI": ("title", "title_zh"), "KY": ("keywords", "keywords_zh"), "AB": ("abstract", "abstract_zh"), "FT": ("full_text",), "AU": ("authors",), "FI": ("first_author",), "F": ("first_author",),
    "AF": ("affiliations",), "JN": ("journal", "venue_name", "venue"), "RF": ("references",), "YE": ("pub_year", "year"), "FU": ("funders",), "CLC": ("clc",), "SN": ("issn",), "CN": ("cn",), "IB": ("isbn",), "CF": ("citation_count",), "DOI": ("normalized_doi", "doi"),
}
PROXIMITY = ("NEAR", "PREV", "AFT", "SEN", "PRG")
_TOKEN = re.compile(r"""\s+|(?P<str>'[^']*'|"[^"]*")|(?P<prox>/(?:NEAR|PREV|AFT|SEN|PRG|SUB)\s*\d*)|(?P<freq>\$\s*\d+)|(?P<op>%=|[()+*\-=,%#])|(?P<word>[^\s()+*\-=,%#'"/$]+)""", re.I)


@dataclass
class Term:
    field: str
    text: str
    fuzzy: bool = False
    frequency: int = 1
    between: tuple[str, str] | None = None
    proximity: tuple[str, int, str] | None = None


@dataclass
class Bool:
    op: str
    args: list = field(default_factory=list)


class Query:
    """``OR``/``+`` binds least, then ``AND``/``*`` and ``NOT``/``-``; inside a field clause all bind alike, from the left."""

    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        place = 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise ValueError(f"unexpected {text[place]!r}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m.group()))
            place = m.end()
        self.at = 0
        self.tree = self._or("SU")
        if self.at < len(self.items):
            raise ValueError(f"unexpected {self.items[self.at][1]!r}")

    def _peek(self, ahead: int = 0) -> tuple[str, str]:
        at = self.at + ahead
        return self.items[at] if at < len(self.items) else ("end", "")

    def _next(self) -> tuple[str, str]:
        token = self._peek()
        self.at += 1
        return token

    def _is(self, *words: str) -> bool:
        kind, text = self._peek()
        return kind in ("op", "word") and text.upper() in words

    def _or(self, name: str):
        left = self._and(name)
        while self._is("+", "OR"):
            self._next()
            left = Bool("OR", [left, self._and(name)])
        return left

    def _and(self, name: str):
        left = self._not(name)
        while True:
            if self._is("*", "AND"):
                self._next()
                if self._is("NOT"):
                    self._next()
                    left = Bool("AND", [left, Bool("NOT", [self._not(name)])])
                else:
                    left = Bool("AND", [left, self._not(name)])
            elif self._is("-", "NOT"):
                self._next()
                left = Bool("AND", [left, Bool("NOT", [self._not(name)])])
            else:
                return left

    def _not(self, name: str):
        if self._is("NOT", "-"):
            self._next()
            return Bool("NOT", [self._not(name)])
        return self._primary(name)

    def _primary(self, name: str):
        kind, text = self._peek()
        if kind == "op" and text == "(":
            self._next()
            inner = self._or(name)
            if self._next()[1] != ")":
                raise ValueError("expected )")
            return inner
        if kind == "word" and text.upper() in FIELDS and (self._peek(1)[1] in ("=", "%=") or self._peek(1)[1].upper() in ("BETWEEN", "%")):
            return self._clause(text.upper())
        return self._term(name)

    def _clause(self, name: str):
        self._next()
        if self._peek()[1].upper() == "BETWEEN":
            self._next()
            self._expect("(")
            low = self._text()
            self._expect(",")
            high = self._text()
            self._expect(")")
            if name not in ("YE", "CF"):
                raise ValueError(f"BETWEEN needs a number field, not {name}")
            return Term(name, "", between=(low, high))
        fuzzy = self._next()[1] == "%="
        if self._peek()[1] == "(":
            return self._primary(name)
        left = self._term(name, fuzzy)
        while self._is("*", "+", "-") and not (self._peek(1)[0] == "word" and self._peek(1)[1].upper() in FIELDS and self._peek(2)[1] in ("=", "%=")):
            op = self._next()[1]
            right = self._term(name, fuzzy)
            left = Bool("OR", [left, right]) if op == "+" else Bool("AND", [left, Bool("NOT", [right]) if op == "-" else right])
        return left

    def _expect(self, text: str) -> None:
        if self._next()[1] != text:
            raise ValueError(f"expected {text}")

    def _text(self) -> str:
        kind, text = self._next()
        if kind not in ("str", "word"):
            raise ValueError(f"expected a term, found {text!r}")
        return text[1:-1] if kind == "str" else text

    def _term(self, name: str, fuzzy: bool = False) -> Term:
        if self._peek()[1] == "%":
            self._next()
            fuzzy = True
        text = self._text()
        if name not in FIELDS:
            raise ValueError(f"unknown field {name}")
        term = Term(name, text, fuzzy)
        inner = re.match(r"^(.*?)\s*([#%])\s*(.*)$", text)
        if inner and not fuzzy:
            term.text, term.proximity = inner[1], ("ORDERED" if inner[2] == "%" else "TOGETHER", 0, inner[3])
        if self._peek()[0] == "freq":
            term.frequency = int(re.sub(r"\D", "", self._next()[1]))
            if term.frequency < 1:
                raise ValueError("a frequency is at least 1")
        if self._peek()[0] == "prox":
            op, number = re.match(r"/([A-Z]+)\s*(\d*)", self._next()[1].upper()).groups()
            if op == "SUB":
                raise ValueError("/SUB has no meaning")
            term.proximity = (op, int(number or 0), self._text())
        return term


def terms(tree) -> list[Term]:
    return [tree] if isinstance(tree, Term) else [t for a in tree.args for t in terms(a)]


def normal(text: str) -> str:
    return re.sub(r"[^\S\n]+", " ", unicodedata.normalize("NFKC", text).lower()).strip()


@F.pandas_udf(T.StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """Compatibility form, lower case, blanks collapsed, line breaks kept; Arrow-batched, for there is no built-in."""
    return texts.map(lambda t: None if t is None else normal(t))


def field_text(df: DataFrame, name: str) -> Column:
    parts = []
    for c in FIELDS[name]:
        if c in df.columns:
            parts.append(F.array_join(F.col(c), " ") if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c).cast("string"))
    return F.concat_ws("\n", *parts) if parts else F.lit("")


def _number(df: DataFrame, name: str) -> Column:
    found = [c for c in FIELDS[name] if c in df.columns]
    return F.col(found[0]).cast("int") if found else F.lit(None).cast("int")


_CJK = "[\\u4e00-\\u9fff]"


def _places(words: Column, needle: str) -> Column:
    """Places of the first word of a phrase in an array of words."""
    parts = needle.split()
    hit = lambda i: F.forall(F.sequence(F.lit(0), F.lit(len(parts) - 1)), lambda k: F.contains(F.get(words, i + k), F.get(F.array(*map(F.lit, parts)), k)))
    return F.filter(F.transform(words, lambda w, i: F.when(hit(i), i)), lambda i: i.isNotNull())


def _proximity(text: Column, term: Term) -> Column:
    op, n, other = term.proximity
    a, b = normal(term.text), normal(other)
    size_a, size_b = len(a.split()), len(b.split())
    paragraphs = F.split(text, "\n+")
    sentences = lambda p: F.split(p, "(?<=[.!?。！？])\\s*")
    words = lambda s: F.filter(F.split(s, "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    flat = F.flatten(F.transform(paragraphs, sentences))

    def pair(s: Column, test) -> Column:
        w = words(s)
        return F.exists(_places(w, a), lambda i: F.exists(_places(w, b), lambda j: test(i, j)))

    if op == "NEAR":
        return F.exists(flat, lambda s: pair(s, lambda i, j: F.when(j > i, (j - i - size_a) < n).otherwise((i - j - size_b) < n)))
    if op == "PREV":
        return F.exists(flat, lambda s: pair(s, lambda i, j: (j > i) & ((j - i - size_a) < n)))
    if op == "AFT":
        return F.exists(flat, lambda s: pair(s, lambda i, j: (i > j) & ((i - j - size_b) > n)))
    if op == "TOGETHER":
        return F.exists(flat, lambda s: s.contains(a) & s.contains(b))
    if op == "ORDERED":
        return F.exists(flat, lambda s: pair(s, lambda i, j: j > i))

    def within(units: Column, low: int) -> Column:
        at = lambda needle: F.filter(F.transform(units, lambda u, i: F.when(u.contains(needle), i)), lambda i: i.isNotNull())
        return F.exists(at(a), lambda i: F.exists(at(b), lambda j: ((j - i) >= low) & ((j - i) <= n) if op == "SEN" else (i != j) & (F.abs(j - i) <= n)))

    if op == "SEN":
        return F.exists(paragraphs, lambda p: within(sentences(p), 0))
    return within(paragraphs, 1)


def condition(df: DataFrame, tree, recall: bool = False) -> Column:
    """The Column of a parsed query over a table made by ``with_normal_text``; ``recall`` keeps what can't be judged (no full text, other script)."""

    def text_of(name: str) -> Column:
        return F.col(f"_text_{name}")

    def term(t: Term) -> Column:
        if t.between:
            low, high = (int(re.sub(r"\D", "", x)) for x in t.between)
            return F.coalesce(_number(df, t.field).between(low, high), F.lit(False))
        if t.field == "YE":
            return F.coalesce(_number(df, "YE") == int(t.text), F.lit(False))
        if t.field == "CF":
            return F.coalesce(_number(df, "CF") >= int(t.text), F.lit(False))
        if t.field == "DOI":
            return F.coalesce(doi(field_text(df, "DOI")) == doi(F.lit(t.text)), F.lit(False))
        if t.field == "FT" and not any(c in df.columns for c in FIELDS["FT"]):
            return F.lit(recall)
        text, needle = text_of(t.field), normal(t.text)
        if t.frequency > 1:
            raw = F.lower(field_text(df, t.field))
            return F.regexp_count(raw, F.lit(re.escape(t.text.lower()))) >= t.frequency
        if t.proximity:
            return F.coalesce(_proximity(text, t), F.lit(False))
        hit = text.contains(needle)
        if t.fuzzy:
            hit = hit | F.lit(True if not needle.split() else False)
            every = F.lit(True)
            for w in needle.split():
                every = every & text.contains(w)
            letters = F.lit(True)
            for ch in set(needle.replace(" ", "")):
                letters = letters & text.contains(ch)
            hit = hit | every | letters
        if recall and re.search(r"[一-鿿]", needle):
            hit = hit | ~text.rlike(_CJK)
        return F.coalesce(hit, F.lit(False))

    def build(node) -> Column:
        if isinstance(node, Term):
            return term(node)
        if node.op == "NOT":
            return ~build(node.args[0])
        a, b = map(build, node.args)
        return a & b if node.op == "AND" else a | b

    return build(tree)


def doi(text: Column) -> Column:
    """A DOI without resolver, prefix, blanks and case."""
    return F.regexp_replace(F.lower(F.trim(text)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")


def with_normal_text(df: DataFrame, tree) -> DataFrame:
    """``df`` with the normal text of each field the query reads, computed once a row."""
    names = dict.fromkeys(t.field for t in terms(tree) if t.field not in ("YE", "CF", "DOI"))
    return df.withColumns({f"_text_{n}": normalized(field_text(df, n)) for n in names})


def search(df: DataFrame, query: str, recall: bool = False) -> DataFrame:
    tree = Query(query).tree
    return with_normal_text(df, tree).filter(condition(df, tree, recall)).select(*df.columns)


def search_with_fallback(df: DataFrame, query: str) -> tuple[DataFrame, str]:
    """Strict, then recall when strict finds nothing and there are candidates."""
    strict = search(df, query)
    if not strict.isEmpty() or df.isEmpty():
        return strict, "strict"
    return search(df, query, recall=True), "recall"


def plan(query: str, most: int = 20) -> tuple[list[str], bool]:
    """Rough queries for providers: the positive terms of the disjunctive normal form, sorted and cut off; and whether any was cut."""

    def forms(node) -> list[frozenset[str]]:
        if isinstance(node, Term):
            return [frozenset([node.text])] if node.text else [frozenset()]
        if node.op == "NOT":
            return [frozenset()]
        parts = [forms(a) for a in node.args]
        if node.op == "OR":
            return [f for p in parts for f in p]
        return [frozenset().union(*combo) for combo in product(*parts)]

    found = sorted({" ".join(sorted(f)) for f in forms(Query(query).tree) if f})
    return found[:most], len(found) > most


def filters_of(query: str) -> dict[str, object]:
    """Structured filters in the conjuncts of a query: years, citations, authors, venue and the like."""
    out: dict[str, object] = {}

    def walk(node) -> None:
        if isinstance(node, Bool):
            if node.op == "AND":
                for a in node.args:
                    walk(a)
            return
        if node.field == "YE":
            low, high = node.between or (node.text, node.text)
            out["years"] = (int(low), int(high))
        elif node.field == "CF":
            out["citations"] = int(node.between[0] if node.between else node.text)
        else:
            name = {"AU": "authors", "AF": "institutions", "TI": "title", "AB": "abstract", "JN": "venue"}.get(node.field)
            if name:
                out.setdefault(name, []).append(node.text)

    walk(Query(query).tree)
    return out


# --- merging -----------------------------------------------------------------------------------------


def _script(text: Column) -> Column:
    return F.when(text.rlike(_CJK), "cjk").otherwise("other")


def cluster(df: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with ``cluster``: the least id of records that are one paper.

    Equal DOIs join records, and so do equal year, title and first author in one script.  Records are
    linked to the least id of each of their two keys, so a key of any size adds one link a record, and
    links are closed over by connected components.
    """
    title = F.regexp_replace(normalized(F.coalesce(F.col("title"), F.lit(""))), r"[^\p{L}\p{N}]+", "")
    author = F.regexp_extract(F.lower(F.coalesce(F.col("authors"), F.lit(""))), r'^[\["\s]*([^,;"]*)', 1)
    d = doi(F.coalesce(F.col("normalized_doi"), F.lit("")))
    by_doi = F.when(d != "", F.concat(F.lit("d|"), d))
    by_name = F.when((title != "") & F.col("pub_year").isNotNull(), F.concat_ws("|", F.lit("t"), F.col("pub_year").cast("string"), title, F.trim(author), _script(F.coalesce(F.col("title"), F.lit("")))))
    keyed = df.select(F.col(key).alias("_id"), F.explode(F.filter(F.array(by_doi, by_name), lambda k: k.isNotNull())).alias("k"))
    heads = keyed.groupBy("k").agg(F.min("_id").alias("head"))
    edges = keyed.join(heads, "k").filter("_id <> head").select(F.col("head").alias("src"), F.col("_id").alias("dst")).distinct()
    found = components(edges)
    return df.join(found.select(F.col("vertex").alias(key), F.col("component").alias("_c")), key, "left").withColumn("cluster", F.coalesce("_c", key)).drop("_c")


def merge(df: DataFrame, key: str = "id", order: str = "imported_at") -> DataFrame:
    """One record a paper: the first non-blank of each text, the longest abstract, the most citations, lists united."""
    rows = cluster(df, key)

    def first(c: str) -> Column:
        return F.min_by(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.when(F.trim(F.col(c).cast("string")) != "", F.struct(order, key))).alias(c)

    plain = [c for c in ("normalized_doi", "title", "title_zh", "pub_year", "venue_name", "journal", "publisher", "authors", "pdf_url") if c in df.columns]
    longest = [F.max_by(c, F.struct(F.length(c), F.col(key))).alias(c) for c in ("abstract", "abstract_zh") if c in df.columns]
    return rows.groupBy("cluster").agg(
        F.count("*").alias("records"), *map(first, plain), *longest, F.max("citation_count").alias("citation_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.transform(F.split(F.coalesce("keywords", F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != ""))))).alias("keywords"),
    )


# --- ranking -----------------------------------------------------------------------------------------

#: fixed values: weights of coverage, field match, citations, recency and sources in the profiles
PROFILES = {
    "default": (0.45, 0.20, 0.15, 0.15, 0.05),
    "recent": (0.45, 0.20, 0.05, 0.25, 0.05),
    "classic": (0.35, 0.20, 0.35, 0.05, 0.05),
}


def rank(df: DataFrame, query: str, profile: str = "default", limit: int = 100, now: int | None = None) -> DataFrame:
    """Records with a ``score`` in 0 to 1, the best first: by score, citations, year, then title; ``now`` is this year if not given."""
    now = datetime.now(timezone.utc).year if now is None else now
    wanted = [normal(t.text) for t in terms(Query(query).tree) if t.text]
    everything = normalized(field_text(df, "SU"))
    coverage = sum((everything.contains(w).cast("double") for w in wanted), F.lit(0.0)) / len(wanted) if wanted else F.lit(1.0)
    fields = [normalized(field_text(df, f)) for f in ("TI", "KY", "AB", "AU", "JN")]
    matched = sum((F.greatest(*[f.contains(w).cast("double") for w in wanted], F.lit(0.0)) for f in fields), F.lit(0.0)) / 5
    cited = F.least(F.log10(F.coalesce(F.col("citation_count"), F.lit(0)) + 1) / 3, F.lit(1.0))
    recent = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (now - F.col("pub_year")) / 25)), F.lit(0.0))
    sources = F.least(F.size(F.filter(F.split(F.coalesce("retrieved_from", F.lit("")), "[,;]"), lambda x: F.trim(x) != "")) / 3, F.lit(1.0)) if "retrieved_from" in df.columns else F.lit(0.0)
    score = sum((w * F.coalesce(part, F.lit(0.0)) for w, part in zip(PROFILES[profile], (coverage, matched, cited, recent, sources), strict=True)), F.lit(0.0))
    scored = df.withColumn("score", F.round(score, 6))
    return scored.orderBy(F.desc("score"), F.desc_nulls_last("citation_count"), F.desc_nulls_last("pub_year"), F.asc("title"), F.asc("id")).limit(min(max(limit, 1), 500))

"""Visually identical text to one consistent form.

Each Arrow batch of texts is exploded to a flat array of positioned code points
(row and position are implicit in the offsets), joined with the mapping tables
broadcast to every worker (decomposition, full width, look-alikes, blanks,
characters without width), combining marks are ordered by class, sequences are
recomposed, and the strings are rebuilt.  Exploding inside the batch keeps code
points out of the shuffle, whose rows would outnumber the texts a hundredfold.

What prints alike is folded: blanks of one character, full-width forms, ligatures,
radicals, letters of other scripts with the same look, composed and decomposed
accents; characters without width go.  Case, accents, raised and lowered digits,
and the number of blanks stay.

Defined results: null stays null, "" and texts of invisible characters give "",
texts of any length are processed whole, and the form of a form is itself.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsheet.session import checkpoint

#: fixed values: letters of other scripts, and signs, that print like another character
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Armenian and Latin extensions
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ɡ": "g", "ɑ": "a",
    # signs
    "‐": "-", "‑": "-", "ʼ": "’", "‛": "’", "․": ".", "∶": ":",
}

#: fixed values: characters without width besides those of category Cf
NO_WIDTH = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
#: fixed values: format characters that do print
PRINTED_FORMATS = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}


def _fold(cp: int) -> str:
    """What a code point is replaced by, fully decomposed; the rule the tables are built from."""
    ch = chr(cp)
    category = unicodedata.category(ch)
    if (category == "Cf" and cp not in PRINTED_FORMATS) or any(a <= cp <= b for a, b in NO_WIDTH):
        return ""
    if category == "Zs":
        return " "
    parts = unicodedata.decomposition(ch)
    if parts.startswith("<"):
        tag, *codes = parts.split()
        text = "".join(chr(int(c, 16)) for c in codes)
        letters = all(unicodedata.category(c)[0] in "LM" for c in text)
        if tag == "<wide>" or (tag in ("<compat>", "<narrow>") and letters) or tag == "<noBreak>":
            return "".join(_fold(ord(c)) for c in text) if text != ch else text
    return "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", ch))


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, start, pool) of the folding, combining class, and (pair key, composite), sorted by key."""
    length = np.ones(sys.maxunicode + 1, np.uint8)
    start = np.full(sys.maxunicode + 1, -1, np.int32)
    classes = np.zeros(sys.maxunicode + 1, np.uint8)
    pool: list[int] = []
    pairs: dict[int, int] = {}
    for cp in (*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        classes[cp] = unicodedata.combining(ch)
        folded = _fold(cp)
        if folded != ch:
            length[cp], start[cp] = len(folded), len(pool)
            pool.extend(map(ord, folded))
        parts = unicodedata.decomposition(ch)
        if parts and parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in parts.split())
            pairs[a << 21 | b] = cp
    for lead in range(19):  # Hangul by rule: leading and vowel, then trailing consonant
        for vowel in range(21):
            lv = 0xAC00 + (lead * 21 + vowel) * 28
            pairs[(0x1100 + lead) << 21 | (0x1161 + vowel)] = lv
            for tail in range(1, 28):
                pairs[lv << 21 | (0x11A7 + tail)] = lv + tail
    keys = np.array(sorted(pairs), np.int64)
    return length, start, np.array(pool, np.int32), classes, keys, np.array([pairs[k] for k in keys.tolist()], np.int32)


def _recompose(cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, _, classes, keys, composites = tables()
    hangul = lambda x: (x >= 0x1161) & (x < 0x11C3)
    while len(cps) > 1:
        ccc = classes[cps]
        joins = (ccc > 0) | hangul(cps)
        if not joins.any():
            break
        index = np.arange(len(cps))
        first = np.ones(len(cps), bool)
        first[1:] = rows[1:] != rows[:-1]
        starter = np.maximum.accumulate(np.where((ccc == 0) | first, index, 0))
        at = np.flatnonzero(joins & ~first)
        base = starter[at]
        base = np.where(ccc[at] == 0, at - 1, base)  # a vowel or tail joins what stands before it
        free = (base == at - 1) | ((ccc[at - 1] < ccc[at]) & (ccc[at] > 0))
        free &= (ccc[base] == 0) & (rows[base] == rows[at])
        at, base = at[free], base[free]
        key = cps[base].astype(np.int64) << 21 | cps[at]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[place] == key
        at, base, place = at[hit], base[hit], place[hit]
        if not len(at):
            break
        base, once = np.unique(base, return_index=True)
        apart = np.ones(len(base), bool)  # of overlapping pairs the first is joined in this round
        apart[1:] = base[1:] > at[once][:-1]
        base, once = base[apart], once[apart]
        cps = cps.copy()
        cps[base] = composites[place[once]]
        keep = np.ones(len(cps), bool)
        keep[at[once]] = False
        cps, rows = cps[keep], rows[keep]
    return cps, rows


def canonical_batch(texts: list[str]) -> list[str]:
    """The consistent form of each text of a batch (no nulls)."""
    length, start, pool, classes, _, _ = tables()
    joined = "".join(texts)
    if not joined:
        return ["" for _ in texts]
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    mapped = start[cps] >= 0
    if mapped.any():
        counts = length[cps].astype(np.int64)
        source = np.repeat(np.arange(len(cps)), counts)
        within = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
        offset = start[cps[source]]
        out = cps[source]
        hit = offset >= 0
        out[hit] = pool[offset[hit] + within[hit]]
        cps, rows = out, rows[source]
    ccc = classes[cps]
    if (ccc > 0).any():
        disorder = (ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (rows[1:] == rows[:-1])
        if disorder.any():
            run = np.cumsum((ccc == 0) | np.concatenate(([True], rows[1:] != rows[:-1])))
            order = np.lexsort((ccc, run))
            cps, rows = cps[order], rows[order]
    cps, rows = _recompose(cps, rows)
    text = cps.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(np.bincount(rows, minlength=len(texts))).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def canonical_array(texts: pa.Array, block: int = 1_000_000) -> pa.Array:
    """``canonical_batch`` over an Arrow array, in blocks of about so many code points."""
    out: list[str | None] = []
    at: list[int] = []
    part: list[str] = []
    held = 0

    def flush() -> None:
        for i, value in zip(at, canonical_batch(part), strict=True):
            out[i] = value

    for text in texts.to_pylist():
        out.append(None)
        if text is None:
            continue
        at.append(len(out) - 1)
        part.append(text)
        held += len(text)
        if held >= block:
            flush()
            at, part, held = [], [], 0
    flush()
    return pa.array(out, pa.string())


def with_canonical(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` with the consistent form of column ``text`` beside it."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            made = canonical_array(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*arrays, made], names=[*names, out])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def marked_items(items: DataFrame) -> DataFrame:
    """(key, f1, f2, s1, s2): 128-bit digests of the consistent form and of the spelling of each item (key, text)."""
    whole = items.select("key", "text").filter("key is not null and text is not null")
    form, spelling = F.col("canonical"), F.col("text")
    return with_canonical(whole, "text").select(
        "key",
        F.xxhash64(form).alias("f1"),
        F.xxhash64(F.lit("form"), form).alias("f2"),
        F.xxhash64(spelling).alias("s1"),
        F.xxhash64(F.lit("spelling"), spelling).alias("s2"),
    )


def equal_looks(items: DataFrame) -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b by code point, of items (key, text) that print the same but differ.

    Only digests travel; they are computed once and kept in the shared checkpoint folder.  Forms with
    two or more spellings come from an aggregate with map-side combine.  Spellings are paired before
    items are, so copies of one spelling never meet each other, and items come in by equi-joins on
    (form, spelling), which adaptive execution splits where one is frequent.  Copies of an item
    (same key and text) count once; an item delivered with two texts can pair with itself: it doesn't.
    """
    form = ["f1", "f2"]
    marked = checkpoint(marked_items(items))
    several = marked.groupBy(*form).agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).filter("lo <> hi").select(*form)
    rows = marked.join(several, form, "left_semi").distinct()
    spellings = rows.select(*form, "s1", "s2").distinct()
    other = spellings.select(*form, F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    pairs = spellings.join(other, form).filter("s1 < t1 or (s1 = t1 and s2 < t2)")
    left = pairs.join(rows.withColumnRenamed("key", "k1"), [*form, "s1", "s2"])
    right = rows.select(*form, F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("key").alias("k2"))
    return left.join(right, [*form, "t1", "t2"]).filter("k1 <> k2").select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).distinct()

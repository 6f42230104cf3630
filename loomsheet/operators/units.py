"""Quantities in any unit to canonical units.

A value is read by a grammar (optional qualifier, number, unit expression), its
unit becomes an exponent vector over (length, character, line) with a scale and
an offset, and the canonical value is ``(number * scale + offset) * character^c *
line^l``.  A unit beside the value counts first, then the row's hint, then the
producer's note; otherwise the number already is in the common unit.

Defined results
  * null, empty or non-quantity text ("auto", "-"): no row;
  * a character needs the row's font size; where that isn't known: no row;
  * a unit that can't measure the field (a percentage of a font size): no row;
  * ties at .5 go away from zero; a character is as wide as the font size as it comes out, in whole
    half-points; decimal commas and full-width forms are read;
  * copies of a row give the same rows, which ``common_values`` reduces to one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWIPS_PER_POINT = 20.0
TWIPS_PER_INCH = 1440.0
TWIPS_PER_LINE = 240.0

#: fixed values: unit name -> (length exponent, character exponent, line exponent, scale to twips or to one, offset)
UNITS: dict[str, tuple[int, int, int, float, float]] = {
    "pt": (1, 0, 0, TWIPS_PER_POINT, 0.0),
    "cpt": (1, 0, 0, TWIPS_PER_POINT / 100, 0.0),
    "halfpt": (1, 0, 0, TWIPS_PER_POINT / 2, 0.0),
    "twip": (1, 0, 0, 1.0, 0.0),
    "mm": (1, 0, 0, TWIPS_PER_INCH / 25.4, 0.0),
    "cm": (1, 0, 0, TWIPS_PER_INCH / 2.54, 0.0),
    "in": (1, 0, 0, TWIPS_PER_INCH, 0.0),
    "px": (1, 0, 0, TWIPS_PER_INCH / 96, 0.0),
    "pica": (1, 0, 0, TWIPS_PER_POINT * 12, 0.0),
    "emu": (1, 0, 0, TWIPS_PER_INCH / 914400, 0.0),
    "char": (0, 1, 0, 1.0, 0.0),
    "line": (0, 0, 1, 1.0, 0.0),
    "percent": (0, 0, 1, 0.01, 0.0),
}

#: fixed values: how units are written (lower case, half-width)
SPELLINGS: dict[str, tuple[str, ...]] = {
    "pt": ("pt", "pts", "point", "points", "磅", "点", "punkt"),
    "twip": ("twip", "twips", "缇"),
    "mm": ("mm", "millimetre", "millimetres", "millimeter", "millimeters", "millimetern", "毫米", "公厘"),
    "cm": ("cm", "centimetre", "centimetres", "centimeter", "centimeters", "zentimeter", "厘米", "公分"),
    "in": ("in", "inch", "inches", "zoll", '"', "″", "英寸", "吋"),
    "px": ("px", "pixel", "pixels", "pixeln", "像素"),
    "pica": ("pc", "pica", "picas", "派卡"),
    "emu": ("emu", "emus"),
    "char": ("ch", "char", "chars", "character", "characters", "字", "字符", "个字符"),
    "line": ("line", "lines", "行", "x", "倍", "倍行距", "×"),
    "percent": ("%", "percent", "per cent"),
}

#: fixed values: named type sizes in points
NAMED_SIZES: dict[str, float] = {
    "初号": 42, "小初": 36, "一号": 26, "小一": 24, "二号": 22, "小二": 18, "三号": 16, "小三": 15,
    "四号": 14, "小四": 12, "五号": 10.5, "小五": 9, "六号": 7.5, "小六": 6.5, "七号": 5.5, "八号": 5,
}

#: fixed values: named line spacings in lines
NAMED_LINES: dict[str, float] = {"single": 1, "单倍行距": 1, "单倍": 1, "double": 2, "双倍行距": 2, "双倍": 2, "2倍行距": 2, "1.5倍行距": 1.5}

FIELDS = ("font_size", "first_line_indent", "line_spacing", "space_before")
#: field -> (common unit, units by which it can be measured)
COMMON = {"font_size": "halfpt", "first_line_indent": "twip", "line_spacing": "twip", "space_before": "twip"}
ALLOWED = {"font_size": (1, 0, 0), "first_line_indent": (1, 1, 0), "line_spacing": (1, 0, 1), "space_before": (1, 0, 1)}

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\u00a0"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "


def _literal_map(items: dict) -> Column:
    return F.create_map(*[x for k, v in items.items() for x in (F.lit(k), F.lit(v))])


# --- notes -----------------------------------------------------------------------------------------

#: fixed values: phrases that name a unit in a note, longest reading first
_NOTE_UNITS: tuple[tuple[str, str], ...] = (
    ("cpt", r"hundredths? of a point|百分之一磅"),
    ("halfpt", r"half[- ]points?|半磅"),
    ("twip", r"twentieths? of a point|twips?|缇"),
    ("percent", r"percent|per cent|percentage|百分比|prozent|%"),
    ("line", r"行数|multiples?|的倍数|倍数|number of lines|\blines\b"),
    ("char", r"字符数|字符|\bcharacters?\b|zeichen"),
    ("emu", r"\bemus?\b"),
    ("pica", r"\bpicas?\b|派卡"),
    ("px", r"pixeln?|pixels|像素"),
    ("mm", r"millimet(?:re|er)s?n?|\bmm\b|毫米"),
    ("cm", r"centimet(?:re|er)s?|zentimetern?|\bcm\b|厘米|公分"),
    ("in", r"\binch(?:es)?\b|\bzoll\b|英寸"),
    ("pt", r"\bpoints?\b|\bpt\b|磅|punkt"),
)
#: fixed values: phrases that name a field in a note
_NOTE_FIELDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    (r"字号|font sizes?|type sizes?|\bsizes?\b|schriftgr", ("font_size",)),
    (r"缩进|indents?\b|einzug", ("first_line_indent",)),
    (r"行距(?!的)|line (?:spacing|height)|zeilenabstand", ("line_spacing",)),
    (r"段前|space before|spacing before", ("space_before",)),
    (r"(?<!line )(?<!single )\bspacing\b(?! before)", ("line_spacing", "space_before")),
)


def parse_note(text: str | None) -> dict[str, str]:
    """Units by field that a note or hint states; empty when it states none.

    Clauses are parted by punctuation; a clause that names fields gives its unit to them, one that
    names none gives it to all fields not named elsewhere. ``except X, which is Y`` is read as X: Y.
    """
    if not text:
        return {}
    plain = re.sub(r"[(（][^)）]*[)）]", " ", text.lower())
    named: dict[str, str] = {}
    rest = None
    waiting: tuple[str, ...] = ()
    for clause in re.split(r"[,，;；。]|\.(?!\d)", plain):
        without = re.sub(r"单倍行距|(?:of )?single spacing", " ", clause)
        unit = next((u for u, pattern in _NOTE_UNITS if re.search(pattern, without)), None)
        fields = tuple(f for pattern, fs in _NOTE_FIELDS if re.search(pattern, without) for f in fs)
        if unit is None:
            waiting = fields or waiting
            continue
        if not fields and waiting:
            fields, waiting = waiting, ()
        if fields:
            named.update(dict.fromkeys(fields, unit))
        else:
            rest = unit
    if rest:
        for field in FIELDS:
            named.setdefault(field, rest)
    return named


@F.pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in FIELDS]))
def note_units(notes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Arrow-batched ``parse_note``; equal notes are parsed once per worker."""
    known: dict[str, dict[str, str]] = {}
    for batch in notes:
        rows = []
        for note in batch:
            key = note if isinstance(note, str) else ""
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                known[key] = parse_note(key)
            rows.append([known[key].get(f) for f in FIELDS])
        yield pd.DataFrame(rows, columns=list(FIELDS), dtype=object)


# --- values ----------------------------------------------------------------------------------------

_QUALIFIER = "固定值|最小值|多倍行距|exactly|at least|multiple|auto(?=\\s*\\d)"
_NUMBER = "[+-]?\\d+(?:[.,]\\d+)?|[+-]?[.,]\\d+"


def parse_quantity(raw: Column) -> Column:
    """struct(number, unit): unit is null for a bare number; number is null when the text is no quantity."""
    text = F.trim(F.lower(F.translate(raw, _FULL, _HALF)))
    pattern = f"^(?:({_QUALIFIER})\\s*)?({_NUMBER})\\s*([^\\d\\s].*?)?$"
    qualifier, number, spelled = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    spelling = _literal_map({s: u for u, names in SPELLINGS.items() for s in names})
    named_size = F.try_element_at(_literal_map(NAMED_SIZES | {k + "号": v for k, v in NAMED_SIZES.items() if not k.endswith("号")}), text)
    named_line = F.try_element_at(_literal_map(NAMED_LINES), text)
    value = F.expr("cast(null as double)")
    parsed = F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
    unit = F.when(spelled == "", F.when(qualifier.isin("多倍行距", "multiple"), F.lit("line"))).otherwise(F.try_element_at(spelling, spelled))
    known = (number != "") & ((spelled == "") | unit.isNotNull())
    return (
        F.when(named_size.isNotNull(), F.struct(named_size.cast("double").alias("number"), F.lit("pt").alias("unit")))
        .when(named_line.isNotNull(), F.struct(named_line.cast("double").alias("number"), F.lit("line").alias("unit")))
        .when(known, F.struct(parsed.alias("number"), unit.alias("unit")))
        .otherwise(F.struct(value.alias("number"), F.lit(None).cast("string").alias("unit")))
    )


def _component(unit: Column, index: int) -> Column:
    return F.try_element_at(_literal_map({u: float(v[index]) for u, v in UNITS.items()}), unit)


def to_common(number: Column, unit: Column, field: str, character_twips: Column) -> Column:
    """Canonical value of a number in a unit, or null when the unit can't measure the field."""
    length, char, line, scale, offset = (_component(unit, i) for i in range(5))
    may = ALLOWED[field]
    fits = (length <= may[0]) & (char <= may[1]) & (line <= may[2])
    twips = (number * scale + offset) * F.when(char == 0, F.lit(1.0)).otherwise(F.pow(character_twips, char)) * F.pow(F.lit(TWIPS_PER_LINE), line)
    return F.when(fits, twips / UNITS[COMMON[field]][3])


def _whole(value: Column) -> Column:
    """The nearest integer; noise of binary fractions makes no tie and breaks none."""
    return F.round(F.round(value, 6), 0)


def common_values(formats: DataFrame, sources: DataFrame) -> DataFrame:
    """(format_id, field_name, unit, common_value) for each value stated in another unit than the common one.

    ``sources`` (producer, note) is a small fixed table; Spark broadcasts it only below its own size limit.
    """
    notes = sources.groupBy("producer").agg(F.max("note").alias("note")).select("producer", note_units("note").alias("by_note"))
    rows = formats.select("format_id", "producer", note_units("hint").alias("by_hint"), *FIELDS).join(notes, "producer", "left")
    quantities = rows
    for f in FIELDS:
        quantities = quantities.withColumn(f"q_{f}", parse_quantity(F.col(f)))
    for f in FIELDS:
        stated = F.coalesce(F.col(f"q_{f}.unit"), F.col(f"by_hint.{f}"), F.col(f"by_note.{f}"))
        quantities = quantities.withColumn(f"u_{f}", F.coalesce(stated, F.lit(COMMON[f])))
    unknown = F.lit(None).cast("double")
    size = to_common(F.col("q_font_size.number"), F.col("u_font_size"), "font_size", unknown)
    quantities = quantities.withColumn("char_twips", _whole(size) * 10)
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field_name"),
                F.col(f"u_{f}").alias("unit"),
                _whole(to_common(F.col(f"q_{f}.number"), F.col(f"u_{f}"), f, F.col("char_twips"))).alias("value"),
            )
            for f in FIELDS
        ]
    )
    other = " or ".join(f"(x.field_name = '{f}' and x.unit <> '{u}')" for f, u in COMMON.items())
    return (
        quantities.select("format_id", F.explode(cells).alias("x"))
        .filter(F.expr(f"x.value is not null and ({other})"))
        .select("format_id", "x.field_name", "x.unit", F.col("x.value").try_cast("int").alias("common_value"))
        .filter("common_value is not null")
    )

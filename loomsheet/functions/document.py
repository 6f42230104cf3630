"""Scalar, sequence and aggregate functions of the document query language.

``call(name, args)`` builds the Column.  An argument is a ``Val``: a Column with its kind and its shape,
which is a scalar, a sequence held in an array column, or the source (one value per row of the input,
to be aggregated).  Casts that can't be done give null; aggregates of nothing give 0, not null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Val:
    """An expression: ``shape`` is scalar, seq or src; ``kind`` is the kind of the value or of an element."""

    col: Column
    kind: str = "unknown"
    shape: str = "scalar"
    dtype: T.DataType | None = None
    literal: object = None

    def seq(self) -> Column:
        """The value as an array; an array is the sequence of its items, another scalar one of itself."""
        return self.col if self.shape == "seq" or self.kind == "array" else F.array(self.col)


def kind_of(dtype: T.DataType | None) -> str:
    if dtype is None:
        return "unknown"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    names = {"integer": "int32", "short": "int32", "byte": "int32", "long": "int64", "double": "double", "float": "double", "string": "string", "boolean": "boolean", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime", "binary": "binary", "struct": "document", "map": "document", "array": "array", "void": "null", "variant": "variant"}
    return names.get(dtype.typeName(), "unknown")


NUMBERS = ("int32", "int64", "double", "decimal")
REGISTRY: dict[str, list[tuple[int, int, Callable]]] = {}


def register(names: str, least: int, most: int | None = None):
    def keep(build: Callable) -> Callable:
        for name in names.split():
            REGISTRY.setdefault(name, []).append((least, least if most is None else most, build))
        return build

    return keep


def call(name: str, args: list[Val]) -> Val:
    for least, most, build in REGISTRY.get(name.upper(), ()):
        if least <= len(args) <= most:
            return build(*args)
    raise ValueError(f"no function {name} of {len(args)} arguments")


def scalar(col: Column, kind: str) -> Val:
    return Val(col, kind)


def sequence(col: Column, kind: str = "unknown") -> Val:
    return Val(col, kind, "seq")


# --- aggregates ------------------------------------------------------------------------------------


@register("COUNT", 1)
def _count(v: Val) -> Val:
    return scalar(F.count(F.lit(1)) if v.shape == "src" else F.coalesce(F.size(v.seq()), F.lit(0)).cast("bigint"), "int64")


@register("MIN", 1)
def _min(v: Val) -> Val:
    return scalar(F.min(v.col) if v.shape == "src" else F.array_min(v.seq()), v.kind)


@register("MAX", 1)
def _max(v: Val) -> Val:
    return scalar(F.max(v.col) if v.shape == "src" else F.array_max(v.seq()), v.kind)


def _ordered(v: Val, pick: Callable) -> Val:
    return scalar(pick(v.col), v.kind)


@register("FIRST", 1)
def _first(v: Val) -> Val:
    return _ordered(v, F.first) if v.shape == "src" else scalar(F.try_element_at(v.seq(), F.lit(1)), v.kind)


@register("LAST", 1)
def _last(v: Val) -> Val:
    return _ordered(v, F.last) if v.shape == "src" else scalar(F.try_element_at(v.seq(), F.lit(-1)), v.kind)


def _numbers(v: Val) -> Column:
    return v.col if v.kind in NUMBERS else v.col.try_cast("double")


@register("SUM", 1)
def _sum(v: Val) -> Val:
    if v.shape == "src":
        return scalar(F.coalesce(F.sum(_numbers(v)), F.lit(0)), v.kind if v.kind in NUMBERS else "double")
    total = F.aggregate(v.seq(), F.lit(0.0), lambda a, x: a + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return scalar(total, "double")


@register("AVG", 1)
def _avg(v: Val) -> Val:
    if v.shape == "src":
        return scalar(F.coalesce(F.avg(_numbers(v)), F.lit(0.0)), "double")
    kept = F.filter(F.transform(v.seq(), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return scalar(F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)).otherwise(0.0), "double")


@register("ANY", 1)
def _any(v: Val) -> Val:
    return scalar(F.count(F.lit(1)) > 0 if v.shape == "src" else F.size(v.seq()) > 0, "boolean")


# --- types -----------------------------------------------------------------------------------------


@register("MINVALUE", 0)
def _minvalue() -> Val:
    return scalar(F.lit(None), "minvalue")


@register("MAXVALUE", 0)
def _maxvalue() -> Val:
    return scalar(F.lit(None), "maxvalue")


@register("OBJECTID", 0)
def _new_oid() -> Val:
    return scalar(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 24), "objectid")


@register("OBJECTID", 1)
def _oid(v: Val) -> Val:
    text = F.lower(v.col.cast("string"))
    return scalar(F.when(text.rlike("^[0-9a-f]{24}$"), text), "objectid")


@register("GUID", 0)
def _new_guid() -> Val:
    return scalar(F.expr("uuid()"), "guid")


@register("GUID", 1)
def _guid(v: Val) -> Val:
    text = F.lower(v.col.cast("string"))
    return scalar(F.when(text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), text), "guid")


@register("NOW", 0)
@register("NOW_UTC", 0)
def _now() -> Val:
    return scalar(F.current_timestamp(), "datetime")


@register("TODAY", 0)
def _today() -> Val:
    return scalar(F.current_date().cast("timestamp"), "datetime")


def _cast(names: str, kind: str, to: str) -> None:
    @register(names, 1)
    def build(v: Val) -> Val:
        return scalar(v.col.try_cast(to), kind)


_cast("INT32 INT", "int32", "int")
_cast("INT64 LONG", "int64", "bigint")
_cast("DOUBLE", "double", "double")
_cast("DECIMAL", "decimal", "decimal(38,18)")
_cast("BOOLEAN BOOL", "boolean", "boolean")


def _by_culture(text: Column, culture: str) -> Column:
    """Text of a number in a culture with decimal comma, or in the invariant one, as plain digits."""
    if culture[:2].lower() in ("de", "fr", "es", "pt", "it", "ru", "pl", "nl"):
        return F.replace(F.regexp_replace(text, r"[.\s  ]", ""), F.lit(","), F.lit("."))
    return F.regexp_replace(text, r"[,\s]", "")


def _cast_culture(name: str, kind: str, to: str) -> None:
    @register(name, 2)
    def build(v: Val, culture: Val) -> Val:
        return scalar(_by_culture(v.col.cast("string"), str(culture.literal or "")).try_cast(to), kind)


_cast_culture("DOUBLE", "double", "double")
_cast_culture("DECIMAL", "decimal", "decimal(38,18)")


@register("STRING", 1)
def _string(v: Val) -> Val:
    text = F.to_json(v.col) if v.kind in ("document", "array") else v.col.cast("string")
    return scalar(F.coalesce(text, F.lit("")), "string")


@register("ARRAY", 1)
def _array(v: Val) -> Val:
    return scalar(F.collect_list(v.col) if v.shape == "src" else v.seq(), "array")


@register("BINARY", 1)
def _binary(v: Val) -> Val:
    return scalar(F.try_to_binary(v.col, F.lit("base64")), "binary")


@register("DATETIME DATE", 1)
@register("DATETIME_UTC DATE_UTC", 1)
def _datetime(v: Val) -> Val:
    return scalar(v.col if v.kind == "datetime" else v.col.try_cast("timestamp"), "datetime")


@register("DATETIME DATE DATETIME_UTC DATE_UTC", 2)
def _datetime_culture(v: Val, culture: Val) -> Val:
    day_first = str(culture.literal or "")[:2].lower() not in ("", "en", "zh", "ja")
    pattern = "d.M.y" if str(culture.literal or "")[:2].lower() in ("de", "ru") else "d/M/y" if day_first else "M/d/y"
    parsed = F.try_to_timestamp(v.col.cast("string"), F.lit(pattern))
    return scalar(F.coalesce(parsed, v.col.try_cast("timestamp")), "datetime")


@register("DATETIME DATE DATETIME_UTC DATE_UTC", 3)
def _datetime_parts(y: Val, m: Val, d: Val) -> Val:
    text = F.format_string("%04d-%02d-%02d", y.col.cast("int"), m.col.cast("int"), d.col.cast("int"))
    return scalar(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "datetime")


def _is(names: str, test: Callable[[str], bool], variant: str | None = None) -> None:
    @register(names, 1)
    def build(v: Val) -> Val:
        if v.kind == "variant":
            return scalar(F.coalesce(F.schema_of_variant(v.col).rlike(variant), F.lit(False)) if variant else F.lit(False), "boolean")
        return scalar(v.col.isNotNull() if test(v.kind) else F.lit(False), "boolean")


@register("IS_NULL", 1)
def _is_null(v: Val) -> Val:
    return scalar(v.col.isNull(), "boolean")


_is("IS_INT32 IS_INT", lambda k: k == "int32", "^(INT|SMALLINT|TINYINT)$")
_is("IS_INT64 IS_LONG", lambda k: k == "int64", "^BIGINT$")
_is("IS_DOUBLE", lambda k: k == "double", "^(DOUBLE|FLOAT)$")
_is("IS_DECIMAL", lambda k: k == "decimal", "^DECIMAL")
_is("IS_NUMBER", lambda k: k in NUMBERS, "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
_is("IS_STRING", lambda k: k == "string", "^STRING$")
_is("IS_DOCUMENT", lambda k: k == "document", "^OBJECT")
_is("IS_ARRAY", lambda k: k == "array", "^ARRAY")
_is("IS_BINARY", lambda k: k == "binary", "^BINARY$")
_is("IS_OBJECTID", lambda k: k == "objectid")
_is("IS_GUID", lambda k: k == "guid")
_is("IS_BOOLEAN IS_BOOL", lambda k: k == "boolean", "^BOOLEAN$")
_is("IS_DATETIME IS_DATE", lambda k: k == "datetime", "^(TIMESTAMP|DATE)")


@register("IS_MINVALUE", 1)
def _is_min(v: Val) -> Val:
    return scalar(F.lit(v.kind == "minvalue"), "boolean")


@register("IS_MAXVALUE", 1)
def _is_max(v: Val) -> Val:
    return scalar(F.lit(v.kind == "maxvalue"), "boolean")


# --- dates -----------------------------------------------------------------------------------------


def _part(name: str, build: Callable[[Column], Column]) -> None:
    @register(name, 1)
    def make(v: Val) -> Val:
        return scalar(build(v.col), "int32")


for _name, _f in (("YEAR", F.year), ("MONTH", F.month), ("DAY", F.dayofmonth), ("HOUR", F.hour), ("MINUTE", F.minute), ("SECOND", F.second)):
    _part(_name, _f)


def _unit(v: Val) -> str:
    unit = str(v.literal)
    if unit in ("M", "month", "months"):
        return "MONTH"
    found = {"y": "YEAR", "d": "DAY", "h": "HOUR", "m": "MINUTE", "s": "SECOND"}.get(unit[:1].lower())
    if not found:
        raise ValueError(f"unknown interval {unit}")
    return found


@register("DATEADD", 3)
def _dateadd(unit: Val, number: Val, value: Val) -> Val:
    return scalar(F.timestamp_add(_unit(unit), number.col.cast("int"), value.col), "datetime")


@register("DATEDIFF", 3)
def _datediff(unit: Val, start: Val, end: Val) -> Val:
    return scalar(F.timestamp_diff(_unit(unit), start.col, end.col).cast("int"), "int32")


@register("TO_LOCAL", 1)
def _to_local(v: Val) -> Val:
    return scalar(F.from_utc_timestamp(v.col, F.current_timezone()), "datetime")


@register("TO_UTC", 1)
def _to_utc(v: Val) -> Val:
    return scalar(F.to_utc_timestamp(v.col, F.current_timezone()), "datetime")


# --- numbers ---------------------------------------------------------------------------------------


@register("ABS", 1)
def _abs(v: Val) -> Val:
    return scalar(F.abs(_numbers(v)), v.kind)


@register("ROUND", 2)
def _round(v: Val, digits: Val) -> Val:
    """Half to even; whole numbers stay."""
    return v if v.kind in ("int32", "int64") else scalar(F.bround(_numbers(v), int(digits.literal or 0)), v.kind)


@register("POW", 2)
def _pow(x: Val, y: Val) -> Val:
    return scalar(F.pow(_numbers(x), _numbers(y)), "double")


@register("RANDOM", 0)
def _random() -> Val:
    return scalar(F.floor(F.rand() * 2147483647).cast("int"), "int32")


@register("RANDOM", 2)
def _random_in(low: Val, high: Val) -> Val:
    return scalar((F.floor(F.rand() * (high.col - low.col)) + low.col).cast("int"), "int32")


# --- documents and sequences -----------------------------------------------------------------------


@register("JSON", 1)
def _json(v: Val) -> Val:
    return scalar(F.try_parse_json(v.col), "variant")


@register("EXTEND", 2)
def _extend(a: Val, b: Val) -> Val:
    """Shallow merge, the right side wins; for structs of known schema."""
    left, right = _fields(a), _fields(b)
    if left is None or right is None:
        return scalar(F.map_concat(a.col, b.col), "document")
    merged = left | right
    known = all(v.dtype is not None for v in merged.values())
    dtype = T.StructType([T.StructField(n, v.dtype) for n, v in merged.items()]) if known else None
    return Val(F.struct(*[v.col.alias(n) for n, v in merged.items()]), "document", dtype=dtype, literal=list(merged.items()))


def _fields(v: Val) -> dict[str, Val] | None:
    """The fields of a struct of known schema or of a document written out; None for other documents."""
    if isinstance(v.dtype, T.StructType):
        return {f.name: Val(v.col.getField(f.name), kind_of(f.dataType), dtype=f.dataType) for f in v.dtype.fields}
    if v.kind == "document" and isinstance(v.literal, list):
        return dict(v.literal)
    return None


@register("ITEMS", 1)
def _items(v: Val) -> Val:
    return replace(v, shape="seq", col=v.col if v.kind == "array" or v.shape == "seq" else F.array(v.col))


@register("CONCAT", 2)
def _concat(a: Val, b: Val) -> Val:
    return sequence(F.concat(a.seq(), b.seq()), a.kind)


@register("KEYS", 1)
def _keys(v: Val) -> Val:
    fields = _fields(v)
    if fields is not None:
        return sequence(F.array(*map(F.lit, fields)), "string")
    return sequence(F.json_object_keys(v.col.cast("string")) if v.kind in ("variant", "string") else F.map_keys(v.col), "string")


@register("VALUES", 1)
def _values(v: Val) -> Val:
    fields = _fields(v)
    if fields is not None:
        return sequence(F.array(*[f.col.cast("string") for f in fields.values()]), "string")
    return sequence(F.map_values(v.col))


@register("OID_CREATIONTIME", 1)
def _oid_time(v: Val) -> Val:
    return scalar(F.timestamp_seconds(F.conv(F.substring(v.col, 1, 8), 16, 10).cast("bigint")), "datetime")


@register("IIF", 3)
def _iif(test: Val, yes: Val, no: Val) -> Val:
    return scalar(F.when(test.col, yes.col).otherwise(no.col), yes.kind)


@register("COALESCE", 2)
def _coalesce(a: Val, b: Val) -> Val:
    return scalar(F.coalesce(a.col, b.col), a.kind)


@register("LENGTH", 1)
def _length(v: Val) -> Val:
    if isinstance(v.dtype, T.StructType):
        return scalar(F.lit(len(v.dtype.fields)), "int32")
    return scalar(F.coalesce(F.size(v.col) if v.kind in ("array", "document") or v.shape == "seq" else F.length(v.col), F.lit(0)), "int32")


@register("TOP", 2)
def _top(v: Val, n: Val) -> Val:
    return sequence(F.slice(v.seq(), 1, F.greatest(n.col.cast("int"), F.lit(0))), v.kind)


@register("UNION", 2)
def _union(a: Val, b: Val) -> Val:
    return sequence(F.array_union(a.seq(), b.seq()), a.kind)


@register("EXCEPT", 2)
def _except(a: Val, b: Val) -> Val:
    return sequence(F.array_except(a.seq(), b.seq()), a.kind)


@register("DISTINCT", 1)
def _distinct(v: Val) -> Val:
    return sequence(F.collect_set(v.col) if v.shape == "src" else F.array_distinct(v.seq()), v.kind)


# --- text ------------------------------------------------------------------------------------------


def _text(name: str, build: Callable[[Column], Column]) -> None:
    @register(name, 1)
    def make(v: Val) -> Val:
        return scalar(build(v.col) if v.kind in ("string", "unknown", "objectid", "guid") else F.lit(None).cast("string"), "string")


for _name, _f in (("LOWER", F.lower), ("UPPER", F.upper), ("LTRIM", F.ltrim), ("RTRIM", F.rtrim), ("TRIM", F.trim)):
    _text(_name, _f)


@register("INDEXOF", 2, 3)
def _indexof(v: Val, search: Val, start: Val | None = None) -> Val:
    return scalar(F.locate_at(v.col, search.col, start.col) if hasattr(F, "locate_at") and start else F.call_function("locate", search.col, v.col, (start.col if start else F.lit(0)) + 1) - 1, "int32")


@register("SUBSTRING", 2)
def _substring(v: Val, start: Val) -> Val:
    return scalar(F.substring(v.col, start.col + 1, F.lit(2147483647)), "string")


@register("SUBSTRING", 3)
def _substring_n(v: Val, start: Val, n: Val) -> Val:
    return scalar(F.substring(v.col, start.col + 1, n.col), "string")


@register("REPLACE", 3)
def _replace(v: Val, old: Val, new: Val) -> Val:
    return scalar(F.replace(v.col, old.col, new.col), "string")


def _pad(name: str, build: Callable) -> None:
    @register(name, 3)
    def make(v: Val, width: Val, pad: Val) -> Val:
        wide, first = width.col.cast("int"), F.substring(pad.col, 1, 1)
        return scalar(F.when(F.length(v.col) < wide, build(v.col, wide, first)).otherwise(v.col), "string")


_pad("LPAD", F.lpad)
_pad("RPAD", F.rpad)


@register("SPLIT", 2)
def _split(v: Val, separator: Val) -> Val:
    quoted = F.concat(F.lit("\\Q"), separator.col, F.lit("\\E"))
    return sequence(F.filter(F.split(v.col, quoted), lambda x: x != ""), "string")


@register("SPLIT", 3)
def _split_regex(v: Val, pattern: Val, regex: Val) -> Val:
    return sequence(F.split(v.col, pattern.col), "string") if regex.literal else _split(v, pattern)


@register("FORMAT", 2)
def _format(v: Val, fmt: Val) -> Val:
    """Composite formats for dates and numbers: y M d H m s patterns, N digits, F digits, D width, 0."""
    text = str(fmt.literal)
    if v.kind == "datetime":
        return scalar(F.date_format(v.col, text.replace("tt", "a").replace("fff", "SSS")), "string")
    if text[:1] in "Nn" and text[1:].isdigit():
        return scalar(F.format_number(v.col, int(text[1:])), "string")
    if text[:1] in "Ff" and text[1:].isdigit():
        return scalar(F.format_string(f"%.{int(text[1:])}f", v.col.cast("double")), "string")
    if text[:1] in "Dd" and text[1:].isdigit():
        return scalar(F.format_string(f"%0{int(text[1:])}d", v.col.cast("bigint")), "string")
    digits = len(text.partition(".")[2])
    return scalar(F.format_string(f"%{'0' + str(len(text)) if text.startswith('0') and len(text) > 1 else ''}.{digits}f", v.col.cast("double")), "string")


@register("JOIN", 1, 2)
def _join(v: Val, separator: Val | None = None) -> Val:
    items = F.collect_list(v.col) if v.shape == "src" else v.seq()
    return scalar(F.array_join(F.transform(items, lambda x: x.cast("string")), str(separator.literal) if separator else ""), "string")


@register("IS_MATCH", 2)
def _is_match(v: Val, pattern: Val) -> Val:
    return scalar(F.coalesce(F.rlike(v.col, pattern.col), F.lit(False)) if v.kind in ("string", "unknown") else F.lit(False), "boolean")


@register("MATCH", 3)
def _match(v: Val, pattern: Val, group: Val) -> Val:
    """A capture by number or name; null when nothing matches."""
    number = group.literal
    text = str(pattern.literal)
    if isinstance(number, str):
        import re

        text = text.replace("(?<", "(?P<") if "(?<=" not in text and "(?<!" not in text else text
        number = re.compile(text).groupindex[number]
    return scalar(F.when(F.rlike(v.col, pattern.col), F.regexp_extract(v.col, str(pattern.literal), int(number))), "string")

"""Value semantics of the document model: total order with nulls first, cross-type rank, two collations.

Comparisons always give true or false.  Equality, IN, BETWEEN and LIKE ignore case on text; the order
operators compare text by code point.  Null equals null and is less than everything else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: rank of the kinds of values in the order across types
RANK = {"null": 1, "number": 2, "string": 6, "document": 7, "array": 8, "binary": 9, "objectid": 10, "guid": 11, "boolean": 12, "datetime": 13}


def equal(a: Column, b: Column, text: bool = False) -> Column:
    return F.lower(a).eqNullSafe(F.lower(b)) if text else a.eqNullSafe(b)


def not_equal(a: Column, b: Column, text: bool = False) -> Column:
    return ~equal(a, b, text)


def greater(a: Column, b: Column) -> Column:
    return F.coalesce(a > b, b.isNull() & a.isNotNull())


def less(a: Column, b: Column) -> Column:
    return greater(b, a)


def greater_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a >= b, b.isNull())


def less_equal(a: Column, b: Column) -> Column:
    return greater_equal(b, a)


def between(a: Column, low: Column, high: Column, text: bool = False) -> Column:
    if text:
        a, low, high = F.lower(a), F.lower(low), F.lower(high)
    return greater_equal(a, low) & less_equal(a, high)


def like(a: Column, pattern: Column) -> Column:
    """``%`` and ``_`` without escape, ignoring case; a value that isn't text doesn't match."""
    plain = F.replace(F.lower(pattern), F.lit("\\"), F.lit("\\\\"))
    return F.coalesce(F.call_function("like", F.lower(a), plain), F.lit(False))


def variant_rank(v: Column) -> Column:
    """Rank of the kind of a VARIANT value; null and missing are 1."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (kind == "VOID"), RANK["null"])
        .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), RANK["number"])
        .when(kind == "STRING", RANK["string"])
        .when(kind.startswith("OBJECT"), RANK["document"])
        .when(kind.startswith("ARRAY"), RANK["array"])
        .when(kind == "BINARY", RANK["binary"])
        .when(kind == "BOOLEAN", RANK["boolean"])
        .otherwise(RANK["datetime"])
    )


def variant_key(v: Column) -> Column:
    """Sortable key of a VARIANT, which itself can't be ordered: rank, then the value within its kind."""
    return F.struct(
        variant_rank(v).alias("rank"),
        F.try_variant_get(v, "$", "double").alias("number"),
        F.when(variant_rank(v).isin(RANK["string"], RANK["document"], RANK["array"]), F.try_variant_get(v, "$", "string")).alias("text"),
        F.when(variant_rank(v) == RANK["boolean"], F.try_variant_get(v, "$", "boolean")).alias("truth"),
    )

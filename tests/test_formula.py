import datetime
import math

import pytest
from pyspark.sql import functions as F

from loomsheet.functions.formula import ERRORS, FUNCTIONS, cell, criteria, formula


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, name, *args):
    return one.select(formula(name, *args).alias("v")).first().v


def day(y, m, d):
    return datetime.date(y, m, d)


def test_all_registered():
    assert len(FUNCTIONS) == 186


@pytest.mark.parametrize(
    "name, args, expected",
    [
        ("ATAN2", (1, 1), math.pi / 4), ("ATAN2", (0, 0), None), ("ACOT", (-1,), 3 * math.pi / 4), ("CEILING", (2.5, 0), 0), ("CEILING", (2.5, -1), None), ("CEILING", (-2.5, 1), -2), ("FLOOR", (2.5, 0), None), ("FLOOR", (0, 0), 0),
        ("CEILING.MATH", (-5.5, 2, 1), -6), ("CEILING.MATH", (-5.5, 2), -4), ("FLOOR.MATH", (-5.5, 2, 1), -4), ("FLOOR.MATH", (-5.5, 2), -6), ("EVEN", (-2.5,), -2), ("ODD", (-1.5,), -1), ("EVEN", (1.2,), 2), ("ODD", (2,), 3),
        ("FACT", (-1,), None), ("FACT", (171,), None), ("FACT", (5.9,), 120), ("FACTDOUBLE", (7,), 105), ("POWER", (0, 0), None), ("POWER", (-8, 1 / 3), None), ("LOG", (8, 2), 3), ("LOG", (8, 1), None), ("LN", (0,), None), ("MROUND", (2.5, 1), 3), ("MROUND", (5, -2), None),
        ("MOD", (-3, 2), 1), ("MOD", (3, 0), None), ("QUOTIENT", (-7, 2), -3), ("ROUND", (2.5, 0), 3), ("ROUND", (-2.5, 0), -3), ("ROUNDUP", (2.1, 0), 3), ("ROUNDDOWN", (-2.9, 0), -2), ("TRUNC", (-2.987, 2), -2.98), ("COMBIN", (5, 2), 10), ("COMBINA", (4, 3), 20),
        ("MULTINOMIAL", (2, 3, 4), 1260), ("GCD", (24, 36, 60), 12), ("LCM", (4, 6), 12), ("LCM", (4, 0), 0), ("GCD", (-1, 2), None), ("BASE", (255, 16, 4), "00FF"), ("DECIMAL", ("ff", 16), 255), ("ROMAN", (1994,), "MCMXCIV"), ("ROMAN", (4000,), None), ("ARABIC", ("MCMXCIV",), 1994), ("ARABIC", ("-IV",), -4),
        ("BINOMDIST", (2, 4, 0.5, False), 0.375), ("BINOMDIST", (2, 4, 0.5, True), 0.6875), ("BINOMDIST", (5, 4, 0.5, True), None), ("FISHER", (0.5,), math.atanh(0.5)), ("PI", (), math.pi), ("SQRT", (-1,), None), ("SIGN", (-3,), -1), ("CSC", (0,), None),
        ("FV", (0, 10, -100), 1000), ("PMT", (0.1, 2, 100), -57.61904761904762), ("IPMT", (0.1, 1, 3, 8000), -800), ("IPMT", (0.1, 9, 3, 8000), None), ("TIME", (12, 0, 0), 0.5), ("TIME", (-1, 0, 0), None), ("TIMEVALUE", ("06:00",), 0.25), ("NUMBERVALUE", ("1.234,5%", ",", "."), 12.345), ("VALUE", ("50%",), 0.5), ("VALUE", ("",), 0), ("VALUE", ("x",), None),
    ],
)
def test_numbers(one, name, args, expected):
    got = value(one, name, *args)
    assert got is None if expected is None else got == pytest.approx(expected) if not isinstance(expected, str) else got == expected


@pytest.mark.parametrize(
    "name, args, expected",
    [
        ("MID", ("abc", 3, 1), ""), ("MID", ("abc", 0, 1), None), ("MID", ("abcd", 2, 2), "bc"), ("LEFT", ("a😀b", 2), "a😀"), ("RIGHT", ("abc", 0), ""), ("RIGHT", ("a😀", 1), "😀"), ("LEN", ("a😀",), 3), ("CLEAN", ("a\x07b\x85c",), "abc"), ("FIND", ("B", "abB"), 3), ("FIND", ("x", "abc"), None),
        ("SEARCH", ("b?d", "xABCD"), 3), ("SEARCH", ("z", "abc"), None), ("SUBSTITUTE", ("aaa", "aa", "b", 2), "ab"), ("SUBSTITUTE", ("abab", "b", "x", 2), "abax"), ("SUBSTITUTE", ("abc", "z", "x", 1), "abc"), ("REPT", ("ab", 20000), None), ("PROPER", ("o'neil 2nd x",), "O'Neil 2Nd X"), ("TRIM", ("  a   b ",), "a b"),
        ("ASC", ("ＡＢ\u3000１",), "AB 1"), ("CHAR", (128,), "€"), ("CODE", ("€",), 128), ("CHAR", (65,), "A"), ("CHAR", (300,), None), ("EXACT", ("a", "A"), False), ("DOLLAR", (-1234.5,), "($1,234.50)"), ("FIXED", (1234.567, 1, False), "1,234.6"), ("REPLACE", ("abcdef", 2, 3, "X"), "aXef"), ("TEXTJOIN", (",", True, "a", "", "b"), "a,b"), ("TEXTJOIN", (",", False, "a", "", "b"), "a,,b"),
        ("TEXT", (1234.5, "#,##0.00"), "1,234.50"), ("TEXT", (0.256, "0%"), "26%"), ("TEXT", (7, "000"), "007"), ("HYPERLINK", ("u", "label"), "label"), ("COLUMN", ("AB12",), 28), ("COLUMNS", ("B2:D9",), 3), ("ROWS", ("B2:D9",), 8), ("ROW", ("B7",), 7), ("ISREF", ("A1:B2",), True), ("ISREF", ("x",), False),
    ],
)
def test_texts(one, name, args, expected):
    assert value(one, name, *args) == expected


@pytest.mark.parametrize(
    "name, args, expected",
    [
        ("DATE", (2024, 14, 1), day(2025, 2, 1)), ("DATE", (2024, 3, 0), day(2024, 2, 29)), ("EDATE", (day(2024, 1, 31), 1), day(2024, 2, 29)), ("EOMONTH", (day(2024, 1, 5), 1), day(2024, 2, 29)), ("DAYS360", (day(2024, 1, 31), day(2024, 3, 31)), 60), ("DAYS360", (day(2024, 2, 29), day(2024, 3, 31), True), 31),
        ("NETWORKDAYS", (day(2024, 1, 1), day(2024, 1, 14)), 10), ("NETWORKDAYS", (day(2024, 1, 14), day(2024, 1, 1)), -10), ("NETWORKDAYS", (day(2024, 1, 6), day(2024, 1, 7)), 0), ("WORKDAY", (day(2024, 1, 6), 0), day(2024, 1, 6)), ("WORKDAY", (day(2024, 1, 5), 1), day(2024, 1, 8)), ("WORKDAY", (day(2024, 1, 8), -1), day(2024, 1, 5)),
        ("DATEDIF", (day(2020, 2, 29), day(2024, 2, 28), "Y"), 3), ("DATEDIF", (day(2024, 1, 31), day(2024, 3, 1), "M"), 1), ("WEEKDAY", (day(2024, 1, 7),), 1), ("WEEKDAY", (day(2024, 1, 7), 2), 7), ("WEEKDAY", (day(2024, 1, 7), 3), 6), ("WEEKNUM", (day(2024, 1, 7),), 2), ("WEEKNUM", (day(2024, 1, 7), 2), 1), ("ISOWEEKNUM", (day(2021, 1, 3),), 53),
        ("YEARFRAC", (day(2024, 1, 1), day(2024, 7, 1), 0), 0.5), ("YEARFRAC", (day(2024, 7, 1), day(2024, 1, 1), 3), 182 / 365), ("DATEVALUE", ("1900-01-01",), 2), ("DAYS", (day(2024, 3, 1), day(2024, 2, 1)), 29),
    ],
)
def test_dates(one, name, args, expected):
    got = value(one, name, *args)
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def test_workdays_against_counting(one):
    holidays = F.array(F.lit(day(2024, 1, 1)), F.lit(day(2024, 1, 6)), F.lit(day(2024, 1, 1)))
    assert value(one, "NETWORKDAYS", day(2024, 1, 1), day(2024, 1, 14), holidays) == 9
    assert value(one, "WORKDAY", day(2023, 12, 29), 1, holidays) == day(2024, 1, 2)
    rows = one.select(*[formula("NETWORKDAYS", day(2024, 1, a), day(2024, 2, b)).alias(f"c{a}_{b}") for a in range(1, 9) for b in range(1, 9)]).first()
    for a in range(1, 9):
        for b in range(1, 9):
            expected = sum((day(2024, 1, a) + datetime.timedelta(i)).weekday() < 5 for i in range((day(2024, 2, b) - day(2024, 1, a)).days + 1))
            assert rows[f"c{a}_{b}"] == expected


def test_aggregates_of_nothing_and_mixed(spark):
    df = spark.createDataFrame([("1",), ("x",), ("true",), (None,), ("",)], "v string")
    names = ["SUM", "PRODUCT", "AVERAGE", "AVERAGEA", "COUNT", "COUNTA", "COUNTBLANK", "MAX", "MAXA", "MIN", "MINA", "STDEV", "MEDIAN", "GEOMEAN"]
    made = [formula(n, F.col("v")).alias(n) for n in names]
    row = df.agg(*made).first()
    assert [row[n] for n in names] == [1, 1, 1, 0.5, 1, 4, 2, 1, 1, 1, 0, None, 1, pytest.approx(1)]
    empty = df.limit(0).agg(*made).first()
    assert (empty.SUM, empty.PRODUCT, empty.AVERAGE, empty.COUNT, empty.MAX, empty.MIN, empty.MEDIAN) == (0, 0, None, 0, 0, 0, None)


def test_criteria(spark):
    df = spark.createDataFrame([("a*",), ("abc",), ("",), (None,), ("5",), ("6",)], "v string")

    def hits(c):
        return [r.v for r in df.filter(criteria(F.col("v"), c)).collect()]

    assert hits("a*") == ["a*", "abc"] and hits("a~*") == ["a*"] and hits("A?c") == ["abc"] and hits(">5") == ["6"] and hits("5") == ["5"] and hits("<>5") == ["a*", "abc", "", None, "6"] and hits("") == ["", None] and hits("=") == [None]


def test_cells(one):
    row = one.select(*[formula(n, cell(F.lit("t"), "text")).alias(n) for n in ("ISTEXT", "ISNUMBER", "ISNONTEXT", "ISBLANK", "TYPE", "T", "N")]).first()
    assert tuple(row) == (True, False, False, False, 2, "t", 0.0)
    for error, number in ERRORS.items():
        r = one.select(formula("ERROR.TYPE", cell(None, "number", error)).alias("t"), formula("ISERR", cell(None, "number", error)).alias("e"), formula("ISNA", cell(None, "number", error)).alias("n")).first()
        assert (r.t, r.e, r.n) == (number, error != "#N/A", error == "#N/A")


def test_matrices_and_lookups(one):
    m = F.array(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(3.0)))
    assert value(one, "MDETERM", m) == pytest.approx(6)
    assert value(one, "MMULT", m, m) == [[4, 0], [5, 9]] and value(one, "TRANSPOSE", m) == [[2, 1], [0, 3]]
    assert value(one, "MINVERSE", m)[0] == pytest.approx([0.5, 0])
    xs = F.array(*map(F.lit, (1.0, 2.0, 2.0, 4.0)))
    assert value(one, "MATCH", 3.0, xs) == 3 and value(one, "MATCH", 2.0, xs, 0) == 2 and value(one, "MATCH", 0.5, xs) is None
    assert value(one, "LARGE", xs, 2) == 2 and value(one, "LARGE", xs, 9) is None and value(one, "INDEX", m, 2, 1) == 1
    assert value(one, "SERIESSUM", 2, 0, 1, xs) == 1 + 4 + 8 + 32

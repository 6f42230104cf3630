"""Spreadsheet formula functions as Columns.

Scalar functions map Columns to a Column; range functions are aggregates over the rows of a column.
Errors are null (``IFERROR`` is a fallback for null); where the kind of an error or of a cell matters,
cells are tagged structs made by ``cell``.  Dates are DATE or TIMESTAMP columns; ``serial`` gives their
number.  Texts in numeric places are converted, and null reads as blank, that is 0 or "".
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTIONS: dict[str, tuple[str, int, int | None, Callable]] = {}


def fn(names: str, least: int, most: int | None = -1, kind: str = "scalar"):
    def keep(build: Callable) -> Callable:
        for name in names.split():
            FUNCTIONS[name] = (kind, least, least if most == -1 else most, build)
        return build

    return keep


def formula(name: str, *args) -> Column:
    """The Column of a function by its name; arguments are Columns or Python values."""
    kind, least, most, build = FUNCTIONS[name.upper()]
    if len(args) < least or (most is not None and len(args) > most):
        raise ValueError(f"{name} takes {least} to {most or 'any number of'} arguments")
    return build(*args)


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def num(x) -> Column:
    return lit(x).try_cast("double")


def whole(x) -> Column:
    return F.floor(num(x))


def trunc(x) -> Column:
    x = num(x)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def guard(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


EPOCH = "1899-12-30"


def serial(d) -> Column:
    """Number of a date: days since 1899-12-30."""
    d = lit(d)
    return (F.unix_micros(d.cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / F.lit(86_400_000_000.0)


# --- dates -----------------------------------------------------------------------------------------


@fn("DATE", 3)
def _date(y, m, d):
    y, m, d = (trunc(x).cast("int") for x in (y, m, d))
    first = F.add_months(F.make_date(F.when(y < 1900, y + 1900).otherwise(y), F.lit(1), F.lit(1)), m - 1)
    return F.date_add(first, d - 1)


@fn("DATEDIF", 3)
def _datedif(start, end, unit):
    a, b = lit(start).cast("date"), lit(end).cast("date")
    u = F.upper(lit(unit))
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")
    rest = F.datediff(b, F.add_months(a, months))
    same_year = F.datediff(b, F.add_months(a, F.floor(months / 12).cast("int") * 12))
    value = F.when(u == "Y", F.floor(months / 12)).when(u == "M", months).when(u == "D", F.datediff(b, a)).when(u == "MD", rest).when(u == "YM", F.pmod(months, F.lit(12))).when(u == "YD", same_year)
    return guard(a <= b, value.cast("double"))


@fn("DATEVALUE", 1)
def _datevalue(text):
    return F.floor(serial(lit(text).try_cast("date")))


@fn("TIMEVALUE", 1)
def _timevalue(text):
    t = F.concat(F.lit("1970-01-01 "), F.regexp_extract(lit(text), r"(\d{1,2}:\d{2}(?::\d{2})?)", 1)).try_cast("timestamp")
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400.0


for _name, _f in (("DAY", F.dayofmonth), ("HOUR", F.hour), ("MINUTE", F.minute), ("MONTH", F.month), ("SECOND", F.second), ("YEAR", F.year), ("ISOWEEKNUM", F.weekofyear)):
    fn(_name, 1)(lambda d, f=_f: f(lit(d)))


@fn("DAYS", 2)
def _days(end, start):
    return F.datediff(lit(end), lit(start))


@fn("DAYS360", 2, 3)
def _days360(start, end, european=False):
    a, b = lit(start).cast("date"), lit(end).cast("date")
    da, db = F.dayofmonth(a), F.dayofmonth(b)
    if european is True:
        da, db = F.least(da, F.lit(30)), F.least(db, F.lit(30))
    else:
        last = a == F.last_day(a)
        da = F.when(last, 30).otherwise(da)
        db = F.when((db == 31) & (da == 30), 30).otherwise(db)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + db - da


@fn("EDATE", 2)
def _edate(d, months):
    return F.add_months(lit(d).cast("date"), trunc(months).cast("int"))


@fn("EOMONTH", 2)
def _eomonth(d, months):
    return F.last_day(F.add_months(lit(d).cast("date"), trunc(months).cast("int")))


def _workdays(a: Column, b: Column) -> Column:
    """Days from a to b, both included, that aren't Saturday or Sunday (a <= b), in closed form."""
    n = F.datediff(b, a) + 1
    first = F.weekday(a)  # Monday is 0
    tail = F.pmod(n, F.lit(7))
    weekend = F.greatest(F.lit(0), F.least(first + tail, F.lit(7)) - F.greatest(first, F.lit(5))) + F.greatest(F.lit(0), F.least(first + tail, F.lit(14)) - F.greatest(first, F.lit(12)))
    return F.floor(n / 7) * 5 + tail - weekend


@fn("NETWORKDAYS", 2, 3, "range")
def _networkdays(start, end, holidays=None):
    a, b = lit(start).cast("date"), lit(end).cast("date")
    low, high = F.least(a, b), F.greatest(a, b)
    days = _workdays(low, high)
    if holidays is not None:
        free = F.filter(F.array_distinct(lit(holidays)), lambda h: (h >= low) & (h <= high) & (F.weekday(h) < 5))
        days = days - F.size(free)
    return F.when(a > b, -days).otherwise(days)


@fn("WORKDAY", 2, 3, "range")
def _workday(start, days, holidays=None):
    a, n = lit(start).cast("date"), trunc(days).cast("int")
    spare = F.size(lit(holidays)) if holidays is not None else F.lit(0)
    span = F.abs(n) * 2 + 7 + spare * 2
    up = F.filter(F.sequence(F.date_add(a, 1), F.date_add(a, span)), lambda d: (F.weekday(d) < 5) & (~F.array_contains(lit(holidays), d) if holidays is not None else F.lit(True)))
    down = F.filter(F.sequence(F.date_sub(a, 1), F.date_sub(a, span), F.expr("interval -1 day")), lambda d: (F.weekday(d) < 5) & (~F.array_contains(lit(holidays), d) if holidays is not None else F.lit(True)))
    return F.when(n == 0, a).when(n > 0, F.try_element_at(up, n)).otherwise(F.try_element_at(down, -n))


@fn("NOW", 0, 0, "volatile")
def _now():
    return F.current_timestamp()


@fn("TODAY", 0, 0, "volatile")
def _today():
    return F.current_date()


@fn("TIME", 3)
def _time(h, m, s):
    parts = [whole(x) for x in (h, m, s)]
    ok = (parts[0] >= 0) & (parts[1] >= 0) & (parts[2] >= 0) & (F.greatest(*parts) <= 32767)
    return guard(ok, F.pmod(parts[0] * 3600 + parts[1] * 60 + parts[2], F.lit(86400)) / 86400.0)


@fn("WEEKDAY", 1, 2)
def _weekday(d, kind=1):
    monday = F.weekday(lit(d))  # Monday is 0
    if kind == 3:
        return monday
    start = {1: 6, 2: 0, 11: 0, 12: 1, 13: 2, 14: 3, 15: 4, 16: 5, 17: 6}.get(kind)
    return F.pmod(monday - start, F.lit(7)) + 1 if start is not None else F.lit(None)


@fn("WEEKNUM", 1, 2)
def _weeknum(d, kind=1):
    d = lit(d).cast("date")
    if kind == 21:
        return F.weekofyear(d)
    start = {1: 6, 2: 0, 11: 0, 12: 1, 13: 2, 14: 3, 15: 4, 16: 5, 17: 6}[kind]
    offset = F.pmod(F.weekday(F.trunc(d, "year")) - start, F.lit(7))
    return F.floor((F.dayofyear(d) - 1 + offset) / 7) + 1


@fn("YEARFRAC", 2, 3)
def _yearfrac(start, end, basis=0):
    a, b = F.least(lit(start).cast("date"), lit(end).cast("date")), F.greatest(lit(start).cast("date"), lit(end).cast("date"))
    if basis in (0, 4):
        return F.abs(_days360(a, b, basis == 4)) / 360.0
    days = F.datediff(b, a)
    if basis == 1:
        lengths = F.transform(F.sequence(F.year(a), F.year(b)), lambda y: F.datediff(F.make_date(y + 1, F.lit(1), F.lit(1)), F.make_date(y, F.lit(1), F.lit(1))).cast("double"))
        return days / (F.aggregate(lengths, F.lit(0.0), lambda s, x: s + x) / F.size(lengths))
    return days / F.lit(360.0 if basis == 2 else 365.0)


# --- money -----------------------------------------------------------------------------------------


@fn("FV", 3, 5)
def _fv(rate, periods, payment, present=0, due=0):
    r, n, p, v, d = map(num, (rate, periods, payment, present, due))
    growth = F.pow(1 + r, n)
    return F.when(r == 0, -(v + p * n)).otherwise(-(v * growth + p * (1 + r * d) * (growth - 1) / r))


@fn("PMT", 3, 5)
def _pmt(rate, periods, present, future=0, due=0):
    r, n, v, f, d = map(num, (rate, periods, present, future, due))
    growth = F.pow(1 + r, n)
    return F.when(r == 0, -(v + f) / n).otherwise(-(v * growth + f) * r / ((1 + r * d) * (growth - 1)))


@fn("IPMT", 4, 6)
def _ipmt(rate, period, periods, present, future=0, due=0):
    r, k, d = num(rate), num(period), num(due)
    payment = _pmt(rate, periods, present, future, due)
    interest = _fv(rate, k - 1, payment, present, due) * r
    paid = F.when((d == 1) & (k == 1), 0.0).when(d == 1, (_fv(rate, k - 2, payment, present, 1) - payment) * r).otherwise(interest)
    return guard((k >= 1) & (k <= num(periods)), paid)


# --- kinds of cells and errors ---------------------------------------------------------------------

#: fixed values: error texts and their numbers
ERRORS = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7}


def cell(value=None, kind: str | None = None, error=None) -> Column:
    """A tagged cell: struct(kind, num, txt, log, err); ``error`` makes an error where it isn't null."""
    v = lit(value)
    kind = kind or ("number" if not isinstance(value, str) else "text")
    tag = F.when(v.isNull(), "blank").otherwise(kind)
    number = v.try_cast("double") if kind == "number" else F.lit(None).cast("double")
    text = v.cast("string") if kind == "text" else F.lit(None).cast("string")
    truth = v.cast("boolean") if kind == "logical" else F.lit(None).cast("boolean")
    err = lit(error).cast("string") if error is not None else F.lit(None).cast("string")
    return F.struct(F.when(err.isNotNull(), "error").otherwise(tag).alias("kind"), number.alias("num"), text.alias("txt"), truth.alias("log"), err.alias("err"))


def _tag(x) -> Column:
    return lit(x)["kind"]


@fn("ERROR.TYPE", 1)
def _error_type(x):
    return F.try_element_at(F.create_map(*[lit(v) for kv in ERRORS.items() for v in kv]), lit(x)["err"])


fn("ISBLANK", 1)(lambda x: _tag(x) == "blank")
fn("ISERR", 1)(lambda x: (_tag(x) == "error") & (lit(x)["err"] != "#N/A"))
fn("ISERROR", 1)(lambda x: _tag(x) == "error")
fn("ISNA", 1)(lambda x: (_tag(x) == "error") & (lit(x)["err"] == "#N/A"))
fn("ISLOGICAL", 1)(lambda x: _tag(x) == "logical")
fn("ISNONTEXT", 1)(lambda x: _tag(x) != "text")
fn("ISNUMBER", 1)(lambda x: _tag(x) == "number")
fn("ISTEXT", 1)(lambda x: _tag(x) == "text")
fn("ISREF", 1)(lambda x: F.lit(isinstance(x, str) and bool(re.fullmatch(r"\$?[A-Za-z]{1,3}\$?\d+(:\$?[A-Za-z]{1,3}\$?\d+)?", x))))
fn("ISEVEN", 1)(lambda x: F.pmod(trunc(x), F.lit(2)) == 0)
fn("ISODD", 1)(lambda x: F.pmod(trunc(x), F.lit(2)) == 1)
fn("N", 1)(lambda x: F.when(_tag(x) == "number", lit(x)["num"]).when(_tag(x) == "logical", lit(x)["log"].cast("double")).when(_tag(x) != "error", 0.0))
fn("NA", 0)(lambda: cell(None, "number", "#N/A"))
fn("TYPE", 1)(lambda x: F.when(_tag(x).isin("number", "blank"), 1).when(_tag(x) == "text", 2).when(_tag(x) == "logical", 4).when(_tag(x) == "error", 16))
fn("T", 1)(lambda x: F.when(_tag(x) == "text", lit(x)["txt"]).when(_tag(x) != "error", ""))

# --- logic -----------------------------------------------------------------------------------------

fn("TRUE", 0)(lambda: F.lit(True))
fn("FALSE", 0)(lambda: F.lit(False))
fn("NOT", 1)(lambda x: ~lit(x).cast("boolean"))
fn("IF", 2, 3)(lambda test, yes, no=False: F.when(lit(test).cast("boolean"), lit(yes)).otherwise(lit(no)))
fn("IFERROR", 2)(lambda x, other: F.coalesce(lit(x), lit(other)))


@fn("AND", 1, None, "range")
def _and(*xs):
    """Over arguments of one row; a single Column is taken over all rows."""
    if len(xs) == 1:
        return F.bool_and(lit(xs[0]).try_cast("boolean"))
    return F.aggregate(F.filter(F.array(*[lit(x).try_cast("boolean") for x in xs]), lambda v: v.isNotNull()), F.lit(None).cast("boolean"), lambda a, v: F.coalesce(a & v, v))


@fn("OR", 1, None, "range")
def _or(*xs):
    if len(xs) == 1:
        return F.bool_or(lit(xs[0]).try_cast("boolean"))
    return F.aggregate(F.filter(F.array(*[lit(x).try_cast("boolean") for x in xs]), lambda v: v.isNotNull()), F.lit(None).cast("boolean"), lambda a, v: F.coalesce(a | v, v))


# --- numbers ---------------------------------------------------------------------------------------


def _simple(name: str, f: Callable[[Column], Column], ok: Callable[[Column], Column] | None = None) -> None:
    fn(name, 1)(lambda x: guard(ok(num(x)), f(num(x))) if ok else f(num(x)))


_simple("ABS", F.abs)
_simple("ACOS", F.acos, lambda x: F.abs(x) <= 1)
_simple("ACOSH", F.acosh, lambda x: x >= 1)
_simple("ACOT", lambda x: F.lit(math.pi / 2) - F.atan(x))
_simple("ACOTH", lambda x: 0.5 * F.ln((x + 1) / (x - 1)), lambda x: F.abs(x) > 1)
_simple("ASIN", F.asin, lambda x: F.abs(x) <= 1)
_simple("ASINH", F.asinh)
_simple("ATAN", F.atan)
_simple("ATANH", F.atanh, lambda x: F.abs(x) < 1)
_simple("COS", F.cos)
_simple("COSH", F.cosh)
_simple("COT", F.cot, lambda x: x != 0)
_simple("COTH", lambda x: 1 / F.tanh(x), lambda x: x != 0)
_simple("CSC", F.csc, lambda x: x != 0)
_simple("CSCH", lambda x: 1 / F.sinh(x), lambda x: x != 0)
_simple("DEGREES", F.degrees)
_simple("EXP", F.exp)
_simple("INT", F.floor)
_simple("LN", F.ln, lambda x: x > 0)
_simple("LOG10", F.log10, lambda x: x > 0)
_simple("RADIANS", F.radians)
_simple("SEC", F.sec)
_simple("SECH", lambda x: 1 / F.cosh(x))
_simple("SIGN", F.signum)
_simple("SIN", F.sin)
_simple("SINH", F.sinh)
_simple("SQRT", F.sqrt, lambda x: x >= 0)
_simple("SQRTPI", lambda x: F.sqrt(x * math.pi), lambda x: x >= 0)
_simple("TAN", F.tan)
_simple("TANH", F.tanh)
_simple("FISHER", F.atanh, lambda x: F.abs(x) < 1)
fn("PI", 0)(lambda: F.lit(math.pi))
fn("RAND", 0, 0, "volatile")(lambda: F.rand())
fn("ATAN2", 2)(lambda x, y: guard((num(x) != 0) | (num(y) != 0), F.atan2(num(y), num(x))))


@fn("LOG", 1, 2)
def _log(x, base=10):
    x, b = num(x), num(base)
    return guard((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.ln(b))


@fn("POWER", 2)
def _power(x, y):
    x, y = num(x), num(y)
    return guard(~((x == 0) & (y <= 0)) & ~((x < 0) & (y != F.floor(y))), F.pow(x, y))


@fn("MOD", 2)
def _mod(x, y):
    x, y = num(x), num(y)
    return guard(y != 0, x - F.floor(x / y) * y)


fn("QUOTIENT", 2)(lambda x, y: guard(num(y) != 0, trunc(num(x) / num(y))))


@fn("CEILING", 2)
def _ceiling(x, s):
    x, s = num(x), num(s)
    return F.when((s == 0) | (x == 0), 0.0).when(~((x > 0) & (s < 0)), F.ceil(x / s) * s)


@fn("FLOOR", 2)
def _floor(x, s):
    x, s = num(x), num(s)
    return F.when(x == 0, 0.0).when((s != 0) & ~((x > 0) & (s < 0)), F.floor(x / s) * s)


@fn("CEILING.MATH", 1, 3)
def _ceiling_math(x, s=1, mode=0):
    x, s, m = num(x), F.abs(num(s)), num(mode)
    return F.when(s == 0, 0.0).when((x < 0) & (m != 0), -F.ceil(-x / s) * s).otherwise(F.ceil(x / s) * s)


@fn("FLOOR.MATH", 1, 3)
def _floor_math(x, s=1, mode=0):
    x, s, m = num(x), F.abs(num(s)), num(mode)
    return F.when(s == 0, 0.0).when((x < 0) & (m != 0), -F.floor(-x / s) * s).otherwise(F.floor(x / s) * s)


def _outward(x, want: int) -> Column:
    up = F.ceil(num(x))
    return F.when(F.pmod(up, F.lit(2)) == want, up).when(up < 0, up - 1).otherwise(up + 1).cast("double")


fn("EVEN", 1)(lambda x: _outward(x, 0))
fn("ODD", 1)(lambda x: _outward(x, 1))


@fn("MROUND", 2)
def _mround(x, m):
    x, m = num(x), num(m)
    return F.when((x == 0) | (m == 0), 0.0).when(F.signum(x) == F.signum(m), F.floor(x / m + 0.5) * m)


def _scale(digits) -> Column:
    return F.pow(F.lit(10.0), trunc(digits))


@fn("ROUND", 2)
def _round(x, digits):
    """Half away from zero."""
    x = num(x)
    if isinstance(digits, int):
        return F.round(x, digits)
    return F.signum(x) * F.floor(F.abs(x) * _scale(digits) + 0.5) / _scale(digits)


fn("ROUNDUP", 2)(lambda x, d: F.signum(num(x)) * F.ceil(F.round(F.abs(num(x)) * _scale(d), 9)) / _scale(d))
fn("ROUNDDOWN", 2)(lambda x, d: F.signum(num(x)) * F.floor(F.round(F.abs(num(x)) * _scale(d), 9)) / _scale(d))
fn("TRUNC", 1, 2)(lambda x, d=0: F.signum(num(x)) * F.floor(F.round(F.abs(num(x)) * _scale(d), 9)) / _scale(d))


@fn("RANDBETWEEN", 2, 2, "volatile")
def _randbetween(a, b):
    """End points have half the probability of the numbers between."""
    low, high = F.ceil(num(a)), F.ceil(num(b))
    return guard(low <= high, F.round(low + F.rand() * (high - low)))


def _product_of(n: Column, step: int = 1) -> Column:
    return F.aggregate(F.sequence(n.cast("int"), F.lit(1), F.lit(-step)), F.lit(1.0), lambda a, x: a * x)


@fn("FACT", 1)
def _fact(x):
    n = whole(x)
    return guard((n >= 0) & (n < 171), F.when(n < 2, 1.0).otherwise(_product_of(F.greatest(n, F.lit(1)))))


@fn("FACTDOUBLE", 1)
def _factdouble(x):
    n = whole(x)
    return guard((n >= -1) & (n <= 300), F.when(n < 2, 1.0).otherwise(_product_of(F.greatest(n, F.lit(1)), 2)))


def _choose(n: Column, k: Column) -> Column:
    small = F.least(k, n - k)
    terms = F.when(small >= 1, F.sequence(F.lit(1), small.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(1.0), lambda a, i: a * (n - small + i) / i)


@fn("COMBIN", 2)
def _combin(n, k):
    n, k = trunc(n).cast("double"), trunc(k).cast("double")
    return guard((n >= 0) & (k >= 0) & (k <= n), F.round(_choose(n, k)))


@fn("COMBINA", 2)
def _combina(n, k):
    n, k = trunc(n).cast("double"), trunc(k).cast("double")
    return guard((n >= 0) & (k >= 0) & ((n > 0) | (k == 0)), F.when(k == 0, 1.0).otherwise(F.round(_choose(n + k - 1, k))))


@fn("MULTINOMIAL", 1, None)
def _multinomial(*xs):
    ns = [whole(x).cast("double") for x in xs]
    total, out = F.lit(0.0), F.lit(1.0)
    for n in ns:
        total = total + n
        out = out * F.round(_choose(total, n))
    ok = F.lit(True)
    for n in ns:
        ok = ok & (n >= 0)
    return guard(ok, out)


def _gcd(a: Column, b: Column) -> Column:
    state = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), state, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0)).otherwise(F.try_mod(s["a"], s["b"])).cast("bigint").alias("b")))["a"]


@fn("GCD", 1, None, "range")
def _gcd_all(*xs):
    ns = [whole(x) for x in xs]
    out = ns[0].cast("bigint")
    ok = ns[0] >= 0
    for n in ns[1:]:
        out, ok = _gcd(out, n), ok & (n >= 0)
    return guard(ok, out)


@fn("LCM", 1, None, "range")
def _lcm_all(*xs):
    ns = [whole(x).cast("bigint") for x in xs]
    out, ok = ns[0], ns[0] >= 0
    for n in ns[1:]:
        out = F.when((out == 0) | (n == 0), F.lit(0)).otherwise((out / _gcd(out, n)).cast("bigint") * n)
        ok = ok & (n >= 0)
    return guard(ok, out)


@fn("BASE", 2, 3)
def _base(n, base, width=0):
    text = F.upper(F.conv(whole(n).cast("bigint").cast("string"), 10, int(base)))
    return F.when(F.length(text) < int(width), F.lpad(text, int(width), "0")).otherwise(text)


fn("DECIMAL", 2)(lambda text, base: F.conv(F.upper(lit(text)), int(base), 10).try_cast("double"))

#: fixed values: Roman numerals in the classic form
_ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


@fn("ROMAN", 1, 2)
def _roman(x, form=0):
    n = trunc(x).cast("int")
    rest, parts = n, []
    for value, sign in _ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = F.pmod(rest, F.lit(value))
    return guard((n >= 0) & (n <= 3999), F.concat(*parts))


@fn("ARABIC", 1)
def _arabic(text):
    t = F.upper(F.trim(lit(text)))
    worth = F.create_map(*[F.lit(v) for kv in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for v in kv])
    digits = F.transform(F.filter(F.split(F.reverse(F.regexp_replace(t, "^-", "")), ""), lambda c: c != ""), lambda c: F.try_element_at(worth, c))
    state = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most")), lambda s, v: F.struct((s["sum"] + F.when(v < s["most"], -v).otherwise(v)).alias("sum"), F.greatest(s["most"], v).alias("most")))
    return guard(t.rlike("^-?[IVXLCDM]*$"), F.when(t.startswith("-"), -state["sum"]).otherwise(state["sum"]))


@fn("SERIESSUM", 4, 4, "range")
def _seriessum(x, n, m, coefficients):
    x, n, m = num(x), num(n), num(m)
    return F.aggregate(F.transform(lit(coefficients), lambda c, i: c.try_cast("double") * F.pow(x, n + i * m)), F.lit(0.0), lambda a, v: a + v)


@F.pandas_udf(T.DoubleType())
def _determinant(rows: pd.Series) -> pd.Series:
    return rows.map(lambda m: None if m is None else float(np.linalg.det(np.array([list(r) for r in m], float))))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _inverse(rows: pd.Series) -> pd.Series:
    def one(m):
        a = np.array([list(r) for r in m], float)
        return None if abs(np.linalg.det(a)) < 1e-300 else np.linalg.inv(a).tolist()

    return rows.map(lambda m: None if m is None else one(m))


fn("MDETERM", 1, 1, "range")(lambda m: _determinant(lit(m)))
fn("MINVERSE", 1, 1, "array")(lambda m: _inverse(lit(m)))


@fn("MMULT", 2, 2, "array")
def _mmult(a, b):
    """Product of two small matrices held as arrays of rows; large ones are joined, see operators.tables.mmult."""
    columns = F.transform(F.sequence(F.lit(0), F.size(F.get(lit(b), F.lit(0))) - 1), lambda j: F.transform(lit(b), lambda r: F.get(r, j)))
    return F.transform(lit(a), lambda row: F.transform(columns, lambda c: F.aggregate(F.zip_with(row, c, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)))


# --- aggregates over rows --------------------------------------------------------------------------


def coerced(x) -> Column:
    """Numbers of cells with text as 0 and truth as 0 or 1; null stays out."""
    x = lit(x)
    return F.coalesce(x.try_cast("double"), x.cast("string").try_cast("boolean").cast("double"), F.when(x.isNotNull(), 0.0))


fn("SUM", 1, None, "range")(lambda *xs: sum((F.coalesce(F.sum(num(x)), F.lit(0.0)) for x in xs), F.lit(0.0)))
fn("SUMSQ", 1, None, "range")(lambda *xs: sum((F.coalesce(F.sum(num(x) * num(x)), F.lit(0.0)) for x in xs), F.lit(0.0)))
fn("PRODUCT", 1, None, "range")(lambda x: F.coalesce(F.product(num(x)), F.lit(0.0)))
fn("AVERAGE", 1, None, "range")(lambda x: F.avg(num(x)))
fn("AVERAGEA", 1, None, "range")(lambda x: F.avg(coerced(x)))
fn("COUNT", 1, None, "range")(lambda x: F.count(num(x)))
fn("COUNTA", 1, None, "range")(lambda x: F.count(lit(x)))
fn("COUNTBLANK", 1, 1, "range")(lambda x: F.count_if(lit(x).isNull() | (lit(x).cast("string") == "")))
fn("MAX", 1, None, "range")(lambda x: F.coalesce(F.max(num(x)), F.lit(0.0)))
fn("MAXA", 1, None, "range")(lambda x: F.coalesce(F.max(coerced(x)), F.lit(0.0)))
fn("MIN", 1, None, "range")(lambda x: F.coalesce(F.min(num(x)), F.lit(0.0)))
fn("MINA", 1, None, "range")(lambda x: F.coalesce(F.min(coerced(x)), F.lit(0.0)))
fn("MEDIAN", 1, None, "range")(lambda x: F.median(num(x)))
fn("DEVSQ", 1, None, "range")(lambda x: F.var_pop(num(x)) * F.count(num(x)))
fn("GEOMEAN", 1, None, "range")(lambda x: F.when(F.min(num(x)) > 0, F.exp(F.avg(F.ln(num(x))))))
for _names, _f, _c in (
    ("STDEV STDEV.S", F.stddev_samp, num), ("STDEVP STDEV.P", F.stddev_pop, num), ("STDEVA", F.stddev_samp, coerced), ("STDEVPA", F.stddev_pop, coerced),
    ("VAR VAR.S", F.var_samp, num), ("VARP VAR.P", F.var_pop, num), ("VARA", F.var_samp, coerced), ("VARPA", F.var_pop, coerced),
):
    fn(_names, 1, None, "range")(lambda x, f=_f, c=_c: f(c(x)))


@fn("LARGE", 2, 2, "range")
def _large(items, k):
    """k-th largest number of an array column; over the rows of a table it is operators.tables.kth_largest."""
    numbers = F.filter(F.transform(lit(items), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    place = F.ceil(num(k)).cast("int")
    return guard((place >= 1) & (place <= F.size(numbers)), F.try_element_at(F.sort_array(numbers, False), place))


@fn("SUMPRODUCT", 1, None, "range")
def _sumproduct(*xs):
    term = F.lit(1.0)
    for x in xs:
        term = term * F.coalesce(num(x), F.lit(0.0))
    return F.coalesce(F.sum(term), F.lit(0.0))


_WILD = re.compile(r"~[*?~]|[*?]|[^*?~]+|~")


def wildcard(text: str) -> str:
    """Regular expression of a pattern with ``*``, ``?`` and the escape ``~``, matching the whole text."""
    out = []
    for part in _WILD.findall(text):
        out.append(".*" if part == "*" else "." if part == "?" else re.escape(part[1:] if part[0] == "~" and len(part) == 2 else part))
    return "(?is)^" + "".join(out) + "$"


def criteria(x, condition) -> Column:
    """Whether a cell meets a condition such as 5, ">=3", "<>a", "a*" or ""; never null."""
    x = lit(x)
    if isinstance(condition, Column):
        return F.coalesce(F.lower(x.cast("string")) == F.lower(condition.cast("string")), F.lit(False))
    if isinstance(condition, bool):
        return F.coalesce(x.cast("string").try_cast("boolean") == condition, F.lit(False))
    if isinstance(condition, int | float):
        return F.coalesce(num(x) == float(condition), F.lit(False))
    op, value = re.match(r"(<>|>=|<=|=|>|<)?(.*)$", condition or "", re.S).groups()
    try:
        number: float | None = float(value)
    except ValueError:
        number = None
    if number is not None:
        tests = {None: num(x) == number, "=": num(x) == number, ">": num(x) > number, ">=": num(x) >= number, "<": num(x) < number, "<=": num(x) <= number}
        return ~F.coalesce(num(x) == number, F.lit(False)) if op == "<>" else F.coalesce(tests[op], F.lit(False))
    text = x.cast("string")
    if value == "":
        return text.isNull() if op == "=" else text.isNotNull() if op == "<>" else (text.isNull() | (text == ""))
    if op in (None, "=", "<>"):
        hit = F.coalesce(text.rlike(wildcard(value)), F.lit(False))
        return ~hit if op == "<>" else hit
    low = F.lower(text)
    return F.coalesce({">": low > value.lower(), ">=": low >= value.lower(), "<": low < value.lower(), "<=": low <= value.lower()}[op], F.lit(False))


def _all(pairs: tuple) -> Column:
    ok = F.lit(True)
    for x, c in zip(pairs[::2], pairs[1::2], strict=True):
        ok = ok & criteria(x, c)
    return ok


fn("COUNTIF", 2, 2, "range")(lambda x, c: F.count_if(criteria(x, c)))
fn("COUNTIFS", 2, None, "range")(lambda *pairs: F.count_if(_all(pairs)))
fn("SUMIF", 2, 3, "range")(lambda x, c, values=None: F.coalesce(F.sum(F.when(criteria(x, c), num(x if values is None else values))), F.lit(0.0)))
fn("SUMIFS", 3, None, "range")(lambda values, *pairs: F.coalesce(F.sum(F.when(_all(pairs), num(values))), F.lit(0.0)))

#: fixed values: functions of SUBTOTAL by number
SUBTOTALS = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV", 8: "STDEVP", 9: "SUM", 10: "VAR", 11: "VARP"}


@fn("SUBTOTAL", 2, None, "range")
def _subtotal(number, x, hidden=None):
    """1 to 11 over all rows, 101 to 111 over rows that aren't hidden; ``hidden`` is a Boolean Column."""
    value = lit(x)
    if number > 100 and hidden is not None:
        value = F.when(~hidden, value)
    return formula(SUBTOTALS[number % 100], value)


@fn("BINOMDIST BINOM.DIST", 4)
def _binomdist(k, n, p, cumulative):
    k, n, p = trunc(k).cast("double"), trunc(n).cast("double"), num(p)
    ok = (k >= 0) & (k <= n) & (p >= 0) & (p <= 1)

    def log_mass(j: Column) -> Column:
        terms = F.when(j >= 1, F.sequence(F.lit(1), j.cast("int"))).otherwise(F.array().cast("array<int>"))
        ways = F.aggregate(terms, F.lit(0.0), lambda a, i: a + F.ln((n - j + i) / i))
        return ways + F.when(j == 0, 0.0).otherwise(j * F.ln(p)) + F.when(n == j, 0.0).otherwise((n - j) * F.ln(1 - p))

    sure = F.when(p == 0, F.when(k == 0, 1.0).otherwise(0.0)).when(p == 1, F.when(k == n, 1.0).otherwise(0.0))
    if cumulative:
        first = F.exp(log_mass(F.lit(0.0)))
        terms = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
        total = F.aggregate(terms, F.struct(first.alias("m"), first.alias("s")), lambda s, j: F.struct((s["m"] * (n - j + 1) / j * p / (1 - p)).alias("m"), (s["s"] + s["m"] * (n - j + 1) / j * p / (1 - p)).alias("s")))["s"]
        sure = F.when(p == 0, 1.0).when(p == 1, F.when(k == n, 1.0).otherwise(0.0))
        return guard(ok, F.coalesce(sure, F.least(total, F.lit(1.0))))
    return guard(ok, F.coalesce(sure, F.exp(log_mass(k))))


# --- text ------------------------------------------------------------------------------------------


def text_of(x) -> Column:
    return F.coalesce(lit(x).cast("string"), F.lit(""))


fn("ASC", 1)(lambda s: F.translate(text_of(s), "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "))
#: fixed values: characters of Windows-1252 from 128 to 159
_CP1252 = "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–—˜™š›œ\u009džŸ"


@fn("CHAR", 1)
def _char(n):
    k = trunc(n).cast("int")
    special = F.substring(F.lit(_CP1252), k - 127, F.lit(1))
    return guard((k >= 1) & (k <= 255), F.when((k >= 128) & (k <= 159), special).otherwise(F.char(k)))


@fn("CODE", 1)
def _code(s):
    head = F.substring(text_of(s), 1, 1)
    special = F.call_function("locate", head, F.lit(_CP1252))
    return guard(head != "", F.when(special > 0, special + 127).otherwise(F.ascii(head)))


fn("CLEAN", 1)(lambda s: F.regexp_replace(text_of(s), "[\\x00-\\x1f\\x80-\\x9f]", ""))
CELL_LIMIT = 32_767


def _fits(x: Column) -> Column:
    return guard(F.length(x) <= CELL_LIMIT, x)


fn("CONCAT", 1, None)(lambda *xs: _fits(F.concat(*map(text_of, xs))))
fn("CONCATENATE", 1, None)(lambda *xs: _fits(F.concat(*map(text_of, xs))))
fn("DOLLAR", 1, 2)(lambda x, d=2: F.when(num(x) < 0, F.concat(F.lit("($"), F.format_number(-num(x), d), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(num(x), d))))
fn("EXACT", 2)(lambda a, b: text_of(a) == text_of(b))
fn("FIND", 2, 3)(lambda what, s, start=1: F.nullif(F.call_function("locate", text_of(what), text_of(s), trunc(start).cast("int")), F.lit(0)))
fn("FIXED", 1, 3)(lambda x, d=2, plain=False: F.replace(F.format_number(num(x), d), F.lit(","), F.lit("")) if plain else F.format_number(num(x), d))
fn("LEFT", 1, 2)(lambda s, n=1: guard(num(n) >= 0, F.substring(text_of(s), F.lit(1), trunc(n).cast("int"))))
fn("RIGHT", 1, 2)(lambda s, n=1: guard(num(n) >= 0, F.when(trunc(n) == 0, "").otherwise(F.right(text_of(s), trunc(n).cast("int")))))
#: UTF-16 units: characters beyond the basic plane count twice
fn("LEN", 1)(lambda s: F.length(text_of(s)) + F.regexp_count(text_of(s), F.lit("[\\x{10000}-\\x{10FFFF}]")))
fn("LOWER", 1)(lambda s: F.lower(text_of(s)))
fn("UPPER", 1)(lambda s: F.upper(text_of(s)))


@fn("MID", 3)
def _mid(s, start, n):
    """A start on the last character gives empty text."""
    t, a, k = text_of(s), trunc(start).cast("int"), trunc(n).cast("int")
    return guard((a >= 1) & (k >= 0), F.when(a - 1 >= F.length(t) - 1, "").otherwise(F.substring(t, a, k)))


@fn("NUMBERVALUE", 1, 3)
def _numbervalue(s, decimal=".", group=","):
    t = F.regexp_replace(text_of(s), r"\s", "")
    t = F.replace(t, F.lit(group), F.lit("")) if group else t
    signs = F.length(t) - F.length(F.replace(t, F.lit("%"), F.lit("")))
    bare = F.replace(F.replace(t, F.lit("%"), F.lit("")), F.lit(decimal), F.lit("."))
    return F.when(bare == "", 0.0).otherwise(bare.try_cast("double") / F.pow(F.lit(100.0), signs))


@fn("PROPER", 1)
def _proper(s):
    chars = F.filter(F.split(text_of(s), ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i > 0) & F.get(chars, i - 1).rlike("^\\p{L}$"), F.lower(c)).otherwise(F.upper(c))), "")


fn("REPLACE", 4)(lambda s, start, n, new: guard((trunc(start) >= 1) & (trunc(n) >= 0), F.concat(F.substring(text_of(s), F.lit(1), trunc(start).cast("int") - 1), text_of(new), F.substring(text_of(s), trunc(start).cast("int") + trunc(n).cast("int"), F.lit(CELL_LIMIT)))))
fn("REPT", 2)(lambda s, n: guard(trunc(n) >= 0, guard(F.length(text_of(s)) * trunc(n) <= CELL_LIMIT, F.repeat(text_of(s), trunc(n).cast("int")))))


@fn("SEARCH", 2, 3)
def _search(what, s, start=1):
    """Wildcards, ignoring case; the pattern is a Python text."""
    pattern = "(?is)" + wildcard(what)[6:-1]
    tail = F.substring(text_of(s), F.lit(int(start)), F.lit(CELL_LIMIT))
    place = F.regexp_instr(tail, F.lit(pattern))
    return guard((text_of(s) != "") & (place > 0), place + int(start) - 1)


@fn("SUBSTITUTE", 3, 4)
def _substitute(s, old, new, nth=None):
    t, o, n = text_of(s), text_of(old), text_of(new)
    if nth is None:
        return F.when(o == "", t).otherwise(F.replace(t, o, n))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(int(nth))), F.lit(0), lambda p, i: F.when((i > 1) & (p == 0), 0).otherwise(F.call_function("locate", o, t, p + 1)))
    return F.when((o == "") | (place == 0), t).otherwise(F.concat(F.substring(t, F.lit(1), place - 1), n, F.substring(t, place + F.length(o), F.lit(CELL_LIMIT))))


@fn("TEXT", 2)
def _text(x, pattern: str):
    """Number formats of digits, groups, percent and fixed text; date formats of y m d h s."""
    low = pattern.lower()
    if re.search(r"[ymdhs]", re.sub(r'"[^"]*"', "", low)) and not re.search(r"[0#]", pattern):
        java = re.sub(r"m+", lambda m: m.group() if re.search(r"[h:]$", low[: m.start()].rstrip()) or low[m.end() :].lstrip(":. ").startswith("s") else m.group().upper(), low)
        java = java.replace("h", "h" if "am/pm" in low else "H").replace("AM/PM", "a").replace("am/pm", "a").replace("aM/PM", "a")
        java = re.sub("dddd", "EEEE", java)
        return F.date_format(lit(x), re.sub("ddd", "EEE", java))
    m = re.match(r'^(?P<pre>[^0#.,%]*)(?P<body>[#0,]*(?:\.[0#]+)?)(?P<pct>%?)(?P<post>[^0#]*)$', pattern.replace('"', ""))
    if not m:
        raise ValueError(f"number format {pattern!r} isn't supported")
    body = m["body"]
    digits = len(body.partition(".")[2])
    value = num(x) * (100 if m["pct"] else 1)
    whole_digits = body.partition(".")[0].count("0")
    if "," in body:
        made = F.format_number(value, digits)
    else:
        made = F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
        if whole_digits > 1:
            made = F.lpad(made, whole_digits + (digits + 1 if digits else 0), "0")
    return F.concat(F.lit(m["pre"]), made, F.lit(m["pct"] + m["post"]))


@fn("TEXTJOIN", 3, None)
def _textjoin(separator, skip_empty, *xs):
    items = F.array(*map(text_of, xs))
    return _fits(F.array_join(F.filter(items, lambda x: x != "") if skip_empty else items, separator))


fn("TRIM", 1)(lambda s: F.trim(F.regexp_replace(text_of(s), " +", " ")))


@fn("VALUE", 1)
def _value(s):
    t = F.trim(text_of(s))
    percent = t.endswith("%")
    bare = F.regexp_replace(F.regexp_replace(t, "%$", ""), "[,$€£¥\\s]", "")
    number = bare.try_cast("double") / F.when(percent, 100.0).otherwise(1.0)
    return F.when(t == "", 0.0).otherwise(F.coalesce(number, serial(t.try_cast("timestamp"))))


# --- places ----------------------------------------------------------------------------------------


def _column_number(reference: str) -> int:
    letters = re.match(r"\$?([A-Za-z]+)", reference)[1].upper()
    value = 0
    for ch in letters:
        value = value * 26 + ord(ch) - 64
    return value


def _area(reference: str) -> tuple[int, int, int, int]:
    first, _, last = reference.replace("$", "").partition(":")
    last = last or first
    rows = [int(re.search(r"\d+", r)[0]) for r in (first, last)]
    return min(rows), _column_number(first), max(rows), _column_number(last)


fn("COLUMN", 1, 1)(lambda ref: F.lit(_area(ref)[1]))
fn("COLUMNS", 1)(lambda ref: F.lit(_area(ref)[3] - _area(ref)[1] + 1))
fn("ROW", 1, 1)(lambda ref: F.lit(_area(ref)[0]))
fn("ROWS", 1)(lambda ref: F.lit(_area(ref)[2] - _area(ref)[0] + 1))
fn("HYPERLINK", 1, 2)(lambda url, label=None: text_of(url if label is None else label))
fn("INDEX", 2, 3, "array")(lambda area, row, column=1: F.try_element_at(F.try_element_at(lit(area), trunc(row).cast("int")), trunc(column).cast("int")))
fn("TRANSPOSE", 1, 1, "array")(lambda m: F.transform(F.sequence(F.lit(0), F.size(F.get(lit(m), F.lit(0))) - 1), lambda j: F.transform(lit(m), lambda r: F.get(r, j))))


@fn("MATCH", 2, 3, "range")
def _match(target, items, kind=1):
    """Place of a value in an array column of numbers or texts; tables use operators.lookup."""
    xs, t = lit(items), lit(target)
    places = F.transform(xs, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    if kind == 0:
        same = F.filter(places, lambda p: F.lower(p["x"].cast("string")) == F.lower(t.cast("string")))
        return F.get(same, F.lit(0))["i"]
    kept = F.filter(places, lambda p: (p["x"] <= t) if kind == 1 else (p["x"] >= t))
    return F.try_element_at(kept, F.lit(-1))["i"]


def _lookup(target, keys, values, approximate=True) -> Column:
    place = _match(target, keys, 1 if approximate else 0)
    return F.try_element_at(lit(values), place)


@fn("VLOOKUP", 3, 4, "range")
def _vlookup(target, table, column, approximate=True):
    """Over a table held as an array of structs (key first); tables of any size use operators.lookup."""
    rows = lit(table)
    keys = F.transform(rows, lambda r: r["key"])
    return _lookup(target, keys, F.transform(rows, lambda r: r[column]), approximate)


@fn("HLOOKUP", 3, 4, "range")
def _hlookup(target, area, row, approximate=True):
    """Over an array of rows, whose first one holds the keys."""
    return _lookup(target, F.get(lit(area), F.lit(0)), F.get(lit(area), F.lit(row - 1)), approximate)

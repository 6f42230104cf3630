"""Table operators of the spreadsheet engine: filters, sorts, totals, pivots, lookups, rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsheet.functions.formula import criteria, wildcard

# --- filters -----------------------------------------------------------------------------------------


def value_filter(x: str, values: list) -> Column:
    """Rows whose text is one of the values, ignoring case."""
    return F.lower(F.col(x).cast("string")).isin([str(v).lower() for v in values])


def date_group_filter(x: str, unit: str, day: str) -> Column:
    """Rows equal to a day down to a unit (year to second)."""
    return F.coalesce(F.date_trunc(unit, x) == F.date_trunc(unit, F.lit(day).cast("timestamp")), F.lit(False))


def custom_filter(x: str, op: str, value) -> Column:
    """One clause: gt, lt, ge, le, eq, ne, begins, ends, contains or their negations with ``not_``.

    Blanks never match an order clause and always match a negation; texts match with wildcards and
    without case.
    """
    c = F.col(x)
    if op in ("gt", "lt", "ge", "le"):
        test = {"gt": c > value, "lt": c < value, "ge": c >= value, "le": c <= value}[op]
        return c.isNotNull() & test  # never null, and still pushed to the scan
    if op.startswith("not_"):
        return ~custom_filter(x, op[4:], value)
    if op == "ne":
        return ~custom_filter(x, "eq", value)
    if op == "eq" and not isinstance(value, str):
        return F.coalesce(F.lower(c.cast("string")) == F.lower(F.lit(value).cast("string")) if not isinstance(value, int | float) else c == value, F.lit(False))
    pattern = {"eq": value, "begins": f"{value}*", "ends": f"*{value}", "contains": f"*{value}*"}[op]
    return F.coalesce(c.cast("string").rlike(wildcard(pattern)), F.lit(False))


def two_clauses(first: Column, second: Column | None = None, both: bool = True) -> Column:
    return first if second is None else first & second if both else first | second


def top_n(df: DataFrame, x: str, n: int, bottom: bool = False, percent: bool = False) -> DataFrame:
    """Rows from the n-th value on, ties kept; the n-th value is found without a sort of all rows in one task."""
    kept = df.filter(F.col(x).isNotNull())
    if percent:
        n = max(1, math.ceil(kept.count() * n / 100))
    order = F.col(x).asc() if bottom else F.col(x).desc()
    edge = kept.select(x).orderBy(order).limit(n).agg((F.max if bottom else F.min)(x)).scalar()
    return kept.filter(F.col(x) <= edge if bottom else F.col(x) >= edge)


def average_filter(df: DataFrame, x: str, above: bool = True) -> DataFrame:
    """Rows strictly above or below the average of all rows."""
    mean = df.agg(F.avg(x)).scalar()
    return df.filter(F.col(x) > mean if above else F.col(x) < mean)


def kth_largest(df: DataFrame, x: str, k: int) -> DataFrame:
    """One row with the k-th largest value; null where there are fewer."""
    top = df.select(F.col(x).try_cast("double").alias("v")).filter("v is not null").orderBy(F.col("v").desc()).limit(max(k, 0))
    return top.agg(F.when(F.count("*") == k, F.min("v")).alias("value"))


# --- sorts -------------------------------------------------------------------------------------------


def sort_table(df: DataFrame, spec: str, match_case: bool = False, ignore_blanks: bool = True) -> DataFrame:
    """Sort by a specification such as ``"1 ASC, 2 DESC"`` (1-based columns); blanks last both ways."""
    order: list[Column] = []
    for part in spec.split(","):
        number, _, way = part.strip().partition(" ")
        name = df.columns[int(number) - 1] if number.isdigit() else number
        text = isinstance(df.schema[name].dataType, T.StringType)
        key = F.col(f"`{name}`") if match_case or not text else F.lower(F.col(f"`{name}`"))
        down = way.strip().upper() == "DESC"
        if not ignore_blanks and text:
            key = F.coalesce(key, F.lit(""))
        order.append(key.desc_nulls_last() if down else key.asc_nulls_last())
    return df.orderBy(*order)


def cell_order(cell: str, down: bool = False) -> list[Column]:
    """Sort keys of tagged cells: number, text, logical, error, and blank last in both directions."""
    c = F.col(cell)
    rank = F.when(c["kind"] == "number", 1).when(c["kind"] == "text", 2).when(c["kind"] == "logical", 3).when(c["kind"] == "error", 4).otherwise(5)
    keys = [F.when(rank < 5, rank), c["num"], F.lower(c["txt"]), c["log"]]
    return [k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys]


# --- totals and pivots -------------------------------------------------------------------------------

AGGREGATES = {
    "Sum": F.sum, "Count": lambda x: F.count(x), "Average": F.avg, "Min": F.min, "Max": F.max, "Product": F.product, "CountNumbers": lambda x: F.count(F.col(x).try_cast("double")),
    "StdDev": F.stddev_samp, "StdDevP": F.stddev_pop, "Var": F.var_samp, "VarP": F.var_pop,
}


def totals_row(df: DataFrame, functions: dict[str, str]) -> DataFrame:
    """One row with the totals of columns (column -> name of an aggregate)."""
    return df.agg(*[AGGREGATES[f](c).alias(c) for c, f in functions.items()])


def pivot(df: DataFrame, rows: list[str], columns: str, value: str, summary: str = "Sum", wanted: list | None = None, where: Column | None = None) -> DataFrame:
    """Row labels by column labels; naming the wanted labels saves a pass over the data."""
    source = df.filter(where) if where is not None else df
    return source.groupBy(*rows).pivot(columns, wanted).agg(AGGREGATES[summary](value))


def pivot_totals(df: DataFrame, rows: list[str], value: str, summary: str = "Sum", cube: bool = False) -> DataFrame:
    """Groups with subtotals and the grand total; ``level`` is the number of labels summed over."""
    grouped = df.cube(*rows) if cube else df.rollup(*rows)
    level = sum((F.grouping(r).cast("int") for r in rows), F.lit(0))
    return grouped.agg(AGGREGATES[summary](value).alias("value"), level.alias("level"))


def show_as(grouped: DataFrame, row: str, column: str, value: str, how: str, base: object = None) -> DataFrame:
    """A pivot's "show as" over its grouped result (one row a label pair): adds ``shown``."""
    v = F.col(value)
    by_row, by_column, whole = Window.partitionBy(row), Window.partitionBy(column), Window.partitionBy()
    over = {
        "percent_of_row": lambda: v / F.sum(v).over(by_row),
        "percent_of_column": lambda: v / F.sum(v).over(by_column),
        "percent_of_total": lambda: v / F.sum(v).over(whole),
        "running_total": lambda: F.sum(v).over(by_row.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)),
        "index": lambda: v * F.sum(v).over(whole) / (F.sum(v).over(by_row) * F.sum(v).over(by_column)),
        "difference_from": lambda: v - F.max(F.when(F.col(column) == base, v)).over(by_row),
        "percent_of": lambda: v / F.max(F.when(F.col(column) == base, v)).over(by_row),
        "percent_difference_from": lambda: (v - F.max(F.when(F.col(column) == base, v)).over(by_row)) / F.max(F.when(F.col(column) == base, v)).over(by_row),
        "difference_from_previous": lambda: v - F.lag(v).over(by_row.orderBy(column)),
    }
    return grouped.withColumn("shown", over[how]())


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Columns to groups: one row a column with its name and value."""
    return df.unpivot(ids, values, "metric", "value")


def group_description(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sd, sem, min and max of each group; sd and sem are 0 for one value."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(value))).alias("sem"), F.min(value).alias("min"), F.max(value).alias("max"))


# --- lookups -----------------------------------------------------------------------------------------


def exact_lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, values: list[str], order: str) -> DataFrame:
    """VLOOKUP, exact: the first matching row by ``order``, keys without case; null where none matches."""
    folded = F.lower(F.col(table_key).cast("string"))
    first = table.groupBy(folded.alias("_k")).agg(F.min_by(F.struct(*values), order).alias("_v"))
    joined = df.join(first, F.lower(F.col(key).cast("string")) == F.col("_k"), "left")
    return joined.select(*df.columns, *[F.col("_v")[v].alias(v) for v in values])


def as_of_lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, forward: bool = False, slices: int = 64) -> DataFrame:
    """VLOOKUP and MATCH, approximate: the value at the largest key not above (or smallest not below) the target.

    Both sides are put on one axis and cut into key ranges by quantiles of the table, so that no task
    sees all rows; each range carries in the last value of the ranges before it.  Of equal keys the last
    by value counts.  Null targets find nothing.
    """
    edges = table.agg(F.percentile_approx(F.col(table_key).cast("double"), F.lit([i / slices for i in range(1, slices)]), F.lit(1000)).alias("e")).first()["e"] or []
    bounds = sorted(set(edges))
    right = table.filter(F.col(table_key).isNotNull()).groupBy(F.col(table_key).cast("double").alias("_k")).agg(F.max(value).alias("_v"))
    tagged = right.select("_k", "_v", F.lit(0 if not forward else 1).alias("_side"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    targets = df.select(F.col(key).cast("double").alias("_k"), F.lit(None).cast(table.schema[value].dataType).alias("_v"), F.lit(1 if not forward else 0).alias("_side"), *df.columns)
    place = F.lit(0)
    for i, edge in enumerate(bounds):
        place = F.when(F.col("_k") >= edge, i + 1).otherwise(place)
    rows = tagged.unionByName(targets).withColumn("_slice", place)
    is_right = F.col("_side") == (0 if not forward else 1)
    # at most ``slices`` rows: the last (or first) table value of each range
    ends = rows.filter(is_right).groupBy("_slice").agg((F.max_by if not forward else F.min_by)("_v", "_k").alias("_end"))
    spread = ends.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_slice")).join(F.broadcast(ends), "_slice", "left")
    frame = Window.orderBy("_slice" if not forward else F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.select("_slice", F.last("_end", True).over(frame).alias("_carry"))
    within = Window.partitionBy("_slice").orderBy(*((F.col("_k"), F.col("_side")) if not forward else (F.col("_k").desc(), F.col("_side").desc()))).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_found", F.last("_v", True).over(within)).join(F.broadcast(carried), "_slice", "left")
    kept = found.filter(~is_right)
    return kept.select(*df.columns, F.when(F.col("_k").isNotNull(), F.coalesce("_found", "_carry")).alias(value))


def match_position(df: DataFrame, key: str, table: DataFrame, table_key: str, position: str) -> DataFrame:
    """MATCH 0: first position at which the key stands."""
    first = table.groupBy(F.lower(F.col(table_key).cast("string")).alias("_k")).agg(F.min(position).alias("position"))
    return df.join(first, F.lower(F.col(key).cast("string")) == F.col("_k"), "left").drop("_k")


def match_pattern(table: DataFrame, table_key: str, pattern: str, position: str) -> DataFrame:
    """MATCH 0 with wildcards: first position whose text meets the pattern."""
    return table.filter(criteria(F.col(table_key), pattern)).agg(F.min(position).alias("position"))


def mmult(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices as (i, j, v) tables of any size."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


# --- rules -------------------------------------------------------------------------------------------


def classify(df: DataFrame, x: str, rules: dict[str, tuple]) -> DataFrame:
    """Row classification: a Boolean or numeric column for each rule (name -> (kind, arguments...)).

    Kinds: cell_is (op, value), top10 (n, bottom), unique, duplicate, contains, blank, error, above_average,
    time_period (days back from a day), color_scale, data_bar, icon_set (number of icons).
    """
    c = F.col(x)
    out = df
    for name, (kind, *args) in rules.items():
        if kind == "cell_is":
            out = out.withColumn(name, custom_filter(x, *args))
        elif kind == "contains":
            out = out.withColumn(name, custom_filter(x, "contains", args[0]))
        elif kind == "blank":
            out = out.withColumn(name, c.isNull() | (F.trim(c.cast("string")) == ""))
        elif kind == "error":
            out = out.withColumn(name, F.coalesce(c.cast("string").rlike(r"^#(NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A)$"), F.lit(False)))
        elif kind in ("unique", "duplicate"):
            counts = df.groupBy(c.alias("_x")).agg(F.count("*").alias("_n"))
            out = out.join(counts, c.eqNullSafe(F.col("_x")), "left").withColumn(name, (F.col("_n") > 1) if kind == "duplicate" else (F.col("_n") == 1)).drop("_x", "_n")
        elif kind == "top10":
            n, bottom = args[0], len(args) > 1 and args[1]
            edge = df.filter(c.isNotNull()).select(x).orderBy(c.asc() if bottom else c.desc()).limit(n).agg((F.max if bottom else F.min)(x)).scalar()
            out = out.withColumn(name, F.coalesce(c <= edge if bottom else c >= edge, F.lit(False)))
        elif kind == "time_period":
            day, back = F.lit(args[0]).cast("date"), args[1]
            out = out.withColumn(name, F.coalesce((c.cast("date") <= day) & (c.cast("date") > F.date_sub(day, back)), F.lit(False)))
        else:
            bounds = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"))).scalar()
            low, high, mean = bounds["lo"], bounds["hi"], bounds["mean"]
            share = F.when(high == low, 0.5).otherwise((c - low) / (high - low))
            if kind == "above_average":
                out = out.withColumn(name, F.coalesce(c > mean, F.lit(False)))
            elif kind == "icon_set":
                out = out.withColumn(name, F.least(F.floor(share * args[0]), F.lit(args[0] - 1)).cast("int"))
            else:  # color_scale and data_bar: place between the least and the greatest value
                out = out.withColumn(name, share)
    return out


def validate(df: DataFrame, rules: dict[str, tuple]) -> DataFrame:
    """Data validation: a Boolean column ``ok_<column>`` for each rule (column -> (kind, low, high) or (list, values))."""
    out = df
    for name, (kind, *args) in rules.items():
        c = F.col(name)
        if kind == "whole":
            ok = (c.try_cast("double") == F.floor(c.try_cast("double"))) & c.try_cast("double").between(*args)
        elif kind == "decimal":
            ok = c.try_cast("double").between(*args)
        elif kind in ("date", "time"):
            ok = c.cast("timestamp").between(*[F.lit(a).cast("timestamp") for a in args])
        elif kind == "text_length":
            ok = F.length(c.cast("string")).between(*args)
        elif kind == "list":
            ok = c.isin(*args[0])
        else:
            ok = args[0]
        out = out.withColumn(f"ok_{name}", F.coalesce(ok, F.lit(False)))
    return out


def audit_formulas(df: DataFrame, formula: str) -> Column:
    """Whether a formula divides without IFERROR around it."""
    c = F.col(formula)
    return F.coalesce(c.startswith("=") & c.contains("/") & ~F.upper(c).contains("IFERROR("), F.lit(False))


def search_cells(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any cell holds the text."""
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.col(f"`{c}`").cast("string").contains(text), F.lit(False))
    return df.filter(hit)


def append_data(df: DataFrame, more: DataFrame) -> DataFrame:
    return df.unionByName(more, allowMissingColumns=True)


def replace_data(df: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows under the old columns."""
    return new.select(*[F.col(f"`{c}`") if c in new.columns else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def transpose(df: DataFrame, key: str) -> DataFrame:
    """Rows and columns swapped: the values of ``key`` name the new columns, so there must be few of them."""
    return df.transpose(key)


def slice_rows(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (from 1) in an order: what resizing a table keeps."""
    return df.orderBy(*order).offset(first - 1).limit(last - first + 1)

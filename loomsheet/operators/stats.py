"""Statistics: descriptions, histograms, densities, regression, tests, and multiple comparison."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def describe(df: DataFrame, x: str, skip_nan: bool = True) -> DataFrame:
    """Sum, mean, median, variances, deviations and standard error; NaN is dropped when ``skip_nan``."""
    c = F.when(~F.isnan(x), F.col(x)) if skip_nan and dict(df.dtypes)[x] in ("double", "float") else F.col(x)
    return df.agg(
        F.count(c).alias("n"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.var_samp(c).alias("variance"), F.var_pop(c).alias("variance_p"),
        F.stddev_samp(c).alias("sd"), F.stddev_pop(c).alias("sd_p"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("stderr"), F.min(c).alias("min"), F.max(c).alias("max"),
    )


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column-wise statistics of a matrix, one row a column, by one aggregate over all of them."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")) for c in columns]
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("r")).select("r.*")


def at_places(df: DataFrame, x: str, places: dict[str, Column]) -> DataFrame:
    """Values at given places (from 0) of the sorted column, without sorting it in one task.

    Equal values are counted first; places are then looked up in the running counts of a range-parted
    sort, whose part sums are prefix-summed.
    """
    counts = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("v")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(x)).scalar()
    parts = 64
    edges = df.agg(F.percentile_approx(x, F.lit([i / parts for i in range(1, parts)]), F.lit(10_000)).alias("e")).first()["e"] or []
    slot = F.lit(0)
    for i, edge in enumerate(sorted(set(edges))):
        slot = F.when(F.col("v") >= edge, i + 1).otherwise(slot)
    marked = counts.withColumn("slot", slot)
    before = marked.groupBy("slot").agg(F.sum("n").alias("s")).withColumn("offset", F.coalesce(F.sum("s").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 64 rows
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = marked.withColumn("upto", upto).join(before.select("slot", "offset"), "slot").withColumn("last", F.col("offset") + F.col("upto"))
    return ranked.agg(*[F.min(F.when(F.col("last") > place(total) if callable(place) else F.col("last") > place, F.col("v"))).alias(name) for name, place in places.items()])


def percentile(df: DataFrame, x: str, p: float) -> DataFrame:
    """The element at floor(p n / 100) of the sorted values, clamped: no interpolation."""
    return at_places(df, x, {"value": lambda n: F.least(F.greatest(F.floor(n * p / 100.0), F.lit(0)), n - 1)})


def box_plot(df: DataFrame, x: str) -> DataFrame:
    """Five numbers: quartiles are the elements at n/4, n/2 and 3n/4 by whole division."""
    return at_places(df, x, {"low": lambda n: F.lit(0), "q1": lambda n: F.floor(n / 4), "median": lambda n: F.floor(n / 2), "q3": lambda n: F.floor(n * 3 / 4), "high": lambda n: n - 1})


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int, include_outliers: bool = False) -> DataFrame:
    """(bin, lower, count, probability, peak_share, cumulative): equal bins, the last edge included."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1))
    place = F.greatest(F.lit(0), place) if include_outliers else place
    kept = df.filter(F.col(x).isNotNull()) if include_outliers else df.filter(F.col(x).between(low, high))
    counted = kept.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    rows = every.join(counted, "bin", "left").na.fill(0, ["count"])
    whole = Window.partitionBy()  # over ``bins`` rows
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("count")
    return rows.select("bin", (F.lit(low) + F.col("bin") * width).alias("lower"), "count", (n / F.sum(n).over(whole)).alias("probability"), (n / F.max(n).over(whole)).alias("peak_share"), F.sum(n).over(running).alias("cumulative"))


KERNELS = {
    "gaussian": lambda u: F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi),
    "epanechnikov": lambda u: F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0),
    "uniform": lambda u: F.when(F.abs(u) <= 1, 0.5).otherwise(0.0),
    "triangular": lambda u: F.when(F.abs(u) <= 1, 1 - F.abs(u)).otherwise(0.0),
}


def density(df: DataFrame, x: str, grid: list[float], kernel: str = "gaussian", bandwidth: float | None = None) -> DataFrame:
    """(at, density) at the points of a grid; the bandwidth is by Scott's rule.

    Each row adds to all grid points within one aggregate, so nothing but the grid leaves a partition.
    """
    if bandwidth is None:
        n, sd = df.agg(F.count(x), F.stddev_samp(x)).first()
        bandwidth = (24 * math.sqrt(math.pi)) ** (1 / 3) * (sd or 0.0) * (n or 1) ** (-1 / 3) or 1.0
    k = KERNELS[kernel]
    sums = [F.sum(k((F.lit(float(g)) - F.col(x)) / bandwidth)).alias(f"g{i}") for i, g in enumerate(grid)]
    one = df.filter(F.col(x).isNotNull()).agg(F.count("*").alias("n"), *sums)
    points = F.array(*[F.struct(F.lit(float(g)).alias("at"), (F.col(f"g{i}") / (F.col("n") * bandwidth)).alias("density")) for i, g in enumerate(grid)])
    return one.select(F.explode(points).alias("p")).select("p.*")


def regression(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / sd, 2)) / (sd * math.sqrt(2 * math.pi))


# --- distributions by published formulas -------------------------------------------------------------


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 301):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def f_tail(f: float, between: float, within: float) -> float:
    """Probability of an F value at least as large."""
    return incomplete_beta(within / 2, between / 2, within / (within + between * f)) if f > 0 else 1.0


def t_tails(t: float, freedom: float) -> float:
    """Two-sided probability of a t value."""
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


@F.pandas_udf(T.DoubleType())
def f_probability(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else f_tail(x, b, w) for x, b, w in zip(f, between, within, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_probability(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else t_tails(x, n) for x, n in zip(t, freedom, strict=True)], dtype="float64")


def anova(df: DataFrame, label: str, value: str) -> DataFrame:
    """One-way analysis of variance: one row; null p where there are fewer than two groups."""
    groups = df.filter(F.col(value).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"))
    sums = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("ss_within"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    made = sums.select("k", "n", (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("ss_between"), "ss_within", (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))
    f = F.try_divide(F.col("ss_between") / F.nullif(F.col("df_between"), F.lit(0)), F.col("ss_within") / F.nullif(F.col("df_within"), F.lit(0)))
    return made.withColumn("ss_total", F.col("ss_between") + F.col("ss_within")).withColumn("f", f).withColumn("p", f_probability("f", F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def t_test(df: DataFrame, label: str, value: str, first: str, second: str) -> DataFrame:
    """Unpaired t-test of two groups: the standard errors add up, n1 + n2 - 2 degrees of freedom."""
    def of(name: str, make) -> Column:
        return make(F.when(F.col(label) == name, F.col(value)))

    row = df.agg(*[make(name).alias(a) for name, tag in ((first, "1"), (second, "2")) for a, make in ((f"n{tag}", lambda g: of(g, F.count)), (f"m{tag}", lambda g: of(g, F.avg)), (f"s{tag}", lambda g: of(g, F.stddev_samp)))])
    error = F.sqrt(F.col("s1") * F.col("s1") / F.col("n1") + F.col("s2") * F.col("s2") / F.col("n2"))
    made = row.withColumn("t", (F.col("m1") - F.col("m2")) / error).withColumn("freedom", F.col("n1") + F.col("n2") - 2)
    return made.withColumn("p", t_probability("t", F.col("freedom").cast("double")))


#: fixed values: studentised ranges of Duncan's test at 0.05 for unlimited degrees of freedom, by number of means from 2 to 20
DUNCAN = (2.77, 2.92, 3.02, 3.09, 3.15, 3.19, 3.23, 3.26, 3.29, 3.31, 3.33, 3.35, 3.37, 3.39, 3.40, 3.41, 3.43, 3.44, 3.45)


def duncan(df: DataFrame, label: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Duncan's multiple range test: (label, n, mean, letters) by descending mean, adjacent groups compared.

    The number of groups is small by nature (a group is a treatment); their means are one small table.
    Beyond 20 means the range of 20 holds, as the table ends there.
    """
    if alpha != 0.05:
        raise ValueError("the table holds alpha 0.05 only")
    groups = df.filter(F.col(value).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("ss"))

    def letters(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mean", "label"], ascending=[False, True]).reset_index(drop=True)
        within = max(1, int(pdf.n.sum()) - len(pdf))
        spread = math.sqrt(max(pdf.ss.sum() / within, 0.0))
        size = len(pdf) / (1 / pdf.n).sum()
        marks = [""] * len(pdf)
        letter, reach = 0, -1
        for i in range(len(pdf)):
            last = i
            for j in range(i + 1, len(pdf)):
                q = DUNCAN[min(j - i + 1, len(DUNCAN) + 1) - 2] * (1 + 1 / within if within < 120 else 1)
                if pdf["mean"][i] - pdf["mean"][j] <= q * spread / math.sqrt(size):
                    last = j
                else:
                    break
            if last > reach:
                for j in range(i, last + 1):
                    marks[j] += chr(97 + letter % 26)
                letter, reach = letter + 1, last
        return pdf.assign(letters=marks)[["label", "n", "mean", "letters"]]

    return groups.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(letters, "label string, n bigint, mean double, letters string")

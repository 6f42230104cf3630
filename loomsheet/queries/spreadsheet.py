"""Queries of the spreadsheet engine: formula functions, criteria aggregation, filters, pivots, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsheet.functions.formula import cell, formula
from loomsheet.operators import tables
from loomsheet.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}
fx = formula


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(c, digits: int = 9):
    return F.round(c, digits)


@query(
    """SELECT p_partkey AS k, round(abs(x), 9) AS abs_, round(atan(x), 9) AS atan_, round(cos(x), 9) AS cos_, round(sin(x), 9) AS sin_, round(degrees(x), 6) AS deg_, round(radians(x), 9) AS rad_,
    round(exp(x), 9) AS exp_, floor(x)::BIGINT AS int_, round(ln(p_size), 9) AS ln_, round(log10(p_size), 9) AS log10_, round(ln(p_size) / ln(2), 9) AS log2_, sign(x)::DOUBLE AS sign_, round(sqrt(p_size), 9) AS sqrt_,
    round(sqrt(p_size * pi()), 9) AS sqrtpi_, round(tan(x), 9) AS tan_, round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 9) AS tanh_, round((exp(x) + exp(-x)) / 2, 9) AS cosh_, round((exp(x) - exp(-x)) / 2, 9) AS sinh_,
    round(pi() / 2 - atan(x), 9) AS acot_, round(atan2(p_size, x), 9) AS atan2_, round(1 / cos(x), 9) AS sec_
    FROM (SELECT *, p_retailprice / 1000 - 1.25 AS x FROM part)"""
)
def formula_trigonometry(spark, sf_dir):
    df = load(spark, sf_dir, "part").withColumn("x", F.col("p_retailprice") / 1000 - 1.25)
    x, n = F.col("x"), F.col("p_size")
    made = {"abs_": fx("ABS", x), "atan_": fx("ATAN", x), "cos_": fx("COS", x), "sin_": fx("SIN", x), "rad_": fx("RADIANS", x), "exp_": fx("EXP", x), "ln_": fx("LN", n), "log10_": fx("LOG10", n), "log2_": fx("LOG", n, 2), "sqrt_": fx("SQRT", n), "sqrtpi_": fx("SQRTPI", n), "tan_": fx("TAN", x), "tanh_": fx("TANH", x), "cosh_": fx("COSH", x), "sinh_": fx("SINH", x), "acot_": fx("ACOT", x), "atan2_": fx("ATAN2", x, n), "sec_": fx("SEC", x)}
    return df.select(F.col("p_partkey").alias("k"), fx("INT", x).alias("int_"), fx("SIGN", x).alias("sign_"), _r(fx("DEGREES", x), 6).alias("deg_"), *[_r(c).alias(a) for a, c in made.items()])


@query(
    """SELECT l_orderkey AS k, l_linenumber AS n, ceil(q / 7) * 7 AS ceiling_, floor(q / 7) * 7 AS floor_, (q - floor(q / 7) * 7)::DOUBLE AS mod_, trunc(q / 7)::BIGINT AS quotient_, CASE WHEN q % 2 = 0 THEN q ELSE q + 1 END::DOUBLE AS even_, CASE WHEN q % 2 = 1 THEN q ELSE q + 1 END::DOUBLE AS odd_,
    floor(q / 3 + 0.5) * 3 AS mround_, power(q, 2) AS power_, (l_partkey % 2 = 0) AS iseven_, upper(format('{:b}', l_linenumber)) AS base_, l_linenumber::DOUBLE AS decimal_, factorial(l_linenumber)::DOUBLE AS fact_, (l_linenumber + 1)::DOUBLE AS combin_, gcd(l_partkey, l_suppkey)::BIGINT AS gcd_, lcm(l_linenumber, 12)::BIGINT AS lcm_,
    trunc(q / 7) AS trunc_, ceil(q / 7) AS roundup_ FROM (SELECT *, l_quantity AS q FROM lineitem)"""
)
def formula_numbers(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    base = fx("BASE", n, 2)
    made = {"ceiling_": fx("CEILING", q, 7), "floor_": fx("FLOOR", q, 7), "mod_": fx("MOD", q, 7), "quotient_": fx("QUOTIENT", q, 7), "even_": fx("EVEN", q), "odd_": fx("ODD", q), "mround_": fx("MROUND", q, 3), "power_": fx("POWER", q, 2), "iseven_": fx("ISEVEN", F.col("l_partkey")), "base_": base, "decimal_": fx("DECIMAL", base, 2), "fact_": fx("FACT", n), "combin_": fx("COMBIN", n + 1, 1), "gcd_": fx("GCD", F.col("l_partkey"), F.col("l_suppkey")), "lcm_": fx("LCM", n, 12), "trunc_": fx("TRUNC", q / 7), "roundup_": fx("ROUNDUP", q / 7, 0)}
    return df.select(F.col("l_orderkey").alias("k"), n.alias("n"), *[c.alias(a) for a, c in made.items()])


@query(
    """SELECT o_orderkey AS k, year(d)::INT AS y, month(d)::INT AS m, day(d)::INT AS dd, hour(d)::INT AS h, minute(d)::INT AS mi, second(d)::INT AS s, weekofyear(d)::INT AS iso, (dayofweek(d) + 1)::INT AS wd, date_diff('day', d::DATE, DATE '2000-01-01')::INT AS days, (d::DATE + INTERVAL 2 MONTH)::DATE AS edate, last_day((d + INTERVAL 1 MONTH)::DATE) AS eomonth,
    len(list_filter(range(d::DATE, d::DATE + INTERVAL 15 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6))::BIGINT AS net, date_diff('day', DATE '1899-12-30', d::DATE)::DOUBLE AS serial_, strftime(d, '%Y-%m-%d') AS text_ FROM (SELECT *, o_orderdate AS d FROM orders)"""
)
def formula_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    made = {"y": fx("YEAR", d), "m": fx("MONTH", d), "dd": fx("DAY", d), "h": fx("HOUR", d), "mi": fx("MINUTE", d), "s": fx("SECOND", d), "iso": fx("ISOWEEKNUM", d), "wd": fx("WEEKDAY", d), "days": fx("DAYS", F.lit("2000-01-01").cast("date"), d), "edate": fx("EDATE", d, 2), "eomonth": fx("EOMONTH", d, 1), "net": fx("NETWORKDAYS", d, F.date_add(d, 14)), "serial_": fx("DATEVALUE", d.cast("date").cast("string")).cast("double"), "text_": fx("TEXT", d, "yyyy-mm-dd")}
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), *[c.alias(a) for a, c in made.items()])


@query(
    """SELECT p_partkey AS k, length(p_name)::INT AS len_, left(p_name, 3) AS left_, right(p_name, 3) AS right_, substr(p_name, 2, 3) AS mid_, upper(p_name) AS upper_, lower(p_brand) AS lower_, repeat(p_brand, 2) AS rept_, p_name || '-' || p_brand AS concat_, nullif(instr(p_name, 'e'), 0)::INT AS find_,
    replace(p_name, 'e', 'EE') AS substitute_, p_brand = 'Brand#13' AS exact_, 'ab' || substr(p_name, 3) AS replace_, printf('%.2f', p_retailprice) AS fixed_, array_to_string([p_name, p_brand], '|') AS textjoin_, ascii(p_name)::INT AS code_, p_size::DOUBLE AS value_ FROM part"""
)
def formula_text(spark, sf_dir):
    s, b = F.col("p_name"), F.col("p_brand")
    made = {"len_": fx("LEN", s), "left_": fx("LEFT", s, 3), "right_": fx("RIGHT", s, 3), "mid_": fx("MID", s, 2, 3), "upper_": fx("UPPER", s), "lower_": fx("LOWER", b), "rept_": fx("REPT", b, 2), "concat_": fx("CONCAT", s, "-", b), "find_": fx("FIND", "e", s), "substitute_": fx("SUBSTITUTE", s, "e", "EE"), "exact_": fx("EXACT", b, "Brand#13"), "replace_": fx("REPLACE", s, 1, 2, "ab"), "fixed_": fx("FIXED", F.col("p_retailprice"), 2, True), "textjoin_": fx("TEXTJOIN", "|", True, s, b), "code_": fx("CODE", s), "value_": fx("VALUE", F.col("p_size").cast("string"))}
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *[c.alias(a) for a, c in made.items()])


@query(
    """SELECT l_returnflag AS g, round(sum(l_quantity), 4) AS sum_, round(sum(l_quantity * l_quantity), 2) AS sumsq_, round(avg(l_quantity), 6) AS average_, count(l_quantity) AS count_, max(l_quantity) AS max_, min(l_quantity) AS min_, median(l_quantity) AS median_, round(stddev_samp(l_quantity), 6) AS stdev_, round(stddev_pop(l_quantity), 6) AS stdevp_,
    round(var_samp(l_quantity), 5) AS var_, round(var_pop(l_quantity), 5) AS varp_, round(var_pop(l_quantity) * count(*), 0) AS devsq_, round(exp(avg(ln(l_quantity))), 6) AS geomean_, round(sum(l_quantity * l_discount), 3) AS sumproduct_, count(*) FILTER (l_quantity IS NULL) AS blank_ FROM lineitem GROUP BY 1"""
)
def formula_statistics(spark, sf_dir):
    q = F.col("l_quantity")
    made = {"sum_": _r(fx("SUM", q), 4), "sumsq_": _r(fx("SUMSQ", q), 2), "average_": _r(fx("AVERAGE", q), 6), "count_": fx("COUNT", q), "max_": fx("MAX", q), "min_": fx("MIN", q), "median_": fx("MEDIAN", q), "stdev_": _r(fx("STDEV", q), 6), "stdevp_": _r(fx("STDEV.P", q), 6), "var_": _r(fx("VAR", q), 5), "varp_": _r(fx("VARP", q), 5), "devsq_": _r(fx("DEVSQ", q), 0), "geomean_": _r(fx("GEOMEAN", q), 6), "sumproduct_": _r(fx("SUMPRODUCT", q, F.col("l_discount")), 3), "blank_": fx("COUNTBLANK", q)}
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(*[c.alias(a) for a, c in made.items()])


@query(
    """SELECT count(*) FILTER (p_size > 25) AS gt, count(*) FILTER (p_brand ILIKE 'brand#1_') AS wild, count(*) FILTER (p_size <> 7 OR p_size IS NULL) AS ne, round(sum(p_retailprice) FILTER (p_size <= 10), 2) AS sumif_, round(sum(p_retailprice) FILTER (p_size >= 5 AND lower(p_brand) = 'brand#13'), 2) AS sumifs_, count(*) FILTER (p_size >= 5 AND p_type ILIKE '%steel') AS countifs_ FROM part"""
)
def formula_criteria(spark, sf_dir):
    size, brand = F.col("p_size"), F.col("p_brand")
    return load(spark, sf_dir, "part").agg(
        fx("COUNTIF", size, ">25").alias("gt"),
        fx("COUNTIF", brand, "brand#1?").alias("wild"),
        fx("COUNTIF", size, "<>7").alias("ne"),
        _r(fx("SUMIF", size, "<=10", F.col("p_retailprice")), 2).alias("sumif_"),
        _r(fx("SUMIFS", F.col("p_retailprice"), size, ">=5", brand, "Brand#13"), 2).alias("sumifs_"),
        fx("COUNTIFS", size, ">=5", F.col("p_type"), "*steel").alias("countifs_"),
    )


@query(
    """SELECT c_nationkey AS g, round(avg(c_acctbal) FILTER (c_acctbal >= 0), 6) AS visible_mean, count(*) AS all_count, round(sum(c_acctbal), 2) AS all_sum FROM customer GROUP BY 1"""
)
def formula_subtotal(spark, sf_dir):
    bal, hidden = F.col("c_acctbal"), F.col("c_acctbal") < 0
    return load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(_r(fx("SUBTOTAL", 101, bal, hidden), 6).alias("visible_mean"), fx("SUBTOTAL", 2, bal).alias("all_count"), _r(fx("SUBTOTAL", 9, bal), 2).alias("all_sum"))


@query("SELECT c_custkey AS k, round(-(c_acctbal * power(1.01, 12) + 100 * (power(1.01, 12) - 1) / 0.01), 6) AS fv_, round(-(c_acctbal * power(1.01, 12)) * 0.01 / (power(1.01, 12) - 1), 6) AS pmt_ FROM customer")
def formula_money(spark, sf_dir):
    bal = F.col("c_acctbal")
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _r(fx("FV", 0.01, 12, 100, bal), 6).alias("fv_"), _r(fx("PMT", 0.01, 12, bal), 6).alias("pmt_"))


@query("SELECT id AS k, pub_year IS NULL AS blank_, pub_year IS NOT NULL AS number_, CASE WHEN pub_year IS NULL THEN '#N/A' ELSE 'ok' END AS shown, CASE WHEN pub_year > 2010 THEN 'new' ELSE 'old' END AS if_, coalesce(pub_year, 0) AS iferror_, NOT (pub_year > 2010) AS not_ FROM papers")
def formula_cells(spark, sf_dir):
    year = F.col("pub_year")
    tagged = cell(year)
    failed = cell(year, error=F.when(year.isNull(), "#N/A"))
    return load(spark, sf_dir, "papers").select(
        F.col("id").alias("k"), fx("ISBLANK", tagged).alias("blank_"), fx("ISNUMBER", tagged).alias("number_"), F.when(fx("ISNA", failed), "#N/A").otherwise("ok").alias("shown"), fx("IF", year > 2010, "new", "old").alias("if_"), fx("IFERROR", year, 0).alias("iferror_"), fx("NOT", year > 2010).alias("not_")
    )


@query()
def formula_roman(spark, sf_dir):
    n = F.col("p_partkey") % 4000
    return load(spark, sf_dir, "part").select("p_partkey", fx("ROMAN", n).alias("roman"), fx("ARABIC", fx("ROMAN", n)).alias("arabic"))


SQL["formula_roman"] = """SELECT p_partkey, concat(repeat('M', (n // 1000)::INT), [ '', 'C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n // 100 % 10 + 1], ['', 'X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n // 10 % 10 + 1], ['', 'I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1]) AS roman, n::INT AS arabic FROM (SELECT p_partkey, p_partkey % 4000 AS n FROM part)"""


@query("SELECT l_orderkey AS k, l_linenumber AS n, round(power(0.25::DOUBLE, l_linenumber), 9) AS mass FROM lineitem")
def formula_binomial(spark, sf_dir):
    n = F.col("l_linenumber")
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), _r(fx("BINOM.DIST", F.lit(0), n, 0.75, False)).alias("mass"))


# --- filters and sorts -------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'household')")
def filter_values(spark, sf_dir):
    return load(spark, sf_dir, "customer").filter(tables.value_filter("c_mktsegment", ["BUILDING", "household"])).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) = TIMESTAMP '1995-03-01'")
def filter_date_group(spark, sf_dir):
    return load(spark, sf_dir, "orders").filter(tables.date_group_filter("o_orderdate", "month", "1995-03-15")).select("o_orderkey")


@query("SELECT id FROM papers WHERE (pub_year > 2000 AND pub_year <= 2015) AND NOT coalesce(title ILIKE '%soil%', false) AND coalesce(title ILIKE 't%' OR title ILIKE 'e%', false)")
def filter_custom(spark, sf_dir):
    years = tables.two_clauses(tables.custom_filter("pub_year", "gt", 2000), tables.custom_filter("pub_year", "le", 2015))
    return load(spark, sf_dir, "papers").filter(years & tables.custom_filter("title", "not_contains", "soil") & tables.two_clauses(tables.custom_filter("title", "begins", "t"), tables.custom_filter("title", "begins", "e"), both=False)).select("id")


@query("SELECT id FROM papers WHERE pub_year IS DISTINCT FROM 2010")
def filter_not_equal(spark, sf_dir):
    return load(spark, sf_dir, "papers").filter(tables.custom_filter("pub_year", "ne", 2010)).select("id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, rank() OVER (ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 50")
def filter_top_n(spark, sf_dir):
    return tables.top_n(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 50)


@query("SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r, count(p_size) OVER () AS n FROM part) WHERE r <= ceil(n * 10 / 100.0)")
def filter_bottom_percent(spark, sf_dir):
    return tables.top_n(load(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 10, bottom=True, percent=True)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def filter_above_average(spark, sf_dir):
    return tables.average_filter(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("SELECT l_extendedprice AS value FROM lineitem ORDER BY l_extendedprice DESC LIMIT 1 OFFSET 9")
def kth_largest(spark, sf_dir):
    return tables.kth_largest(load(spark, sf_dir, "lineitem"), "l_extendedprice", 10)


@query("SELECT title, pub_year, id FROM papers ORDER BY lower(title), pub_year DESC NULLS LAST, id LIMIT 50")
def sort_spec(spark, sf_dir):
    return tables.sort_table(load(spark, sf_dir, "papers").select("title", "pub_year", "id"), "1 ASC, 2 DESC, 3 ASC").limit(50)


# --- totals, pivots ----------------------------------------------------------------------------------


@query("SELECT round(sum(o_totalprice), 2) AS o_totalprice, count(o_orderkey) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders")
def totals_row(spark, sf_dir):
    out = tables.totals_row(load(spark, sf_dir, "orders"), {"o_totalprice": "Sum", "o_orderkey": "Count", "o_orderdate": "Max"})
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_count(spark, sf_dir):
    out = tables.pivot(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_orderkey", "Count", ["F", "O", "P"])
    return out.na.fill(0, ["F", "O", "P"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS value, (grouping(l_returnflag) + grouping(l_linestatus))::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def pivot_rollup(spark, sf_dir):
    return tables.pivot_totals(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("value", F.round("value", 2))


@query("SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS value, (grouping(o_orderstatus) + grouping(o_orderpriority))::INT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def pivot_cube(spark, sf_dir):
    return tables.pivot_totals(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", "Count", cube=True)


def _grouped(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").cast("double").alias("n"))


for _how, _sql in (
    ("percent_of_row", "n / sum(n) OVER (PARTITION BY o_orderstatus)"),
    ("percent_of_column", "n / sum(n) OVER (PARTITION BY o_orderpriority)"),
    ("percent_of_total", "n / sum(n) OVER ()"),
    ("running_total", "sum(n) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)"),
    ("index", "n * sum(n) OVER () / (sum(n) OVER (PARTITION BY o_orderstatus) * sum(n) OVER (PARTITION BY o_orderpriority))"),
    ("difference_from_previous", "n - lag(n) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)"),
):
    QUERIES[f"pivot_{_how}"] = lambda spark, sf_dir, how=_how: tables.show_as(_grouped(spark, sf_dir), "o_orderstatus", "o_orderpriority", "n", how).withColumn("shown", F.round("shown", 9))
    SQL[f"pivot_{_how}"] = f"SELECT o_orderstatus, o_orderpriority, n, round({_sql}, 9) AS shown FROM (SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2)"


@query("SELECT p_partkey, metric, value FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) UNPIVOT (value FOR metric IN (p_size, p_retailprice))")
def unpivot_columns(spark, sf_dir):
    df = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return tables.unpivot(df, ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS sem, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1")
def group_description(spark, sf_dir):
    out = tables.group_description(load(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return out.select("c_mktsegment", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("sem", 6).alias("sem"), "min", "max")


# --- lookups and rules -------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_exact(spark, sf_dir):
    return tables.exact_lookup(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", load(spark, sf_dir, "nation"), "n_nationkey", ["n_name"], "n_nationkey")


@query("SELECT p_partkey, p_retailprice, (SELECT max(s_suppkey) FROM supplier WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier WHERE s_acctbal <= p_retailprice)) AS s_suppkey FROM part")
def lookup_as_of(spark, sf_dir):
    return tables.as_of_lookup(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", load(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey")


@query("SELECT p_partkey, p_retailprice, (SELECT max(s_suppkey) FROM supplier WHERE s_acctbal = (SELECT min(s_acctbal) FROM supplier WHERE s_acctbal >= p_retailprice)) AS s_suppkey FROM part")
def lookup_as_of_forward(spark, sf_dir):
    return tables.as_of_lookup(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", load(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey", forward=True)


@query("SELECT n_nationkey, n_name, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS position FROM nation")
def lookup_match(spark, sf_dir):
    return tables.match_position(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", load(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")


@query("SELECT min(p_partkey) AS position FROM part WHERE p_type ILIKE '%brass'")
def lookup_match_wildcard(spark, sf_dir):
    return tables.match_pattern(load(spark, sf_dir, "part"), "p_type", "*brass", "p_partkey")


@query(
    """SELECT p_partkey, p_size > 40 AS big, count(*) OVER (PARTITION BY p_size) = 1 AS single, p_size > avg(p_size) OVER () AS above, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 9) AS bar, least(floor((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE * 3), 2)::INT AS icon, rank() OVER (ORDER BY p_size DESC) <= 10 AS top FROM part"""
)
def classify_rows(spark, sf_dir):
    rules = {"big": ("cell_is", "gt", 40), "single": ("unique",), "above": ("above_average",), "bar": ("data_bar",), "icon": ("icon_set", 3), "top": ("top10", 10)}
    out = tables.classify(load(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", rules)
    return out.withColumn("bar", F.round("bar", 9)).drop("p_size")


@query("SELECT p_partkey, p_size BETWEEN 1 AND 25 AS ok_p_size, length(p_name) BETWEEN 5 AND 20 AS ok_p_name, p_brand IN ('Brand#11', 'Brand#12') AS ok_p_brand FROM part")
def validate_rows(spark, sf_dir):
    rules = {"p_size": ("whole", 1, 25), "p_name": ("text_length", 5, 20), "p_brand": ("list", ["Brand#11", "Brand#12"])}
    return tables.validate(load(spark, sf_dir, "part"), rules).select("p_partkey", "ok_p_size", "ok_p_name", "ok_p_brand")


@query("SELECT a.l_suppkey AS i, b.l_returnflag AS j, round(sum(a.v * b.v), 2) AS v FROM (SELECT l_suppkey, l_linenumber AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_linenumber AS k, l_returnflag, avg(l_tax) AS v FROM lineitem GROUP BY 1, 2) b USING (k) GROUP BY 1, 2")
def matrix_product(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    a = lines.groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = lines.groupBy(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("j")).agg(F.avg("l_tax").alias("v"))
    return tables.mmult(a, b).withColumn("v", F.round("v", 2))


@query("SELECT 'n_regionkey' AS key, " + ", ".join(f"max(n_regionkey) FILTER (n_name = 'NATION_{i}') AS \"NATION_{i}\"" for i in range(25)) + " FROM nation")
def transpose_table(spark, sf_dir):
    return tables.transpose(load(spark, sf_dir, "nation").select("n_name", "n_regionkey"), "n_name")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 4")
def slice_table(spark, sf_dir):
    return tables.slice_rows(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 5, 14)


@query("SELECT n_name, n_regionkey::VARCHAR AS extra FROM nation WHERE n_name LIKE '%1%' OR n_regionkey::VARCHAR LIKE '%1%'")
def search_cells(spark, sf_dir):
    df = load(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("extra"))
    return tables.search_cells(df, "1")


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey, NULL FROM region")
def append_table(spark, sf_dir):
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return tables.append_data(nations, load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")))


@query("SELECT p_partkey, contains(f, '/') AND NOT contains(upper(f), 'IFERROR(') AS risky FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '=A1/B1' WHEN p_size % 3 = 1 THEN '=IFERROR(A1/B1,0)' ELSE '=SUM(A1:A9)' END AS f FROM part)")
def audit_formulas(spark, sf_dir):
    f = F.expr("case when p_size % 3 = 0 then '=A1/B1' when p_size % 3 = 1 then '=IFERROR(A1/B1,0)' else '=SUM(A1:A9)' end")
    df = load(spark, sf_dir, "part").select("p_partkey", f.alias("f"))
    return df.select("p_partkey", tables.audit_formulas(df, "f").alias("risky"))

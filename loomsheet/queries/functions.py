"""Queries of spreadsheet functions that the other modules don't call, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsheet.functions.formula import cell
from loomsheet.functions.formula import formula as fx
from loomsheet.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _r(c, digits=9):
    return F.round(c, digits)


def _named(made: dict) -> list:
    return [c.alias(a) for a, c in made.items()]


@query(
    """SELECT p_partkey AS k, round(acos(u), 9) AS acos_, round(asin(u), 9) AS asin_, round(ln((1 + u) / (1 - u)) / 2, 9) AS atanh_, round(ln((1 + u) / (1 - u)) / 2, 9) AS fisher_, round(ln(u + sqrt(u * u + 1)), 9) AS asinh_, round(ln(v + sqrt(v * v - 1)), 9) AS acosh_,
    round(ln((v + 1) / (v - 1)) / 2, 9) AS acoth_, round(cos(v) / sin(v), 6) AS cot_, round(1 / sin(v), 6) AS csc_, round((exp(v) + exp(-v)) / (exp(v) - exp(-v)), 9) AS coth_, round(2 / (exp(v) - exp(-v)), 9) AS csch_, round(2 / (exp(v) + exp(-v)), 9) AS sech_, round(pi(), 9) AS pi_
    FROM (SELECT *, (p_size - 25.5::DOUBLE) / 26 AS u, p_size + 0.5::DOUBLE AS v FROM part)"""
)
def formula_inverses(spark, sf_dir):
    df = load(spark, sf_dir, "part").withColumn("u", (F.col("p_size") - 25.5) / 26).withColumn("v", F.col("p_size") + 0.5)
    u, v = F.col("u"), F.col("v")
    made = {"acos_": fx("ACOS", u), "asin_": fx("ASIN", u), "atanh_": fx("ATANH", u), "fisher_": fx("FISHER", u), "asinh_": fx("ASINH", u), "acosh_": fx("ACOSH", v), "acoth_": fx("ACOTH", v), "coth_": fx("COTH", v), "csch_": fx("CSCH", v), "sech_": fx("SECH", v), "pi_": fx("PI")}
    return df.select(F.col("p_partkey").alias("k"), _r(fx("COT", v), 6).alias("cot_"), _r(fx("CSC", v), 6).alias("csc_"), *_named({a: _r(c) for a, c in made.items()}))


@query(
    """SELECT p_partkey AS k, round(round(p_size / 8::DOUBLE, 1), 6) AS round_, round(p_size / 100::DOUBLE) * 100 AS hundreds, trunc(p_retailprice)::DOUBLE AS rounddown_, ceil(p_retailprice / 7) * 7 AS ceiling_math_, floor(p_retailprice / 7) * 7 AS floor_math_, p_size % 2 = 1 AS isodd_, ((p_size + 1) * p_size / 2)::DOUBLE AS combina_,
    coalesce(list_product(list_filter(range(1, p_size % 10 + 1), lambda x: x % 2 = p_size % 10 % 2)::DOUBLE[]), 1) AS factdouble_, (factorial((p_size % 5 + 3)::INT) / (factorial((p_size % 5)::INT) * 6))::DOUBLE AS multinomial_, round(x + 2 * power(x, 3) + 3 * power(x, 5), 9) AS seriessum_,
    list_sort([p_size, 10, p_partkey % 70], 'DESC')[2]::DOUBLE AS large_, true AS rand_, true AS between_ FROM (SELECT *, p_size / 50::DOUBLE AS x FROM part)"""
)
def formula_rounding(spark, sf_dir):
    n, price = F.col("p_size"), F.col("p_retailprice")
    made = {"round_": _r(fx("ROUND", n / 8, 1), 6), "hundreds": fx("ROUND", n, -2), "rounddown_": fx("ROUNDDOWN", price, 0), "ceiling_math_": fx("CEILING.MATH", price, 7), "floor_math_": fx("FLOOR.MATH", price, 7), "isodd_": fx("ISODD", n), "combina_": fx("COMBINA", n, 2), "factdouble_": fx("FACTDOUBLE", n % 10), "multinomial_": fx("MULTINOMIAL", n % 5, 3), "seriessum_": _r(fx("SERIESSUM", n / 50, 1, 2, F.array(F.lit(1), F.lit(2), F.lit(3)))), "large_": fx("LARGE", F.array(n.cast("double"), F.lit(10.0), (F.col("p_partkey") % 70).cast("double")), 2), "rand_": fx("RAND").between(0, 1), "between_": fx("RANDBETWEEN", 3, 7).between(3, 7)}
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *_named(made))


@query(
    """SELECT p_partkey AS k, round(4 * n - 6::DOUBLE, 6) AS mdeterm_, round(4 / (4 * n - 6::DOUBLE), 9) AS inverse_11, round(-3 / (4 * n - 6::DOUBLE), 9) AS inverse_21, (2 * n + 4)::DOUBLE AS product_12, 6::DOUBLE AS product_21, 3::DOUBLE AS transposed_12, 2::DOUBLE AS index_,
    CASE WHEN n >= 30 THEN 4 WHEN n >= 20 THEN 3 WHEN n >= 10 THEN 2 ELSE 1 END::INT AS match_, CASE n WHEN 10 THEN 2 WHEN 20 THEN 3 WHEN 30 THEN 4 WHEN 1 THEN 1 END::INT AS exact_, CASE WHEN n >= 30 THEN 'd' WHEN n >= 20 THEN 'c' WHEN n >= 10 THEN 'b' ELSE 'a' END AS vlookup_, CASE n WHEN 10 THEN 'b' WHEN 20 THEN 'c' WHEN 1 THEN 'a' WHEN 30 THEN 'd' END AS hlookup_,
    3::INT AS row_, 2::INT AS column_, 5::INT AS rows_, 3::INT AS columns_, p_name AS hyperlink_ FROM (SELECT *, p_size AS n FROM part)"""
)
def formula_matrices(spark, sf_dir):
    n = F.col("p_size").cast("double")

    def matrix(*rows):
        return F.array(*[F.array(*[F.lit(x).cast("double") if not hasattr(x, "cast") else x for x in r]) for r in rows])

    m = matrix((n, 2), (3, 4))
    keys = F.array(*[F.lit(x) for x in (1.0, 10.0, 20.0, 30.0)])
    table = F.array(*[F.struct(F.lit(float(x)).alias("key"), F.lit(name).alias("name")) for x, name in zip((1, 10, 20, 30), "abcd", strict=True)])
    wide = F.array(*[F.array(*[F.lit(str(x)) for x in row]) for row in (("1.0", "10.0", "20.0", "30.0"), "abcd")])

    def at(array, i, j):
        return F.get(F.get(array, F.lit(i)), F.lit(j))

    inverse, product = fx("MINVERSE", m), fx("MMULT", matrix((n, 1), (0, 2)), matrix((1, 2), (3, 4)))
    made = {"mdeterm_": _r(fx("MDETERM", m), 6), "inverse_11": _r(at(inverse, 0, 0)), "inverse_21": _r(at(inverse, 1, 0)), "product_12": at(product, 0, 1), "product_21": at(product, 1, 0), "transposed_12": at(fx("TRANSPOSE", m), 0, 1), "index_": fx("INDEX", m, 1, 2), "match_": fx("MATCH", n, keys), "exact_": fx("MATCH", n, keys, 0), "vlookup_": fx("VLOOKUP", n, table, "name"), "hlookup_": fx("HLOOKUP", n.cast("string"), wide, 2, False), "row_": fx("ROW", "B3:D7"), "column_": fx("COLUMN", "B3:D7"), "rows_": fx("ROWS", "B3:D7"), "columns_": fx("COLUMNS", "B3:D7"), "hyperlink_": fx("HYPERLINK", "x", F.col("p_name"))}
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *_named(made))


@query(
    """SELECT o_orderkey AS k, make_date(year(d), month(d), 1) + INTERVAL 1 MONTH + INTERVAL 14 DAY AS date_, date_sub('year', a, d)::DOUBLE AS years, date_sub('month', a, d)::DOUBLE AS months, date_diff('day', a, d)::DOUBLE AS days, (date_sub('month', a, d) % 12)::DOUBLE AS ym,
    ((year(d) - 1990) * 360 + (month(d) - 5) * 30 + day(d) - 17)::INT AS days360_, ((year(d) - 1990) * 360 + (month(d) - 5) * 30 + least(day(d), 30) - 17)::INT AS european, (floor((dayofyear(d) - 1 + isodow(date_trunc('year', d)) % 7) / 7) + 1)::BIGINT AS weeknum_, CASE isodow(d) WHEN 6 THEN d + 13 WHEN 7 THEN d + 12 ELSE d + 14 END AS workday_,
    round(date_diff('day', a, d) / 360, 9) AS frac_2, round(date_diff('day', a, d) / 365, 9) AS frac_3, round(abs((year(d) - 1990) * 360 + (month(d) - 5) * 30 + day(d) - 17) / 360, 9) AS frac_0, round((month(d) * 3600 + 1815) / 86400, 9) AS time_, round((month(d) * 3600 + 60 * day(d)) / 86400, 9) AS timevalue_, true AS now_
    FROM (SELECT *, o_orderdate::DATE AS d, DATE '1990-05-17' AS a FROM orders)"""
)
def formula_calendar(spark, sf_dir):
    d, a = F.col("o_orderdate").cast("date"), F.lit("1990-05-17").cast("date")
    made = {"date_": fx("DATE", F.year(d), F.month(d) + 1, 15).cast("timestamp"), "years": fx("DATEDIF", a, d, "Y"), "months": fx("DATEDIF", a, d, "M"), "days": fx("DATEDIF", a, d, "D"), "ym": fx("DATEDIF", a, d, "YM"), "days360_": fx("DAYS360", a, d), "european": fx("DAYS360", a, d, True), "weeknum_": fx("WEEKNUM", d), "workday_": fx("WORKDAY", d, 10), "frac_2": _r(fx("YEARFRAC", a, d, 2)), "frac_3": _r(fx("YEARFRAC", a, d, 3)), "frac_0": _r(fx("YEARFRAC", a, d)), "time_": _r(fx("TIME", F.month(d), 30, 15)), "timevalue_": _r(fx("TIMEVALUE", F.concat_ws(":", F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.dayofmonth(d).cast("string"), 2, "0")))), "now_": fx("NOW") >= fx("TODAY").cast("timestamp")}
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), *_named(made))


@query("SELECT c_custkey AS k, round(-c_acctbal * 0.01, 6) AS first_interest FROM customer")
def formula_interest(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _r(fx("IPMT", 0.01, 1, 12, F.col("c_acctbal")), 6).alias("first_interest"))


@query(
    """SELECT id AS k, pub_year IS NULL OR pub_year < 2000 AS iserror_, pub_year IS NOT NULL AND pub_year < 2000 AS iserr_, CASE WHEN pub_year IS NULL THEN 7 WHEN pub_year < 2000 THEN 2 END::INT AS error_type_, CASE WHEN pub_year IS NULL OR pub_year < 2000 THEN 16 ELSE 1 END::INT AS type_, journal IS NOT NULL AS istext_, journal IS NULL AS isnontext_, coalesce(journal, '') AS t_,
    CASE WHEN pub_year IS NULL OR pub_year < 2000 THEN NULL ELSE pub_year END::DOUBLE AS n_, open_access IS NOT NULL AS islogical_, true AS isref_, true AS na_, coalesce(pub_year > 2000 AND citation_count > 5, pub_year > 2000, citation_count > 5) AS and_, coalesce(pub_year > 2000 OR citation_count > 5, pub_year > 2000, citation_count > 5) AS or_, true AS true_, false AS false_
    FROM papers"""
)
def formula_kinds(spark, sf_dir):
    year = F.col("pub_year")
    failed = cell(year, error=F.when(year.isNull(), "#N/A").when(year < 2000, "#DIV/0!"))
    text = cell(F.col("journal"), "text")
    recent, cited = year > 2000, F.col("citation_count") > 5
    made = {"iserror_": fx("ISERROR", failed), "iserr_": fx("ISERR", failed), "error_type_": fx("ERROR.TYPE", failed), "type_": fx("TYPE", failed), "istext_": fx("ISTEXT", text), "isnontext_": fx("ISNONTEXT", text), "t_": fx("T", text), "n_": fx("N", failed), "islogical_": fx("ISLOGICAL", cell(F.when(F.col("open_access").isNotNull(), True), "logical")), "isref_": fx("ISREF", "A1:B2"), "na_": fx("ISNA", fx("NA")), "and_": fx("AND", recent, cited), "or_": fx("OR", recent, cited), "true_": fx("TRUE"), "false_": fx("FALSE")}
    return load(spark, sf_dir, "papers").select(F.col("id").alias("k"), *_named(made))


@query(
    """SELECT l_returnflag AS g, round(stddev_samp(q), 6) AS stdev_s, round(stddev_pop(q), 6) AS stdevp_, round(var_samp(q), 5) AS var_s, round(var_pop(q), 5) AS var_p, round(stddev_samp(m), 6) AS stdeva_, round(stddev_pop(m), 6) AS stdevpa_, round(var_samp(m), 5) AS vara_, round(var_pop(m), 5) AS varpa_, round(avg(m), 6) AS averagea_, count(c) AS counta_, max(m) AS maxa_, min(m) AS mina_
    FROM (SELECT *, l_quantity AS q, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END AS m, CASE WHEN l_linenumber = 1 THEN 'x' WHEN l_linenumber < 7 THEN l_quantity::VARCHAR END AS c FROM lineitem) GROUP BY 1"""
)
def formula_spread(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    mixed = F.when(n == 1, "x").otherwise(q.cast("string"))
    made = {"stdev_s": _r(fx("STDEV.S", q), 6), "stdevp_": _r(fx("STDEVP", q), 6), "var_s": _r(fx("VAR.S", q), 5), "var_p": _r(fx("VAR.P", q), 5), "stdeva_": _r(fx("STDEVA", mixed), 6), "stdevpa_": _r(fx("STDEVPA", mixed), 6), "vara_": _r(fx("VARA", mixed), 5), "varpa_": _r(fx("VARPA", mixed), 5), "averagea_": _r(fx("AVERAGEA", mixed), 6), "counta_": fx("COUNTA", F.when(n < 7, mixed)), "maxa_": fx("MAXA", mixed), "mina_": fx("MINA", mixed)}
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(*_named(made))


@query("SELECT l_orderkey AS k, round(product(l_quantity::DOUBLE), 2) AS product_ FROM lineitem GROUP BY 1")
def formula_product(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(_r(fx("PRODUCT", F.col("l_quantity")), 2).alias("product_"))


@query(
    """SELECT p_partkey AS k, 'AB ' || p_name AS asc_, chr(64 + p_size % 26) AS char_, p_name AS clean_, p_name || p_brand AS concatenate_, '$' || format('{:,.2f}', p_retailprice) AS dollar_, p_size + 1000.5::DOUBLE AS numbervalue_, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS proper_,
    nullif(instr(lower(p_name), 'e'), 0)::INT AS search_, p_name || ' ' || p_brand AS trim_, round(comb * power(0.25::DOUBLE, p_size % 4) * power(0.75::DOUBLE, 4 - p_size % 4), 9) AS binomdist_ FROM (SELECT *, [1, 4, 6, 4][p_size % 4 + 1] AS comb FROM part)"""
)
def formula_words(spark, sf_dir):
    name, n = F.col("p_name"), F.col("p_size")
    made = {"asc_": fx("ASC", F.concat(F.lit("ＡＢ　"), name)), "char_": fx("CHAR", n % 26 + 64), "clean_": fx("CLEAN", F.concat(F.lit("\x07"), name, F.lit("\x1f"))), "concatenate_": fx("CONCATENATE", name, F.col("p_brand")), "dollar_": fx("DOLLAR", F.col("p_retailprice")), "numbervalue_": fx("NUMBERVALUE", F.concat(F.lit("1."), F.lpad(n.cast("string"), 3, "0"), F.lit(",5")), ",", "."), "proper_": fx("PROPER", name), "search_": fx("SEARCH", "E", name), "trim_": fx("TRIM", F.concat(F.lit("  "), name, F.lit("   "), F.col("p_brand"), F.lit(" "))), "binomdist_": _r(fx("BINOMDIST", n % 4, 4, 0.25, False))}
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *_named(made))

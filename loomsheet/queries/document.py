"""Queries of the document engine: its SQL, functions, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.operators.fluent import Collection, all_of, any_in, any_of, between, contains, eq, gt, gte, isin, lt, negate, starts_with
from loomsheet.plans.docsql import Database
from loomsheet.session import load

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "papers", "relationships", "runs", "registered_files", "word_texts", "paragraph_audits")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def database(spark: SparkSession, sf_dir: str) -> Database:
    return Database(spark, {t: load(spark, sf_dir, t) for t in TABLES})


def docsql(name: str, text: str, sql: str, **parameters) -> None:
    QUERIES[name] = lambda spark, sf_dir: database(spark, sf_dir).execute(text, parameters)
    SQL[name] = sql


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- projection, filter, sort, limit, group ----------------------------------------------------------

docsql(
    "docsql_group",
    "SELECT { status: @key, n: COUNT(*), total: ROUND(SUM(*.o_totalprice), 2) } FROM orders WHERE $.o_totalprice > 1000 GROUP BY $.o_orderstatus",
    "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1",
)
docsql("docsql_scan", "SELECT $ FROM nation", "SELECT * FROM nation")
docsql("docsql_seek", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 37", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 37")
docsql("docsql_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ['building', 'MACHINERY']", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
docsql("docsql_range", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20")
docsql("docsql_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9")
docsql("docsql_like_prefix", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 's%'")
docsql("docsql_like_inner", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bol_'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%bol_'")
docsql("docsql_not_equal", "SELECT n_name FROM nation WHERE n_regionkey != 2", "SELECT n_name FROM nation WHERE n_regionkey IS DISTINCT FROM 2")
docsql("docsql_null_order", "SELECT id, pub_year FROM papers WHERE pub_year < 2005", "SELECT id, pub_year FROM papers WHERE pub_year IS NULL OR pub_year < 2005")
docsql("docsql_null_equal", "SELECT id FROM papers WHERE pub_year = NULL", "SELECT id FROM papers WHERE pub_year IS NULL")
docsql(
    "docsql_order_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5",
)
docsql("docsql_order_nulls", "SELECT id, pub_year FROM papers ORDER BY pub_year, id LIMIT 40", "SELECT id, pub_year FROM papers ORDER BY pub_year NULLS FIRST, id LIMIT 40")
docsql(
    "docsql_having",
    "SELECT { customer: @key, n: COUNT(*), most: MAX(*.o_totalprice) } FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "SELECT o_custkey AS customer, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1 HAVING count(*) > 12",
)
docsql(
    "docsql_global",
    "SELECT { n: COUNT(*), least: MIN(*.l_quantity), most: MAX(*.l_quantity), mean: ROUND(AVG(*.l_quantity), 6), has: ANY(*) } FROM lineitem",
    'SELECT count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean, count(*) > 0 AS has FROM lineitem',
)
docsql("docsql_empty_sum", "SELECT { s: SUM(*.c_acctbal), a: AVG(*.c_acctbal) } FROM customer WHERE c_custkey < 0", "SELECT 0.0::DOUBLE AS s, 0.0::DOUBLE AS a")
docsql("docsql_no_source", "SELECT { a: 1 + 2 * 3, b: 'x' + 1, c: 7 / 2, d: 7 % 4 }", "SELECT 7 AS a, 'x1' AS b, 3.5::DOUBLE AS c, 3 AS d")
docsql(
    "docsql_subquery",
    "SELECT { status: @key, n: COUNT(*) } FROM $query('SELECT o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000') GROUP BY o_orderstatus",
    "SELECT o_orderstatus AS status, count(*) AS n FROM (SELECT * FROM orders WHERE o_totalprice > 100000) GROUP BY 1",
)
docsql("docsql_parameters", "SELECT c_custkey FROM customer WHERE c_acctbal > @low AND c_mktsegment = @segment", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND lower(c_mktsegment) = 'building'", low=5000, segment="Building")
docsql("docsql_catalog", "SELECT name FROM $cols", "SELECT unnest(['region','nation','customer','supplier','part','orders','lineitem','events','documents','papers','relationships','runs','registered_files','word_texts','paragraph_audits']) AS name")
docsql(
    "docsql_arithmetic",
    "SELECT { k: l_orderkey, n: l_linenumber, price: l_extendedprice * (1 - l_discount), half: l_quantity / 2, rest: l_partkey % 7 } FROM lineitem WHERE l_quantity > 40",
    "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice * (1 - l_discount) AS price, l_quantity / 2 AS half, l_partkey % 7 AS rest FROM lineitem WHERE l_quantity > 40",
)

# --- arrays ------------------------------------------------------------------------------------------

docsql(
    "docsql_array_items",
    "SELECT { id: id, n: COUNT(inputs[*]), first: inputs[0], last: inputs[-1], top: LENGTH(TOP(inputs, 2)) } FROM runs",
    "SELECT id, coalesce(len(inputs), -1)::BIGINT AS n, inputs[1] AS first, inputs[-1] AS last, coalesce(least(len(inputs), 2), -1)::INT AS top FROM runs WHERE inputs IS NOT NULL",
)
docsql("docsql_any", "SELECT id FROM runs WHERE inputs[*] ANY LIKE '64%'", "SELECT id FROM runs WHERE len(list_filter(inputs, lambda x: x LIKE '64%')) > 0")
docsql("docsql_all", "SELECT word_id FROM word_texts WHERE paragraphs[*] ALL != ''", "SELECT word_id FROM word_texts WHERE paragraphs IS NULL OR len(list_filter(paragraphs, lambda x: x = '')) = 0")
docsql(
    "docsql_map_filter",
    "SELECT { id: word_id, sizes: SUM(MAP(paragraphs[*] => LENGTH(@))), long: COUNT(FILTER(paragraphs[*] => LENGTH(@) > 100)) } FROM word_texts WHERE paragraphs != NULL",
    "SELECT word_id AS id, coalesce(list_sum(list_transform(paragraphs, lambda x: length(x))), 0)::DOUBLE AS sizes, len(list_filter(paragraphs, lambda x: length(x) > 100))::BIGINT AS long FROM word_texts WHERE paragraphs IS NOT NULL",
)
docsql(
    "docsql_sort_items",
    "SELECT { id: id, sorted: JOIN(SORT(inputs[*] => @), ',') } FROM runs WHERE inputs != NULL",
    "SELECT id, array_to_string(list_sort(inputs), ',') AS sorted FROM runs WHERE inputs IS NOT NULL",
)
docsql(
    "docsql_sequences",
    "SELECT { id: id, u: LENGTH(UNION(inputs, outputs)), e: LENGTH(EXCEPT(inputs, outputs)), c: LENGTH(CONCAT(inputs, outputs)), d: LENGTH(DISTINCT(inputs)) } FROM runs WHERE inputs != NULL AND outputs != NULL",
    "SELECT id, len(list_distinct(list_concat(inputs, outputs)))::INT AS u, len(list_distinct(list_filter(inputs, lambda x: NOT list_contains(outputs, x))))::INT AS e, (len(inputs) + len(outputs))::INT AS c, len(list_distinct(inputs))::INT AS d FROM runs WHERE inputs IS NOT NULL AND outputs IS NOT NULL",
)
docsql("docsql_struct_path", "SELECT { id: audit_id, font: para_format.font_ascii, bold: para_format.bold } FROM paragraph_audits WHERE para_format.bold = true", "SELECT audit_id AS id, para_format.font_ascii AS font, para_format.bold AS bold FROM paragraph_audits WHERE para_format.bold")

# --- functions ---------------------------------------------------------------------------------------

docsql(
    "docfn_text",
    "SELECT { k: p_partkey, up: UPPER(p_name), low: LOWER(p_brand), at: INDEXOF(p_name, 'e'), from3: INDEXOF(p_name, 'e', 3), mid: SUBSTRING(p_name, 2, 4), rest: SUBSTRING(p_name, 3), rep: REPLACE(p_name, 'e', '#'), left: LPAD(p_brand, 12, '*'), right: RPAD(p_brand, 12, '.'), n: LENGTH(p_name), t: TRIM('  x '), words: LENGTH(SPLIT(p_type, ' ')) } FROM part",
    "SELECT p_partkey AS k, upper(p_name) AS up, lower(p_brand) AS low, (instr(p_name, 'e') - 1)::INT AS at, (CASE WHEN instr(substr(p_name, 4), 'e') = 0 THEN -1 ELSE instr(substr(p_name, 4), 'e') + 2 END)::INT AS from3, substr(p_name, 3, 4) AS mid, substr(p_name, 4) AS rest, replace(p_name, 'e', '#') AS rep, CASE WHEN length(p_brand) < 12 THEN lpad(p_brand, 12, '*') ELSE p_brand END AS left, CASE WHEN length(p_brand) < 12 THEN rpad(p_brand, 12, '.') ELSE p_brand END AS right, length(p_name)::INT AS n, 'x' AS t, len(list_filter(string_split(p_type, ' '), lambda x: x <> ''))::INT AS words FROM part",
)
docsql(
    "docfn_match",
    "SELECT { id: event_id, hit: IS_MATCH(event_type, '^[a-c]'), head: MATCH(event_type, '^(.)(.*)$', 1) } FROM events",
    "SELECT event_id AS id, regexp_matches(event_type, '^[a-c]') AS hit, regexp_extract(event_type, '^(.)(.*)$', 1) AS head FROM events",
)
docsql(
    "docfn_dates",
    "SELECT { k: o_orderkey, y: YEAR(o_orderdate), m: MONTH(o_orderdate), d: DAY(o_orderdate), h: HOUR(o_orderdate), n: MINUTE(o_orderdate), s: SECOND(o_orderdate), next: DATEADD('M', 1, o_orderdate), soon: DATEADD('d', 10, o_orderdate), diff: DATEDIFF('d', DATETIME(1995, 1, 1), o_orderdate), text: FORMAT(o_orderdate, 'yyyy/MM') } FROM orders",
    "SELECT o_orderkey AS k, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, hour(o_orderdate)::INT AS h, minute(o_orderdate)::INT AS n, second(o_orderdate)::INT AS s, o_orderdate + INTERVAL 1 MONTH AS next, o_orderdate + INTERVAL 10 DAY AS soon, trunc(epoch(o_orderdate - TIMESTAMP '1995-01-01') / 86400)::INT AS diff, strftime(o_orderdate, '%Y/%m') AS text FROM orders",
)
docsql(
    "docfn_casts",
    "SELECT { k: event_id, i: INT32('12'), bad: INT32('x'), l: INT64(value), d: DOUBLE('1.5'), c: DOUBLE('1.234,5', 'de-DE'), s: STRING(user_id), b: BOOLEAN('true'), r: ROUND(value, 1), a: ABS(value), p: POW(2, 10), z: COALESCE(props, ''), q: IIF(value > 50, 'hi', 'lo') } FROM events",
    "SELECT event_id AS k, 12 AS i, CAST(NULL AS INT) AS bad, trunc(value)::BIGINT AS l, 1.5::DOUBLE AS d, 1234.5::DOUBLE AS c, user_id::VARCHAR AS s, true AS b, round_even(value, 1) AS r, abs(value) AS a, 1024.0::DOUBLE AS p, coalesce(props, '') AS z, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS q FROM events",
)
docsql(
    "docfn_types",
    "SELECT { id: id, n: IS_NULL(pub_year), i: IS_INT32(pub_year), s: IS_STRING(title), b: IS_NUMBER(citation_count), t: IS_DATETIME(imported_at), d: IS_DOCUMENT(title), g: IS_GUID(title) } FROM papers",
    "SELECT id, pub_year IS NULL AS n, pub_year IS NOT NULL AS i, title IS NOT NULL AS s, citation_count IS NOT NULL AS b, imported_at IS NOT NULL AS t, false AS d, false AS g FROM papers",
)
docsql(
    "docfn_ids",
    "SELECT { id: OBJECTID(id), bad: OBJECTID('zz'), at: OID_CREATIONTIME(id) } FROM registered_files",
    "SELECT id, CAST(NULL AS VARCHAR) AS bad, to_timestamp(('0x' || substr(id, 1, 8))::BIGINT) AS at FROM registered_files",
)
docsql(
    "docfn_first_last",
    "SELECT { u: @key, n: COUNT(*), kinds: LENGTH(DISTINCT(*.event_type)), all: LENGTH(ARRAY(*.event_id)) } FROM events GROUP BY user_id",
    "SELECT user_id AS u, count(*) AS n, count(DISTINCT event_type)::INT AS kinds, count(*)::INT AS all FROM events GROUP BY 1",
)


docsql(
    "docfn_values",
    "SELECT { k: o_orderkey, f: FIRST([o_custkey, 1]), l: LAST([1, o_custkey]), lt: LTRIM(' a '), rt: RTRIM(' a '), i: INT(o_custkey), g: LONG(o_custkey), b: BOOL('true'), d: DOUBLE(DECIMAL('12.5')), r: RANDOM() >= 0, s: RANDOM(3, 7) >= 3 } FROM orders",
    "SELECT o_orderkey AS k, o_custkey AS f, o_custkey AS l, 'a ' AS lt, ' a' AS rt, o_custkey::INT AS i, o_custkey::BIGINT AS g, true AS b, 12.5::DOUBLE AS d, true AS r, true AS s FROM orders",
)
docsql(
    "docfn_kinds",
    "SELECT { k: o_orderkey, long: IS_INT64(LONG(o_custkey)), long2: IS_LONG(INT(o_custkey)), int: IS_INT(INT(o_custkey)), double: IS_DOUBLE(o_totalprice), dec: IS_DECIMAL(DECIMAL('1.5')), arr: IS_ARRAY([1, 2]), bin: IS_BINARY(o_comment), oid: IS_OBJECTID(o_custkey), bool: IS_BOOLEAN(1 = 1), bool2: IS_BOOL(o_custkey), date: IS_DATE(o_orderdate), low: IS_MINVALUE(MINVALUE()), high: IS_MAXVALUE(o_custkey), doc: IS_DOCUMENT({ a: 1 }) } FROM orders",
    "SELECT o_orderkey AS k, true AS long, false AS long2, true AS int, true AS double, true AS dec, true AS arr, false AS bin, false AS oid, true AS bool, false AS bool2, true AS date, true AS low, false AS high, true AS doc FROM orders",
)
docsql(
    "docfn_times",
    "SELECT { k: o_orderkey, later: NOW() > o_orderdate, utc: NOW_UTC() > o_orderdate, today: TODAY() > o_orderdate, y: YEAR(DATE(2020, 2, 3)), m: MONTH(DATE_UTC(2020, 2, 3)), d: DAY(DATETIME_UTC(2020, 2, 3)), same: TO_UTC(TO_LOCAL(o_orderdate)) = o_orderdate, text: YEAR(DATE('2021-05-06')), text2: YEAR(DATETIME_UTC('2021-05-06')) } FROM orders",
    "SELECT o_orderkey AS k, true AS later, true AS utc, true AS today, 2020::INT AS y, 2::INT AS m, 3::INT AS d, true AS same, 2021::INT AS text, 2021::INT AS text2 FROM orders",
)
docsql(
    "docfn_documents",
    "SELECT { k: o_orderkey, items: COUNT(ITEMS([o_custkey, 2, 3])), names: JOIN(KEYS({ a: o_custkey, b: 2 }), '-'), sum: SUM(VALUES({ a: o_custkey, b: 2 })), more: EXTEND({ a: 1 }, { b: o_custkey }).b } FROM orders",
    "SELECT o_orderkey AS k, 3::BIGINT AS items, 'a-b' AS names, (o_custkey + 2)::DOUBLE AS sum, o_custkey AS more FROM orders",
)


@query("SELECT (json_extract_string(props, '$.k'))::VARCHAR AS k, count(*) AS n FROM events GROUP BY 1")
def docfn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path into semi-structured text, by VARIANT."""
    doc = load(spark, sf_dir, "events").select(F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))
    return doc.groupBy("k").agg(F.count("*").alias("n"))


# --- changes -----------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS s, count(*) AS n, round(sum(CASE WHEN o_totalprice > 200000 THEN 0 ELSE o_totalprice END), 2) AS t FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def docsql_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.execute("UPDATE orders SET o_totalprice = 0.0 WHERE o_totalprice > 200000")
    db.execute("DELETE orders WHERE o_orderstatus = 'P'")
    return db.execute("SELECT { s: @key, n: COUNT(*), t: ROUND(SUM(*.o_totalprice), 2) } FROM orders GROUP BY o_orderstatus")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (90, 'North'), (91, 'South')) t(r_regionkey, r_name)")
def docsql_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.execute("INSERT INTO region VALUES { r_regionkey: 90, r_name: 'North' }, { r_regionkey: 91, r_name: 'South' }")
    return db.execute("SELECT r_regionkey, r_name FROM region")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def docsql_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.execute("SELECT n_name, n_regionkey INTO picked : int FROM nation WHERE n_regionkey = 1")
    return db.execute("SELECT n_name, n_regionkey FROM picked")


@query("SELECT c_custkey AS _id, CASE WHEN c_custkey <= 10 THEN 'new' ELSE c_name END AS name FROM customer")
def docsql_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.tables["c"] = db.tables["customer"].select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"))
    db.upsert("c", db.tables["c"].filter("_id <= 10").withColumn("name", F.lit("new")))
    return db.execute("SELECT $ FROM c")


# --- references and set operations -------------------------------------------------------------------


@query("SELECT c_custkey, n_name AS nation, n_nationkey IS NULL AS missing FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def include_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INCLUDE: references dereferenced by a join, a dangling one marked missing."""
    db = database(spark, sf_dir)
    db.tables["n"] = db.tables["nation"].select(F.col("n_nationkey").alias("_id"), "n_name")
    df = db.tables["customer"].select("c_custkey", F.struct(F.col("c_nationkey").alias("id"), F.lit("n").alias("coll")).alias("ref"))
    out = db.include(df, "ref", "n")
    return out.select("c_custkey", F.col("ref.n_name").alias("nation"), F.col("ref.missing").alias("missing"))


@query("SELECT r.id, string_agg(coalesce(f.file_name, '?'), '|' ORDER BY r.pos) AS files FROM (SELECT id, unnest(inputs) AS fid, generate_subscripts(inputs, 1) AS pos FROM (SELECT DISTINCT id, inputs FROM runs)) r LEFT JOIN registered_files f ON f.id = r.fid GROUP BY r.id UNION ALL SELECT DISTINCT id, CASE WHEN inputs IS NULL THEN NULL ELSE NULL END FROM runs WHERE inputs IS NULL OR len(inputs) = 0")
def include_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INCLUDE of an array of references, in its order."""
    db = database(spark, sf_dir)
    db.tables["f"] = db.tables["registered_files"].select(F.col("id").alias("_id"), "file_name")
    refs = F.transform("inputs", lambda x: F.struct(x.alias("id"), F.lit("f").alias("coll")))
    df = db.tables["runs"].select("id", refs.alias("files")).distinct()
    return db.include(df, "files", "f").select("id", F.array_join(F.transform("files", lambda x: F.coalesce(x["file_name"], F.lit("?"))), "|").alias("files"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT DISTINCT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def set_concat(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(load(spark, sf_dir, "customer").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def set_except(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(load(spark, sf_dir, "supplier").select("s_suppkey"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(load(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def set_distinct(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").distinct()


# --- fluent ------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer WHERE lower(c_mktsegment) = 'building' AND c_acctbal > 100 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 3")
def fluent_query(spark, sf_dir):
    c = Collection(load(spark, sf_dir, "customer"))
    return c.query().where(eq("c_mktsegment", "Building")).where(gt("c_acctbal", 100)).order_by_descending("c_acctbal", "c_custkey").skip(3).limit(20).select("c_custkey", "c_acctbal").to_documents()


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 10")
def fluent_group(spark, sf_dir):
    return Collection(load(spark, sf_dir, "orders")).query().group_by("o_custkey").having("COUNT(*) >= 10").select("@key AS key", "COUNT(*) AS n").to_documents()


@query(
    "SELECT p_partkey FROM part WHERE (starts_with(lower(p_name), 'b') OR contains(lower(p_type), 'tin')) AND p_size BETWEEN 3 AND 30 AND p_size IN (4, 5, 6, 20, 21) AND p_size < 21 AND p_size >= 4 AND lower(p_brand) <> 'brand#11'"
)
def fluent_builders(spark, sf_dir):
    q = all_of(any_of(starts_with("p_name", "B"), contains("p_type", "TIN")), between("p_size", 3, 30), isin("p_size", [4, 5, 6, 20, 21]), lt("p_size", 21), gte("p_size", 4), negate("p_brand", "Brand#11"))
    return Collection(load(spark, sf_dir, "part")).find(q).select("p_partkey")


@query("SELECT id FROM runs WHERE list_contains(list_transform(inputs, lambda x: substr(x, 1, 2)), '64')")
def fluent_any(spark, sf_dir):
    return Collection(load(spark, sf_dir, "runs")).find(any_in("inputs", "LIKE", "64%")).select("id")


@query("SELECT count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def fluent_scalars(spark, sf_dir):
    return Collection(load(spark, sf_dir, "orders")).summary("o_totalprice")


SQL["docsql_array_items"] = "SELECT id, coalesce(len(inputs), 0)::BIGINT AS n, inputs[1] AS first, inputs[-1] AS last, coalesce(least(len(inputs), 2), 0)::INT AS top FROM runs"

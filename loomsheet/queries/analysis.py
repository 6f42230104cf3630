"""Queries of series, statistics, search, store, vectors, space, graphs, text rules, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsheet.operators import graph, search, series, spatial, stats, store, textrules, vector
from loomsheet.session import load, scratch
from loomsheet.sources import files
from loomsheet.streaming import operators as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- series ------------------------------------------------------------------------------------------

_EVENTS = "SELECT *, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, CASE WHEN rn > 5 THEN round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) END AS moving_average FROM ({_EVENTS})")
def series_moving_average(spark, sf_dir):
    out = series.moving_average(load(spark, sf_dir, "events"), "value", 5, ["ts", "event_id"], ["user_id"])
    return _round(out.select("event_id", "moving_average"), 6, "moving_average")


@query(f"SELECT event_id, CASE WHEN rn > 5 THEN round(stddev_samp(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 5) END AS moving_deviation FROM ({_EVENTS})")
def series_moving_deviation(spark, sf_dir):
    out = series.moving_deviation(load(spark, sf_dir, "events"), "value", 5, ["ts", "event_id"], ["user_id"])
    return _round(out.select("event_id", "moving_deviation"), 5, "moving_deviation")


@query(
    f"SELECT event_id, round(m, 5) AS band_mean, round(m - 2 * s, 5) AS band_low, round(m + 2 * s, 5) AS band_high FROM (SELECT event_id, CASE WHEN rn > 5 THEN avg(value) OVER v END AS m, CASE WHEN rn > 5 THEN stddev_samp(value) OVER v END AS s FROM ({_EVENTS}) WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING))"
)
def series_bollinger(spark, sf_dir):
    out = series.bollinger(load(spark, sf_dir, "events"), "value", 5, ["ts", "event_id"], ["user_id"])
    return _round(out.select("event_id", "band_mean", "band_low", "band_high"), 5, "band_mean", "band_low", "band_high")


@query("SELECT r.o_orderkey AS range_id, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM orders r JOIN lineitem l ON l.l_orderkey BETWEEN r.o_orderkey AND r.o_orderkey + 2500 GROUP BY 1")
def series_range_extremes(spark, sf_dir):
    ranges = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("range_id"), F.col("o_orderkey").alias("first"), (F.col("o_orderkey") + 2500).alias("last"))
    return series.range_extremes(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", ranges, 500)


@query(
    "SELECT event_id, count(value) OVER w AS held, min(value) OVER w AS lo, max(value) OVER w AS hi, min(value) OVER p AS all_lo, max(value) OVER p AS all_hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
)
def series_ring_buffer(spark, sf_dir):
    return series.ring_buffer(load(spark, sf_dir, "events"), "value", 10, ["ts", "event_id"], ["user_id"]).select("event_id", "held", "lo", "hi", "all_lo", "all_hi")


@query("SELECT doc_id FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)) WHERE used <= 40000")
def series_budget(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return series.within_budget(docs, "text", [F.desc("n_chars"), F.asc("doc_id")], 40_000, 50).select("doc_id")


# --- statistics --------------------------------------------------------------------------------------


@query(
    "SELECT count(value) AS n, round(sum(value), 2) AS sum, round(avg(value), 6) AS mean, median(value) AS median, round(var_samp(value), 4) AS variance, round(var_pop(value), 4) AS variance_p, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sd_p, round(stddev_samp(value) / sqrt(count(value)), 6) AS stderr, min(value) AS min, max(value) AS max FROM events"
)
def stats_describe(spark, sf_dir):
    out = _round(stats.describe(load(spark, sf_dir, "events"), "value"), 6, "mean", "sd", "sd_p", "stderr")
    return _round(_round(out, 4, "variance", "variance_p"), 2, "sum")


@query("SELECT l_extendedprice AS value FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET (SELECT floor(count(*) * 0.9)::BIGINT FROM lineitem)")
def stats_percentile(spark, sf_dir):
    return stats.percentile(load(spark, sf_dir, "lineitem"), "l_extendedprice", 90)


@query("SELECT s[1] AS low, s[(n // 4) + 1] AS q1, s[(n // 2) + 1] AS median, s[(n * 3 // 4) + 1] AS q3, s[n] AS high FROM (SELECT list(o_totalprice ORDER BY o_totalprice) AS s, count(*) AS n FROM orders)")
def stats_box_plot(spark, sf_dir):
    return stats.box_plot(load(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "SELECT bin, lower, count, round(count / sum(count) OVER (), 9) AS probability, round(count / max(count) OVER (), 9) AS peak_share, sum(count) OVER (ORDER BY bin)::BIGINT AS cumulative FROM (SELECT r.bin::INT AS bin, r.bin * 5.0::DOUBLE AS lower, count(l.b) AS count FROM range(10) r(bin) LEFT JOIN (SELECT least(floor(l_quantity / 5), 9) AS b FROM lineitem WHERE l_quantity BETWEEN 0 AND 50) l ON l.b = r.bin GROUP BY 1, 2)"
)
def stats_histogram(spark, sf_dir):
    return _round(stats.histogram(load(spark, sf_dir, "lineitem"), "l_quantity", 0, 50, 10), 9, "probability", "peak_share")


@query("SELECT g AS at, round(avg(CASE WHEN abs((g - p_size) / 5.0) <= 1 THEN 0.75 * (1 - power((g - p_size) / 5.0, 2)) ELSE 0 END) / 5.0, 9) AS density FROM part, (SELECT unnest([5.0, 15.0, 25.0, 35.0, 45.0])::DOUBLE AS g) GROUP BY 1")
def stats_density(spark, sf_dir):
    return _round(stats.density(load(spark, sf_dir, "part"), "p_size", [5, 15, 25, 35, 45], "epanechnikov", 5.0), 9, "density")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def stats_regression(spark, sf_dir):
    out = stats.regression(load(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return _round(_round(_round(out, 5, "slope"), 3, "intercept"), 8, "r2")


@query(
    "WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS ss FROM customer GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(ss) AS ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb FROM g) SELECT k, n::BIGINT AS n, round(ssb, 0) AS ss_between, round(ssw, 0) AS ss_within, round((ssb / (k - 1)) / (ssw / (n - k)), 5) AS f FROM t"
)
def stats_anova(spark, sf_dir):
    out = stats.anova(load(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return _round(_round(out, 0, "ss_between", "ss_within"), 5, "f").select("k", "n", "ss_between", "ss_within", "f")


@query(
    "SELECT 'l_quantity' AS \"column\", count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), round(avg(l_tax), 6), round(stddev_samp(l_tax), 6), min(l_tax), max(l_tax) FROM lineitem"
)
def stats_columns(spark, sf_dir):
    return _round(stats.describe_columns(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]), 6, "mean", "sd")


@query("SELECT p_partkey, round(exp(-0.5 * power((p_size - 25) / 10.0, 2)) / (10 * sqrt(2 * pi())), 9) AS d FROM part")
def stats_normal(spark, sf_dir):
    d = stats.normal_density(F.col("p_size"), F.lit(25.0), F.lit(10.0))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(d, 9).alias("d"))


@query()
def stats_anova_p(spark, sf_dir):
    return stats.anova(load(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")


@query(
    "SELECT n1, n2, round((m1 - m2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2), 6) AS t, (n1 + n2 - 2) AS freedom FROM (SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS n1, count(*) FILTER (c_mktsegment = 'MACHINERY') AS n2, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS m1, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS m2, stddev_samp(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS s1, stddev_samp(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS s2 FROM customer)"
)
def stats_t_test(spark, sf_dir):
    return _round(stats.t_test(load(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY"), 6, "t").select("n1", "n2", "t", "freedom")


@query()
def stats_duncan(spark, sf_dir):
    return stats.duncan(load(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")


# --- search ------------------------------------------------------------------------------------------


def _papers(spark, sf_dir):
    return load(spark, sf_dir, "papers")


@query("SELECT id FROM papers WHERE contains(lower(concat_ws(chr(10), title, title_zh)), 'soil') AND pub_year BETWEEN 2000 AND 2020")
def search_title_year(spark, sf_dir):
    return search.search(_papers(spark, sf_dir), "TI=soil AND YE BETWEEN ('2000','2020')").select("id")


@query(
    "SELECT id FROM (SELECT id, citation_count, lower(concat_ws(chr(10), title, title_zh, abstract, abstract_zh, keywords, keywords_zh)) AS t FROM papers) WHERE (contains(t, 'carbon') OR contains(t, 'nitrogen')) AND (contains(t, 'soil') OR contains(t, 'peat')) AND NOT contains(t, 'sludge') AND citation_count >= 3"
)
def search_boolean(spark, sf_dir):
    return search.search(_papers(spark, sf_dir), "SU=(carbon+nitrogen)*(soil+peat) NOT SU=sludge AND CF=3").select("id")


@query("SELECT id FROM papers WHERE (len(regexp_extract_all(lower(concat_ws(chr(10), abstract, abstract_zh)), 'the')) >= 4)")
def search_frequency(spark, sf_dir):
    return search.search(_papers(spark, sf_dir), "AB='the' $4").select("id")


@query()
def search_near(spark, sf_dir):
    return search.search(_papers(spark, sf_dir), "AB='carbon' /NEAR 6 'soil'").select("id")


@query()
def search_sentence(spark, sf_dir):
    return search.search(_papers(spark, sf_dir), "AB='soil' /SEN 2 'control'").select("id")


@query()
def search_merge(spark, sf_dir):
    return search.merge(_papers(spark, sf_dir))


@query()
def search_rank(spark, sf_dir):
    return search.rank(_papers(spark, sf_dir), "SU=soil*carbon", "recent", 50, now=2025).select("id", "score", "citation_count", "pub_year")


# --- store -------------------------------------------------------------------------------------------


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY sha256 ORDER BY registered_at, id) AS r FROM registered_files) WHERE r = 1")
def store_register(spark, sf_dir):
    return store.register(load(spark, sf_dir, "registered_files")).select("id")


@query("SELECT id FROM registered_files WHERE lower(file_format) = 'docx'")
def store_find(spark, sf_dir):
    return store.find(load(spark, sf_dir, "registered_files"), file_format="DOCX").select("id")


@query("SELECT source_kind, kind, target_kind, count(DISTINCT id) AS n FROM relationships GROUP BY 1, 2, 3")
def store_edges(spark, sf_dir):
    return load(spark, sf_dir, "relationships").groupBy("source_kind", "kind", "target_kind").agg(F.count_distinct("id").alias("n"))


@query("SELECT DISTINCT r.id FROM relationships r LEFT JOIN papers p ON r.target_id = p.id WHERE r.target_kind = 'paper' AND p.id IS NULL")
def store_dangling(spark, sf_dir):
    edges = load(spark, sf_dir, "relationships").filter("target_kind = 'paper'")
    return edges.join(_papers(spark, sf_dir).select(F.col("id").alias("target_id")), "target_id", "left_anti").select("id").distinct()


@query("SELECT DISTINCT id, target_kind, target_id FROM relationships WHERE source_kind = 'paper' AND source_id = (SELECT min(source_id) FROM relationships WHERE source_kind = 'paper')")
def store_outgoing(spark, sf_dir):
    edges = load(spark, sf_dir, "relationships")
    first = edges.filter("source_kind = 'paper'").agg(F.min("source_id")).first()[0]
    return store.outgoing(edges, "paper", first).select("id", "target_kind", "target_id")


@query("SELECT DISTINCT id, source_kind, source_id FROM relationships WHERE target_kind = 'document' AND target_id = (SELECT min(target_id) FROM relationships WHERE target_kind = 'document')")
def store_incoming(spark, sf_dir):
    edges = load(spark, sf_dir, "relationships")
    first = edges.filter("target_kind = 'document'").agg(F.min("target_id")).first()[0]
    return store.incoming(edges, "document", first).select("id", "source_kind", "source_id")


@query("SELECT id FROM papers WHERE query_hash = (SELECT max(query_hash) FROM papers)")
def store_list_papers(spark, sf_dir):
    papers = _papers(spark, sf_dir)
    chosen = papers.filter(F.col("query_hash") == papers.agg(F.max("query_hash")).scalar())
    _, edges = files.literature_list(chosen, "list-1")
    return store.list_papers(edges, papers, "list-1").select("id")


@query("SELECT id, status, started_at FROM (SELECT DISTINCT * FROM runs) ORDER BY started_at DESC NULLS LAST, id LIMIT 50")
def store_latest_runs(spark, sf_dir):
    return store.latest_runs(load(spark, sf_dir, "runs")).select("id", "status", "started_at")


@query("SELECT id, citation_count FROM papers WHERE pub_year BETWEEN 2005 AND 2022 AND citation_count >= 1 ORDER BY citation_count DESC, id LIMIT 30 OFFSET 10")
def store_query_papers(spark, sf_dir):
    return store.query_papers(_papers(spark, sf_dir), years=(2005, 2022), citations=1, skip=10, limit=30).select("id", "citation_count")


@query("SELECT count(*) AS papers, count(*) FILTER (coalesce(normalized_doi, '') <> '') AS with_doi, count(*) FILTER (coalesce(abstract, '') <> '') AS with_abstract, count(*) FILTER (coalesce(pdf_url, '') <> '') AS with_pdf, min(pub_year) AS first_year, max(pub_year) AS last_year FROM papers")
def store_statistics(spark, sf_dir):
    return store.statistics(_papers(spark, sf_dir))


@query("SELECT s AS source, count(*) AS n FROM (SELECT trim(unnest(string_split(coalesce(retrieved_from, ''), ','))) AS s FROM papers) WHERE s <> '' GROUP BY 1")
def store_by_source(spark, sf_dir):
    return store.by_source(_papers(spark, sf_dir))


@query(
    "WITH old AS (SELECT DISTINCT lower(trim(normalized_doi)) AS d FROM papers WHERE pub_year < 2010 AND coalesce(trim(normalized_doi), '') <> ''), new AS (SELECT id, lower(trim(coalesce(normalized_doi, ''))) AS d FROM papers WHERE pub_year >= 2010) SELECT min(id) AS id FROM new WHERE d <> '' AND d NOT IN (SELECT d FROM old) GROUP BY d UNION ALL SELECT id FROM new WHERE d = ''"
)
def store_new_papers(spark, sf_dir):
    papers = _papers(spark, sf_dir)
    return store.new_papers(papers.filter("pub_year >= 2010"), papers.filter("pub_year < 2010")).select("id")


@query("SELECT id, journal, citation_count FROM (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY citation_count DESC NULLS LAST, id) AS r FROM papers) WHERE r <= 3")
def store_most_cited(spark, sf_dir):
    return store.most_cited(_papers(spark, sf_dir), "journal", 3).select("id", "journal", "citation_count")


# --- vectors and space -------------------------------------------------------------------------------


@query(
    "SELECT query_id, id, score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS n FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 50 = 0) WHERE n <= 20"
)
def vector_nearest(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.nearest_of(vectors, vectors.filter("id % 50 = 0"), 20)


@query(
    "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)::DOUBLE[]), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20"
)
def vector_nearest_to_one(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    return vector.nearest(vectors, list(vectors.orderBy("vec_id").first()["embedding"]), 20)


@query(
    "WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 0.5 AS x1, l_discount * 100 + 0.5 AS y1 FROM lineitem), a AS (SELECT s_suppkey AS id, s_suppkey % 50 AS x0, s_suppkey % 10 AS y0, s_suppkey % 50 + 2.0 AS x1, s_suppkey % 10 + 1.5 AS y1 FROM supplier) SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0"
)
def spatial_join(spark, sf_dir):
    def box(x, y, w, h):
        return F.struct(x.cast("double").alias("min_x"), y.cast("double").alias("min_y"), (x + w).cast("double").alias("max_x"), (y + h).cast("double").alias("max_y")).alias("e")

    a = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), box(F.col("s_suppkey") % 50, F.col("s_suppkey") % 10, 2.0, 1.5))
    b = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), box(F.col("l_quantity"), F.col("l_discount") * 100, 0.5, 0.5))
    return spatial.intersection_join(a, b, 4.0)


@query("SELECT p_partkey AS id, round(sqrt(power(p_size - 20, 2) + power(p_retailprice - 1000, 2)), 6) AS distance FROM part WHERE sqrt(power(p_size - 20, 2) + power(p_retailprice - 1000, 2)) <= 60 ORDER BY sqrt(power(p_size - 20, 2) + power(p_retailprice - 1000, 2)), p_partkey LIMIT 25")
def spatial_nearest_to_one(spark, sf_dir):
    point = F.struct(F.col("p_size").cast("double").alias("min_x"), F.col("p_retailprice").alias("min_y"), F.col("p_size").cast("double").alias("max_x"), F.col("p_retailprice").alias("max_y"))
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), point.alias("e"))
    return _round(spatial.nearest(rows, 20, 1000, 25, farthest=60).select("id", "distance"), 6, "distance")


@query(
    "SELECT query_id, id, score FROM (SELECT q.p_partkey AS query_id, p.p_partkey AS id, round(sqrt(power(p.p_size - q.p_size, 2) + power(p.p_retailprice - q.p_retailprice, 2)), 6) AS score, row_number() OVER (PARTITION BY q.p_partkey ORDER BY round(sqrt(power(p.p_size - q.p_size, 2) + power(p.p_retailprice - q.p_retailprice, 2)), 6), p.p_partkey) AS n FROM part p CROSS JOIN part q WHERE q.p_partkey % 50 = 0) WHERE n <= 10"
)
def spatial_nearest(spark, sf_dir):
    points = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return spatial.nearest_of(points, points.filter("id % 50 = 0"), 10)


@query(
    "SELECT a.id AS a_id, b.id AS b_id, (a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1) AS holds, greatest(a.x0, b.x0)::DOUBLE AS left, greatest(a.x1, b.x1)::DOUBLE AS right FROM (SELECT s_suppkey AS id, s_nationkey * 1.0 AS x0, 0.0 AS y0, s_nationkey + 3.0 AS x1, 2.0 AS y1 FROM supplier) a JOIN (SELECT n_nationkey AS id, n_nationkey + 0.5 AS x0, 0.5 AS y0, n_nationkey + 2.5 AS x1, 1.5 AS y1 FROM nation) b ON a.id % 25 = b.id WHERE a.x0 <= b.x1 AND a.x1 >= b.x0"
)
def spatial_envelopes(spark, sf_dir):
    def box(x, w, y, h):
        return F.struct(x.cast("double").alias("min_x"), F.lit(y).alias("min_y"), (x + w).cast("double").alias("max_x"), F.lit(h).alias("max_y"))

    a = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a_id"), box(F.col("s_nationkey"), 3.0, 0.0, 2.0).alias("a"))
    b = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("b_id"), box(F.col("n_nationkey") + 0.5, 2.0, 0.5, 1.5).alias("b"))
    met = a.join(b, F.col("a_id") % 25 == F.col("b_id")).filter(spatial.intersects("a", "b"))
    return met.select("a_id", "b_id", spatial.contains("a", "b").alias("holds"), F.round(spatial.intersection("a", "b")["min_x"], 6).alias("left"), F.round(spatial.extend("a", "b")["max_x"], 6).alias("right"))


@query()
def spatial_hull(spark, sf_dir):
    return spatial.convex_hull(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


# --- graphs ------------------------------------------------------------------------------------------


def _links(spark, sf_dir):
    edges = load(spark, sf_dir, "relationships").select(F.concat_ws(":", "source_kind", "source_id").alias("src"), F.concat_ws(":", "target_kind", "target_id").alias("dst")).distinct()
    return edges


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT source_kind || ':' || source_id AS a, target_kind || ':' || target_id AS b FROM relationships WHERE source_kind || ':' || source_id <> target_kind || ':' || target_id), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(v, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v) SELECT v AS vertex, min(c) AS component FROM r GROUP BY 1"
)
def graph_components(spark, sf_dir):
    return graph.components(_links(spark, sf_dir))


def _trade(spark, sf_dir):
    """Nations linked by trade: suppliers' to customers', weight by the number of lines."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    sup = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    cus = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    return lines.join(orders, "l_orderkey").join(sup, "l_suppkey").join(cus, "o_custkey").filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


@query()
def graph_spanning_forest(spark, sf_dir):
    return graph.minimum_spanning_forest(_trade(spark, sf_dir))


@query()
def graph_distances(spark, sf_dir):
    return graph.distances(_trade(spark, sf_dir), spark.createDataFrame([(0,)], "vertex int"))


@query()
def graph_all_distances(spark, sf_dir):
    edges = _trade(spark, sf_dir)
    return graph.distances(edges, edges.select(F.col("src").alias("vertex")).union(edges.select("dst")).distinct())


@query()
def graph_levels(spark, sf_dir):
    return graph.topological_levels(_links(spark, sf_dir))


@query()
def graph_feedback(spark, sf_dir):
    return graph.feedback_edges(_links(spark, sf_dir))


@query()
def graph_layout(spark, sf_dir):
    return graph.pivot_mds(_trade(spark, sf_dir), 0, 4)


# --- text rules --------------------------------------------------------------------------------------

CLASSES = {"soil": ["soil", "loess", "peat", "clay"], "water": ["groundwater", "river", "rainfall"], "methods": ["anova", "hplc", "ftir", "icp-oes", "bet"]}


@query(
    "SELECT doc_id, class, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class)::INT AS rank FROM (SELECT doc_id, unnest([{'class': 'soil', 'score': round((contains(t, 'soil')::INT + contains(t, 'loess')::INT + contains(t, 'peat')::INT + contains(t, 'clay')::INT) * 100 / 4)::INT}, {'class': 'water', 'score': round((contains(t, 'groundwater')::INT + contains(t, 'river')::INT + contains(t, 'rainfall')::INT) * 100 / 3)::INT}, {'class': 'methods', 'score': round((contains(t, 'anova')::INT + contains(t, 'hplc')::INT + contains(t, 'ftir')::INT + contains(t, 'icp-oes')::INT + contains(t, 'bet')::INT) * 100 / 5)::INT}], recursive := true) FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))"
)
def text_classify(spark, sf_dir):
    return textrules.classify(load(spark, sf_dir, "documents"), "doc_id", "text", CLASSES)


@query()
def text_citations(spark, sf_dir):
    return textrules.citations(load(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def text_references(spark, sf_dir):
    return textrules.references(load(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def text_unmatched(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return textrules.unmatched(textrules.cited_spans(docs, "doc_id", "text"), textrules.references(docs, "doc_id", "text"))


@query()
def text_evidence(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    best = textrules.classify(docs, "doc_id", "text", CLASSES).filter("rank = 1").select("doc_id", "score")
    return textrules.evidence(docs, "doc_id", "text").join(best, "doc_id").withColumn("grade", textrules.grade(F.col("failed"), F.col("score")))


@query()
def text_scan(spark, sf_dir):
    return textrules.scan(load(spark, sf_dir, "documents"), "doc_id", "text")


# --- sources and sinks -------------------------------------------------------------------------------


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def source_csv(spark, sf_dir):
    path = scratch(spark, "csv") + ".csv"
    files.write_file(load(spark, sf_dir, "nation"), path)
    return files.read_file(spark, path)


@query("SELECT r_name, r_regionkey::BIGINT AS r_regionkey FROM region")
def source_json(spark, sf_dir):
    path = scratch(spark, "json") + ".jsonl"
    files.write_file(load(spark, sf_dir, "region"), path)
    return files.read_file(spark, path)


@query("SELECT c_mktsegment AS label, 0::INT AS position, c_acctbal AS value FROM customer")
def source_grouped_json(spark, sf_dir):
    text = load(spark, sf_dir, "customer").select(F.to_json(F.create_map("c_mktsegment", F.array("c_acctbal"))).alias("j"))
    return files.grouped_json(text, "j")


@query("SELECT p_partkey, (p_size + p_retailprice) / 2 AS mean FROM part")
def source_row_means(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    return df.select("p_partkey", files.row_means(df, ["p_size", "p_retailprice", "p_name"]).alias("mean"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS vid FROM documents")
def source_virtual_id(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", files.virtual_id(F.col("text")).alias("vid"))


@query("SELECT id, '- **' || coalesce(title, '') || '** ' || coalesce(authors, '') || ' (' || coalesce(pub_year::VARCHAR, 'n.d.') || '). ' || coalesce(journal, '') || '.' || CASE WHEN coalesce(normalized_doi, '') <> '' THEN ' doi:' || normalized_doi ELSE '' END AS value FROM papers")
def export_markdown(spark, sf_dir):
    return files.export_markdown(_papers(spark, sf_dir))


@query(
    "SELECT id, '@article{' || id || ',' || chr(10) || concat_ws(',' || chr(10), CASE WHEN coalesce(title, '') <> '' THEN '  title = {' || title || '}' END, CASE WHEN coalesce(authors, '') <> '' THEN '  author = {' || authors || '}' END, CASE WHEN coalesce(journal, '') <> '' THEN '  journal = {' || journal || '}' END, CASE WHEN pub_year IS NOT NULL THEN '  year = {' || pub_year || '}' END, CASE WHEN coalesce(normalized_doi, '') <> '' THEN '  doi = {' || normalized_doi || '}' END) || chr(10) || '}' AS value FROM papers"
)
def export_bibtex(spark, sf_dir):
    return files.export_bibtex(_papers(spark, sf_dir))


# --- streams -----------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts)::TIMESTAMPTZ AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    events = streaming.event_stream(spark, sf_dir)
    return _round(streaming.run_once(streaming.windowed_counts(events, "ts", "event_type", late="3650 days")), 4, "total")


@query("WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(ts)::TIMESTAMPTZ AS start, count(*) AS n FROM s GROUP BY user_id, g")
def stream_sessions(spark, sf_dir):
    out = streaming.sessions(streaming.event_stream(spark, sf_dir), "ts", "user_id", "6 hours", late="3650 days")
    return streaming.run_once(out).select("user_id", "start", "n")


@query("SELECT least(floor(value / 20), 9)::INT AS bin, count(*) AS count FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1")
def stream_histogram(spark, sf_dir):
    return streaming.run_once(streaming.running_histogram(streaming.event_stream(spark, sf_dir), "value", 0, 200, 10))


@query(
    "SELECT user_id AS key, least(count(value), 10)::INT AS size, min(value) FILTER (r <= 10) AS lo, max(value) FILTER (r <= 10) AS hi, min(value) AS all_lo, max(value) AS all_hi FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS r FROM events WHERE value IS NOT NULL) GROUP BY 1"
)
def stream_ring_buffer(spark, sf_dir):
    return streaming.run_once(streaming.ring_buffer(streaming.event_stream(spark, sf_dir), "user_id", "ts", "value", 10), "update", ["key"])

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomsheet.operators import graph, search, series, spatial, stats, store, tables, textrules, vector
from loomsheet.streaming import operators as streaming


def edges(spark, rows):
    return spark.createDataFrame(rows, "src int, dst int, weight double")


def brute_components(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in rows:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(parent)}


def random_edges(seed, n=60, m=70):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), float(r.randrange(1, 20))) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = [e for e in random_edges(seed) if e[0] != e[1]] + [(i, i + 1, 1.0) for i in range(100, 130)]
    got = {r.vertex: r.component for r in graph.components(edges(spark, rows + rows)).collect()}
    assert got == brute_components(rows)


def test_components_of_nothing(spark):
    assert graph.components(edges(spark, [(1, 1, 1.0), (None, 2, 1.0)])).count() == 0


def test_forest_and_distances(spark):
    rows = [e for e in random_edges(3) if e[0] != e[1]]
    forest = graph.minimum_spanning_forest(edges(spark, rows)).collect()
    parent, total = {}, 0.0

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in rows):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += w
    assert sum(r.weight for r in forest) == total
    near = {rows[0][0]: 0.0}
    for _ in range(70):
        for a, b, w in rows:
            for x, y in ((a, b), (b, a)):
                if x in near:
                    near[y] = min(near.get(y, math.inf), near[x] + w)
    got = {r.vertex: r.distance for r in graph.distances(edges(spark, rows), spark.createDataFrame([(rows[0][0],)], "vertex int")).collect()}
    assert got == near


def test_no_silent_end_of_rounds(spark):
    chain = edges(spark, [(k, k + 1, 1.0) for k in range(1, 5)])
    source = spark.createDataFrame([(1,)], "vertex int")
    assert {r.vertex: r.distance for r in graph.distances(chain, source, directed=True).collect()} == {k: k - 1.0 for k in range(1, 6)}
    with pytest.raises(RuntimeError):
        graph.distances(chain, source, most=2).collect()
    with pytest.raises(RuntimeError):
        graph.topological_levels(chain, most=2).collect()
    with pytest.raises(RuntimeError):  # a cycle of negative weight
        graph.distances(edges(spark, [(1, 2, 1.0), (2, 1, -2.0)]), source, directed=True)


def test_levels_and_feedback(spark):
    rows = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (5, 6, 1.0), (6, 5, 1.0)]
    assert {r.vertex: r.level for r in graph.topological_levels(edges(spark, rows)).collect()} == {1: 0, 2: 1, 3: 2}
    assert [(r.src, r.dst) for r in graph.feedback_edges(edges(spark, rows)).collect()] == [(6, 5)]


def test_layout_keeps_a_line_in_order(spark):
    rows = [(i, i + 1, 1.0) for i in range(6)]
    got = {r.vertex: r.x for r in graph.pivot_mds(edges(spark, rows), 0, 3).collect()}
    xs = [got[i] for i in range(7)]
    assert xs == sorted(xs) or xs == sorted(xs, reverse=True)


def test_moving_average_places(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 11)], "g int, i int, v double")
    plain = [r.m for r in series.moving_average(df, "v", 3, ["i"], ["g"], "m").orderBy("i").collect()]
    standard = [r.m for r in series.moving_average(df, "v", 3, ["i"], ["g"], "m", standard=True).orderBy("i").collect()]
    assert plain[:4] == [None, None, None, 3.0] and standard[:4] == [None, None, 2.0, 3.0]


def test_statistics(spark):
    groups = spark.createDataFrame([(g, v) for g, vs in (("Low", (1, 2, 3, 2, 1)), ("Mid", (11, 12, 13, 12, 11)), ("High", (21, 22, 23, 22, 21))) for v in map(float, vs)], "label string, value double")
    row = stats.anova(groups, "label", "value").first()
    assert (row.df_between, row.df_within, row.n) == (2, 12, 15) and row.f > 10 and row.p < 0.05
    assert stats.anova(groups.filter("label = 'Low'"), "label", "value").first().p is None
    letters = {r.label: r.letters for r in stats.duncan(groups, "label", "value").collect()}
    assert len(letters) == 3 and len(set(letters.values())) == 3
    with pytest.raises(ValueError):
        stats.duncan(groups, "label", "value", 0.01)
    assert stats.t_test(groups, "label", "value", "Low", "Low").first().p == pytest.approx(1)
    assert stats.f_tail(4.256494729, 2, 9) == pytest.approx(0.05, abs=1e-6) and stats.t_tails(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    d = stats.describe(spark.createDataFrame([(2.0,), (4.0,), (6.0,), (8.0,), (10.0,), (float("nan"),), (None,)], "v double"), "v").first()
    assert (d.n, d.mean, d.min, d.max) == (5, 6, 2, 10)
    assert stats.describe(groups.limit(0), "value").first().n == 0


def test_top_n_ties_and_lookup(spark):
    df = spark.createDataFrame([(5,), (5,), (4,), (3,), (None,)], "v int")
    assert sorted(r.v for r in tables.top_n(df, "v", 1).collect()) == [5, 5]
    keys = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (2.0, "c"), (4.0, "d"), (None, "n")], "k double, v string")
    want = spark.createDataFrame([(0.5,), (1.0,), (2.5,), (9.0,), (None,)], "t double")
    assert {r.t: r.v for r in tables.as_of_lookup(want, "t", keys, "k", "v").collect()} == {0.5: None, 1.0: "a", 2.5: "c", 9.0: "d", None: None}
    assert {r.t: r.v for r in tables.as_of_lookup(want, "t", keys, "k", "v", forward=True).collect()} == {0.5: "a", 1.0: "a", 2.5: "d", 9.0: None, None: None}


def test_space(spark):
    r = random.Random(4)

    def boxes(n):
        return [(i, (x, y, x + r.random() * 3, y + r.random() * 3)) for i in range(n) for x, y in [(r.uniform(-9, 9), r.uniform(-9, 9))]]

    a, b = boxes(60), boxes(60)
    kind = "id int, e struct<min_x double, min_y double, max_x double, max_y double>"
    expected = sorted((i, j) for i, p in a for j, q in b if p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1])
    got = sorted(tuple(x) for x in spatial.intersection_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 2.0).collect())
    assert got == expected
    near = spatial.nearest(spark.createDataFrame(a, kind), 0, 0, 0, farthest=5.0).collect()
    assert all(x.distance <= 5 for x in near) and [x.distance for x in near] == sorted(x.distance for x in near)
    hull = spatial.convex_hull(spark.createDataFrame([("g", float(x), float(y)) for x in range(5) for y in range(5)], "g string, x double, y double"), "g", "x", "y").orderBy("position").collect()
    assert [(h.x, h.y) for h in hull] == [(0, 0), (4, 0), (4, 4), (0, 4)]


def test_range_join_shuffles_ids_and_not_pairs(spark):
    """Equal envelopes go through the join as one row, so pairs aren't rows of the join; null ids and empty sides stay right."""
    kind = "id bigint, e struct<min_x double, min_y double, max_x double, max_y double>"
    a = [(i if i else None, (float(i % 3), 0.0, i % 3 + 0.5, 0.5)) for i in range(30)] + [(99, None)]
    b = [(i if i else None, (i % 4 + 0.25, 0.25, i % 4 + 5.0, 0.75)) for i in range(400)] + [(99, (None, 0.0, 1.0, 1.0))]
    pairs = spatial.intersection_join(spark.createDataFrame(a, kind).coalesce(1), spark.createDataFrame(b, kind).coalesce(1), 2.0)
    text = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("MapInArrow") < text.index("Join") < text.index("collect_list")
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    want = sorted(((i, j) for i, p in a for j, q in b if p and q[0] is not None and p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1]), key=key)
    assert want and sorted((tuple(x) for x in pairs.collect()), key=key) == want
    few, many = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    assert spatial.intersection_join(few.limit(0), many, 2.0).count() == spatial.intersection_join(few, many.limit(0), 2.0).count() == 0


def test_pairs_of_crowded_rows_are_not_searched_for(monkeypatch):
    """Ids of a crowded row are repeated in whole; the place of a pair is only searched for where rows have few. Nulls and empty rows stay right."""
    searched = []
    find = np.searchsorted
    monkeypatch.setattr(spatial.np, "searchsorted", lambda ends, pair, **k: searched.append(len(pair)) or find(ends, pair, **k))
    a = [[1, 2, None], list(range(300)), [], [7], list(range(200_000)), [8]]
    b = [[5], list(range(1000, 1500)), [1], [None, 9], [3, 4, None], []]
    batch = pa.RecordBatch.from_arrays([pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64()))], names=["a_ids", "b_ids"])
    for part in (batch, batch.slice(1, 3), batch.slice(2, 1)):
        got = list(spatial._pairs(iter([part])))
        key = lambda x: tuple((v is not None, v or 0) for v in x)
        pairs = [p for g in got for p in zip(g.column(0).to_pylist(), g.column(1).to_pylist(), strict=True)]
        want = [(i, j) for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for j in y for i in x]
        assert sorted(pairs, key=key) == sorted(want, key=key) and all(g.num_rows <= spatial.PAIRS for g in got)
    assert sum(searched) == 5 + 2


def test_nearest_points_meet_few_others(spark):
    """As by brute force: places shared by many points, clusters, places far apart, distances that round alike; dense places are met in part."""
    r = random.Random(9)
    places = [(i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(150)] + [(i, 500 + r.random() / 100, 7.0) for i in range(150, 250)] + [(i, 3.0, 4.0) for i in range(250, 300)]
    places += [(300, 1e6, -1e6), (301, 3.0, 4.0000001), (1000, 3.0, 4.0000002), (303, None, 1.0), (304, float("nan"), 1.0), (305, 1.0, float("inf"))]
    df = spark.createDataFrame(places, "id bigint, x double, y double")
    held = [p for p in places if None not in p and all(map(math.isfinite, p[1:]))]
    for k in (1, 7, 400):
        got = {}
        for row in spatial.nearest_of(df, df.filter("id % 20 = 0"), k).collect():
            got.setdefault(row.query_id, []).append((row.score, row.id))
        for q, x, y in held:
            if q % 20 == 0:
                assert sorted(got.pop(q)) == sorted((round(math.dist((x, y), (a, b)), 6), i) for i, a, b in held)[:k]
        assert not got
    assert spatial.nearest_of(df.limit(0), df, 3).count() == spatial.nearest_of(df, df.limit(0), 3).count() == 0
    wide = spark.range(40_000).select("id", (F.col("id") % 200).cast("double").alias("x"), F.floor(F.col("id") / 200).cast("double").alias("y"))
    text = spatial.nearest_of(wide, wide.filter("id % 400 = 0"), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in text and "level" in text[text.index("Join Inner") :].splitlines()[0]


PAPER = "id string, title string, title_zh string, abstract string, keywords string, authors string, journal string, normalized_doi string, pub_year int, citation_count int, retrieved_from string, imported_at string"


def paper(spark, *rows):
    return spark.createDataFrame([(str(i), *(r.get(k) for k in ("title", "title_zh", "abstract", "keywords", "authors", "journal", "doi", "year", "cites", "from")), str(i)) for i, r in enumerate(rows)], PAPER)


def hits(df, text, **k):
    return [r.id for r in search.search(df, text, **k).orderBy("id").collect()]


def test_search_language(spark):
    df = paper(spark, {"title": "Humic acid in soil", "year": 2007, "cites": 4, "doi": "10.1/AB", "abstract": "Soil was dry. It rained on the field.\nThen corn grew."}, {"title": "Ｈｕｍｉｃ matter", "year": 2020, "abstract": "Corn on dry soil"}, {})
    assert hits(df, "TI=humic") == ["0", "1"] and hits(df, "TI=humic AND YE BETWEEN ('2000','2013')") == ["0"] and hits(df, "humic NOT soil") == [] and hits(df, "TI=(humic-acid)") == ["1"]
    assert hits(df, "CF=3") == ["0"] and hits(df, "DOI='https://doi.org/10.1/ab'") == ["0"] and hits(df, "TI=%'acid humic'") == ["0"] and hits(df, "FT=x") == [] and hits(df, "FT=x", recall=True) == ["0", "1", "2"]
    assert hits(df, "AB='soil' /NEAR 3 'dry'") == ["0", "1"] and hits(df, "AB='dry' /PREV 1 'soil'") == ["1"] and hits(df, "AB='soil' /AFT 1 'corn'") == ["1"] and hits(df, "AB='soil' /SEN 1 'rained'") == ["0"] and hits(df, "AB='soil' /PRG 1 'corn'") == ["0"]
    assert hits(df, "AB='soil # dry'") == ["0", "1"] and hits(df, "AB='dry % soil'") == ["1"]
    for wrong in ("TI=a /SUB 2 b", "AU BETWEEN ('1','2')", "TI=(a", "a $0"):
        with pytest.raises(ValueError):
            search.Query(wrong)
    queries, cut = search.plan("(a+b+c+d+e+f)*(g+h+i+j+k)")
    assert len(queries) == 20 and cut
    assert search.filters_of("TI=soil AND YE BETWEEN ('2000','2013') AND CF=5")["years"] == (2000, 2013)


def test_merge_and_rank(spark):
    df = paper(
        spark,
        {"title": "One title", "doi": "10.1/x", "year": 2000, "cites": 1, "authors": "A. B.", "keywords": "k1"}, {"title": "Other", "doi": "10.1/X", "cites": 5, "abstract": "long abstract", "keywords": "k2;k1"},
        {"title": "Same  Title!", "year": 2010, "authors": "C. D.; E."}, {"title": "same title", "year": 2010, "authors": "C. D.", "abstract": "filled"}, {"title": "same title", "year": 2011, "authors": "C. D."}, {"title": None},
    )
    merged = {r.cluster: r for r in search.merge(df).collect()}
    assert set(merged) == {"0", "2", "4", "5"} and merged["0"].citation_count == 5 and merged["0"].keywords == ["k1", "k2"] and merged["2"].abstract == "filled"
    ranked = search.rank(paper(spark, {"title": "soil", "year": 2000, "cites": 9}, {"title": "soil", "year": 2025}), "SU=soil", "recent").collect()
    assert ranked[0].pub_year == 2025 and all(0 <= r.score <= 1 for r in ranked)


def test_text_rules(spark):
    text = "see [1, 3] and [5–6]\nMorvaine et al. (2010)\nReferences\n[1] First, a\n continued. 2001.\n[2] Second. 2002."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    assert [(r.number, r.entry) for r in textrules.references(df, "k", "t").orderBy("number").collect()] == [(1, "First, a  continued. 2001."), (2, "Second. 2002.")]
    both = textrules.unmatched(textrules.cited_numbers(df, "k", "t").filter("k = 1"), textrules.references(df, "k", "t")).collect()
    assert sorted((r.side, r.number) for r in both if r.number > 2 or r.side == "listed") == [("cited", 3), ("cited", 5), ("cited", 6), ("listed", 2)]
    secret = spark.createDataFrame([(1, "a\nmail me@x.org\napi_key = 'abcdefghijklmnop1234'\nme@y.org"), (2, "clean")], "k int, t string")
    assert sorted((r.rule, r.line) for r in textrules.scan(secret, "k", "t").collect()) == [("api_key", 3), ("email", 2)]
    assert textrules.classify(df, "k", "t", {"a": ["first", "second"], "b": ["zzz"]}).filter("k = 1 and rank = 1").first().score == 100


def test_unmatched_within_one_text(spark):
    texts = [(1, "see [3]\nReferences\n[1] One."), (2, "see [3], [1-250]\nReferences\n[3] Three.\n[250] Last.\n[251] More."), (3, "[7–2000000000]"), (4, "[9-2] and [10]")]
    df = spark.createDataFrame(texts, "k int, t string")
    rows = textrules.unmatched(textrules.cited_spans(df, "k", "t"), textrules.references(df, "k", "t")).collect()
    assert {(r.side, r.k, r.number) for r in rows} == {("cited", 1, 3), ("listed", 1, 1), ("listed", 2, 251), ("cited", 4, 9), ("cited", 4, 10)} | {("cited", 2, n) for n in (1, 2, 4, 5, 6, 7, 8, 9)} | {("cited", 3, n) for n in range(7, 15)}
    assert len(rows) == 21
    assert [r.number for r in textrules.cited_numbers(df.filter("k = 2"), "k", "t").orderBy("number").collect()] == list(range(1, 251))


def test_store_and_vectors(spark):
    files = spark.createDataFrame([("b", "h", 2), ("a", "h", 1), ("c", None, 3), ("d", None, 4)], "id string, sha256 string, registered_at int")
    assert sorted(r.id for r in store.register(files).collect()) == ["a", "c", "d"]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [3.0, 3.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in vector.nearest(v, [2.0, 0.1], 2).collect()] == [1, 4]
    assert v.select(vector.normalized(F.col("embedding")).alias("n")).filter("vec_id = 4").first().n == pytest.approx([0.5**0.5] * 2)


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, k int, v double").withColumn("ts", F.timestamp_seconds("i"))
    for part in range(2):
        df.filter(F.col("i") % 2 == part).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = streaming.run_once(streaming.ring_buffer(stream, "k", "ts", "v", 5), "update", ["key"]).collect()
    assert {r.key: (r.size, r.all_lo, r.all_hi) for r in out} == {k: (5, float(k), float(57 + k)) for k in range(3)}
    bars = {r.bin: r["count"] for r in streaming.run_once(streaming.running_histogram(stream, "v", 0, 60, 6)).collect()}
    assert bars == dict.fromkeys(range(6), 10)


def test_nearest_of_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], "clash") for i in range(120)]
    rows += [(200, [0.0] * 4, "zero"), (201, None, "null"), (202, rows[3][1], "copy"), (203, rows[3][1], "copy")]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>, score string")
    held = [(i, v) for i, v, _ in rows if v]

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return None if size == 0 else round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 6)

    for metric, k in (("cosine", 5), ("euclidean", 3)):
        got = {}
        for r in vector.nearest_of(df, df.filter("id % 50 = 0"), k, metric, block=16).collect():
            got.setdefault(r.query_id, []).append((r.score, r.id))
        for q, v in held:
            if q % 50:
                continue
            scores = [(cosine(v, w) if metric == "cosine" else round(math.dist(v, w), 6), i) for i, w in held]
            want = sorted(((s, i) for s, i in scores if s is not None), key=lambda x: (-x[0] if metric == "cosine" else x[0], x[1]))[:k]
            assert sorted(got.get(q, [])) == sorted(want)
    assert vector.nearest_of(df.limit(0), df, 3).count() == 0 and vector.nearest_of(df, df.limit(0), 3).count() == 0


def test_feedback_edges_without_and_with_cycles(spark):
    chain = [(i, i + 1) for i in range(1, 9)] + [(3, 9), (5, 5)]
    assert graph.feedback_edges(spark.createDataFrame(chain, "src bigint, dst bigint")).count() == 0
    cycles = [*chain, (9, 7), (9, 20), (20, 21), (4, 1), (4, 1)]
    got = {tuple(r) for r in graph.feedback_edges(spark.createDataFrame(cycles, "src bigint, dst bigint")).collect()}
    assert got == {(4, 1), (9, 7)}

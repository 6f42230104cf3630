import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsheet.llm import mixing, packing, ranks, sentences, splitting, tokens


def loads(plan, histogram):
    load, placed = np.zeros(plan.containers, int), Counter()
    seen = {s: np.zeros(n, int) for s, n in histogram.items()}
    for size, rank, n, first in plan.moves:
        load[first : first + n] += size
        placed[size] += n
        seen[size][rank : rank + n] += 1
    assert all((x == 1).all() for x in seen.values()) and placed == Counter(histogram)
    return load


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plan_places_all_once(histogram):
    load = loads(packing.make_plan(histogram, capacity=64, bins=16), histogram)
    assert not len(load) or (load.max() <= 64 and load.min() > 0)


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    sizes, counts = np.unique(np.minimum(2048, rng.lognormal(5.5, 1, 50_000).astype(int) + 1), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    load = loads(packing.make_plan(histogram), histogram)
    assert load.sum() / (2048 * len(load)) > 0.99


def test_least_squares():
    rng = np.random.default_rng(1)
    a = rng.random((12, 30))
    x = np.maximum(rng.normal(size=30), 0)
    b = a @ x
    got = packing.nnls(a, b)
    assert (got >= 0).all() and np.linalg.norm(a @ got - b) < 1e-6


def test_pack(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([700] * 5 + list(range(1, 3000)))) for i in range(800)] + [(9_001, 0), (9_002, None), (9_003, 2048), (9_004, 5000)]
    items = spark.createDataFrame([(i, t) for i, t in data + data[:5]], "doc_id bigint, tokens bigint")
    rows = packing.pack(items).collect()
    assert len({(r.doc_id, r.part_no) for r in rows}) == len(rows)
    sums, per = Counter(), Counter()
    for r in rows:
        sums[r.container] += r.tokens
        per[r.doc_id] += r.tokens
    assert max(sums.values()) <= 2048 and per == Counter({i: t for i, t in data if t})
    assert [r.tokens for r in rows if r.doc_id == 9_004].count(2048) == 2 and all(r.part_no == 0 for r in rows if r.tokens <= 2048 and r.doc_id != 9_004 and per[r.doc_id] <= 2048)
    assert packing.pack(items.limit(0)).count() == 0


def test_running_sums(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"g{i % 5}", i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, i int, v int")
    rows = ranks.running(df, ["g"], ["i"], (F.col("i") / 40).cast("int"), F.col("v"), "s").collect()
    expected, total = {}, Counter()
    for g, i, v in sorted(data, key=lambda x: x[1]):
        expected[i] = total[g]
        total[g] += v
    assert {r.i: r.s for r in rows} == expected


TARGETS = [("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2), (None, 0.5, 1)]


def test_mixture(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["Big", "big ", "BIG"]), rng.randrange(50, 400)) for i in range(900)] + [(5_000 + i, "small", rng.randrange(50, 400)) for i in range(90)] + [(9_000, "other", 99), (9_001, None, 9), (9_002, "big", 0)]
    items = spark.createDataFrame(data + data[:9], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    rows = mixing.mixture(items, targets, block=1_000).collect()
    uses = Counter((r.source, r.doc_id) for r in rows)
    assert max(n for (s, _), n in uses.items() if s == "big") == 1 and max(n for (s, _), n in uses.items() if s == "small") <= 3
    tokens_of = Counter()
    for r in rows:
        tokens_of[r.source] += r.tokens
    assert set(tokens_of) == {"big", "small"} and tokens_of["big"] / sum(tokens_of.values()) == pytest.approx(2 / 3, abs=0.01)
    owner = {}
    assert all(owner.setdefault(r.slot, r.source) == r.source for r in rows)
    share = {r.source: r.share for r in mixing.reached(mixing.mixture(items, targets, block=1_000), targets).collect()}
    assert share["big"] == pytest.approx(2 / 3, abs=0.01)
    first = [s for s, _ in sorted(((r.source, r.slot) for r in rows), key=lambda x: x[1])][: len(rows) // 4]
    assert first.count("big") / len(first) == pytest.approx(2 / 3, abs=0.08)  # any stretch has about the shares
    assert mixing.mixture(items.limit(0), targets).count() == 0


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    long = "Corn grew well.\n\nThe soil; " * 12_000
    assert tokens.count(long) == len(encode(long)) and tokens.count(None) == tokens.count("") == 0 and tokens.count("\ud800") > 0
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 8)], "id int, text string, tokens int")
    assert sorted(tuple(r) for r in tokens.with_tokens(df).collect()) == [(1, tokens.count("a b")), (2, 0)]


MODEL = sentences.Model({}, 0.0)


@settings(max_examples=120, deadline=None)
@given(st.text(st.sampled_from("abcd  \n.,。\u0301\u200dก่" + "é"), min_size=0, max_size=900), st.integers(80, 200), st.integers(0, 40))
def test_split_round_trip(text, limit, overlap):
    found = splitting.split(text, limit, overlap, MODEL)
    if len(text) <= limit:
        assert found == []
        return
    assert "".join(text[fresh:end] for _, fresh, end in found) == text
    assert all(0 < end - start <= limit and start <= fresh < end for start, fresh, end in found)
    assert all(abs((fresh - start) - overlap) <= splitting.NEAR + 12 or start == 0 or overlap == 0 for start, fresh, _ in found[1:])


def test_split_at_natural_places():
    paragraph = "Word word word word word. " * 8
    text = "\n\n".join([paragraph.strip()] * 8)
    found = splitting.split(text, 500, 50, MODEL)
    assert len(found) > 3 and all(text[end - 1] in "\n. " for _, _, end in found[:-1])
    with pytest.raises(ValueError):
        splitting.split("x" * 200, 60, 50, MODEL)


def test_piece_rows(spark):
    long = "x" * 250 + " " + "y" * 249
    df = spark.createDataFrame([(1, "text", 0, long, 200, 20), (2, "text", 0, "short", 200, 20), (3, "text", 0, None, 200, 20)], "word_id bigint, field_name string, item_no int, text string, size_limit int, overlap int")
    rows = splitting.pieces(df, MODEL).orderBy("piece_no").collect()
    assert {r.word_id for r in rows} == {1} and "".join(long[r.fresh_start : r.piece_end] for r in rows) == long
    assert splitting.pieces(df.limit(0), MODEL).count() == 0

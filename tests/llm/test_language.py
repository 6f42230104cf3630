import math
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsheet.llm import language, ppm, sentences

TRAIN = {"a": [b"banana band", b"bandana"], "b": [b"cabbage can", b"abc abc"], "c": [b"xyz"]}


def brute(pieces, text):
    counts = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        s = ppm.PAD + p
        for i in range(len(ppm.PAD), len(s)):
            for n in range(ppm.ORDER + 1):
                counts[s[i - n : i]][s[i]] += 1
    s, bits = ppm.PAD + text, 0.0
    for i in range(len(ppm.PAD), len(s)):
        for n in range(ppm.ORDER, -2, -1):
            if n < 0:
                bits += 8
                break
            seen = counts.get(s[i - n : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if s[i] in seen:
                bits -= math.log2(seen[s[i]] / whole)
                break
            bits -= math.log2(len(seen) / whole)
    return bits


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: b.replace(b"\n", b"")) | st.text("abnd cz", max_size=15).map(str.encode), max_size=5))
def test_exact_code_lengths(texts):
    models = ppm.Models.train(TRAIN)
    got = models.bits(texts)
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx([brute(TRAIN[c], text) for c in models.classes], rel=2e-3, abs=0.05)


WORDS = {
    "en": "the soil was dried and the sample weighed in every batch of water from this river after we had measured",
    "de": "der Boden wurde getrocknet und die Probe gewogen in jeder Charge des Wassers aus diesem Fluss nachdem wir",
    "fr": "le sol a été séché et l’échantillon pesé dans chaque lot de cette eau de la rivière après que nous avons",
    "zh": "土壤 干燥 样品 称重 每个 批次 的 水 河流 之后 我们 测量 结果 表明",
    "ja": "土壌 を 乾燥 した 試料 の 重さ を 測った それぞれ の ロット で 水 は",
    "ru": "почву сушили и образец взвешивали в каждой партии воды из этой реки после того как мы измерили",
}


def sentence(lang, rng):
    words = rng.choices(WORDS[lang].split(), k=9)
    return "".join(words) + "。" if lang in ("zh", "ja") else " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def models():
    rng = random.Random(0)
    rows = [(rng.choice([lang] * 9 + ["en"]), " ".join(sentence(lang, rng) for _ in range(4))) for lang in WORDS for _ in range(60)]
    return language.train(rows)


def test_held_out_accuracy(models):
    rng = random.Random(1)
    cases = [(lang, sentence(lang, rng) + " " + sentence(lang, rng)) for lang in WORDS for _ in range(40)]
    found = language.analyse([[t] for _, t in cases], language.Identifier(models), sentences.Model({}, 0.0))
    right = sum(models.classes[main] == lang for (lang, _), (main, _, _) in zip(cases, found, strict=True))
    assert right >= 0.97 * len(cases) and all(0 <= sure <= 1 for _, sure, _ in found)


def test_segments_and_no_language(models):
    rng = random.Random(2)
    text = "\n".join([sentence("de", rng), sentence("de", rng), "x = 3 ± 4", sentence("zh", rng), sentence("fr", rng)])
    units = sentences.train([text])
    rows = [[text], ["x = 3 ± 4"], ["ACGTACGTACGTACGTACGTACGTACGTACGT"], [], [""], ["tool run --fast a.txt"]]
    found = language.analyse(rows, language.Identifier(models), units)
    assert [models.classes[c] for c, _ in found[0][2]] == ["de", "zh", "fr"] and models.classes[found[0][0]] == "de"
    assert [m for m, _, _ in found[1:]] == [-1] * 5


@pytest.mark.parametrize("label, code", [("EN", "en"), ("en_GB", "en"), ("pt-BR", "pt"), ("中文", "zh"), ("zh-Hans", "zh"), ("日本語", "ja"), ("ger", "de"), (" Deutsch ", "de"), ("und", None), ("", None), (None, None), ("n/a", None), ("-", None)])
def test_labels(label, code):
    assert language.label_language(label) == code


def test_rows(spark, models):
    rng = random.Random(3)
    text = sentence("en", rng) + " " + sentence("en", rng)
    data = [("t", 1, "en", [text]), ("t", 2, "de", [text]), ("t", 3, None, [text, None]), ("t", 4, "en", None), ("t", 5, "en", [None, ""]), ("t", 1, "en", [text]), ("t", 6, "en", [text * 3000])]
    df = spark.createDataFrame(data, "rec_table string, rec_id bigint, label string, texts array<string>")
    got = {(r.rec_id, r.segment_no, r.lang, r.label_right) for r in language.language_rows(df, models, sentences.Model({}, 0.0)).collect()}
    assert got == {(1, 0, "en", True), (2, 0, "en", False), (3, 0, "en", False), (6, 0, "en", True)}
    assert language.language_rows(df.limit(0), models, sentences.Model({}, 0.0)).count() == 0


def test_training_on_little():
    for rows in ([], [(None, "x"), ("en", None), ("en", ""), ("zz", "abc def")], [("en", "Only one row here with a sentence.")]):
        found = language.analyse([["Only one row here."], [""]], language.Identifier(language.train(rows)), sentences.Model({}, 0.0))
        assert found[1][0] == -1 and len(found) == 2


def test_garbled_rows_are_restored_first(models):
    rng = random.Random(4)
    text = sentence("ru", rng) + " " + sentence("ru", rng)
    found = language.analyse([[text.encode().decode("latin-1")]], language.Identifier(models), sentences.Model({}, 0.0))
    assert models.classes[found[0][0]] == "ru"


def test_all_rows_teach(spark, tmp_path, monkeypatch):
    """The models of problem 9 are those of all labelled rows and all their bytes, without a sample."""
    rng = random.Random(6)
    rows = [(i, rng.choice([lang] * 9 + ["en"]), " ".join(sentence(lang, rng) for _ in range(4))) for i, lang in enumerate(list(WORDS) * 40)]
    rows += [(900, None, "no label here."), (901, "en", None), (902, "??", "no language of a label."), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = language.fit_all(df)
    with monkeypatch.context() as m:
        m.setattr(language, "TRAIN_BYTES", 1 << 40)
        want = language.train([(label, text) for _, label, text in rows])
    assert got.classes == want.classes and sorted(got.keys.tolist()) == sorted(want.keys.tolist())
    probe = [sentence(lang, rng).lower().encode() for lang in WORDS]
    assert got.bits(probe) == pytest.approx(want.bits(probe))
    empty = language.fit_all(df.limit(0))
    assert empty.classes == want.classes and len(empty.bits([b"abc"])) == 1

    def sampled(*_):
        raise AssertionError("a sample")

    monkeypatch.setattr(language, "bounded", sampled)
    garbled = sentence("ru", rng).encode().decode("latin-1")
    spark.createDataFrame([*rows, (950, "ru", garbled)], "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/more/documents.parquet")
    from loomsheet.llm import queries

    assert [r.doc_id for r in queries.p9_found(spark, f"{tmp_path}/more").collect()] == [950]

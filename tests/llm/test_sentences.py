import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsheet.llm import sentences

LINES = [
    "The soil was dry. Dr. Morvaine weighed 3.5 g, i.e. less. It rained at 2 a.m. Then, cf. Fig. 3, corn grew.",
    "Metals such as Zn, Cd, Pb, etc. were low. We used lot 5 of J. K. Halvinde. The yield was 12 mg/L. Was it? Yes!",
    "Die Probe wurde z. B. am 7. Mai gewogen. Die Werte gelten u. a. für Ton. Gefunden wurden Zn, Cd usw. Die Lösung war klar.",
    "样品采自河口。“应避光保存。”的样品已剔除。为什么会下降？！第二作者说：“是否稳定？”随后给出意见。（详见第3节！）结束。",
    "試料を測定した。「凍結しないこと。」とある。なぜ下がったのか？",
    "В 1997 г. на глубине 5 м. После сушки пробу взвесили. Металлы, т. е. цинк и т. д. Рецензенты спросили.",
    "हर नमूना मापा गया। नमूना सं. 11 टूट गया!",
    "เราวัดผล อุณหภูมิคงที่ 5 องศา ตัวอย่างแตก",
]


@pytest.fixture(scope="module")
def model():
    """Trained on rows of the smaller table, as the queries do; the texts of these tests aren't among them."""
    texts = pd.read_parquet("/root/testdata/sf0.01/word_texts.parquet", columns=["text"]).text
    more = pd.read_parquet("/root/testdata/sf0.1/word_texts.parquet", columns=["text"]).text
    return sentences.train([*texts.dropna(), *more.dropna()[:2000]])


def cut(model, text):
    return [text[a:b] for a, b in model.units(text)]


@pytest.mark.parametrize(
    "text, units",
    [
        ("The soil was dry. Dr. Morvaine weighed 3.5 g, i.e. less.", ["The soil was dry.", "Dr. Morvaine weighed 3.5 g, i.e. less."]),
        ("It rained at 2 a.m. Then we left.", ["It rained at 2 a.m.", "Then we left."]),
        ("样品采自河口。“应避光保存。”的样品已剔除。", ["样品采自河口。", "“应避光保存。”的样品已剔除。"]),
        ("为什么？！（详见第3节！）结束。", ["为什么？！", "（详见第3节！）", "结束。"]),
        ("One (why? because.) two. The label reads “Do not freeze.” The end.", ["One (why? because.) two.", "The label reads “Do not freeze.”", "The end."]),
        ("เราวัดผล อุณหภูมิคงที่ 5 องศา", ["เราวัดผล", "อุณหภูมิคงที่ 5 องศา"]),
        ("soil\t3.5\t4. x\r\n--- Footnotes ---\n  A note. \n\n", ["soil\t3.5\t4. x", "A note."]),
        ("subtracted.By then it was over.", ["subtracted.", "By then it was over."]),
        ("", []),
        (" \n\t\n", []),
    ],
)
def test_units(model, text, units):
    assert cut(model, text) == units


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aA. !?。”“()\n\t\r9กข\u200b "), max_size=60))
def test_units_are_whole_and_in_order(text):
    units = sentences.Model({}, 0.0).units(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in units)
    assert all(b <= c for (_, b), (c, _) in zip(units, units[1:], strict=False))
    kept = "".join(text[a:b] for a, b in units)
    lines = [x for x in sentences.BREAK.split(text) if not sentences.MARKER.match(x)]
    assert "".join(kept.split()) == "".join("".join(lines).split())


def test_viterbi_against_all_taggings(model):
    import itertools

    for line in LINES:
        found = sentences.candidates(line)[:8]
        score = [model.score(c.parts) for c in found]

        if len(sentences.candidates(line)) > 8:
            continue

        def value(tags, found=found, score=score):
            total = 0.0
            for k, tag in enumerate(tags):
                total += score[k] if tag else 0.0
                if k:
                    total += model.links[0 if found[k].end - found[k - 1].end <= model.NEAR else 1][int(tags[k - 1])][int(tag)]
            return total

        best = max(itertools.product((False, True), repeat=len(found)), key=value) if found else ()
        assert value(best) == pytest.approx(value([c.end in set(model.decode(line)) for c in found]))


def test_held_out_lines_are_found_again(model):
    """Lines of rows that weren't in the sample, joined as a paragraph would: their ends come out."""
    texts = pd.read_parquet("/root/testdata/sf0.1/word_texts.parquet", columns=["text"]).text.dropna()[2100:2400]
    hit = missed = 0
    for text in texts:
        lines = [x for x in sentences._lines(text) if x[-1] in ".!?。！？।"]
        gap = " "
        for first, second in zip(lines, lines[1:], strict=False):
            ends = {b for _, b in model.units(first + gap + second)}
            hit += len(first) in ends
            missed += len(first) not in ends
    assert hit > 500 and hit / (hit + missed) > 0.98


def test_nothing_to_learn_from():
    for texts in ([], [None, ""], ["one line"], ["ก ข\tค"]):
        model = sentences.train(texts)
        assert model.units("One line. Two") and model.links == sentences.NO_LINKS


def test_rows(spark, model):
    data = [(1, "text", 0, "Corn grew. Soil dried.", "x"), (2, "text", 0, None, "x"), (3, "footnotes", 1, "", "x"), (4, "text", 0, "Corn grew. " * 20_000, "x")]
    df = spark.createDataFrame(data, "word_id bigint, field_name string, item_no int, text string, sent_start string")
    got = sentences.unit_rows(df, model).groupBy("word_id").count().collect()
    assert {r.word_id: r["count"] for r in got} == {1: 2, 4: 20_000}
    assert sentences.unit_rows(df.limit(0), model).count() == 0
    fitted = sentences.fit(df, "text", "word_id", rows=3)
    assert isinstance(fitted, sentences.Model)

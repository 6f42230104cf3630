import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from loomsheet.llm import canonical

ALPHABET = st.characters(exclude_categories=("Cs",)) | st.sampled_from("Аасеорх \u200b\u00adéé\u200cﬁ⽔Ａ９，ำ각ᄀ\u0327\u0301") | st.sampled_from([chr(0x301), chr(0x323), chr(0x302)])


def brute(text):
    """The form by plain string functions, code point by code point."""
    folded = "".join(canonical._fold(ord(c)) for c in text)
    ordered, run = [], []
    for c in folded:
        if unicodedata.combining(c):
            run.append(c)
        else:
            ordered += [*sorted(run, key=unicodedata.combining), c]
            run = []
    return unicodedata.normalize("NFC", "".join([*ordered, *sorted(run, key=unicodedata.combining)]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), max_size=6))
def test_against_plain_functions(texts):
    assert canonical.canonical_batch(texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=40))
def test_form_of_form(text):
    form = canonical.canonical_batch([text])
    assert canonical.canonical_batch(form) == form


def test_equal_and_different_looks():
    def form(t):
        return canonical.canonical_batch([t])[0]

    for a, b in [("Ａ１（％）", "A1(%)"), ("a\u00a0b", "a b"), ("a\u3000b", "a b"), ("zero\u200bwidth\u00ad", "zerowidth"), ("МVХ‐1", "MVX-1"), ("e\u0301", "é"), ("ﬁeld", "field"), ("⽔", "水"), ("µ", "μ")]:
        assert form(a) == form(b)
    for a, b in [("a", "A"), ("e", "é"), ("m²", "m2"), ("CO₂", "CO2"), ("a  b", "a b"), ("%", "‰"), (".", ",")]:
        assert form(a) != form(b)


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "key string, text string, canonical string, f1 bigint")
    return sorted(tuple(r) for r in canonical.equal_looks(df).collect())


def test_pairs(spark):
    rows = [("b", "x\u200by"), ("a", "xy"), ("c", "xy"), ("d", "x y"), ("e", "x\u00a0y"), ("f", None), (None, "xy"), ("g", ""), ("h", "\u200b"), ("a", "xy"), ("b", "x\u200by")]
    assert pairs(spark, [(*r, "clash", 1) for r in rows]) == [("a", "b"), ("b", "c"), ("d", "e"), ("g", "h")]
    assert pairs(spark, []) == []


def test_frequent_spelling(spark):
    rows = [(f"k{i:04d}", "same", "", 0) for i in range(400)] + [("z", "ѕame", "", 0)]
    assert pairs(spark, rows) == [(f"k{i:04d}", "z") for i in range(400)]


def test_long_and_null_column(spark):
    long = "é，" * 400_000
    df = spark.createDataFrame([(1, long), (2, None)], "id int, t string")
    got = {r.id: r.n for r in canonical.with_canonical(df, "t").selectExpr("id", "length(canonical) as n").collect()}
    assert got == {1: 800_000, 2: None}

import pytest

from loomsheet.operators import units

COLUMNS = "format_id bigint, producer string, hint string, font_size string, first_line_indent string, line_spacing string, space_before string, note string"


def found(spark, *rows, notes=()):
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], COLUMNS)
    sources = spark.createDataFrame(list(notes), "producer string, note string")
    return {(r.format_id, r.field_name): r.common_value for r in units.common_values(df, sources).collect()}


@pytest.mark.parametrize(
    "text, twips",
    [("12pt", 240), (" 1,27 cm ", 720), ("１２．７ ｍｍ", 720), ("0.5\"", 720), ("96px", 1440), ("10.7 px", 161), ("26.7px", 401), ("37.3px", 560), ("2 pica", 480), ("304800 EMU", 480), ("2ch", 480), ("2 字符", 480)],
)
def test_lengths(spark, text, twips):
    assert found(spark, (None, None, "24", text, None, None)) == {(0, "first_line_indent"): twips}


@pytest.mark.parametrize("text, twips", [("1.5倍", 360), ("150%", 360), ("single", 240), ("双倍行距", 480), ("固定值20磅", 400), ("at least 12pt", 240), ("multiple 1.25", 300), ("多倍行距1.5", 360), ("2 lines", 480)])
def test_line_spacing(spark, text, twips):
    assert found(spark, (None, None, None, None, text, None)) == {(0, "line_spacing"): twips}


def test_sizes_and_no_quantities(spark):
    assert found(spark, (None, None, "小四", None, None, None), (None, None, "五号", None, None, None)) == {(0, "font_size"): 24, (1, "font_size"): 21}
    nothing = [(None, None, x, x, x, x) for x in (None, "", "auto", "-", "?", "默认", "24", "1.2.3 pt", "pt")]
    assert found(spark, *nothing) == {}


def test_order_of_statements(spark):
    notes = [("p", "All lengths are points (72 to the inch)."), ("q", None)]
    rows = [("p", None, "12", None, None, None), ("p", "all four measures in millimetres", "10", None, None, None), ("p", "see reviewer note", "1cm", None, None, None), ("q", None, "12", None, None, None), (None, None, "12", None, None, None)]
    assert found(spark, *rows, notes=notes) == {(0, "font_size"): 24, (1, "font_size"): 57, (2, "font_size"): 57}


def test_character_is_as_wide_as_the_size_that_comes_out(spark):
    assert found(spark, (None, None, "4.07mm", "2 字符", None, None)) == {(0, "font_size"): 23, (0, "first_line_indent"): 460}


def test_character_needs_size(spark):
    assert found(spark, (None, None, None, "2ch", None, None), (None, None, "auto", "2ch", None, None)) == {}
    assert found(spark, (None, None, "14%", None, None, None)) == {}


def test_notes():
    n = units.parse_note("Everything was measured in CSS pixels, except line height, which is a percentage of single spacing.")
    assert n == {"font_size": "px", "first_line_indent": "px", "line_spacing": "percent", "space_before": "px"}
    assert units.parse_note("sizes and spacing are in points, the indent is in cm")["first_line_indent"] == "cm"
    assert units.parse_note(None) == units.parse_note("待核对") == {}


def test_very_long_texts(spark):
    long = "9" * 200_000
    assert found(spark, (None, None, long, "x" * 200_000, "1 " * 100_000, "12pt" + " " * 100_000)) == {(0, "space_before"): 240}


def test_copies_and_empty(spark):
    assert len(found(spark, (None, None, "12pt", None, None, None))) == 1
    assert found(spark) == {}

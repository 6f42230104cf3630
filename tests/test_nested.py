import datetime
import json

from loomsheet.operators import nested

SCHEMA = "record_id bigint, payload string, tool_version string, received_at timestamp, entity string"


def at(day):
    return datetime.datetime(2024, 1, day)


def rows(spark, *payloads):
    data = [(i, p if p is None or isinstance(p, str) else json.dumps(p), "v1", at(1), "clash") for i, p in enumerate(payloads)]
    out = nested.tagged_rows(spark.createDataFrame(data, SCHEMA)).collect()
    return {(r.record_id, r.entity, r.node_path, r.parent_path) for r in out}


def test_paths_groups_and_forms(spark):
    record = {"Slides": [None, {"Index": 2, "Shapes": [{"Name": "a"}, "x", {"Type": "Group", "Shapes": json.dumps([{"Name": "b"}])}]}]}
    expected = {("slide", "1", ""), ("shape", "1.0", "1"), ("shape", "1.2", "1"), ("shape", "1.2.0", "1.2")}
    forms = [record, json.dumps(json.dumps(record)), "\ufeff" + json.dumps(record), {"ok": True, "data": {"slides": record["Slides"]}}]
    got = rows(spark, *forms)
    for i in range(len(forms)):
        assert {x[1:] for x in got if x[0] == i} == expected


def test_lone_elements_nulls_and_damage(spark):
    got = rows(spark, {"QualityIssues": {"类别": "x"}}, {"Slides": {"Shapes": {"Name": "n"}}}, {"Slides": None}, {}, None, "", "{", "[1]", '"text"', {"Slides": [1, "s", []]})
    assert got == {(0, "quality_issue", "0", ""), (1, "slide", "0", ""), (1, "shape", "0.0", "0")}


def test_latest_complete_delivery(spark):
    good, better, broken = ({"Slides": [{}]}, {"Slides": [{}, {}]}, '{"Slides": [')
    data = [(1, json.dumps(good), "v1", at(1), ""), (1, json.dumps(better), "v1", at(2), ""), (1, broken, "v2", at(3), ""), (2, broken, "v1", at(1), ""), (3, json.dumps(good), None, None, ""), (None, json.dumps(good), "v1", at(1), "")]
    df = spark.createDataFrame(data + data, SCHEMA)
    assert sorted((r.record_id, r.node_path) for r in nested.tagged_rows(df).collect()) == [(1, "0"), (1, "1"), (3, "0")]


def test_very_deep_and_empty(spark):
    deep = {"Name": "leaf"}
    for _ in range(150):
        deep = {"Shapes": [deep]}
    assert len(rows(spark, {"Slides": [deep]})) == 151
    assert nested.tagged_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_written_tables_join(spark, tmp_path):
    data = [(1, json.dumps({"Slides": [{"Index": 7, "Shapes": [{"Name": "s", "X": 1.5, "FontSize": None}]}]}), "v1", at(1), "")]
    nested.write_tables(spark.createDataFrame(data, SCHEMA), str(tmp_path / "t"))
    slides, shapes = (nested.read_table(spark, str(tmp_path / "t"), e) for e in ("slide", "shape"))
    joined = shapes.alias("c").join(slides.alias("p"), "record_id").filter("c.parent_path = p.node_path").first()
    assert (joined["index"], joined["name"], joined["x"], joined["fontsize"]) == (7, "s", 1.5, None)

import pytest

from loomsheet.operators.fluent import Collection, eq
from loomsheet.plans.docsql import Database


@pytest.fixture(scope="module")
def db(spark):
    rows = [(1, 3, "a", [1, 2]), (2, None, "A", []), (3, 9, "b", None), (4, 3, None, [5])]
    return Database(spark, {"t": spark.createDataFrame(rows, "_id int, x int, s string, items array<int>")})


def ids(db, where):
    return [r[0] for r in db.execute(f"SELECT _id FROM t WHERE {where} ORDER BY _id").collect()]


@pytest.mark.parametrize(
    "where, expected",
    [("x < 5", [1, 2, 4]), ("x <= 3", [1, 2, 4]), ("x > 3", [3]), ("x = null", [2]), ("x != 3", [2, 3]), ("s = 'a'", [1, 2]), ("s > 'A'", [1, 3]), ("s LIKE 'A%'", [1, 2]), ("s IN ['A', 'B']", [1, 2, 3]), ("x BETWEEN 3 AND 8", [1, 4]), ("missing = null", [1, 2, 3, 4]), ("items[*] ANY > 1", [1, 4]), ("items[*] ALL > 1", [2, 3, 4]), ("items ANY = 5", [4]), ("x = 3 AND s = 'a' OR _id = 3", [1, 3])],
)
def test_comparisons(db, where, expected):
    assert ids(db, where) == expected


def test_precedence_modes(spark):
    one = Database(spark).execute("SELECT { a: 10 - 3 + 2, b: 2 * 6 / 4 }").first()
    old = Database(spark, legacy=True).execute("SELECT { a: 10 - 3 + 2, b: 2 * 6 / 4 }").first()
    assert (one.a, one.b) == (9, 3) and (old.a, old.b) == (5, 3)


def test_division_and_text(spark):
    row = Database(spark).execute("SELECT { a: 1 / 0, c: 'n' + 1, d: 7 % 3 }").first()
    assert (row.a, row.c, row.d) == (float("inf"), "n1", 1)


def test_paths_and_lambdas(db):
    row = db.execute("SELECT { a: items[0], b: items[-1], c: SUM(MAP(items[*] => @ * 2)), d: COUNT(FILTER(items[*] => @ > 1)), e: items[@ > 1] } FROM t WHERE _id = 1").first()
    assert (row.a, row.b, row.c, row.d, row.e) == (1, 2, 6, 1, [2])


def test_order_and_group(db):
    assert [r[0] for r in db.execute("SELECT _id FROM t ORDER BY x DESC, _id").collect()] == [3, 1, 4, 2]
    assert sorted(tuple(r) for r in db.execute("SELECT { k: @key, n: COUNT(*) } FROM t GROUP BY x HAVING COUNT(*) > 1").collect()) == [(3, 2)]
    assert tuple(db.execute("SELECT { n: COUNT(*), s: SUM(*.x) } FROM t WHERE _id > 99").first()) == (0, 0)


def test_commands(spark):
    db = Database(spark, {"t": spark.createDataFrame([(1, "a")], "_id int, s string")})
    assert db.execute("INSERT INTO t VALUES { _id: 2, s: 'b' }").first()[0] == 1
    assert db.execute("UPDATE t SET s = 'z', n = 5 WHERE _id = 2").first()[0] == 1
    assert sorted(tuple(r) for r in db.execute("SELECT $ FROM t").collect()) == [(1, "a", None), (2, "z", 5)]
    assert db.execute("DELETE t WHERE _id = 1").first()[0] == 1 and db.tables["t"].count() == 1
    db.execute("CREATE UNIQUE INDEX i ON t(s)")
    db.execute("INSERT INTO t VALUES { _id: 3, s: 'z' }")
    with pytest.raises(ValueError):
        db.execute("CREATE UNIQUE INDEX j ON t(s)")
    db.execute("RENAME COLLECTION t TO u")
    assert [r.name for r in db.execute("SELECT $ FROM $cols").collect()] == ["u"]
    assert db.execute("PRAGMA TIMEOUT = 5").first()[0] == "5" and db.execute("BEGIN TRANSACTION").first()[0]
    assert "Scan" in db.execute("EXPLAIN SELECT $ FROM u").first()[0]
    db.execute("DROP COLLECTION u")
    for wrong in ("SELECT $ FROM nope", "UPDATE t SET _id = 1", "SELECT COUNT( FROM t", "FLY"):
        with pytest.raises((ValueError, KeyError)):
            db.execute(wrong)


def test_files(spark, tmp_path):
    db = Database(spark, {"t": spark.createDataFrame([(1, "a,b"), (2, None)], "_id int, s string")})
    path = str(tmp_path / "x.csv")
    db.execute(f"SELECT _id, s INTO $file('{path}') FROM t")
    assert sorted(r._id for r in db.execute(f"SELECT _id FROM $file('{path}')").collect()) == ["1", "2"]


def test_collection(spark):
    c = Collection(spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "_id int, s string"))
    assert c.find_by_id(2)["s"] == "y" and c.find_by_id(9) is None and c.query().where(eq("s", "Y")).count() == 2 and c.min("_id") == 1
    with pytest.raises(LookupError):
        c.query().where(eq("s", "y")).single()
    assert c.query().where("s = @v", {"v": "x"}).exists() and not c.query().where("_id > 5").exists()
    assert c.query().where("_id = 1").single()["s"] == "x" and "Scan" in c.query().where("_id = 1").get_plan()


def test_values(spark):
    from pyspark.sql import functions as F

    from loomsheet.functions import values

    texts = ["null", "3", "2.5", '"b"', '"a"', "true", "[1]", '{"a":1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", F.parse_json("t"))
    got = [r.t for r in df.orderBy(values.variant_key(F.col("v"))).collect()]
    assert got == ["null", "2.5", "3", '"a"', '"b"', '{"a":1}', "[1]", "true"]

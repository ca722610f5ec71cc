import pytest

from millrace.errors import BindError
from millrace.operators import relational as R
from millrace.plans.options import COMPATIBLE, Options
from millrace.session import Session
from millrace.sources.catalog import from_text, to_text
from millrace.sources.layouts import KeyedTable, Layout
from millrace.sources.text import console_line, parse_rows, to_lines

FROM = " FROM t AS a WHERE (a.x > 0)"


@pytest.fixture
def own(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(1, 4, 1.5, "p"), (2, 3, 2.5, "q"), (2, 3, 2.5, "q"), (5, 0, 0.5, "p")], "x int, y bigint, z double, s string"))
    return s


def one(own, text):
    return own.query(text).first()[0]


def test_sums(own):
    assert one(own, "SELECT SUM (a.x + a.y)" + FROM) == 20
    # (1, 4), (2, 3), (5, 0): tuples are distinct, not values.
    assert one(own, "SELECT SUM DISTINCT (a.x + a.y)" + FROM) == 15
    assert one(own, "SELECT SUM (a.x * a.z)" + FROM) == pytest.approx(14.0)
    assert one(own, "SELECT SUM (a.x - 7 / 2)" + FROM) == 10 - 4 * 3 + 0
    assert one(own, "SELECT SUM (a.z)" + FROM.replace("> 0", "> 99")) == 0.0
    assert own.query("SELECT SUM (a.x)" + FROM).schema[0].dataType.simpleString() == "bigint"
    big = own.spark.createDataFrame([(2**31 - 1,), (2**31 - 1,)], "x int")
    own.register("t", big)
    assert one(own, "SELECT SUM (a.x * 2)" + FROM) == 4 * (2**31 - 1)


def test_group_by(own):
    rows = own.query("SELECT SUM DISTINCT (a.x), a.s" + FROM + " GROUP BY a.s").collect()
    assert sorted(map(tuple, rows)) == [(2, "q"), (6, "p")]
    assert own.query("SELECT SUM (a.x)" + FROM.replace("> 0", "> 99") + " GROUP BY a.s").collect() == []
    alone = Session(own.spark, options=COMPATIBLE)
    alone.catalog.tables = own.catalog.tables
    assert alone.query("SELECT SUM DISTINCT (a.x), a.s" + FROM + " GROUP BY a.s").columns == ["SUM"]
    assert alone.query("SELECT SUM DISTINCT (a.x)" + FROM).first()[0] == 10
    assert alone.query("SELECT DISTINCT a.x, a.s" + FROM).columns == ["a.s", "a.x"]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a.nope" + FROM, "SELECT a.x FROM nope AS a WHERE (a.x > 0)", "SELECT x" + FROM, "SELECT a.x FROM t AS a WHERE (a.nope > 0)",
        "SELECT a.x FROM t AS a WHERE (a.z > 5)", "SELECT a.x FROM t AS a WHERE (a.s = 5)", "SELECT SUM (a.s)" + FROM, "SELECT SUM (a.x), a.s" + FROM,
        "SELECT a.x" + FROM + " GROUP BY a.x", "SELECT SUM (a.x), a.y" + FROM + " GROUP BY a.s", "SELECT a.x FROM t AS a, t AS a WHERE (a.x > 0)",
    ],
)
def test_errors(own, text):
    with pytest.raises(BindError):
        own.query(text)
    own.query("SELECT a.x" + FROM)  # the session goes on


def test_coercion_is_an_option(own):
    free = Session(own.spark, options=Options(coerce=True))
    free.catalog.tables = own.catalog.tables
    assert free.query("SELECT a.x FROM t AS a WHERE (a.z > 1)").count() == 3


def test_plan_text(own):
    own.sql("SET OUTPUT NONE")
    plan = own.sql("SELECT SUM DISTINCT (a.x / a.y), a.s FROM t AS a, t AS b WHERE (a.x = b.x) AND (b.y > 1) GROUP BY a.s")
    assert plan.count("Operation: Select File") == 2 and "Operation: Duplicate Removal" in plan
    assert "(a.x = b.x)" in plan and "(b.y > 1)" in plan and "(a.x / a.y)" in plan and "SUM : Int" in plan
    assert plan.index("Operation: Join") < plan.index("Operation: Group By")


TEXT = ["1|a b|2.5|", '-2x| "q"|1e1y|', "z||.5|", "9|short", "4|é|-|"]
SCHEMA = [("i", "Int"), ("s", "String"), ("d", "Double")]


def test_text_fields(spark):
    rows = parse_rows(spark, TEXT, SCHEMA)
    assert sorted(map(tuple, rows.collect())) == sorted([(1, "a b", 2.5), (-2, ' "q"', 10.0), (0, "", 0.5), (4, "é", 0.0)])
    assert [r.value for r in to_lines(rows, SCHEMA).collect()][:2] == ["1|a b|2.500000|", '-2| "q"|10.000000|']
    assert console_line((1, "x", 1234567.0), SCHEMA) == "i: [1], s: [x], d: [1.23457e+06]"


@pytest.mark.parametrize("layout", ["HEAP", "SORTED ON s, i", "BTREE"])
def test_life_of_a_table(spark, tmp_path, layout):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "t.tbl").write_text("\n".join(TEXT))
    (tmp_path / "data" / "u.tbl").write_text("7|only|0.0|")
    own = Session(spark, str(tmp_path / "root"), str(tmp_path / "data"))
    create = f"CREATE TABLE t (i INTEGER, s STRING, d DOUBLE) AS {layout}"
    assert own.sql(create) is None and own.sql(create) == "table t exists"
    assert own.query("SELECT a.i FROM t AS a WHERE (a.i > -9)").count() == 0
    own.sql("INSERT 't.tbl' INTO t")
    assert own.query("SELECT a.i FROM t AS a WHERE (a.d > 0.4)").count() == 3
    again = Session(spark, str(tmp_path / "root"), str(tmp_path / "data"))
    assert again.query("SELECT SUM (a.i) FROM t AS a WHERE (a.i > -9)").first()[0] == 3
    again.sql("INSERT 'u.tbl' INTO t")  # a load replaces what was there
    assert [tuple(r) for r in again.query("SELECT a.i, a.s FROM t AS a WHERE (a.i > -9)").collect()] == [(7, "only")]
    again.sql(f"SET OUTPUT '{tmp_path / 'out'}'")
    again.sql("SELECT a.i, a.d FROM t AS a WHERE (a.i > 0)")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["7|0.000000|"]
    again.sql("DROP TABLE t")
    with pytest.raises(BindError):
        again.query("SELECT a.i FROM t AS a WHERE (a.i > 0)")
    assert "t" not in Session(spark, str(tmp_path / "root")).catalog
    again.sql("EXIT")
    assert again.over


def test_bad_tables(spark, tmp_path):
    own = Session(spark, str(tmp_path))
    for text in ("CREATE TABLE t (a INTEGER, a DOUBLE) AS HEAP", "CREATE TABLE t (a INTEGER) AS SORTED ON b", "INSERT 'x' INTO t", "DROP TABLE t"):
        with pytest.raises(BindError):
            own.sql(text)
    said = []
    own.run("SELECT", said.append)
    own.run("DROP TABLE t", said.append)
    assert said[0].startswith("ParseError") and said[1].startswith("BindError")


def test_keyed_tables(spark, tmp_path):
    layout = Layout("tree", ("k",))
    layout.write(spark.createDataFrame([(k % 50, f"v{k}") for k in range(100)], "k bigint, v string"), str(tmp_path / "a"))
    t = KeyedTable(spark, str(tmp_path / "a"), layout)
    assert t.get(7).count() == 2 and t.get(99).count() == 0 and t.between(-5, 3).count() == 8
    assert [r.k for r in t.between(0, 9, limit=3).collect()] == [0, 0, 1]
    more = t.insert(spark.createDataFrame([(7, "new")], "k bigint, v string"), str(tmp_path / "b"))
    assert more.get(7).count() == 3 and t.get(7).count() == 2
    less = more.remove(7, str(tmp_path / "c"))
    assert less.get(7).count() == 0 and less.rows().count() == 98
    new = less.update(8, spark.createDataFrame([(8, "one")], "k bigint, v string"), str(tmp_path / "d"))
    assert [r.v for r in new.get(8).collect()] == ["one"]


def test_sort_and_product(spark):
    df = spark.createDataFrame([(2, "b", 1.0), (1, "Z", 2.0), (1, "a", 0.5)], "i int, s string, d double")
    assert [r.s for r in R.sort(df, ["i", "s"]).collect()] == ["Z", "a", "b"]
    assert R.default_order(df) == ["i", "d", "s"]
    assert R.join(R.scan(df, "x"), R.scan(df, "y")).count() == 9
    assert R.join(R.scan(df, "x"), R.scan(df, "y"), "(x.i > y.i)").count() == 2
    assert R.sum_(df, "i * d").first()[0] == pytest.approx(4.5)


def test_catalog_text():
    text = "BEGIN\nabc\nabc.tbl\natt1 Int\natt2 Double\nEND\n\nBEGIN\nd\nd.tbl\nx String\nEND\n"
    tables = from_text(text)
    assert [(t.name, t.columns) for t in tables] == [("abc", [("att1", "Int"), ("att2", "Double")]), ("d", [("x", "String")])]
    assert from_text(to_text(tables)) == tables
    with pytest.raises(BindError):
        from_text("BEGIN\na\na.tbl\nx Float\nEND")


def test_a_shell_survives_errors_of_the_engine_below(own, tmp_path):
    said = []
    own.run("SELECT SUM (a.x / 0)" + FROM, said.append)
    made = Session(own.spark, str(tmp_path / "root"), str(tmp_path))
    made.sql("CREATE TABLE t (i INTEGER) AS HEAP")
    made.run("INSERT 'missing.tbl' INTO t", said.append)
    assert len(said) == 2 and all("Exception" in x for x in said)
    own.run("SELECT a.x" + FROM, said.append)
    assert len(said) == 6
    big = Session(own.spark)
    big.register("t", own.spark.range(2500).selectExpr("id as x"))
    lines = []
    big.run("SELECT a.x FROM t AS a WHERE (a.x > -1)", lines.append)
    assert len(lines) == 2500


def test_null_keys_and_null_fields(spark, tmp_path):
    layout = Layout("tree", ("k",))
    layout.write(spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k bigint, v string"), str(tmp_path / "a"))
    t = KeyedTable(spark, str(tmp_path / "a"), layout)
    assert sorted(r.v for r in t.remove(1, str(tmp_path / "b")).rows().collect()) == ["b", "c"]
    assert sorted(r.v for r in t.update(2, spark.createDataFrame([(2, "d")], "k bigint, v string"), str(tmp_path / "c")).rows().collect()) == ["a", "b", "d"]
    rows = spark.createDataFrame([(None, None, None)], "i bigint, s string, d double")
    assert [r.value for r in to_lines(rows, SCHEMA).collect()] == ["|||"]


def test_readers_outlive_one_load(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|\n2|\n")
    own = Session(spark, str(tmp_path / "root"), str(tmp_path))
    own.sql("CREATE TABLE t (i INTEGER) AS HEAP")
    own.sql("INSERT 't.tbl' INTO t")
    begun = own.query("SELECT a.i FROM t AS a WHERE (a.i > 0)")
    own.sql("INSERT 't.tbl' INTO t")
    assert begun.count() == 2
    assert len(list((tmp_path / "root" / "t").iterdir())) == 2


def test_cheapest_order_in_the_plan(spark):
    own = Session(spark)
    own.register("big", spark.range(1000).selectExpr("id as k", "id % 10 as g"))
    own.register("small", spark.range(10).selectExpr("id as g"))
    text = "SELECT b.k FROM big AS b, small AS s WHERE (b.g = s.g) AND (b.k = 7)"
    assert "Cheapest" not in own.explain(text)
    own.analyze("big", exact=True)
    own.analyze("small", exact=True)
    assert "Cheapest order, with estimated rows: b (1), s (1)" in own.explain(text)
    assert "s (10), b (1000)" in own.explain(text.replace(" AND (b.k = 7)", ""))

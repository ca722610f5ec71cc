"""The dialect's queries over the driver's tables, with ordinary SQL for each.

Every entry runs statement text, or an operator of the API, over whole tables.
Sums of doubles are rounded to cents on both sides, as they are added in
different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from tempfile import mkdtemp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .operators import relational as R
from .plans.estimator import Statistics, orders
from .plans.options import Options
from .plans.parser import parse_predicate
from .plans.syntax import predicate_text
from .session import Session
from .sources import files
from .sources.catalog import SPARK_TYPES, from_text, to_text
from .sources.layouts import KeyedTable, Layout, scan
from .sources.text import from_lines, parse_rows, to_lines

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def session(spark: SparkSession, sf_dir: str, options: Options = Options()) -> Session:
    found = Session(spark, options=options)
    found.register_folder(sf_dir, TABLES)
    return found


def _plain(df: DataFrame, **changed: Column | str) -> DataFrame:
    """Names without their qualifier; SUM and others as asked for."""
    names = [changed.get(c.replace(".", "__"), c.rpartition(".")[2]) for c in df.columns]
    return df.toDF(*names)


def _cents(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.round(name, 2))


def _add(name: str, text: str, oracle: str, cents: str | None = None, options: Options = Options(), **changed: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _plain(session(spark, sf_dir, options).query(text), **changed)
        return _cents(found, cents) if cents else found

    query.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = query, oracle


_add("select_eq", "SELECT n.n_nationkey FROM nation AS n WHERE (n.n_name = 'NATION_7')", "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7'")
_add(
    "select_cnf_or",
    "SELECT l.l_orderkey, l.l_linenumber, l.l_discount FROM lineitem AS l WHERE (l.l_returnflag = 'R') AND (l.l_discount < 0.04 OR l.l_linestatus = 'F')",
    "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_returnflag = 'R' AND (l_discount < 0.04 OR l_linestatus = 'F')",
)
_add(
    "select_att_att",
    "SELECT l.l_orderkey, l.l_partkey, l.l_suppkey FROM lineitem AS l WHERE (l.l_partkey < l.l_suppkey)",
    "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey < l_suppkey",
)
_add("select_literals", "SELECT r.r_name FROM region AS r WHERE (1 < 2) AND ('a' = 'a' OR r.r_regionkey = 9)", "SELECT r_name FROM region WHERE 1 < 2")
_add(
    "select_date_text",
    "SELECT o.o_orderkey, o.o_orderdate FROM orders AS o WHERE (o.o_orderdate < '1995-03-01')",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1995-03-01'",
)
_add(
    "project_all",
    "SELECT n.n_nationkey, n.n_name, n.n_regionkey FROM nation AS n WHERE (n.n_nationkey > -1)",
    "SELECT n_nationkey, n_name, n_regionkey FROM nation",
)
_add(
    "project_reversed",
    "SELECT n.n_nationkey, n.n_name FROM nation AS n WHERE (n.n_nationkey > 3)",
    "SELECT n_name, n_nationkey FROM nation WHERE n_nationkey > 3",
    options=Options(reversed_columns=True),
)
_add(
    "join_equi",
    "SELECT n.n_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey > 5)",
    "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 5",
)
_add(
    "join_theta",
    "SELECT s.s_suppkey, n.n_name FROM supplier AS s, nation AS n WHERE (s.s_nationkey > n.n_nationkey) AND (n.n_nationkey > 20)",
    "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey > n_nationkey WHERE n_nationkey > 20",
)
_add(
    "join_cross",
    "SELECT n.n_name, r.r_name FROM nation AS n, region AS r WHERE (n.n_nationkey > 3)",
    "SELECT n_name, r_name FROM nation CROSS JOIN region WHERE n_nationkey > 3",
)
_add(
    "join_self",
    "SELECT n1.n_name, n2.n_nationkey FROM nation AS n1, nation AS n2 WHERE (n1.n_regionkey = n2.n_regionkey)",
    "SELECT a.n_name, b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
)
_add(
    "join_cross_table_or",
    "SELECT n.n_name, s.s_suppkey FROM nation AS n, supplier AS s WHERE (n.n_nationkey = s.s_nationkey) AND (n.n_regionkey = 1 OR s.s_acctbal > 5000.0)",
    "SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE n_regionkey = 1 OR s_acctbal > 5000.0",
)
_add(
    "join_two_conditions",
    "SELECT l.l_orderkey, o.o_custkey FROM lineitem AS l, orders AS o WHERE (l.l_orderkey = o.o_orderkey) AND (l.l_partkey > o.o_custkey)",
    "SELECT l_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_partkey > o_custkey",
)
_add(
    "join_3way_lineitem",
    "SELECT SUM (l.l_extendedprice), s.s_suppkey FROM part AS p, lineitem AS l, supplier AS s "
    "WHERE (p.p_partkey = l.l_partkey) AND (s.s_suppkey = l.l_suppkey) AND (s.s_acctbal > 2500.0) GROUP BY s.s_suppkey",
    "SELECT ROUND(SUM(l_extendedprice), 2) AS sum_price, s_suppkey FROM part JOIN lineitem ON p_partkey = l_partkey "
    "JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 2500.0 GROUP BY s_suppkey",
    cents="sum_price",
    SUM="sum_price",
)
_add(
    "sum_int",
    "SELECT SUM (n.n_nationkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name = 'NATION_7')",
    "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS sum_key FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_7'",
    SUM="sum_key",
)
_add(
    "sum_empty",
    "SELECT SUM (n.n_nationkey) FROM nation AS n WHERE (n.n_name = 'NOWHERE')",
    "SELECT CAST(COALESCE(SUM(n_nationkey), 0) AS BIGINT) AS sum_key FROM nation WHERE n_name = 'NOWHERE'",
    SUM="sum_key",
)
_add(
    "sum_double_expr",
    "SELECT SUM (l.l_extendedprice * (1 - l.l_discount)) FROM lineitem AS l WHERE (l.l_quantity > 10.0)",
    "SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_revenue FROM lineitem WHERE l_quantity > 10.0",
    cents="sum_revenue",
    SUM="sum_revenue",
)
_add(
    "sum_right_assoc",
    "SELECT SUM (l.l_linenumber - l.l_partkey - l.l_suppkey) FROM lineitem AS l WHERE (l.l_orderkey > 0)",
    "SELECT CAST(SUM(l_linenumber - (l_partkey - l_suppkey)) AS BIGINT) AS sum_right FROM lineitem WHERE l_orderkey > 0",
    SUM="sum_right",
)
_add(
    "sum_negative",
    "SELECT SUM (- l.l_linenumber * l.l_linenumber + 3) FROM lineitem AS l WHERE (l.l_orderkey > 0)",
    "SELECT CAST(SUM(-(l_linenumber * (l_linenumber + 3))) AS BIGINT) AS sum_negative FROM lineitem WHERE l_orderkey > 0",
    SUM="sum_negative",
)
_add(
    "sum_int_div",
    "SELECT SUM (l.l_partkey / 7) FROM lineitem AS l WHERE (l.l_orderkey > 0)",
    "SELECT CAST(SUM(l_partkey // 7) AS BIGINT) AS sum_div FROM lineitem WHERE l_orderkey > 0",
    SUM="sum_div",
)
_add(
    "sum_distinct_scalar",
    "SELECT SUM DISTINCT (l.l_linenumber + l.l_suppkey) FROM lineitem AS l WHERE (l.l_orderkey > 0)",
    "SELECT CAST(SUM(l_linenumber + l_suppkey) AS BIGINT) AS sum_tuples FROM (SELECT DISTINCT l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey > 0)",
    SUM="sum_tuples",
)
_add(
    "group_join",
    "SELECT SUM (s.s_acctbal), n.n_name FROM supplier AS s, nation AS n WHERE (s.s_nationkey = n.n_nationkey) GROUP BY n.n_name",
    "SELECT ROUND(SUM(s_acctbal), 2) AS sum_bal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    cents="sum_bal",
    SUM="sum_bal",
)
_add(
    "group_multi",
    "SELECT SUM (l.l_quantity), l.l_returnflag, l.l_linestatus FROM lineitem AS l WHERE (l.l_orderkey > 0) GROUP BY l.l_returnflag, l.l_linestatus",
    "SELECT ROUND(SUM(l_quantity), 2) AS sum_qty, l_returnflag, l_linestatus FROM lineitem WHERE l_orderkey > 0 GROUP BY l_returnflag, l_linestatus",
    cents="sum_qty",
    SUM="sum_qty",
)
_add(
    "sum_distinct_group",
    "SELECT SUM DISTINCT (n.n_nationkey + r.r_regionkey), r.r_regionkey FROM nation AS n, region AS r, customer AS c "
    "WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey = c.c_nationkey) AND (n.n_nationkey > 10) GROUP BY r.r_regionkey",
    "SELECT CAST(SUM(n_nationkey + r_regionkey) AS BIGINT) AS sum_keys, r_regionkey FROM (SELECT DISTINCT n_nationkey, r_regionkey FROM nation "
    "JOIN region ON n_regionkey = r_regionkey JOIN customer ON n_nationkey = c_nationkey WHERE n_nationkey > 10) GROUP BY r_regionkey",
    SUM="sum_keys",
)
_add(
    "select_distinct",
    "SELECT DISTINCT c.c_mktsegment, c.c_nationkey FROM customer AS c WHERE (c.c_custkey > 0)",
    "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_custkey > 0",
)


def _query(oracle: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, oracle
        return f

    return add


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def select_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SelectPipe and Project through the operator API."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return R.project(R.select_pipe(rows, "(o_orderstatus = 'O')"), ["o_orderkey", "o_orderstatus"])


@_query("SELECT s_suppkey, s_name, s_acctbal, n_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SelectFile and Join through the operator API."""
    left = R.select_file(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s")
    right = R.select_file(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n", "(n.n_nationkey > -1)")
    return _plain(R.join(left, right, "(s.s_nationkey = n.n_nationkey)")).drop("s_nationkey")


@_query("SELECT DISTINCT * FROM (SELECT n_regionkey FROM nation)")
def duplicate_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicate_removal(R.project(spark.read.parquet(f"{sf_dir}/nation.parquet"), ["n_regionkey"]))


def _ranked(df: DataFrame) -> DataFrame:
    """The rows with their place in the order in which the DataFrame gives them, from 1.

    Only the number of rows of each partition is gathered.
    """
    spark, path = df.sparkSession, _folder(df.sparkSession)
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    kept = spark.read.schema(numbered.schema).parquet(path)
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    before, rows = 0, []
    for r in kept.groupBy(part.alias("part")).count().orderBy("part").collect():
        rows.append((r["part"], before))
        before += r["count"]
    bases = spark.createDataFrame(rows, "_part long, _base long")
    placed = kept.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return placed.withColumn("place", F.col("_base") + inside + 1).drop("_id", "_part", "_base")


@_query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def external_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in order of price, then key, with the place of each row in it."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _ranked(R.project(R.sort(rows, ["o_totalprice", "o_orderkey"]), ["o_orderkey", "o_totalprice"]))


@_query("SELECT s_suppkey, s_name, CAST(row_number() OVER (ORDER BY s_nationkey, s_suppkey, s_acctbal, s_name) AS BIGINT) AS place FROM supplier")
def sort_default_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparator over all columns: integers, then doubles, then strings."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    return _ranked(R.sort(rows, R.default_order(rows))).select("s_suppkey", "s_name", "place")


@_query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(printf('%.6f', c_acctbal) AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as delimited text, and read back."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    schema = list(R.types_of(rows).items())
    return from_lines(to_lines(rows, schema), schema)


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def sorted_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equality on the sort key of a sorted table."""
    layout, path = Layout("sorted", ("o_custkey",)), _folder(spark)
    layout.write(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), path)
    return KeyedTable(spark, path, layout).get(7)


@_query("SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 10 AND 20")
def tree_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of keys of a tree table."""
    layout, path = Layout("tree", ("p_partkey",)), _folder(spark)
    layout.write(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), path)
    return KeyedTable(spark, path, layout).between(10, 20)


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE, INSERT from text, SELECT: the life of a table."""
    root, data = _folder(spark), _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    R.write_out(rows, f"{data}/nation.tbl")
    own = Session(spark, root, data)
    own.sql("CREATE TABLE nation (n_nationkey INTEGER, n_name STRING, n_regionkey INTEGER) AS SORTED ON n_regionkey")
    own.sql("INSERT 'nation.tbl' INTO nation")
    return _plain(own.sql("SELECT n.n_nationkey, n.n_name FROM nation AS n WHERE (n.n_regionkey = 1)"))


_add(
    "sum_double_div",
    "SELECT SUM (l.l_extendedprice / l.l_quantity) FROM lineitem AS l WHERE (l.l_quantity > 0.0)",
    "SELECT ROUND(SUM(l_extendedprice / l_quantity), 2) AS sum_unit FROM lineitem WHERE l_quantity > 0",
    cents="sum_unit",
    SUM="sum_unit",
)
_add(
    "option_ignore_distinct",
    "SELECT SUM DISTINCT (l.l_linenumber) FROM lineitem AS l WHERE (l.l_orderkey > 0)",
    "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS sum_all FROM lineitem WHERE l_orderkey > 0",
    options=Options(ignore_distinct=True),
    SUM="sum_all",
)
_add(
    "option_distinct_sum_alone",
    "SELECT SUM DISTINCT (l.l_linenumber), l.l_returnflag FROM lineitem AS l WHERE (l.l_orderkey > 0) GROUP BY l.l_returnflag",
    "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS sum_lines FROM (SELECT DISTINCT l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey > 0) GROUP BY l_returnflag",
    options=Options(distinct_sum_alone=True),
    SUM="sum_lines",
)
_add(
    "option_ignore_columns",
    "SELECT SUM (n.n_nationkey), n.n_name FROM nation AS n WHERE (n.n_regionkey > 1)",
    "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS sum_keys FROM nation WHERE n_regionkey > 1",
    options=Options(ignore_columns=True),
    SUM="sum_keys",
)
_add(
    "option_coerce",
    "SELECT l.l_orderkey, l.l_linenumber FROM lineitem AS l WHERE (l.l_quantity > 48) AND (l.l_linenumber < 2.5)",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 48 AND l_linenumber < 2.5",
    options=Options(coerce=True),
)
_add(
    "option_any_case",
    "select n.n_name from nation as n where (n.n_nationkey < 4)",
    "SELECT n_name FROM nation WHERE n_nationkey < 4",
    options=Options(any_case=True),
)


@_query("SELECT * FROM (VALUES (1, 'a b', 2.5), (-2, ' \"q\"', 10.0), (0, '', 0.5), (4, 'ü', 0.0)) t(i, s, d)".replace("(VALUES", "(SELECT CAST(i AS BIGINT) AS i, s, CAST(d AS DOUBLE) AS d FROM (VALUES").replace(" t(i, s, d)", " t(i, s, d))"))
def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row parser over strings in memory: prefixes of numbers, blanks, a line with too few fields."""
    return parse_rows(spark, ["1|a b|2.5|", '-2x| "q"|1e1y|', "z||.5|", "9|short", "4|ü|-|"], [("i", "Int"), ("s", "String"), ("d", "Double")])


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def heap_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heap written, then scanned with a filter."""
    path = _folder(spark)
    Layout("heap").write(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), path)
    return scan(spark, path, F.col("o_totalprice") > 250000)


def _parts(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """part as a tree table, with a row whose key is null."""
    layout, path = Layout("tree", ("p_partkey",)), _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    layout.write(rows.unionByName(spark.createDataFrame([(None, "no key")], "p_partkey long, p_name string")), path)
    return KeyedTable(spark, path, layout)


_PARTS = "(SELECT p_partkey, p_name FROM part UNION ALL SELECT NULL, 'no key') p"


@_query(f"SELECT p_partkey, p_name FROM {_PARTS} UNION ALL VALUES (7, 'second seven'), (-3, 'new') ")
def tree_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put into a tree table: a new key, and one that is there already."""
    more = spark.createDataFrame([(7, "second seven"), (-3, "new")], "p_partkey long, p_name string")
    return _parts(spark, sf_dir).insert(more, _folder(spark)).rows()


@_query(f"SELECT p_partkey, p_name FROM {_PARTS} WHERE p_partkey IS DISTINCT FROM 7 AND p_partkey IS DISTINCT FROM 11")
def tree_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys removed; the row without a key stays."""
    return _parts(spark, sf_dir).remove(7, _folder(spark)).remove(11, _folder(spark)).rows()


@_query(f"SELECT p_partkey, p_name FROM {_PARTS} WHERE p_partkey IS DISTINCT FROM 7 UNION ALL SELECT 7, 'renamed'")
def tree_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a key replaced."""
    new = spark.createDataFrame([(7, "renamed")], "p_partkey long, p_name string")
    return _parts(spark, sf_dir).update(7, new, _folder(spark)).rows()


@_query("SELECT p_partkey, p_name FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 5")
def tree_range_with_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range search's own limit: the five smallest keys of a range."""
    return _parts(spark, sf_dir).between(101, 1 << 40, limit=5)


def _made(spark: SparkSession, sf_dir: str, layout: str, name: str = "supplier", options: Options = Options()) -> Session:
    """A session with a created table, loaded from delimited text; twice, as a load replaces."""
    root, data = _folder(spark), _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    R.write_out(rows, f"{data}/s.tbl")
    R.write_out(rows.where("s_nationkey = 99"), f"{data}/none.tbl")
    own = Session(spark, root, data, options)
    own.sql(f"CREATE TABLE {name} (s_suppkey INTEGER, s_name STRING, s_nationkey INTEGER) AS {layout}")
    own.sql(f"INSERT 'none.tbl' INTO {name}")
    own.sql(f"INSERT 's.tbl' INTO {name}")
    return own


_BY_NATION = "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 OR s_nationkey = 11"
_SELECT_BY_NATION = "SELECT s.s_suppkey, s.s_name FROM supplier AS s WHERE (s.s_nationkey = 3 OR s.s_nationkey = 11)"


@_query(_BY_NATION)
def create_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE … AS HEAP, INSERT, SELECT."""
    return _plain(_made(spark, sf_dir, "HEAP").sql(_SELECT_BY_NATION))


@_query(_BY_NATION)
def create_btree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE … AS BTREE, INSERT, SELECT."""
    return _plain(_made(spark, sf_dir, "BTREE").sql(_SELECT_BY_NATION))


@_query(_BY_NATION)
def reopened_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second session over the same root finds the table."""
    own = _made(spark, sf_dir, "SORTED ON s_nationkey, s_suppkey")
    return _plain(Session(spark, own.catalog.root).sql(_SELECT_BY_NATION))


@_query("SELECT * FROM (VALUES ('kept', true, 'sorted', 's_nationkey s_suppkey'), ('gone', false, NULL, NULL)) t(name, listed, layout, sort_by)")
def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file of a catalog says after DROP TABLE, read by another session; the metadata of the table that stays."""
    own = _made(spark, sf_dir, "SORTED ON s_nationkey, s_suppkey", "kept")
    own.sql("CREATE TABLE gone (x INTEGER) AS HEAP")
    own.sql("DROP TABLE gone")
    later = Session(spark, own.catalog.root).catalog
    rows = [(n, n in later, later.table(n).layout if n in later else None, " ".join(later.table(n).sort_by) if n in later else None) for n in ("kept", "gone")]
    return spark.createDataFrame(rows, "name string, listed boolean, layout string, sort_by string")


@_query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 OR s_nationkey = 11")
def set_output_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET OUTPUT 'file': the rows of a SELECT written, and read back."""
    own, path = _made(spark, sf_dir, "HEAP"), _folder(spark)
    own.sql(f"SET OUTPUT '{path}'")
    own.sql(_SELECT_BY_NATION)
    return from_lines(spark.read.text(path), [("s_suppkey", "Int"), ("s_name", "String")])


@_query("SELECT * FROM (VALUES (1, 'SELECT', 'plan'), (2, 'SELECT', 'rows'), (3, 'CREATE TABLE', 'table supplier exists'), (4, 'EXIT', 'over')) t(step, statement, result)".replace("SELECT * FROM", "SELECT CAST(step AS BIGINT) AS step, statement, result FROM", 1))
def session_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET OUTPUT NONE gives the plan, STDOUT the rows; CREATE of a table that is there changes nothing; EXIT ends."""
    own = _made(spark, sf_dir, "HEAP")
    own.sql("SET OUTPUT NONE")
    plan = own.sql(_SELECT_BY_NATION)
    own.sql("SET OUTPUT STDOUT")
    found = own.sql(_SELECT_BY_NATION)
    again = own.sql("CREATE TABLE supplier (x INTEGER) AS HEAP")
    own.sql("EXIT")
    rows = [(1, "SELECT", "plan" if isinstance(plan, str) else ""), (2, "SELECT", "rows" if isinstance(found, DataFrame) else ""), (3, "CREATE TABLE", again), (4, "EXIT", "over" if own.over else "")]
    return spark.createDataFrame(rows, "step long, statement string, result string")


@_query("SELECT 'c_custkey: [' || c_custkey || '], c_name: [' || c_name || '], c_acctbal: [' || printf('%g', c_acctbal) || ']' AS line FROM customer WHERE c_nationkey = 5")
def console_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the shell prints."""
    own, lines = session(spark, sf_dir), []
    own.run("SELECT c.c_custkey, c.c_name, c.c_acctbal FROM customer AS c WHERE (c.c_nationkey = 5)", lines.append)
    return spark.createDataFrame([(x.replace("c.c_", "c_"),) for x in lines], "line string")


_STATEMENTS = {
    "an Int meets an Int": ("(n.n_nationkey > 5)", "accepted"),
    "an Int meets a Double": ("(n.n_nationkey > 5.0)", "BindError"),
    "a String meets an Int": ("(n.n_name = 5)", "BindError"),
    "a Double meets a Double": ("(s.s_acctbal < 0.0)", "accepted"),
    "no such column": ("(n.n_size = 1)", "BindError"),
    "no parentheses": ("n.n_nationkey = 1", "ParseError"),
    "no such operator": ("(n.n_nationkey <= 1)", "ParseError"),
}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[1]}')" for k, v in _STATEMENTS.items()) + ") t(condition, result)")
def strict_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conditions the binder takes; none of the errors ends the session."""
    own, rows = session(spark, sf_dir), []
    for what, (condition, _) in _STATEMENTS.items():
        try:
            own.query(f"SELECT n.n_name FROM nation AS n, supplier AS s WHERE {condition}")
            rows.append((what, "accepted"))
        except EngineError as e:
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "condition string, result string")


_PLAN_LINES = [
    "Operation: Select File", "Operation: Select File", "Operation: Join", "Join CNF:", "(n.n_regionkey = r.r_regionkey)", "Join Keys:", "(n.n_regionkey = r.r_regionkey)",
    "Operation: Group By", "Function:", "(n.n_nationkey / 2)", "SUM : Int", "r.r_name : String", "Selection CNF:", "(n.n_nationkey > 5)", "Selection CNF:",
]


@_query("SELECT line, CAST(count(*) AS BIGINT) AS times FROM (VALUES " + ", ".join(f"('{x}')" for x in _PLAN_LINES) + ") t(line) GROUP BY line")
def plan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a plan's text, and how often each stands there."""
    text = session(spark, sf_dir).explain(
        "SELECT SUM (n.n_nationkey / 2), r.r_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey > 5) GROUP BY r.r_name"
    )
    end = text[text.index("Operation: Group By") :]
    wanted = set(_PLAN_LINES) - {"SUM : Int", "r.r_name : String"}
    lines = [x for x in text.splitlines() if x in wanted] + [x for x in end.splitlines() if x in ("SUM : Int", "r.r_name : String")]
    return spark.createDataFrame([(x, lines.count(x)) for x in dict.fromkeys(lines)], "line string, times long")


@_query(r"SELECT '(a.x = 1 OR b.y > 2.5) AND (''it\''s'' < c.z)' AS text")
def predicate_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a predicate."""
    return spark.createDataFrame([(predicate_text(parse_predicate("( a.x=1 OR b.y  > 2.5 )AND ('it\\'s' < c.z)")),)], "text string")


@_query("SELECT a.n || ' ' || b.n || ' ' || c.n AS tables FROM (VALUES ('x'), ('y'), ('z')) a(n), (VALUES ('x'), ('y'), ('z')) b(n), (VALUES ('x'), ('y'), ('z')) c(n) WHERE a.n <> b.n AND b.n <> c.n AND a.n <> c.n")
def join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All left-deep orders of three tables."""
    return spark.createDataFrame([(" ".join(o),) for o in orders(["x", "y", "z"])], "tables string")


@_query("SELECT * FROM (VALUES ('t', 1, 'a', 'Int'), ('t', 2, 'b', 'Double'), ('u', 1, 'c', 'String')) v(name, place, col, kind)".replace("SELECT *", "SELECT name, CAST(place AS BIGINT) AS place, col, kind"))
def catalog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text form of a catalog, read, written and read again."""
    tables = from_text(to_text(from_text("BEGIN\nt\nt.tbl\na Int\nb Double\nEND\n\nBEGIN\nu\nu.tbl\nc String\nEND\n")))
    rows = [(t.name, i, n, k) for t in tables for i, (n, k) in enumerate(t.columns, 1) if k in SPARK_TYPES]
    return spark.createDataFrame(rows, "name string, place long, col string, kind string")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_saved_and_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables saved under a text-form catalog and opened by another session."""
    path = f"{_folder(spark)}/catalog"
    session(spark, sf_dir).catalog.save_text(path, ["nation", "region"])
    own = Session(spark)
    own.catalog.open_text(path)
    return _plain(own.query("SELECT n.n_nationkey, n.n_name, r.r_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey)"))


# The estimator's results, from counts of the tables; SQL has the same formulas over the same counts.


def _counted(spark: SparkSession, sf_dir: str, *names: str) -> Statistics:
    own = session(spark, sf_dir)
    for name in names:
        own.analyze(name, exact=True)
    return own.catalog.statistics


def _estimates(spark: SparkSession, rows: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "what string, n double").withColumn("n", F.round("n", 3))


@_query("""WITH c AS (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linestatus) AS states, count(DISTINCT l_linenumber) AS lines FROM lineitem)
SELECT what, ROUND(CAST(n AS DOUBLE), 3) AS n FROM (
  SELECT 'equality' AS what, n / flags AS n FROM c UNION ALL SELECT 'range', n / 3 FROM c UNION ALL
  SELECT 'alternatives', n * (1 - (1 - 1 / states) * 2 / 3) FROM c UNION ALL SELECT 'one column', n * (2 / lines) FROM c UNION ALL
  SELECT 'conjunction', n / flags / 3 FROM c)""")
def estimate_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate over one table."""
    s = _counted(spark, sf_dir, "lineitem")
    texts = {
        "equality": "(l_returnflag = 'R')", "range": "(l_discount < 0.04)", "alternatives": "(l_linestatus = 'F' OR l_tax > 0.05)",
        "one column": "(l_linenumber = 1 OR l_linenumber = 2)", "conjunction": "(l_returnflag = 'R') AND (l_tax < 0.02)",
    }
    return _estimates(spark, [(k, s.estimate(t, ["lineitem"])) for k, t in texts.items()])


@_query("""WITH s AS (SELECT count(*) AS n, count(DISTINCT s_nationkey) AS d FROM supplier), m AS (SELECT count(*) AS n, count(DISTINCT n_nationkey) AS d FROM nation),
c AS (SELECT count(*) AS n, count(DISTINCT c_nationkey) AS d FROM customer)
SELECT what, ROUND(CAST(n AS DOUBLE), 3) AS n FROM (
  SELECT 'estimate' AS what, s.n * m.n / greatest(s.d, m.d) AS n FROM s, m UNION ALL SELECT 'before', s.n FROM s UNION ALL
  SELECT 'applied', s.n * m.n / greatest(s.d, m.d) FROM s, m UNION ALL SELECT 'joined', round(s.n * m.n / greatest(s.d, m.d)) FROM s, m UNION ALL
  SELECT 'copy', s.n FROM s UNION ALL
  SELECT 'next', round(s.n * m.n / greatest(s.d, m.d)) * c.n / greatest(m.d, c.d) FROM s, m, c)""")
def estimate_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate leaves the counts alone, Apply merges the relations; a copy doesn't follow."""
    s = _counted(spark, sf_dir, "supplier", "nation", "customer")
    condition, both = "(s_nationkey = n_nationkey)", ["supplier", "nation"]
    rows = [("estimate", s.estimate(condition, both)), ("before", float(s.tuples["supplier"]))]
    copied = Statistics(s)
    rows += [("applied", s.apply(condition, both)), ("joined", float(s.tuples["supplier_nation"])), ("copy", float(copied.tuples["supplier"]))]
    rows.append(("next", s.estimate("(n_nationkey = c_nationkey)", ["supplier_nation", "customer"])))
    return _estimates(spark, rows)


@_query("""SELECT 'nation' AS relation, 'tuples' AS what, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL
SELECT 'nation', 'n_regionkey', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'm', 'm.n_regionkey', count(DISTINCT n_regionkey) FROM nation UNION ALL
SELECT 'own', 'tuples', 12 UNION ALL SELECT 'own', 'key', 12 UNION ALL SELECT 'own', 'kind', 3""")
def statistics_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts set, copied, written to a file and read back."""
    s, path = _counted(spark, sf_dir, "nation"), f"{_folder(spark)}/statistics"
    s.copy_relation("nation", "m")
    s.add_relation("own", 12)
    s.add_attribute("own", "key", -1)
    s.add_attribute("own", "kind", 3)
    files.write_text(spark, path, s.write())
    found = Statistics.read(files.read_text(spark, path))
    pairs = [("nation", "tuples"), ("nation", "n_regionkey"), ("m", "m.n_regionkey"), ("own", "tuples"), ("own", "key"), ("own", "kind")]
    return spark.createDataFrame([(r, a, found.tuples[r] if a == "tuples" else found.distinct[r][a]) for r, a in pairs], "relation string, what string, n long")


@_query("""SELECT 'created' AS step, CAST(0 AS BIGINT) AS tuples UNION ALL SELECT 'loaded', count(*) FROM supplier UNION ALL SELECT 'reopened', count(*) FROM supplier UNION ALL SELECT 'dropped', -1""")
def statistics_of_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE sets the counts to 0, INSERT collects them, another session finds them, DROP removes them."""
    own = _made(spark, sf_dir, "HEAP")
    own.sql("CREATE TABLE empty (x INTEGER) AS HEAP")
    counts = own.catalog.statistics.tuples
    rows = [("created", counts["empty"]), ("loaded", counts["supplier"]), ("reopened", Session(spark, own.catalog.root).catalog.statistics.tuples["supplier"])]
    own.sql("DROP TABLE supplier")
    return spark.createDataFrame([*rows, ("dropped", counts.get("supplier", -1))], "step string, tuples long")

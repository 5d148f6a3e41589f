import pandas as pd
import pytest

from plumbline.operators import gate
from plumbline.operators import query as Q
from plumbline.operators import transform as X
from tests.conftest import rows


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame([(1, "New York", 8000000), (2, "London", 9000000), (3, "Tokyo", 14000000)], "id long, city string, population long")


@pytest.mark.parametrize("op, value, ids", [("==", 9000000, [2]), (">", 8500000, [2, 3]), ("!=", 9000000, [1, 3]), ("<=", 9000000, [1, 2]),
                                            ("in", [8000000, 1], [1]), ("between", (8500000, 10000000), [2]), ("is_null", True, [])])
def test_filters(cities, op, value, ids):
    assert [r[0] for r in rows(X.filter_data(cities, "population", value, op), "id")] == ids


def test_unknown_filter_is_refused(cities):
    with pytest.raises(ValueError):
        X.filter_data(cities, "id", 1, "~")


def test_aggregate_matches_pandas(spark):
    data = [("a", 1.0, 5), ("a", 3.0, 1), ("a", None, 2), ("b", 2.0, 9), (None, 7.0, 1), ("c", None, 3)]
    df = spark.createDataFrame(data, "k string, v double, o int")
    fns = ["sum", "mean", "min", "max", "count", "nunique", "std", "var", "median"]
    got = X.aggregate(df, ["k"], {"v": fns}, sort=True).toPandas().set_index("k")
    wanted = pd.DataFrame(data, columns=["k", "v", "o"]).groupby("k").agg({"v": fns})["v"]
    for fn in fns:
        assert got[f"v_{fn}"].astype(float).round(9).fillna(-1).tolist() == wanted[fn].astype(float).round(9).fillna(-1).tolist(), fn
    assert rows(X.aggregate(df, ["k"], {"v": "first", "o": "last"}, order_by="o")) == [("a", 3.0, 5), ("b", 2.0, 9), ("c", None, 3)]
    assert X.aggregate(df, ["k"], {"v": "median"}, keep_null_keys=True).filter("k IS NULL").first()[1] == 7.0
    with pytest.raises(ValueError):
        X.aggregate(df, ["k"], {"v": "mode"})
    with pytest.raises(ValueError):
        X.aggregate(df, ["k"], {"v": "first"})


def test_user_code(cities):
    assert rows(X.apply_pandas(cities, lambda pdf: pdf.assign(id=pdf.id * 2)[["id"]], "id long")) == [(2,), (4,), (6,)]
    assert X.apply_frame(cities, lambda d: d.limit(1)).count() == 1


@pytest.mark.parametrize("sql, ok", [
    ("  select 1", True), ("WITH x AS (SELECT 1 AS a) SELECT * FROM x", True), ("SHOW TABLES", True), ("EXPLAIN SELECT 1", True),
    ("WITH x AS (SELECT 1 AS a) INSERT INTO gone SELECT * FROM x", False), ("DROP TABLE t", False), ("DELETE FROM t", False), ("TRUNCATE TABLE t", False),
    ("UPDATE t SET a = 1", False), ("ALTER TABLE t ADD COLUMN b INT", False)])
def test_gate(spark, sql, ok):
    assert Q.is_read_only(spark, sql) is ok


def test_guarded_query(spark, cities):
    cities.createOrReplaceTempView("cities")
    assert [r.city for r in Q.guarded_query(spark, "SELECT city FROM cities ORDER BY population DESC", max_rows=2).collect()] == ["Tokyo", "London"]
    assert Q.guarded_query(spark, "SELECT city FROM cities WHERE id = :i", {"i": 2}).first()[0] == "London"
    assert Q.is_truncated(spark, "SELECT * FROM cities", max_rows=3) and not Q.is_truncated(spark, "SELECT * FROM cities", max_rows=4)
    for bad in ["", "  ", "DROP TABLE cities"]:
        with pytest.raises(ValueError):
            Q.guarded_query(spark, bad)
    with pytest.raises(Exception):
        Q.guarded_query(spark, "SELECT 1; DROP TABLE cities")


WIDE = ", ".join(f"{i} AS c{i}" for i in range(60))
CALL = "reflect('java.lang.System', 'getProperty', 'user.dir')"


@pytest.mark.parametrize("sql", [
    f"SELECT {WIDE}, {CALL}", f"SELECT {WIDE}, java_method('java.lang.System', 'nanoTime')", "SELECT value FROM text.`/etc/hostname`", "SELECT * FROM csv.`/etc/hostname` t",
    f"SELECT (SELECT max(a) FROM (SELECT {CALL} AS a))", "SELECT 1 WHERE 1 IN (SELECT max(value) FROM text.`/etc/hostname`)", "SELECT * FROM range(3) WHERE EXISTS (SELECT assert_true(false))",
    f"SELECT transform(array(1), x -> {CALL})", f"SELECT id FROM range(3) ORDER BY {CALL}", f"SELECT count(*) FROM range(3) GROUP BY id HAVING max({CALL}) > ''",
    f"WITH a AS (WITH b AS (SELECT {CALL} AS x) SELECT * FROM b) SELECT * FROM a", f"SELECT * FROM range(2) r JOIN LATERAL (SELECT {CALL}) l", "SELECT raise_error('no')", "SELECT input_file_name()",
    "SELECT system.builtin.reflect('a', 'b')", "SELECT * FROM IDENTIFIER('cities')", "SELECT nobody_knows(1)", f"EXPLAIN SELECT {CALL}", "EXPLAIN DROP TABLE cities", "EXPLAIN INSERT INTO cities SELECT 1",
    "DESCRIBE TABLE text.`/etc/hostname`", "SELECT * FROM not_there", "SELECT * FROM a.b.c.d", "WITH cities AS (SELECT 1) DELETE FROM cities"])
def test_gate_refuses(spark, cities, sql):
    cities.createOrReplaceTempView("cities")
    with pytest.raises(ValueError, match="read-only"):
        Q.guarded_query(spark, sql)


@pytest.mark.parametrize("sql", [
    "SELECT 'please reflect on this; drop table x' AS c, `id` AS `java_method` FROM range(1)", f"SELECT {WIDE}", "SELECT current_date() IS NOT NULL, typeof(1), x'00', date '2024-01-01'",
    "WITH RECURSIVE n AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM n WHERE i < 3) SELECT * FROM n", "SELECT id, rank() OVER (PARTITION BY id % 2 ORDER BY id) FROM range(3)",
    "SELECT e FROM cities LATERAL VIEW explode(array(1, 2)) t AS e", "SELECT * FROM cities c WHERE population = (SELECT max(population) FROM cities d WHERE d.id = c.id)",
    "SELECT id FROM range(3) UNION (SELECT 1 EXCEPT SELECT 2)", "SELECT transform(array(1), x -> x + 1)", "DESCRIBE cities", "SHOW TABLES", "EXPLAIN SELECT * FROM cities"])
def test_gate_lets_reads_through(spark, cities, sql):
    cities.createOrReplaceTempView("cities")
    assert Q.guarded_query(spark, sql).columns


def test_gate_knows_functions_by_class(spark):
    """A user function under the name of a built-in one is not the built-in one; allowed names are."""
    other = spark.newSession()
    assert Q.is_read_only(other, "SELECT upper('a')")
    other.udf.register("upper", lambda s: s)
    assert not Q.is_read_only(other, "SELECT upper('a')")
    gate.check_statement(other, "SELECT upper('a')", functions=["upper"])


def test_frames_are_bound_for_one_call(spark, cities):
    spark.range(1).createOrReplaceTempView("towns")
    assert Q.query_over_frames(spark, "SELECT count(*) AS n FROM towns", {"towns": cities}).first().n == cities.count()
    assert spark.table("towns").columns == ["id"]
    spark.catalog.dropTempView("towns")
    got = Q.guarded_query(spark, "SELECT city FROM {towns} WHERE id = :i", {"i": 2}, frames={"towns": cities})
    assert got.first().city == "London" and not spark.catalog.tableExists("towns")


def test_fingerprints(spark):
    df = spark.createDataFrame([("SELECT  1", 10), ("select\n1 ", 20), ("select 2", 5)], "query_executed string, execution_time_ms int")
    assert sorted((r.n_queries, r.avg_ms) for r in Q.query_fingerprints(df).collect()) == [(1, 5.0), (2, 15.0)]


def test_recover_json(spark):
    texts = ['{"a": 1}', 'so:\n```json\n{"a": 2}\n```', 'so:\n```json\n{"a": \n``` {"a": 3}', 'x {"a": 4} y', "none", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r.json_text for r in Q.recover_json(df, "t").orderBy("id").collect()] == ['{"a":1}', '{"a":2}', None, '{"a":4}', None, None]


def test_rank_entities(spark):
    df = spark.createDataFrame([("order_items", None), ("Order_Date", "2024"), ("misc", "")], "name string, last_used string")
    assert [tuple(r) for r in Q.rank_entities(df, "order date order").collect()] == [("Order_Date", 25), ("order_items", 10), ("misc", 0)]


def test_schema_summary(spark):
    df = spark.createDataFrame([("t", f"c{i}", "int", i) for i in range(12, 0, -1)], "table_name string, name string, data_type string, ordinal_position int")
    assert Q.schema_summary(df).first().summary == "Table t: " + ", ".join(f"c{i} (int)" for i in range(1, 11))
    assert Q.schema_summary(df, None).first().summary.endswith("c12 (int)")


def test_plan_bottlenecks(spark):
    plan = ('[{"Plan": {"Node Type": "Nested Loop", "Plan Rows": 1001, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "t", "Plan Rows": 10001},'
            '{"Node Type": "Seq Scan", "Relation Name": "u", "Plan Rows": 10000}, {"Node Type": "Nested Loop", "Plan Rows": 1000}]}}]')
    df = spark.createDataFrame([("p", plan), ("broken", "{"), ("empty", "[]")], "plan_id string, plan_json string")
    assert rows(Q.plan_bottlenecks(df), "plan_id", "node", "table_name", "impact") == [
        ("p", "Nested Loop Join", None, "Medium"), ("p", "Sequential Scan", "t", "High")]
    assert Q.plan_bottlenecks(df.filter("plan_id = 'empty'")).count() == 0

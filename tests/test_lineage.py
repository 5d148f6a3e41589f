import pytest

from plumbline.operators import lineage as L
from tests.conftest import rows


def log(spark, *statements):
    return spark.createDataFrame([(i, s, "query_executed") for i, s in enumerate(statements)], "query_id int, query_executed string, action string")


@pytest.mark.parametrize("sql, names", [
    ("SELECT * FROM a JOIN s.b ON 1=1", ["a", "s.b"]),
    ("select 1 from a -- from hidden\n join c", ["a", "c"]),
    ("SELECT 1 /* FROM x\n JOIN y */ FROM a", ["a"]),
    ("SELECT * FROM (SELECT x FROM t1) AS z JOIN t2", ["t2", "z"]),
    ("SELECT * FROM a, b", ["a"]),
    ("INSERT INTO t VALUES (1)", []),
])
def test_source_tables(spark, sql, names):
    assert sorted(r.table_name for r in L.source_tables(log(spark, sql)).collect()) == names


def test_deep_scan_finds_inner_tables(spark):
    got = L.source_tables(log(spark, "SELECT * FROM (SELECT x FROM t1) AS z JOIN t2"), deep=True)
    assert {"t1", "t2"} <= {r.table_name for r in got.collect()}


def test_edges(spark):
    got = rows(L.lineage_edges(log(
        spark, " create table if not exists T as select * from a join b", "INSERT INTO r(x) SELECT 1 FROM a", "UPDATE u SET x=1 FROM U JOIN v",
        "SELECT * FROM a", "CREATE TEMPORARY TABLE q AS SELECT 1 FROM a")), "source_table", "target_table", "lineage_type", "confidence")
    assert got == sorted([("a", "T", "transform", 0.95), ("b", "T", "transform", 0.95), ("a", "r", "direct", 0.95), ("v", "u", "join", 0.85)], key=str)


def test_registration(spark):
    edges = L.lineage_edges(log(spark, "INSERT INTO r SELECT 1 FROM a", "INSERT INTO r SELECT 2 FROM a", "INSERT INTO r SELECT 1 FROM missing"))
    tables = spark.createDataFrame([("1", "a"), ("2", "r")], "table_id string, table_name string")
    new = L.register_edges(edges, tables)
    assert rows(new, "source_table_id", "target_table_id", "query_template") == [("1", "2", "INSERT INTO r SELECT 1 FROM a")]
    assert L.register_edges(edges, tables, new).count() == 0
    wanted = spark.createDataFrame([("1", "2", "x"), ("2", "1", "y"), ("2", "1", "y")], "source_table_id string, target_table_id string, transformation_logic string")
    assert rows(L.manual_edges(wanted, new), "source_table_id", "target_table_id", "confidence") == [("2", "1", 1.0)]


def test_tokens_and_graph(spark):
    tokens = rows(L.column_tokens(log(spark, "SELECT a.x, sum(y) FROM a")), "position", "qualifier", "token")
    assert tokens == [(0, "a", "x"), (1, "", "sum"), (2, "", "y")]
    nodes, edges = L.query_graph(log(spark, "SELECT 1 FROM a", "SELECT 2 from a JOIN b"))
    assert rows(nodes, "node_id", "node_type") == [("a", "table"), ("q_0", "query"), ("q_1", "query")]
    assert rows(edges) == [("a", "q_0"), ("a", "q_1")]


def test_ungrounded(spark):
    tables = spark.createDataFrame([("Known",)], "table_name string")
    got = rows(L.ungrounded_references(log(spark, "SELECT 1 FROM known JOIN public.KNOWN k JOIN other"), tables))
    assert got == [(0, "other")]

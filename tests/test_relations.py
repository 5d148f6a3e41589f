import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.operators import inclusion
from plumbline.operators import relations as R
from tests.conftest import rows
from tests.oracle import compare

COLS = ["source_table", "source_column", "target_table", "target_column"]


@pytest.fixture(scope="module")
def catalog(spark):
    layout = {"customers": ["id", "name"], "orders": ["ID", "customer_id", "Address_ID", "order_id", "ghost_id"], "address": ["id"],
              "codes": ["code"], "lines": ["code_id", "orderid", "paid"]}
    tables = spark.createDataFrame([(t, t) for t in layout], "table_id string, table_name string")
    columns = spark.createDataFrame([(t, f"{t}.{c}", c) for t, cs in layout.items() for c in cs], "table_id string, column_id string, name string")
    return columns, tables


def test_names_to_tables(catalog):
    columns, tables = catalog
    got = rows(R.infer_relationships(columns, tables), *COLS)
    # codes has no id column; order_id inside orders would point at itself
    assert got == sorted([("orders", "customer_id", "customers", "id"), ("orders", "Address_ID", "address", "id"), ("lines", "orderid", "orders", "ID")], key=str)


def test_declared_keys_suppress_guesses(spark, catalog):
    columns, tables = catalog
    declared = spark.createDataFrame([("ORDERS", "CUSTOMER_ID", "Customers", "Id"), ("orders", "nope", "address", "id")],
                                     "source_table string, source_column string, target_table string, target_column string")
    explicit = R.explicit_relationships(columns, tables, declared)
    assert rows(explicit, *COLS, "confidence_score") == [("orders", "customer_id", "customers", "id", 0.95)]
    assert ("orders", "customer_id", "customers", "id") not in rows(R.infer_relationships(columns, tables, explicit), *COLS)


@pytest.mark.parametrize("kind, confidence, text", [
    ("Many-to-One", 0.95, "Each Customer belongs to exactly one Order Line. Join on a = b. ✓ (High confidence: 95%)"),
    ("one_to_many", 0.85, "Each Order Line can have zero or more Customers. Join on a = b."),
    ("N:N", 0.79, "Each Order Line can be related to many Customers, and vice versa. Join on a = b. ⚠️ (Low confidence: 79%)"),
    ("1:1", 0.80, "Each Order Line maps to exactly one Customer. Join on a = b."),
    (None, None, "There is a relationship between Order Line and Customer. Join on a = b."),
])
def test_sentences(spark, kind, confidence, text):
    df = spark.createDataFrame([("order_lines_v2", "a", "customers_dim", "b", kind, confidence)],
                               "source_table string, source_column string, target_table string, target_column string, relationship_type string, confidence_score double")
    assert R.relationship_text(df).first().explanation == text


def test_paths_and_junctions(spark):
    df = spark.createDataFrame([(["a_fact"],), (["a", "bs"],), (["a", "b", "c"],)], "path array<string>")
    assert [r.explanation for r in R.join_path_text(df).collect()] == [
        "Join path too short.", "To join A to B, use: A → B", "To join A to C, traverse: A → B → C"]
    rel = spark.createDataFrame([("enrol_bridge", "students"), ("enrol_bridge", "courses"), ("x", "courses")], "source_table string, target_table string")
    assert [r.explanation for r in R.many_to_many_text(rel).collect()] == [
        "Each Course can be associated with many Students, and vice versa, through the Enrol table."]
    three = spark.createDataFrame([("j", t) for t in "abc"], "source_table string, target_table string")
    assert rows(R.many_to_many_text(three), "left_table", "right_table") == [("a", "b"), ("a", "c"), ("b", "c")]


def test_keys_stay_in_their_connection(spark, catalog):
    columns, tables = catalog
    apart = tables.selectExpr("*", "CASE WHEN table_name = 'customers' THEN 'c2' ELSE 'c1' END AS connection_id")
    assert ("orders", "customer_id", "customers", "id") not in rows(R.infer_relationships(columns, apart), *COLS)
    assert ("orders", "Address_ID", "address", "id") in rows(R.infer_relationships(columns, apart), *COLS)
    declared = spark.createDataFrame([("orders", "customer_id", "customers", "id"), ("orders", "address_id", "address", "id")],
                                     "source_table string, source_column string, target_table string, target_column string")
    assert rows(R.explicit_relationships(columns, apart, declared), *COLS) == [("orders", "Address_ID", "address", "id")]


def test_inclusions_against_plain_sets(spark):
    """Nulls, repeats, types that don't compare, an empty table, and one value that most rows hold."""
    a = spark.createDataFrame([(i % 5 if i % 7 else None, f"x{i % 3}", decimal.Decimal(i % 4)) for i in range(50)], "k int, s string, d decimal(6,2)")
    b = spark.createDataFrame([(0, "x0", decimal.Decimal(i)) for i in range(4)] * 20 + [(9, None, None)], "k long, s string, d decimal(9,3)")
    tables = {"a": a, "b": b, "empty": a.limit(0), "odd": spark.createDataFrame([(1.5, [1])], "f double, l array<int>")}
    cells = {(t, c): [str(r[c] if c != "d" else float(r[c])) for r in df.collect() if r[c] is not None] for t, df in tables.items() if t in "ab" for c in ("k", "s", "d")}
    want = {}
    for (t, c), mine in cells.items():
        for (u, e), other in cells.items():
            shared = set(mine) & set(other)
            if (t, c) != (u, e) and c == e and shared:
                matched = sum(v in shared for v in mine)
                want[t, c, u, e] = (len(set(mine)), len(shared), len(mine), matched, round(100 * matched / len(mine), 4))
    got = {tuple(r)[:4]: tuple(r)[4:] for r in inclusion.inclusions(tables).collect()}
    assert got == want
    assert {tuple(r)[:4] for r in inclusion.dependencies(tables, {"a": ["k"], "b": ["k"]}).collect()} == set()
    assert {tuple(r)[:4] for r in inclusion.dependencies(tables, least_values=4).collect()} == {("a", "d", "b", "d"), ("b", "d", "a", "d")}
    with pytest.raises(ValueError):
        inclusion.inclusions({"odd": tables["odd"]})


def test_given_junctions(spark):
    rel = spark.createDataFrame([("enrolments", "students"), ("enrolments", "courses"), ("orders", "customers"), ("orders", "shops")], "source_table string, target_table string")
    assert R.many_to_many_text(rel).count() == 2
    told = R.many_to_many_text(rel, spark.createDataFrame([("enrolments",), ("enrolments",)], "table_name string"))
    assert rows(told, "left_table", "right_table", "junction_table") == [("courses", "students", "enrolments")]


def test_many_to_many_over_all_connections(spark, tmp_path):
    """The query tells junctions of the whole catalog: the two ends may lie in different connections."""
    parts = [(p, f"n{p}", "b", "t", 5 + p % 7, 1.0) for p in range(1, 500)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    told = entry.queries()["many_to_many_text"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert compare(told, duck, entry.oracle_sql()["many_to_many_text"]) is None
    number = lambda name: int(name.split("_")[1].rstrip("s"))
    connection = lambda name: number(name) // 64 % 5 == 0
    assert any(len({connection(r[c]) for c in ("junction_table", "left_table", "right_table")}) == 2 for r in told.collect())

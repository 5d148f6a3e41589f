import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import kpis, semantic as S
from tests.conftest import rows


def test_entities(spark):
    def table(name, n, fks):
        return [(name, i, 0 < i <= fks) for i in range(n)]

    columns = spark.createDataFrame(
        [(t, i, fk) for t, i, fk in table("sales_fact", 11, 2) + table("customers_dim", 10, 1) + table("a_bridge", 3, 2) + table("big", 11, 1) + table("near", 11, 2)],
        "table_id string, i int, is_foreign_key boolean")
    tables = spark.createDataFrame([(t, t) for t in ["sales_fact", "customers_dim", "a_bridge", "big", "near", "no_columns"]], "table_id string, table_name string")
    rel = spark.createDataFrame([("sales_fact", "x"), ("sales_fact", "y"), ("z", "sales_fact"), ("near", "x"), ("near", "y"), ("near", None)],
                                "source_table_id string, target_table_id string")
    assert rows(S.map_entities(columns, tables, rel)) == sorted([
        ("sales_fact", "Sales", "fact", 0.85), ("customers_dim", "Customers", "dimension", 0.80), ("a_bridge", "A Bridge", "bridge", 0.90),
        ("big", "Big", "entity", 0.50), ("near", "Near", "entity", 0.50)], key=str)


@pytest.mark.parametrize("name, kind, flags, role, metric, agg, dim", [
    ("id", "int", (True, False), "pk", None, None, None), ("customer_id", "bigint", (False, True), "fk", None, None, None),
    ("total_amount", "DECIMAL(10,2)", (False, False), "measure", "Amount", "SUM", None),
    ("discount", "float", (False, False), "measure", "Discount", "COUNT", None),
    ("avg_price", "double", (False, False), "measure", "Price", "AVG", None),
    ("sales", "varchar", (False, False), "attribute", None, None, None),
    ("created", "timestamp", (False, False), "dimension", None, None, "attribute"),
    ("order_date", "date", (False, False), "dimension", None, None, "time"),
    ("country", "char(2)", (False, False), "dimension", None, None, "geography"),
    ("order_status", "varchar", (False, False), "dimension", None, None, "categorical"),
    ("notes", "text", (False, False), "attribute", None, None, None)])
def test_roles(spark, name, kind, flags, role, metric, agg, dim):
    df = spark.createDataFrame([(name, kind, *flags)], "name string, data_type string, is_primary_key boolean, is_foreign_key boolean")
    got = S.column_roles(df).first()
    assert (got.role, got.metric_name, got.aggregation, got.dimension_type) == (role, metric, agg, dim)


def test_trust(spark):
    df = spark.createDataFrame([("a", None, None, None), ("b", True, "d", "f"), ("c", False, "", "f")], "name string, is_certified boolean, description string, formula string")
    assert rows(S.trust_scores(df)) == [("a", 50.0), ("b", 100.0), ("c", 60.0)]


def test_compiled_metric_does_not_multiply_rows(spark):
    tables = {
        "item": spark.createDataFrame([(1, 10.0), (1, 5.0), (2, 1.0), (3, 7.0)], "item_order int, amount double"),
        "ord": spark.createDataFrame([(1, 1), (2, 2)], "ord_id int, ord_cust int"),
        "cust": spark.createDataFrame([(1, "N"), (2, "S")], "cust_id int, area string")}
    links = [S.Link("item", "item_order", "ord", "ord_id"), S.Link("ord", "ord_cust", "cust", "cust_id")]
    metrics = {"rev": S.Metric("rev", "sum(amount)", ("item",)), "bad": S.Metric("bad", "amount; drop table x", ("item",))}
    assert rows(S.compile_metric("rev", metrics, tables, links, ["area"])) == [("N", 15.0), ("S", 1.0), (None, 7.0)]
    assert rows(S.compile_metric("rev", metrics, tables, links, filters={"area": "N", "x; y": 1})) == [(15.0,)]
    for name, dims in [("unknown", ()), ("bad", ()), ("rev", ("nope",))]:
        with pytest.raises(ValueError):
            S.compile_metric(name, metrics, tables, links, dims)


def test_certification_is_for_admins(spark):
    df = spark.createDataFrame([("a", None, None), ("b", False, None)], "name string, is_certified boolean, certified_at timestamp")
    done = S.certify(df, "b", "admin", dt.datetime(2024, 1, 1))
    assert rows(done) == [("a", None, None), ("b", True, dt.datetime(2024, 1, 1))]
    with pytest.raises(PermissionError):
        S.certify(df, "b", "analyst", dt.datetime(2024, 1, 1))


def test_registry_replaces_and_adds(spark):
    old = spark.createDataFrame([("c", "m", "sum(x)")], "connection_id string, name string, formula string")
    new = spark.createDataFrame([("c", "m", "avg(x)"), ("d", "m", None)], "connection_id string, name string, formula string")
    assert rows(S.register(old, new)) == [("c", "m", "avg(x)"), ("d", "m", None)]


def test_period_comparison_survives_gaps(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 5), 10.0), (dt.datetime(2024, 1, 9), 15.0), (dt.datetime(2024, 3, 1), 2.0)], "t timestamp, v double")
    got = rows(kpis.period_over_period(df, "t", F.sum("v")))
    assert got == [(dt.date(2023, 1, 1), 10.0, None, None), (dt.date(2024, 1, 1), 15.0, 10.0, 50.0), (dt.date(2024, 3, 1), 2.0, None, None)]


def test_drivers_add_up(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 25.0), ("b", 1, 5.0), ("c", 2, 5.0)], "k string, y int, v double")
    got = kpis.change_drivers(df, "k", F.sum("v"), F.col("y") == 1, F.col("y") == 2)
    assert rows(got.select("k", "delta", F.round("contribution_pct", 6))) == [("a", 15.0, 100.0), ("b", -5.0, -33.333333), ("c", 5.0, 33.333333)]


def test_last_months(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 31),), (dt.datetime(2023, 2, 1),), (dt.datetime(2024, 1, 31),), (dt.datetime(2024, 2, 1),)], "t timestamp")
    assert kpis.last_n_months(df, "t", dt.datetime(2024, 2, 1)).count() == 2


@pytest.mark.parametrize("formula, ok", [
    ("sum(a * (1 - b))", True), ("sum(a) / count(DISTINCT b)", True), ("round(coalesce(max(a), 0), 2)", True), ("sum(a) FILTER (WHERE b > 1)", True), ("count(*)", True),
    ("sum(1) + assert_true(false)", False), ("sum(a) + b", False), ("a", False), ("upper('x')", False), ("reflect('a', 'b')", False), ("sum(reflect('a', 'b'))", False),
    ("sum((SELECT max(x) FROM t))", False), ("sum(a); DROP TABLE t", False), ("sum(a) OVER (PARTITION BY b)", False), ("sum(", False), ("raise_error(max(a))", False)])
def test_formulas(spark, formula, ok):
    if ok:
        assert S.check_formula(formula, spark) == formula
    else:
        with pytest.raises(ValueError):
            S.check_formula(formula, spark)


def test_ambiguous_columns_raise(spark):
    tables = {"a": spark.createDataFrame([(1, 2)], "id int, region int"), "b": spark.createDataFrame([(2, 3)], "a_id int, region int")}
    metrics = {"m": S.Metric("m", "sum(id)", ("a",))}
    with pytest.raises(ValueError, match="ambiguous"):
        S.compile_metric("m", metrics, tables, [], dims=["region"])

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import catalog_index, recommend, search
from plumbline.workloads import derived as V
from tests.conftest import rows

AS_OF = dt.datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def catalog(spark):
    tables = spark.createDataFrame([
        ("1", "c", "w", "customer", "all clients", "o", AS_OF, "public"), ("2", "c", "w", "customer_sales", None, None, None, "public"),
        ("3", "c", "x", "customers", "", "", AS_OF - dt.timedelta(days=73), "sales"), ("4", "c", "w", "misc", "The CUSTOMER list of everything", "o", AS_OF, "sales")],
        "table_id string, connection_id string, workspace_id string, table_name string, description string, owner_id string, created_at timestamp, schema_name string")
    columns = spark.createDataFrame([
        ("1.a", "1", "id", "int", 1, False, False, None), ("1.b", "1", "customer_name", "text", 2, True, False, "given"), ("4.a", "4", "email", "text", 1, True, True, None)],
        "column_id string, table_id string, name string, data_type string, ordinal_position int, is_pii boolean, is_masked boolean, description string")
    return tables, columns


def test_expansion():
    assert search.expand_query("Order  DATE x") == sorted(["order", "purchase", "transaction", "deal", "sale", "date", "time", "when", "period", "timestamp", "x"])


@pytest.mark.parametrize("name, description, score", [("customer", None, 1.0), ("customer_sales", None, 0.95), ("customers", None, 0.85), ("misc", "a Customer", 0.60), ("misc", None, 0.0)])
def test_relevance(spark, name, description, score):
    df = spark.createDataFrame([(name, description)], "n string, d string")
    assert df.select(search.relevance(["zzz", "customer"], F.col("n"), F.col("d"))).first()[0] == score


def test_ranked_search(catalog):
    got = [(r.name, r.relevance_score, r.recency_score) for r in search.semantic_search(*catalog, "customer", AS_OF).collect()]
    assert got == [("customer", 1.0, 1.0), ("customer.customer_name", 0.95, 1.0), ("customers", 0.85, 0.8), ("customer_sales", 0.95, 0.5), ("misc", 0.6, 1.0)] or \
        sorted(got) == sorted([("customer", 1.0, 1.0), ("customer.customer_name", 0.95, 1.0), ("customers", 0.85, 0.8), ("customer_sales", 0.95, 0.5), ("misc", 0.6, 1.0)])
    assert {r.resource_type for r in search.semantic_search(*catalog, "customer", AS_OF, types=["column"]).collect()} == {"column"}
    assert search.semantic_search(*catalog, "customer", AS_OF, limit=2).count() == 2
    with pytest.raises(ValueError):
        search.semantic_search(*catalog, " ", AS_OF)


def test_suggestions_and_lookups(catalog):
    tables, columns = catalog
    assert [r[0] for r in search.suggest(tables, columns, "CUST").collect()] == ["customer", "customer_name", "customer_sales", "customers"]
    assert search.suggest(tables, columns, "c").count() == 0
    assert rows(search.metadata_search(tables, columns, "customer"), "name", "score") == [
        ("customer", 100), ("customer_name", 80), ("customer_sales", 80), ("customers", 80), ("misc", 10)]
    assert rows(search.catalog_search(tables, columns, "email"), "table_name", "n_columns") == [("misc", 1)]
    assert search.catalog_search(tables, columns, "customer", "sales").count() == 1


def test_upsert_keeps_absent_fields(spark):
    now = spark.createDataFrame([("1", "ann", 24), ("2", "bob", 12)], "table_id string, owner string, sla int")
    change = spark.createDataFrame([("1", None, 48), ("3", "cy", None)], "table_id string, owner string, sla int")
    assert rows(search.upsert(now, change, ["table_id"])) == [("1", "ann", 48), ("2", "bob", 12), ("3", "cy", None)]


def test_findings(spark, catalog):
    tables, columns = catalog
    history = spark.createDataFrame([
        ("1", AS_OF - dt.timedelta(days=91), [("v", 51.0, 1)]), ("1", AS_OF - dt.timedelta(days=200), [("v", 99.0, 1)]),
        ("4", AS_OF - dt.timedelta(days=90), [("v", 50.0, 1)])],
        "table_id string, created_at timestamp, columns array<struct<name:string,null_percentage:double,distinct_count:long>>")
    found = recommend.recommendations(tables, columns, history, AS_OF)
    assert rows(found, "recommendation_type", "resource_name") == sorted([
        ("assign_owner", "customer_sales"), ("assign_owner", "customers"), ("mask_pii", "customer"), ("fix_description", "customer"),
        ("fix_description", "customer_sales"), ("fix_description", "customers"), ("flag_unused", "customer"), ("improve_quality", "customer.v")], key=str)
    assert rows(recommend.recommendations(tables, columns, history, AS_OF, severity="critical"), "title") == [("Apply masking to 1 PII columns in customer",)]
    assert recommend.recommendations(tables, columns, history, AS_OF, limit=3).count() == 3
    assert recommend.recommendations(tables, columns, history, AS_OF, resource_id="2").count() == 2
    assert dict(map(tuple, recommend.by_type(found).collect()))["fix_description"] == 3
    assert rows(recommend.exposed_columns(columns)) == [("1", "customer_name")]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    """Names and descriptions of all kinds, with lists that fall into several chunks; short, long, odd and absent terms."""
    rng = random.Random(2)
    words = ["order", "Orders", "customer", "ord", "card", "CARD_no", "or", "é", "étage", "a", "line item", "der"]
    say = lambda: rng.choice([None, "", "_".join(rng.choice(words) for _ in range(rng.randint(1, 4)))])
    tables = spark.createDataFrame([(f"t{i}", f"c{i % 2}", "w" if i % 3 else "x", say() or f"n{i}", say(), AS_OF, "s") for i in range(60)],
                                   "table_id string, connection_id string, workspace_id string, table_name string, description string, created_at timestamp, schema_name string")
    columns = spark.createDataFrame([(f"t{i % 60}.{i}", f"t{i % 60}", say() or "k", "int", None, say()) for i in range(300)],
                                    "column_id string, table_id string, name string, data_type string, pii_tag string, description string")
    catalog_index.CHUNK, chunk = 50, catalog_index.CHUNK
    try:
        index = catalog_index.CatalogIndex.build(tables, columns, str(tmp_path / "index"))
    finally:
        catalog_index.CHUNK = chunk
    again = catalog_index.CatalogIndex(spark, str(tmp_path / "index"))
    for query in ["order", "ORD", "or", "étage", "line item", "absent", "rder_", "customer_order", "é"]:
        for conn in (None, "c1"):
            want = [tuple(r) for r in search.metadata_search(tables, columns, query, conn).collect()]
            assert [tuple(r) for r in again.search(query, conn).collect()] == want, query
    for query in ("customer order", "or card", "absent"):
        scan = search.semantic_search(tables, columns, query, AS_OF, limit=500, workspace_id="w")
        assert sorted(map(str, search.semantic_search(None, None, query, AS_OF, limit=500, workspace_id="w", index=index).collect())) == sorted(map(str, scan.collect()))
    assert index.candidates(["order"]).count() < index.entries().count()
    assert catalog_index.CatalogIndex.build(tables.limit(0), columns.limit(0)).search("order").count() == 0


def test_lists_against_plain_sets(spark, tmp_path, monkeypatch):
    """Each entry is listed once for each trigram of its name or description, whatever the texts; long lists come in parts."""
    monkeypatch.setattr(catalog_index, "PART_CHARS", 40)
    names = ["abc", "ABCabc", "\u00e9tage", "\U0001f600ab", "ab", "", None, "x" * 50, "a b c"] * 5
    tables = spark.createDataFrame([(f"t{i}", n, names[-i], AS_OF) for i, n in enumerate(names)], "table_id string, table_name string, description string, created_at timestamp")
    columns = spark.createDataFrame([], "column_id string, table_id string, name string")
    index = catalog_index.CatalogIndex.build(tables, columns, str(tmp_path / "index"))
    cut = lambda t: {t.lower()[i : i + 3] for i in range(len(t) - 2)} if t else set()
    want = sorted((g, r.entry) for r in index.entries().collect() for g in cut(r.name) | cut(r.description))
    lists = spark.read.parquet(f"{index.path}/lists")
    assert sorted((r.gram, e) for r in lists.collect() for e in r.entries) == want
    assert lists.groupBy("gram", "chunk").count().where("count > 1").count() > 0


def test_stored_derivations_are_made_by_many_tasks(spark, tmp_path):
    """A small file is one task's to read; the rows made from it are written by several."""
    parts = [(p, f"n{p}", "b", "t", 5, 1.0) for p in range(1, 300)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(parts, schema).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = V.stored(spark, str(tmp_path), V.CATALOG_COLUMNS)
    assert len(made.inputFiles()) > 1
    assert rows(made) == rows(V.frame(spark, str(tmp_path), V.CATALOG_COLUMNS))

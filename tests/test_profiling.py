import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profiling as P
from plumbline.operators.profile_store import ProfileStore
from tests.conftest import rows


def test_profile_counts_nulls_distincts_and_mixed_types(spark):
    df = spark.createDataFrame(
        [(1, 0.0, "a", True, dt.date(2024, 1, 1), [1, 2]), (2, -0.0, "a", None, dt.date(2024, 1, 1), [1, 2]),
         (None, float("nan"), None, False, None, None), (2, float("nan"), "", True, dt.date(2024, 1, 2), [2, 1])],
        "i int, d double, s string, b boolean, day date, arr array<int>")
    got = {r["column_name"]: (r["total"], r["non_null"], r["null_count"], r["distinct_count"], r["cardinality"])
           for r in P.profile_columns(df).collect()}
    assert got == {
        "i": (4, 3, 1, 2, 0.5), "d": (4, 4, 0, 2, 0.5), "s": (4, 3, 1, 2, 0.5), "b": (4, 3, 1, 2, 0.5),
        "day": (4, 3, 1, 2, 0.5), "arr": (4, 3, 1, 2, 0.5)}


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert rows(P.profile_columns(df)) == [("a", 0, 0, 0, 0, 0.0), ("b", 0, 0, 0, 0, 0.0)]


def test_approx_agrees_on_small_data(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).cast("string").alias("m"))
    exact, sketched = rows(P.profile_columns(df)), rows(P.profile_columns(df, approx=True))
    assert [r[:4] for r in exact] == [r[:4] for r in sketched]
    assert all(abs(a[4] - b[4]) <= 3 for a, b in zip(exact, sketched))


def test_top_values_breaks_ties_by_value_and_skips_null(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", "a", "c", None, None, None]], "v string")
    assert rows(P.top_values(df, k=2)) == [("v", "a", 2, 1), ("v", "b", 2, 2)]


def test_top_values_plan_limits_rows_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 90).alias("v"))
    plan = P.top_values(df, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_completeness(spark):
    profile = spark.createDataFrame([("a", 10, 5), ("b", 10, 0), ("c", 10, None)], "column_name string, total long, null_count long")
    assert P.completeness_percent(profile).first()[0] == 50.0
    assert P.completeness_percent(profile.limit(0)).first()[0] == 50.0


def test_history_snapshots(spark):
    df = spark.createDataFrame(
        [("t", dt.datetime(2024, 1, 3), "x"), ("t", dt.datetime(2024, 1, 9), None), ("t", dt.datetime(2024, 2, 1), "y")],
        "k string, at timestamp, v string")
    got = P.profile_history(df, "k", "at", cols=["v"]).orderBy("created_at").collect()
    assert [(r.row_count, r.created_at, r.last_updated) for r in got] == [
        (2, dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 9)), (1, dt.datetime(2024, 3, 1), dt.datetime(2024, 2, 1))]
    assert [(c.name, c.null_percentage, c.distinct_count) for c in got[0]["columns"]] == [("v", 50.0, 1)]


def test_histogram_covers_every_row(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    bins = P.histogram(df, "v", 7).collect()
    assert sum(r.y for r in bins) == 100 and {r.bin for r in bins} == set(range(7))


def test_sample_fraction():
    assert P.sample_fraction(500) == 1.0
    assert P.sample_fraction(100_000) == 0.1


def test_stored_profile_reads_new_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "id % 7 AS small", "cast(id / 4 AS double) AS x", "IF(id % 5 = 0, NULL, concat('v', id % 3)) AS s", "date '2024-01-01' + cast(id % 9 AS int) AS d", "id div 1000 AS day")
    table(0, 3000).write.partitionBy("day").parquet(path)
    store = ProfileStore(spark, str(tmp_path / "p"), ["day"])
    assert store.refresh(spark.read.parquet(path)) == 3000
    assert store.refresh(spark.read.parquet(path)) == 0
    table(3000, 4000).write.mode("append").partitionBy("day").parquet(path)
    assert store.refresh(spark.read.parquet(path)) == 1000
    table(2000, 2500).write.mode("append").partitionBy("day").parquet(path)  # a partition that grows is read whole
    assert store.refresh(spark.read.parquet(path)) == 1500
    got = {r.column_name: r for r in store.profile().collect()}
    assert set(got) == {"id", "small", "x", "s", "d"} and got["id"].total == 4500
    assert (got["s"].null_count, got["s"].distinct_count, got["s"].min_text, got["s"].max_text, got["s"].avg_value) == (900, 3, "v0", "v2", None)
    assert (got["id"].min_value, got["id"].max_value) == (0, 3999) and got["small"].distinct_count == 7 and got["d"].distinct_count == 9
    assert abs(got["x"].avg_value - sum([*range(4000), *range(2000, 2500)]) / 4 / 4500) < 1e-9
    assert abs(got["id"].distinct_count - 4000) < 4000 * 0.05 and abs(got["id"].quantiles[1] - 2062) < 4500 * 0.03
    top = {(r.column_name, r.value): r["count"] for r in store.top_values(3).collect() if r.column_name == "s"}
    assert sum(top.values()) == 3600 and {v for _, v in top} == {"v0", "v1", "v2"}
    # a partition that is gone is forgotten without reading another
    rest = spark.read.option("basePath", path).parquet(*[f"{path}/day={i}" for i in (0, 1, 3)])
    assert store.refresh(rest) == 0
    assert {r.total for r in store.profile().collect()} == {3000}
    store.vacuum()
    assert {r.total for r in store.profile().collect()} == {3000} and not (tmp_path / "p/parts/v3").exists() and (tmp_path / "p/parts/v0").exists()


def test_stored_profile_of_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([(None, 1, None), ("a", 2, None), ("b", None, None)], "p string, v int, n string")
    df.write.partitionBy("p", "v").parquet(str(tmp_path / "t"))
    store = ProfileStore(spark, str(tmp_path / "p"), ["p", "v"])
    assert store.refresh(spark.read.schema("n string, p string, v int").parquet(str(tmp_path / "t"))) == 3
    spark.createDataFrame([("a", 2, "x")], "p string, v int, n string").write.mode("append").partitionBy("p", "v").parquet(str(tmp_path / "t"))
    assert store.refresh(spark.read.schema("n string, p string, v int").parquet(str(tmp_path / "t"))) == 2
    row = store.profile().first()
    assert (row.total, row.non_null, row.min_text) == (4, 1, "x")
    with pytest.raises(ValueError):
        ProfileStore(spark, str(tmp_path / "none")).profile()


def test_hash_sample_is_stable(spark):
    df = spark.range(20_000).selectExpr("id", "id % 3 AS k")
    once, again = (set(map(tuple, P.hash_sample(d, ["id"], 0.25).collect())) for d in (df, df.repartition(7)))
    assert once == again and abs(len(once) - 5000) < 400

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import quality as Q

AS_OF = dt.datetime(2024, 2, 1)


@pytest.mark.parametrize("hours, sla, expected", [(None, 24, 0.0), (24, 24, 100.0), (25, 24, 95.0), (44, 24, 0.0), (500, 24, 0.0), (47, 48, 100.0)])
def test_freshness(spark, hours, sla, expected):
    synced = None if hours is None else AS_OF - dt.timedelta(hours=hours)
    df = spark.createDataFrame([(synced,)], "t timestamp")
    assert df.select(Q.freshness_score(F.col("t"), F.lit(float(sla)), F.lit(AS_OF))).first()[0] == expected


@pytest.mark.parametrize("days, expected", [(None, 75.0), (6, 90.0), (7, 80.0), (29, 80.0), (30, 70.0)])
def test_accuracy(spark, days, expected):
    synced = None if days is None else AS_OF - dt.timedelta(days=days)
    df = spark.createDataFrame([(synced,)], "t timestamp")
    assert df.select(Q.accuracy_score(F.col("t"), F.lit(AS_OF))).first()[0] == expected


def score(spark, table, sync=True):
    catalog = spark.createDataFrame([("t", AS_OF if sync else None)], "table_name string, last_metadata_sync timestamp")
    assets = spark.createDataFrame([], "table_name string, sla_freshness_hours int")
    return Q.score_tables({"t": table}, catalog, assets, AS_OF).first()


def test_scores_of_a_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, "c")], "k int, v string")
    got = score(spark, Q.ScoredTable(df, ("k",)))
    assert (got.completeness, got.uniqueness, got.freshness, got.timeliness) == (50.0, 66.6667, 100.0, 90.0)
    assert got.overall == round(0.25 * 100 + 0.25 * 50 + 0.15 * 66.66667 + 0.15 * 90 + 0.1 * 85 + 0.1 * 90, 4)
    assert got.completeness_percent == 75.0


def test_scores_without_rows_key_or_sync(spark):
    got = score(spark, Q.ScoredTable(spark.createDataFrame([], "k int")), sync=False)
    assert (got.completeness, got.uniqueness, got.freshness, got.accuracy, got.freshness_hours) == (50.0, 75.0, 0.0, 75.0, 9999)
    assert score(spark, Q.ScoredTable(spark.createDataFrame([(None,)], "k int"), ("k",))).uniqueness == 100.0


def test_rules_and_links_replace_the_constants(spark):
    child = spark.createDataFrame([(1, 5), (2, -1), (9, 7), (None, 1)], "fk int, q int")
    parent = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    got = score(spark, Q.ScoredTable(child, rules=[F.col("q") > 0], foreign_keys=[("fk", parent, "id")]))
    assert (got.accuracy, got.consistency) == (75.0, 66.6667)
    assert tuple(Q.fk_containment(child, "fk", parent, "id").first()) == (3, 2, 66.6667)


def test_upsert_and_totals(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "table_name string, overall double")
    new = spark.createDataFrame([("b", 9.0), ("c", 3.0)], "table_name string, overall double")
    assert sorted(map(tuple, Q.upsert_scores(old, new).collect())) == [("a", 1.0), ("b", 9.0), ("c", 3.0)]
    assert tuple(Q.refresh_totals(["a", "b", "x"], old).first()) == (3, 2, 1)

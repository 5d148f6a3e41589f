import datetime as dt

import pytest

from plumbline.operators import anomalies as A

AS_OF = dt.datetime(2024, 2, 1)
SCHEMA = ("table_id string, created_at timestamp, last_updated timestamp, row_count long, update_frequency_hours double, "
          "columns array<struct<name:string,null_percentage:double,distinct_count:long>>")


def history(spark, *snapshots):
    """(days before as-of, row_count, [(column, null %, distinct)])"""
    return spark.createDataFrame([
        ("t", AS_OF - dt.timedelta(days=d), AS_OF - dt.timedelta(days=d), n, None, cols) for d, n, cols in snapshots], SCHEMA)


@pytest.mark.parametrize("latest, severity", [(1300, None), (1301, "low"), (1499, "low"), (1500, "medium"), (2000, "high"), (3000, "critical"), (100, None)])
def test_row_spike_edges(spark, latest, severity):
    found = A.row_spike(history(spark, (3, 900, []), (2, 1100, []), (1, latest, [])), AS_OF).collect()
    assert [r.severity for r in found] == ([severity] if severity else [])


def test_row_spike_ignores_empty_snapshots_and_old_ones(spark):
    assert A.row_spike(history(spark, (3, None, []), (2, 0, []), (1, 900, [])), AS_OF).count() == 0
    assert A.row_spike(history(spark, (40, 10, []), (1, 900, [])), AS_OF).count() == 0
    text = A.row_spike(history(spark, (3, 1200, []), (1, 3_400_000, [])), AS_OF).first().description
    assert text == "Row count increased 283233.3% from 1.2K to 3.4M"


@pytest.mark.parametrize("first, last, severity", [(0.0, 10.0, None), (0.0, 10.1, "low"), (5.0, 26.0, "medium"), (5.0, 51.0, "high"), (50.0, 20.0, None)])
def test_null_increase_edges(spark, first, last, severity):
    ends = A.column_ends(history(spark, (3, 1, [("c", first, 1)]), (1, 1, [("c", last, 1)])), AS_OF)
    found = A.null_increase(ends).collect()
    assert [r.severity for r in found] == ([severity] if severity else [])
    if severity and first == 0.0:
        assert found[0].deviation_pct == 100.0


@pytest.mark.parametrize("first, last, days, kinds", [
    (10, 10, 7, []), (10, 10, 8, ["warning"]), (0, 0, 20, []), (100, 80, 3, []), (100, 79, 3, ["high"]), (10, 11, 20, [])])
def test_cardinality_edges(spark, first, last, days, kinds):
    ends = A.column_ends(history(spark, (days + 1, 1, [("c", 0.0, first)]), (1, 1, [("c", 0.0, last)])), AS_OF)
    assert [r.severity for r in A.cardinality_shift(ends).collect()] == kinds


def test_one_snapshot_says_nothing(spark):
    ends = A.column_ends(history(spark, (1, 1, [("c", 90.0, 1)])), AS_OF)
    assert ends.count() == 0


@pytest.mark.parametrize("hours, freq, severity", [(48, None, None), (49, None, "medium"), (73, None, "high"), (169, None, "critical"), (49, 30.0, None)])
def test_freshness_edges(spark, hours, freq, severity):
    df = spark.createDataFrame([("t", AS_OF, AS_OF - dt.timedelta(hours=hours), 1, freq, [])], SCHEMA)
    assert [r.severity for r in A.freshness_delay(df, AS_OF).collect()] == ([severity] if severity else [])


def test_all_kinds_share_one_shape(spark):
    found = A.detect_anomalies(history(spark, (20, 10, [("c", 0.0, 100)]), (5, 100, [("c", 60.0, 10)])), AS_OF)
    assert found.columns == A.COLUMNS
    assert {r.anomaly_type for r in found.collect()} == {"row_spike", "null_increase", "cardinality_shift", "freshness_delay"}
    with pytest.raises(ValueError):
        A.detect_anomalies(found, AS_OF, 400)

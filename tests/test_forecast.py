import datetime as dt

import numpy as np

from plumbline.operators import forecast as FC


def test_line_is_continued_at_month_ends(spark):
    points = [("a", dt.date(2023, m, 15), 10.0 * m) for m in range(1, 13)] + [("b", dt.date(2024, 1, 31), 5.0), ("b", dt.date(2023, 12, 31), 4.0)]
    df = spark.createDataFrame(points, "k string, ds date, y double")
    got = {(r.series_id, r.ds): round(r.y, 6) for r in FC.forecast_linear(df, "k", "ds", "y", 2).collect()}
    assert got == {("a", dt.date(2024, 1, 31)): 130.0, ("a", dt.date(2024, 2, 29)): 140.0,
                   ("b", dt.date(2024, 2, 29)): 6.0, ("b", dt.date(2024, 3, 31)): 7.0}


def test_matches_polyfit_and_skips_single_points(spark):
    rng = np.random.default_rng(3)
    ys = rng.normal(100, 9, 40)
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=31 * i), float(y)) for i, y in enumerate(ys)] + [("one", dt.date(2020, 1, 1), 1.0)]
    got = FC.forecast_linear(spark.createDataFrame(rows, "k string, ds date, y double"), "k", "ds", "y", 3).orderBy("ds").collect()
    slope, intercept = np.polyfit(np.arange(40), ys, 1)
    assert [r.series_id for r in got] == ["s"] * 3
    assert np.allclose([r.y for r in got], intercept + slope * np.arange(40, 43))


def test_zscore(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1] * 20 + [50]] + [("flat", 3.0)] * 4 + [("one", 1.0)], "k string, y double")
    assert [(r.k, r.y) for r in FC.zscore_outliers(df, "k", "y").collect()] == [("a", 50.0)]

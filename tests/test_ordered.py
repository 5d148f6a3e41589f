"""Segmented order operators against brute force, with one key owning most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.transform import exact_median
from plumbline.plans import ordered, ranges
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 20}", rng.randrange(0, 200), i) for i in range(900)]
    return data, spark.createDataFrame(data, "k string, t int, v int")


def by_key(data):
    groups = {}
    for k, t, v in data:
        groups.setdefault(k, []).append((t, v))
    return {k: sorted(g) for k, g in groups.items()}


@pytest.mark.parametrize("segments", [1, 2, 7, 50])
def test_row_numbers(skewed, segments):
    data, df = skewed
    expected = sorted(((k, t, v, i) for k, g in by_key(data).items() for i, (t, v) in enumerate(g, 1)), key=str)
    assert rows(ordered.row_numbers(df, ["k"], "t", ["v"], segments=segments), "k", "t", "v", "rn") == expected


def test_running_sum(skewed):
    data, df = skewed
    expected = []
    for k, g in by_key(data).items():
        total = 0
        for t, v in g:
            total += v
            expected.append((k, t, v, total))
    assert rows(ordered.running_sum(df, ["k"], "t", "v", ["v"], segments=9), "k", "t", "v", "running") == sorted(expected, key=str)


def test_asof(spark, skewed):
    data, df = skewed
    rights = [(k, t, v) for k, t, v in data if v % 4 == 0]
    lefts = [(k, t, v) for k, t, v in data if v % 4 == 1]
    right = spark.createDataFrame([(k, t, t * 1000 + v) for k, t, v in rights], "k string, t int, x int")
    left = spark.createDataFrame(lefts, "k string, t int, v int")
    expected = []
    for k, t, v in lefts:
        earlier = [(rt, rt * 1000 + rv) for rk, rt, rv in rights if rk == k and rt <= t]
        expected.append((k, t, v, max(earlier)[1] if earlier else None))
    assert rows(ordered.asof_join(left, right, ["k"], "t", "t", "x", segments=6)) == sorted(expected, key=str)


def test_median(skewed):
    data, df = skewed
    import statistics

    expected = sorted(((k, float(statistics.median(t for t, _ in g))) for k, g in by_key(data).items()), key=str)
    assert rows(exact_median(df, ["k"], "t")) == expected


def test_range_join(spark):
    points = spark.createDataFrame([(i,) for i in range(-20, 60)], "x int")
    spans = spark.createDataFrame([("a", -5, 3), ("b", 0, 40), ("c", 59, 60), ("d", 5, 5)], "n string, lo int, hi int")
    expected = sorted(((n, x) for n, lo, hi in [("a", -5, 3), ("b", 0, 40), ("c", 59, 60), ("d", 5, 5)] for x in range(-20, 60) if lo <= x < hi), key=str)
    assert rows(ranges.range_join(points, "x", spans, "lo", "hi", 10), "n", "x") == expected


@pytest.mark.parametrize("width, salts", [(1, 16), (0.5, 16), (7, 0), (1, 3)])
def test_range_join_of_any_length(spark, width, salts):
    """Short, empty, inverted, negative and very long ranges, fractional bounds, nulls, repeats and a hot point."""
    rng = random.Random(8)
    xs = [None, 5.0, -3.25, 0.0, 1e9 - 1, 1e9] + [rng.choice([2.5, rng.uniform(-50, 50), rng.uniform(0, 1e9)]) for _ in range(300)]
    spans = [("long", -7.0, 1e9), ("none", 3.0, 3.0), ("back", 9.0, 1.0), ("null", None, 4.0), ("bits", -0.5, 0.25), ("one", 5.0, 6.0)] + [
        (f"r{i}", float(a), float(a) + rng.choice([0.1, 1, 33, 12345.5])) for i, a in enumerate(rng.sample(range(-60, 60), 30))]
    points = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    spread = spark.createDataFrame(spans, "n string, lo double, hi double")
    want = sorted(((i, n) for i, x in enumerate(xs) for n, a, b in spans if x is not None and a is not None and a <= x < b), key=str)
    assert rows(ranges.range_join(points, "x", spread, "lo", "hi", width, salts), "i", "n") == want
    assert ranges.range_join(points, "x", spread.limit(0), "lo", "hi", width, salts).count() == 0


def test_dyadic_blocks_are_few_and_exact(spark):
    pairs = [(0, 0), (0, 7), (1, 6), (-5, 9), (3, 1_000_000_002), (-(2**40), 2**40 + 1), (2**50 + 1, 2**50 + 1)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", ranges.dyadic_blocks(F.col("a"), F.col("b")).alias("blocks"))
    for r in df.collect():
        cells = sorted((x.at << x.level, (x.at + 1) << x.level) for x in r.blocks)
        assert cells[0][0] == r.a and cells[-1][1] == r.b + 1 and all(p[1] == q[0] for p, q in zip(cells, cells[1:]))
        assert len(cells) <= max(1, 2 * (r.b - r.a + 1).bit_length())
    assert len(df.where("b = 1000000002").first().blocks) <= 60


def test_parts_stay_small_for_a_hot_key(spark):
    df = spark.range(4000).selectExpr("'hot' AS k", "id AS t")
    sizes = [r["count"] for r in ordered.ranged(df, ["k"], ["t"], 8).groupBy(ordered.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 900


def test_one_hot_order_value_is_split(spark):
    """All rows share key and order value, and no tie tells them apart; the parts stay even, the numbers and sums whole."""
    df = spark.range(4000).selectExpr("'hot' AS k", "7 AS t", "id AS v")
    sizes = [r["count"] for r in ordered.ranged(df, ["k"], ["t"], 8).groupBy(ordered.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 900
    assert sorted(r.rn for r in ordered.row_numbers(df, ["k"], "t", segments=8).collect()) == list(range(1, 4001))
    assert max(r.running for r in ordered.running_sum(df, ["k"], "t", "v", segments=8).collect()) == 4000 * 3999 // 2


def test_plan_does_not_grow_with_the_parts(spark):
    df = spark.range(3000).selectExpr("id % 3 AS k", "id AS t", "id AS v")
    plans = [ordered.running_sum(df, ["k"], "t", "v", segments=n)._jdf.queryExecution().analyzed().toString().count("\n") for n in (2, 300)]
    assert plans[0] == plans[1]


def test_nulls_in_order_and_value(spark):
    df = spark.createDataFrame([("a", None, 5), ("a", 1, None), ("a", 2, 3), ("b", None, None), (None, 1, 4)], "k string, t int, v int")
    assert rows(ordered.running_sum(df, ["k"], "t", "v", segments=3), "k", "t", "running") == [("a", 1, 5), ("a", 2, 8), ("a", None, 5), ("b", None, 0), (None, 1, 4)]
    left = spark.createDataFrame([("a", None), ("a", 3), (None, 3)], "k string, t int")
    assert rows(ordered.asof_join(left, df, ["k"], "t", "t", "v", segments=3)) == sorted([("a", None, None), ("a", 3, 3), (None, 3, None)], key=str)


def test_timestamps_as_order(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", base + dt.timedelta(hours=i), i) for i in range(30)], "k string, t timestamp, v int")
    assert [r.rn for r in ordered.row_numbers(df, ["k"], "t", segments=4).orderBy("t").collect()] == list(range(1, 31))


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, i, i) for i in range(6)] + [("a", 3, 1)], "k string, t int, v int")
    assert [r.rn for r in ordered.row_numbers(df, ["k"], "t", segments=3).filter("k IS NULL").orderBy("t").collect()] == [1, 2, 3, 4, 5, 6]
    joined = ordered.asof_join(df, df.select("k", "t", F.col("v").alias("x")), ["k"], "t", "t", "x", segments=3)
    assert {(r.k, r.x) for r in joined.collect()} == {(None, None), ("a", 1)}

"""Ranks over range partitions, order statistics and the normal quantile."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from ratewise.functions.columns import normal_quantile
from ratewise.operators import aggregates as A
from ratewise.operators import features as FE
from ratewise.operators.quantiles import order_statistics, prefix_sums


def test_normal_quantile_matches_the_standard_library(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.99999, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile("p").alias("z")).collect()
    for r in rows:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-13, abs=1e-15)
    edge = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(normal_quantile("p").alias("z"))
    assert [r.z for r in edge.collect()] == [None] * 3


def test_order_statistics_of_hot_values(spark):
    values = [3.0] * 500 + [1.0, None, 2.0, 2.0] + [float(x) for x in range(100, 160)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    got = sorted((r.i, r.value, r.n) for r in order_statistics(df, "x", step=7).collect())
    want = sorted(v for v in values if v is not None)
    assert got == [(i + 1, v, len(want)) for i, v in enumerate(want)]
    assert order_statistics(df.where("false"), "x").collect() == []


def test_prefix_sums_by_group(spark):
    rows = [(g, i, i % 4 + 1) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i long, w long").repartition(6)
    got = {(r.g, r.i): (r._before, r._all) for r in prefix_sums(df, ["g"], ["i"], "w").collect()}
    for g, i, _ in rows:
        assert got[g, i] == (sum(w for h, j, w in rows if h == g and j < i), sum(w for h, _, w in rows if h == g))


def test_a_point_for_every_row(bookings_small):
    q = A.qq_points(bookings_small, "actual_price")
    n = bookings_small.where("actual_price is not null").count()
    s = q.agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.countDistinct("i").alias("d")).first()
    assert (s.n, s.lo, s.hi, s.d) == (n, 0, n - 1, n)


def test_label_codes_without_a_window_over_a_column(bookings_small):
    maps = FE.label_maps(bookings_small, ["hotel_name", "season"])
    assert "dense_rank" not in maps._jdf.queryExecution().optimizedPlan().toString()
    for c in ("hotel_name", "season"):
        want = sorted(r[0] for r in bookings_small.select(c).distinct().collect())
        assert [r.value for r in maps.where(F.col("column") == c).orderBy("code").collect()] == want

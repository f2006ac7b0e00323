"""Invariants of the row-count-checked operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.operators import aggregates as A
from ratewise.operators import anomaly as AN
from ratewise.operators import models as M
from ratewise.operators import segments as K
from ratewise.operators.clean import sample_n

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def test_histogram_counts_sum_to_rows(bookings_small):
    h = A.histogram(bookings_small, "actual_price", 50).collect()
    assert len(h) == 50
    assert sum(r["count"] for r in h) == bookings_small.count()


def test_density_integrates_to_one(bookings_small):
    h = A.histogram(bookings_small.withColumn("g", F.col("is_weekend")), "actual_price", 40, by="g",
                    density=True).collect()
    for g in (0, 1):
        rows = [r for r in h if r.g == g]
        width = rows[0].bin_hi - rows[0].bin_lo
        assert sum(r.density for r in rows) * width == pytest.approx(1.0, abs=1e-4)


def test_shares_sum_to_100(bookings_small):
    s = A.share_by(bookings_small, "room_type").collect()
    assert sum(r.share_pct for r in s) == pytest.approx(100.0, abs=1e-3)


def test_kde_integrates_to_about_one(bookings_small):
    k = A.kde(bookings_small, "actual_price", "hotel_name", 200).collect()
    for h in {r.hotel_name for r in k}:
        pts = sorted((r.x, r.density) for r in k if r.hotel_name == h)
        xs, ys = zip(*pts)
        assert np.trapezoid(ys, xs) == pytest.approx(1.0, abs=0.02)


def test_qq_points_monotone(bookings_small):
    q = A.qq_points(bookings_small, "actual_price", 50).orderBy("i").collect()
    assert all(a.theoretical < b.theoretical and a.sample <= b.sample for a, b in zip(q, q[1:]))


def test_sample_n_is_exact_and_stable(bookings_small):
    a = [tuple(r) for r in sample_n(bookings_small, 100, 7, KEYS).select(*KEYS).collect()]
    b = [tuple(r) for r in sample_n(bookings_small.repartition(5), 100, 7, KEYS).select(*KEYS).collect()]
    assert len(a) == 100 and sorted(a) == sorted(b)


def test_folds_partition_rows(bookings_small):
    f = M.fold_column(bookings_small, 5).groupBy("fold").count().collect()
    assert sorted(r.fold for r in f) == [0, 1, 2, 3, 4]
    assert sum(r["count"] for r in f) == bookings_small.count()


def test_random_split_is_partition(bookings_small):
    tr, te = M.random_split(bookings_small)
    n, a, b = bookings_small.count(), tr.count(), te.count()
    assert a + b == n and 0.7 < a / n < 0.9


def test_permutation_keeps_values(bookings_small):
    perm = M.permute_column(bookings_small.select(*KEYS, "actual_price"), "actual_price", 3, bucket_rows=64)
    before = sorted(r[0] for r in bookings_small.select("actual_price").collect())
    after = sorted(r[0] for r in perm.select("actual_price").collect())
    assert before == after


def test_isolation_forest_ranks_planted_outliers_lowest(spark, bookings_small):
    planted = bookings_small.withColumn(
        "actual_price", F.when(F.col("l_orderkey") % 97 == 0, F.col("actual_price") * 25).otherwise(F.col("actual_price")))
    s = AN.isolation_score(planted, AN.ANOMALY_COLS, keys=KEYS, trees=50, psi=128, seed=1)
    s = AN.flag_lowest(s, "anomaly_score", 0.05)
    rows = s.select((F.col("l_orderkey") % 97 == 0).alias("planted"), "is_anomaly").collect()
    planted_flags = [r.is_anomaly for r in rows if r.planted]
    assert planted_flags and sum(planted_flags) / len(planted_flags) > 0.9
    rate = sum(r.is_anomaly for r in rows) / len(rows)
    assert rate == pytest.approx(0.05, abs=0.01)


def test_kmeans_cost_falls_with_k(bookings_small):
    vec = K.scaled_vectors(bookings_small)
    e = K.elbow(vec, [2, 4, 8], restarts=2).orderBy("k").collect()
    assert e[0].inertia > e[1].inertia > e[2].inertia


def test_pca_ratios_sorted_and_sum_to_one(bookings_small):
    cols = K.SEGMENT_COLS
    vec = K.scaled_vectors(bookings_small, cols)
    v = K.pca_variance(vec, len(cols)).orderBy("component").collect()
    ratios = [r.ratio for r in v]
    assert ratios == sorted(ratios, reverse=True)
    assert sum(ratios) == pytest.approx(1.0, abs=1e-9)
    assert v[-1].cumulative == pytest.approx(1.0, abs=1e-9)
    assert 1 <= v[0].n_for_threshold <= len(cols)


def test_pca_matches_numpy_eigen(bookings_small):
    cols = K.SEGMENT_COLS
    vec = K.scaled_vectors(bookings_small, cols)
    ratios = [r.ratio for r in K.pca_variance(vec, len(cols)).orderBy("component").collect()]
    x = np.array([r.toArray() for r in vec.select("features").toPandas()["features"]])
    ev = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert ratios == pytest.approx(list(ev / ev.sum()), abs=1e-9)


def test_avg_path_known_values():
    assert AN.avg_path(1) == 0.0 and AN.avg_path(2) == 1.0
    assert AN.avg_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256)


def test_binned_kde_close_to_exact(bookings_small):
    exact = {(r.hotel_name, r.gi): r.density for r in A.kde(bookings_small, "actual_price", "hotel_name", 100).collect()}
    binned = {(r.hotel_name, r.gi): r.density
              for r in A.kde(bookings_small, "actual_price", "hotel_name", 100, bins=4096).collect()}
    peak = max(exact.values())
    assert exact.keys() == binned.keys()
    assert max(abs(exact[k] - binned[k]) for k in exact) < 0.01 * peak

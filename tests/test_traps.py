"""Hand-computed micro tests for the semantic traps."""

import math

import pytest
from pyspark.sql import functions as F

from ratewise.functions.columns import clip, occ_band, rnd, sample_skew
from ratewise.operators import features as FE
from ratewise.operators import series as S
from ratewise.operators.clean import impute_mode
from ratewise.sources.bookings import mark_test


def test_t3_weekend_is_fri_sat_sun(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-04",), ("2024-01-05",), ("2024-01-07",)], "d string")
    out = df.select(F.weekday(F.to_date("d")).alias("dow")).withColumn(
        "wk", F.when(F.col("dow") >= 4, 1).otherwise(0)).collect()
    assert [r.dow for r in out] == [0, 3, 4, 6]
    assert [r.wk for r in out] == [0, 0, 1, 1]


def test_t2_none_is_a_category(spark):
    df = spark.createDataFrame([("None",), ("Concert",), (None,)], "event_type string")
    out = FE.event_features(df.withColumn("event_magnitude", F.lit(0))).collect()
    assert [r.has_event for r in out] == [0, 1, None]


def test_t4_high_demand_needs_both_strict(spark):
    df = spark.createDataFrame([(0.81, 0.86), (0.80, 0.90), (0.90, 0.85), (0.95, 0.95)],
                               "occupancy_rate double, demand_score double")
    out = FE.demand_features(df.withColumn("lead_time_days", F.lit(1))).collect()
    assert [r.high_demand for r in out] == [1, 0, 0, 1]


def test_t5_scaling_uses_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    out = [r.x_scaled for r in FE.standardize(df, ["x"]).collect()]
    vals = [1.0, 2.0, 3.0, 0.0]  # null -> 0 first
    m = sum(vals) / 4
    sd = math.sqrt(sum((v - m) ** 2 for v in vals) / 4)
    assert out == pytest.approx([(v - m) / sd for v in vals])


def test_t5_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r.x_scaled for r in FE.standardize(df, ["x"]).collect()] == [0.0, 0.0]


def test_t6_bias_corrected_skew(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (9.0,)], "x double")
    assert df.agg(sample_skew("x")).first()[0] == pytest.approx(1.9137, abs=1e-4)


def test_t7_half_up_through_decimal(spark):
    df = spark.createDataFrame([(0.285,), (2.675,), (1.005,)], "x double")
    assert [r.r for r in df.select(rnd("x", 2).alias("r")).collect()] == [0.29, 2.68, 1.01]


def test_t9_qcut_right_closed_lowest_included_duplicates_dropped(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0]], "x double")
    edges = FE.qcut_edges(df, "x", 4)
    assert edges == [1.0, 1.5, 3.25, 5.0]  # 1.0 twice (q0 and q25) -> one edge
    bins = [r.b for r in FE.qcut(df, "x", 4, name="b", edges=edges).collect()]
    assert bins == [0, 0, 0, 0, 1, 1, 2, 2]


def test_t10_cut_lowest_edge_excluded(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.50001,), (1.0,), (1.02,)], "x double")
    assert [r.b for r in df.select(occ_band("x").alias("b")).collect()] == [None, "<50%", "50–65%", ">95%", None]


def test_t11_t12_rolling_counts_rows_and_first_std_is_zero(spark):
    import datetime as dt
    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 2), dt.date(2020, 1, 10)]
    s = spark.createDataFrame([(d, float(i + 1)) for i, d in enumerate(days)], "ds date, y double")
    out = S.rolling_stats(s).orderBy("ds").collect()
    assert [r.roll7 for r in out] == [1.0, 1.5, 2.0]  # rows, not calendar days
    assert out[0].std30 == 0.0
    assert [r.t_days for r in out] == [0, 1, 9]


def test_t13_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "g string")
    assert [r.g for r in impute_mode(df, ["g"]).collect()] == ["b", "a", "b", "a", "a"]


def test_t15_label_codes_alphabetical(spark):
    df = spark.createDataFrame([(d,) for d in [1, 10, 30, 90]], "lead_time_days int")
    feat = FE.demand_features(df.withColumns({"occupancy_rate": F.lit(0.5), "demand_score": F.lit(0.5)}))
    enc = FE.label_encode(feat, ["lead_time_bucket"]).orderBy("lead_time_days").collect()
    assert [(r.lead_time_bucket, r.lead_time_bucket_enc) for r in enc] == [
        ("Last_Minute", 0), ("Short_Term", 3), ("Medium_Term", 2), ("Long_Term", 1)]


def test_t20_split_cutoff_rank(spark):
    import datetime as dt
    rows = [(dt.date(2020, 1, d),) for d in [1, 1, 2, 3, 3, 3, 4, 5, 5, 6]]
    df = spark.createDataFrame(rows, "checkin_date date")
    out = mark_test(df).orderBy("checkin_date").collect()
    # n=10, 0-based rank 8 in date order is 2020-01-05 -> test from that date on
    assert [r.is_test for r in out] == [0, 0, 0, 0, 0, 0, 0, 1, 1, 1]


def test_t21_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-9.0,), (0.5,), (9.0,)], "x double")
    assert [r.c for r in df.select(clip("x", -5, 5).alias("c")).collect()] == [None, -5.0, 0.5, 5.0]

"""Physical-plan properties the scale design relies on."""

import pytest
from pyspark.sql import functions as F

from ratewise.operators import aggregates as A
from ratewise.operators.clean import sample_n
from ratewise.sources import bookings as B

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def materialized(spark):
    B.materialize(spark, SMALL)
    yield B.bookings(spark, SMALL)
    B.forget_materialized(SMALL)


def test_materialized_scan_prunes_and_pushes_the_split(materialized):
    q = materialized.filter(F.col("is_test") == 1).select("month", "actual_price")
    plan = q._jdf.queryExecution().sparkPlan().toString()
    assert "PushedFilters: [IsNotNull(checkin_date), GreaterThanOrEqual(checkin_date" in plan
    read = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "checkin_date" in read and "month" in read and "actual_price" in read
    assert "revpar" not in read and "room_type" not in read


def test_grouped_aggregation_is_partial_before_the_shuffle(materialized):
    plan = _plan(materialized.transform(A.monthly_summary))
    assert "partial_avg" in plan and "hashpartitioning(month" in plan
    assert plan.index("hashpartitioning(month") < plan.index("partial_avg")  # partial agg below the exchange


def test_sample_is_a_top_k_not_a_sort(materialized):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    plan = sample_n(materialized, 50, 1, keys)._jdf.queryExecution().sparkPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_star_join_broadcasts_only_tiny_dimensions_by_hint(spark):
    plan = B.star_join(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("BROADCAST") <= 2  # nation and region hints only


def test_exact_quantiles_without_a_value_map(spark, materialized):
    import numpy as np
    from ratewise.operators.elasticity import elasticity_by, row_elasticity
    from ratewise.operators.quantiles import exact_quantiles
    e = row_elasticity(materialized)
    got = exact_quantiles(e, "elasticity", [0.0, 0.05, 0.5, 0.9, 1.0], ["room_type"])
    rows = e.select("room_type", "elasticity").where("elasticity is not null").toPandas()
    for r in got.collect():
        want = np.percentile(rows[rows.room_type == r.room_type].elasticity, [0, 5, 50, 90, 100])
        assert list(r.q) == pytest.approx(list(want), abs=1e-9)
    plan = elasticity_by(e, "room_type")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan
    odd = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0), ("b", 2.0)], "g string, x double")
    assert {r.g: list(r.q) for r in exact_quantiles(odd, "x", [0.5], ["g"]).collect()} == {None: [2.0], "b": [2.0]}
    assert exact_quantiles(odd.limit(0), "x", [0.5]).first().q == [None]


def test_grouped_statistics_do_not_shuffle_rows_by_group(spark, materialized):
    """Rows are counted by group and value before anything meets on the group key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (A.histogram(materialized, "actual_price", 20, by="season"), A.kde(materialized, "actual_price", "hotel_name", 20)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            # below every join: an aggregate by group and value
            assert plan.count("Join") and all("Aggregate" in part for part in plan.split("Join")[1:])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_groups_and_pairwise_correlations(spark):
    import pandas as pd
    rows = [("a", 1.0, 2.0, None), ("a", 2.0, None, 1.0), (None, 9.0, 1.0, 2.0), ("b", 4.0, 5.0, 3.0), ("b", None, 2.0, 8.0), ("b", 7.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    h = A.histogram(df, "x", 4, by="g").collect()
    assert {r.g for r in h} == {"a", "b"} and sum(r["count"] for r in h) == 4
    want = pd.DataFrame(rows, columns=["g", "x", "y", "z"])[["x", "y", "z"]].corr()
    for r in A.corr_matrix(df, ["x", "y", "z"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r.col_a, r.col_b], abs=1e-6)


def test_row_hash_draws_are_unrelated(spark):
    from ratewise.functions.seeded import seeded_event, uniform01
    from ratewise.operators.anomaly import _hash_t
    from ratewise.operators.clean import row_hash
    from ratewise.sources.raw import raw_from_tables, to_bookings
    df = spark.range(20_000).select("id")
    d = df.select(uniform01(["id"], 1).alias("a"), uniform01(["id"], 2).alias("b"), uniform01(["id"], 3).alias("c"), "id")
    r = d.agg(F.corr("a", "b"), F.corr("a", "id"), F.avg("a"), F.stddev(2 * (F.col("a") + F.col("b") + F.col("c")) - 3)).first()
    assert abs(r[0]) < 0.02 and abs(r[1]) < 0.02 and abs(r[2] - 0.5) < 0.01 and abs(r[3] - 1.0) < 0.02
    assert df.select(row_hash(["id"], 1).alias("h")).where("h > 1000003").count() > 19_990
    first = sample_n(df, 500, 1, ["id"]).select("id").toPandas().id
    assert abs(first.mean() - 10_000) < 1500 and not first.is_monotonic_increasing
    h = df.select(_hash_t(["id"], 1, F.lit(0)).alias("a"), _hash_t(["id"], 2, F.lit(0)).alias("b"), _hash_t(["id"], 1, F.lit(1)).alias("c"))
    assert h.where("a = b or a = c").count() == 0 and abs(h.agg(F.corr("a", "b")).first()[0]) < 0.03
    b = to_bookings(raw_from_tables(spark, SMALL))
    w = b.where("event_magnitude > 0").agg(F.avg((F.col("weather_score") == F.col("event_magnitude")).cast("int")),
                                           F.stddev("occupancy_rate")).first()
    assert 0.1 < w[0] < 0.3 and b.select("booking_id").distinct().count() == spark.read.parquet(
        f"{SMALL}/lineitem.parquet").where("l_extendedprice / 500 - 2 > 5").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().count()


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace
    from ratewise.session import checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda p: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d)))


def test_sketch_options_track_exact(materialized):
    from ratewise.operators import profile as P
    cols = ["actual_price", "occupancy_rate", "lead_time_days"]
    ex = {r.column: r for r in P.describe(materialized, cols).collect()}
    ap = {r.column: r for r in P.describe(materialized, cols, exact=False).collect()}
    for c in cols:
        assert ap[c]["count"] == ex[c]["count"] and ap[c].mean == ex[c].mean
        span = ex[c].max - ex[c].min
        for q in ("p25", "p50", "p75"):
            assert abs(getattr(ap[c], q) - getattr(ex[c], q)) <= 0.01 * span
    card = ["hotel_name", "room_type", "market_segment"]
    e = {r.column: r.n_distinct for r in P.cardinality(materialized, card).collect()}
    a = {r.column: r.n_distinct for r in P.cardinality(materialized, card, exact=False).collect()}
    assert all(abs(a[c] - e[c]) <= max(1, 0.05 * e[c]) for c in card)

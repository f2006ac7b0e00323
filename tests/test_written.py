"""Queries that read the bookings several times do so over one written table; dedupe shuffles only likely copies."""

import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ratewise.operators import clean as C
from ratewise.plans.catalog import load_all
from ratewise.session import cut_lineage
from ratewise.sources import bookings as B


def test_dedupe_equals_drop_duplicates(spark):
    nan = float("nan")
    rows = [(1, "a", 0.0), (2, "a", -0.0), (3, "a", None), (4, "a", None), (5, None, nan), (6, None, nan), (7, None, None),
            (8, "b", 1.5), (9, "b", 1.5), (10, "b", 1.5), (11, "c", 2.5), (12, "d", 2.5)]
    df = cut_lineage(spark.createDataFrame(rows, "booking_id int, s string, x double"))

    def seen(out):
        return Counter((r["s"], str(r["x"] + 0.0 if r["x"] is not None else None)) for r in out.collect())
    assert seen(C.dedupe(df)) == seen(df.dropDuplicates(["s", "x"]))
    assert C.dedupe(df, exclude=()).count() == len(rows)


def test_dedupe_compares_whole_rows_only_where_hashes_repeat(spark):
    plan = C.dedupe(spark.createDataFrame([(1, "a")], "a int, s string"), ())._jdf.queryExecution().analyzed().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan


@pytest.mark.parametrize("most", [64, 2 ** 24])
def test_dedupe_joins_only_likely_copies(spark, monkeypatch, most):
    monkeypatch.setattr(C, "MOST_BITS", most)
    rows = [(i, i % 7, "x") for i in range(5000)] + [(i, i % 7, "x") for i in range(0, 5000, 50)] * 2
    df = cut_lineage(spark.createDataFrame(rows, "a int, b int, s string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # as if the repeated hashes were too many to broadcast
    written = []
    try:
        from ratewise import session
        plain = session.cut_lineage
        monkeypatch.setattr(session, "cut_lineage", lambda d: written.append(plain(d)) or written[-1])
        got = C.dedupe(df, ())
        assert sorted(map(tuple, got.collect())) == sorted(set(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joined = written[-1].count()                                        # the rows that are shuffled for the joins
    assert joined >= 300 and (most == 64 or joined < 1000)


def test_a_written_cut_leaves_no_shuffle_files(spark):
    import os
    import time
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)

    def shuffles():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    held = shuffles()
    cut = cut_lineage(spark.range(20_000).repartition(4, "id"))
    for _ in range(50):
        if not shuffles() - held:
            break
        time.sleep(0.2)
    assert not shuffles() - held and spark.conf.get(name) == before and cut.count() == 20_000


def test_written_bookings_are_the_bookings(spark, small_dir):
    cols = [*B.KEY_COLS, "actual_price", "is_test"]
    want = B.bookings(spark, small_dir).select(*cols)
    got = B.written_bookings(spark, small_dir, *cols)
    assert got.columns == cols and got.count() == want.count() and not got.exceptAll(want).count()


def test_dirty_bookings_join_once(spark, small_dir):
    dirty = B.dirty_bookings(spark, small_dir)
    plan = dirty._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    twice = F.col("l_orderkey") + F.col("l_partkey") * 3
    base = B.derive(B.star_join(spark, small_dir))
    assert dirty.count() == base.count() + base.where(twice % 331 == 0).count()


@pytest.mark.parametrize("module, name", [("q_series", "w05_poly_trend"), ("q_series", "w06_forecast_30d"),
                                          ("q_aggregates", "g43_kde_by_room_type")])
def test_several_readers_of_one_cut(spark, small_dir, monkeypatch, module, name):
    made = []
    where = importlib.import_module(f"ratewise.plans.{module}")
    fn = load_all()[name].fn
    plain = where.cut_lineage
    monkeypatch.setattr(where, "cut_lineage", lambda df: made.append(df) or plain(df))
    plan = fn(spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "l_orderkey" not in plan


@pytest.mark.parametrize("name", ["e02_elasticity_by_room_type", "e03_elasticity_by_month", "f14_label_encode"])
def test_one_star_join_before_a_cut(spark, small_dir, name):
    plan = load_all()[name].fn(spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "o_orderdate" not in plan


def test_csv_of_the_bookings_is_compressed(spark, small_dir):
    from ratewise.plans import q_ingest
    out = q_ingest.s01_csv_roundtrip(spark, small_dir)
    assert out.inputFiles() and all(f.endswith(".csv.gz") for f in out.inputFiles())
    want = B.bookings(spark, small_dir)
    assert out.schema.names == want.schema.names and not out.exceptAll(want).count() and out.count() == want.count()

"""Registered profiling queries (Q1-Q8)."""

from __future__ import annotations

from ratewise.operators import profile as P
from ratewise.plans.catalog import query
from ratewise.plans.oracle import R, with_bookings
from ratewise.sources.bookings import BOOKING_COLS, bookings, dirty_bookings

DESCRIBE_COLS = ["actual_price", "base_price", "competitor_avg_price", "occupancy_rate",
                 "demand_score", "lead_time_days", "length_of_stay", "reviews_score",
                 "revenue_per_night", "revpar"]
CATEGORY_COLS = ["hotel_name", "room_type", "channel", "guest_type", "market_segment",
                 "event_type", "season"]


@query("q01_shape", with_bookings(f"SELECT count(*) AS n_rows, {len(BOOKING_COLS) + 1} AS n_cols FROM bookings"))
def q01_shape(spark, d):
    return P.shape(bookings(spark, d))


@query("q02_dtype_counts")
def q02_dtype_counts(spark, d):
    return P.dtype_counts(bookings(spark, d))


@query("q03_missing_profile", with_bookings(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) - count({c}) AS n_missing, "
        f"{R(f'(count(*) - count({c})) / count(*) * 100', 4)} AS pct_missing FROM bookings_dirty"
        for c in BOOKING_COLS) + ") t WHERE n_missing > 0", dirty=True))
def q03_missing_profile(spark, d):
    return P.missing_profile(dirty_bookings(spark, d))


@query("q04_duplicate_count", with_bookings("""
SELECT (SELECT count(*) FROM bookings_dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM bookings_dirty) t)
  AS n_duplicates""", dirty=True))
def q04_duplicate_count(spark, d):
    return P.duplicate_count(dirty_bookings(spark, d))


@query("q05_describe", with_bookings(" UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS count, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std,
       {R(f'min({c})')} AS min, {R(f'quantile_cont({c}, 0.25)')} AS p25, {R(f'quantile_cont({c}, 0.5)')} AS p50,
       {R(f'quantile_cont({c}, 0.75)')} AS p75, {R(f'max({c})')} AS max,
       {R(f'CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}) / avg({c}) * 100 END')} AS cv_pct FROM bookings"""
    for c in DESCRIBE_COLS)))
def q05_describe(spark, d):
    return P.describe(bookings(spark, d), DESCRIBE_COLS)


@query("q07_cardinality", with_bookings(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_distinct FROM bookings" for c in CATEGORY_COLS)))
def q07_cardinality(spark, d):
    return P.cardinality(bookings(spark, d), CATEGORY_COLS)


@query("q08_value_counts", with_bookings(
    "SELECT event_type, count(*) AS count FROM bookings GROUP BY event_type ORDER BY count DESC, event_type"))
def q08_value_counts(spark, d):
    return P.value_counts(bookings(spark, d), "event_type")


@query("q08_value_counts_room_type", with_bookings(
    "SELECT room_type, count(*) AS count FROM bookings GROUP BY room_type ORDER BY count DESC, room_type"))
def q08_value_counts_room_type(spark, d):
    return P.value_counts(bookings(spark, d), "room_type")

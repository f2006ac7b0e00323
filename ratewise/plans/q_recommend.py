"""Registered recommender queries (P1, P3-P7, A6) over request tables
derived from the bookings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.columns import fin, fin_row
from ratewise.operators import recommend as P
from ratewise.plans.catalog import query
from ratewise.plans.oracle import D, R, RR, with_bookings
from ratewise.sources.bookings import KEY_COLS, bookings

KEYS = ", ".join(KEY_COLS)


def requests_from(b: DataFrame) -> DataFrame:
    """One sparse pricing request per booking: some fields left empty by
    integer rules on the key, so the defaults of P1 are exercised."""
    c = F.col
    return b.select(
        *KEY_COLS, "base_price", "occupancy_rate", "lead_time_days", "month",
        F.when(c("l_orderkey") % 3 != 0, c("competitor_avg_price")).alias("competitor_avg_price"),
        F.when(c("l_linenumber") % 2 == 0, c("is_weekend")).alias("is_weekend"),
        F.when(c("l_partkey") % 5 != 0, c("event_magnitude")).alias("event_magnitude"),
        F.when(c("l_suppkey") % 4 != 0, c("demand_score")).alias("demand_score"),
        F.when(c("l_orderkey") % 7 != 0, c("length_of_stay")).alias("length_of_stay"),
        F.lit(None).cast("int").alias("is_holiday"))


REQ_CTE = f"""req AS (SELECT {KEYS}, base_price, occupancy_rate, lead_time_days, month,
  CASE WHEN l_orderkey % 3 <> 0 THEN competitor_avg_price END AS competitor_avg_price,
  CASE WHEN l_linenumber % 2 = 0 THEN is_weekend END AS is_weekend,
  CASE WHEN l_partkey % 5 <> 0 THEN event_magnitude END AS event_magnitude,
  CASE WHEN l_suppkey % 4 <> 0 THEN demand_score END AS demand_score,
  CASE WHEN l_orderkey % 7 <> 0 THEN length_of_stay END AS length_of_stay,
  CAST(NULL AS INT) AS is_holiday FROM bookings)"""

TWO_PI = D(2 * math.pi)
_DEF = P.REQUEST_DEFAULTS
COMPLETE_CTES = (
    REQ_CTE,
    f"""c1 AS (SELECT {KEYS}, base_price, occupancy_rate, lead_time_days,
  coalesce(month, {_DEF['month']}) AS month,
  coalesce(length_of_stay, {_DEF['length_of_stay']}) AS length_of_stay,
  coalesce(is_weekend, {_DEF['is_weekend']}) AS is_weekend,
  coalesce(is_holiday, {_DEF['is_holiday']}) AS is_holiday,
  coalesce(event_magnitude, {_DEF['event_magnitude']}) AS event_magnitude,
  coalesce(demand_score, {D(_DEF['demand_score'])}) AS demand_score,
  coalesce(competitor_avg_price, base_price * {D(P.COMPETITOR_DEFAULT_MULT)}) AS competitor_avg_price
  FROM req)""",
    f"""c2 AS (SELECT *, CASE WHEN is_weekend = 1 THEN 4 ELSE 1 END AS day_of_week,
  competitor_avg_price * {D(P.COMPETITOR_MIN_MULT)} AS competitor_min_price,
  competitor_avg_price * {D(P.COMPETITOR_MAX_MULT)} AS competitor_max_price,
  CAST(event_magnitude > 0 AS INT) AS has_event,
  CAST(occupancy_rate > 0.8e0 AND demand_score > 0.85e0 AS INT) AS high_demand,
  sin({TWO_PI} * month / 12e0) AS month_sin, cos({TWO_PI} * month / 12e0) AS month_cos FROM c1)""",
    f"""completed AS (SELECT *, sin({TWO_PI} * day_of_week / 7e0) AS dow_sin, cos({TWO_PI} * day_of_week / 7e0) AS dow_cos,
  competitor_max_price - competitor_min_price AS price_comp_spread,
  {', '.join(f'{D(v) if isinstance(v, float) else v} AS {k}' for k, v in P.CONSTANT_FEATURES.items())}
  FROM c2)""",
)
COMPLETED_COLS = (KEY_COLS + ["base_price", "occupancy_rate", "lead_time_days", "month", "length_of_stay",
                              "is_weekend", "is_holiday", "event_magnitude", "demand_score",
                              "competitor_avg_price", "day_of_week", "competitor_min_price",
                              "competitor_max_price", "has_event", "high_demand", "month_sin", "month_cos",
                              "dow_sin", "dow_cos", "price_comp_spread"] + list(P.CONSTANT_FEATURES))
_DOUBLE = {"l_extendedprice", "base_price", "occupancy_rate", "demand_score", "competitor_avg_price",
           "competitor_min_price", "competitor_max_price", "month_sin", "month_cos", "dow_sin", "dow_cos",
           "price_comp_spread", "reviews_score", "price_vs_comp_avg", "price_premium"}


@query("p01_complete_requests", with_bookings(
    "SELECT " + ", ".join(RR(c) + f" AS {c}" if c in _DOUBLE else c for c in COMPLETED_COLS) + " FROM completed",
    *COMPLETE_CTES))
def p01_complete_requests(spark, d):
    done = P.complete_requests(requests_from(bookings(spark, d)))
    return done.select(*[fin_row(c).alias(c) if c in _DOUBLE else F.col(c) for c in COMPLETED_COLS])


_BONUS = " ".join(f"WHEN {k} THEN {D(v)}" for k, v in P.RULE_EVENT_BONUS.items())
RULE_SQL = (f"base_price * least(greatest(1e0 + (occupancy_rate * 100 - 50) / 100 * 0.3e0 "
            f"+ greatest(0e0, (30 - lead_time_days) / 30 * 0.15e0) + coalesce(CASE event_magnitude {_BONUS} END, 0e0), "
            f"{D(P.RULE_MULT_RANGE[0])}), {D(P.RULE_MULT_RANGE[1])})")
RULE_CTE = "ruled AS (SELECT *, " + RR(RULE_SQL, 2) + " AS rule_price FROM bookings)"


def _ruled(spark, d):
    return P.rule_price(bookings(spark, d))


@query("p03_rule_price", with_bookings(f"SELECT {KEYS}, rule_price FROM ruled", RULE_CTE))
def p03_rule_price(spark, d):
    return _ruled(spark, d).select(*KEY_COLS, "rule_price")


_OCC_PCT = "CAST(round(CAST(occupancy_rate AS DECIMAL(18,8)) * 100, 0) AS INT)"
FACTORS_SQL = (
    "concat_ws('; ', "
    f"CASE WHEN {_OCC_PCT} >= 80 THEN 'high occupancy (' || CAST({_OCC_PCT} AS VARCHAR) || '%) adds premium' END, "
    "CASE WHEN lead_time_days <= 3 THEN 'last-minute booking (' || CAST(lead_time_days AS VARCHAR) || ' days) adds premium' END, "
    "CASE WHEN event_magnitude > 0 THEN lower(event_type) || ' event adds ' || CAST(CAST(event_magnitude * 15 AS INT) AS VARCHAR) || '% premium' END, "
    "CASE WHEN is_weekend = 1 THEN 'weekend adds ~10% premium' END)")
N_FACTORS_SQL = (f"(CAST({_OCC_PCT} >= 80 AS INT) + CAST(lead_time_days <= 3 AS INT) "
                 "+ CAST(event_magnitude > 0 AS INT) + CAST(is_weekend = 1 AS INT))")


@query("p04_pricing_factors", with_bookings(
    f"SELECT {KEYS}, {FACTORS_SQL} AS factors, {N_FACTORS_SQL} AS n_factors FROM bookings"))
def p04_pricing_factors(spark, d):
    f = P.pricing_factors(bookings(spark, d))
    return f.select(*KEY_COLS, F.array_join("factors", "; ").alias("factors"),
                    F.size("factors").alias("n_factors"))


@query("p05_price_context", with_bookings(f"""
SELECT {KEYS}, rule_price, {RR('(rule_price - base_price) / base_price * 100')} AS vs_base_pct,
       {RR('(rule_price - competitor_avg_price) / competitor_avg_price * 100')} AS vs_comp_pct,
       {RR('rule_price * occupancy_rate * length_of_stay')} AS expected_revenue FROM ruled""", RULE_CTE))
def p05_price_context(spark, d):
    ctx = P.price_context(_ruled(spark, d), "rule_price")
    return ctx.select(*KEY_COLS, "rule_price", "vs_base_pct", "vs_comp_pct", "expected_revenue")


@query("p06_recommendation_report", with_bookings(f"""
SELECT count(*) AS n, {R('avg((rule_price - actual_price) / actual_price * 100)')} AS mean_diff_pct,
       {R('sum(rule_price)', 2)} AS total_recommended, {R('sum(actual_price)', 2)} AS total_actual,
       {R('(sum(rule_price) - sum(actual_price)) / sum(actual_price) * 100')} AS uplift_pct FROM ruled""", RULE_CTE))
def p06_recommendation_report(spark, d):
    return P.recommendation_report(_ruled(spark, d))


@query("p07_rule_flags", with_bookings(f"""
SELECT {KEYS},
  CAST(abs(actual_price - competitor_avg_price) / competitor_avg_price > 0.05e0 AS INT) AS outside_parity,
  CAST(occupancy_rate < 0.7e0 AS INT) AS undercut,
  CAST(lead_time_days <= 3 AND occupancy_rate > 0.7e0 AS INT) AS last_minute_premium,
  CAST(month IN (1, 2) AS INT) AS low_season FROM bookings"""))
def p07_rule_flags(spark, d):
    f = P.rule_flags(bookings(spark, d))
    return f.select(*KEY_COLS, "outside_parity", "undercut", "last_minute_premium", "low_season")


@query("a06_deviation_flags", with_bookings(f"""
SELECT {KEYS}, actual_price, rule_price FROM ruled
WHERE rule_price IS NOT NULL AND rule_price <> 0 AND abs(actual_price - rule_price) / rule_price > 0.2e0""",
    RULE_CTE))
def a06_deviation_flags(spark, d):
    return P.deviation_flags(_ruled(spark, d), "rule_price").select(*KEY_COLS, "actual_price", "rule_price")

"""Price recommender over a *table* of pricing requests.

The reference prices one request at a time from widgets; here every step is
a column expression, so a million requests cost one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.columns import fin, map_lookup, fin_row

# --- fixed values --------------------------------------------------------
REQUEST_DEFAULTS = {"length_of_stay": 2, "is_weekend": 0, "is_holiday": 0, "event_magnitude": 0,
                    "demand_score": 0.7, "month": 7}
CONSTANT_FEATURES = {"weather_score": 3, "reviews_score": 4.2, "repeat_guest": 0,
                     "price_vs_comp_avg": 0.0, "price_premium": 1.0,
                     "hotel_name_enc": 0, "room_type_enc": 2, "channel_enc": 1,
                     "guest_type_enc": 0, "event_type_enc": 0, "season_enc": 1}
COMPETITOR_DEFAULT_MULT = 1.05
COMPETITOR_MIN_MULT = 0.92
COMPETITOR_MAX_MULT = 1.08
RULE_EVENT_BONUS = {0: 0.0, 1: 0.12, 2: 0.28, 3: 0.45}
RULE_MULT_RANGE = (0.8, 1.5)
FACTOR_TEXTS = {"occupancy": "high occupancy (%d%%) adds premium", "lead": "last-minute booking (%d days) adds premium",
                "event": "%s event adds %d%% premium", "weekend": "weekend adds ~10% premium"}
# -------------------------------------------------------------------------


def complete_requests(req: DataFrame) -> DataFrame:
    """Fill a sparse request table into the model's feature columns."""
    c = F.col
    filled = req.withColumns({k: F.coalesce(c(k), F.lit(v)) for k, v in REQUEST_DEFAULTS.items()
                              if k in req.columns})
    for k, v in REQUEST_DEFAULTS.items():
        if k not in filled.columns:
            filled = filled.withColumn(k, F.lit(v))
    comp = (F.coalesce(c("competitor_avg_price"), c("base_price") * COMPETITOR_DEFAULT_MULT)
            if "competitor_avg_price" in req.columns else c("base_price") * COMPETITOR_DEFAULT_MULT)
    dow = F.when(c("is_weekend") == 1, 4).otherwise(1)
    two_pi = F.lit(2 * math.pi)
    out = filled.withColumns({
        "competitor_avg_price": comp,
        "day_of_week": dow,
    }).withColumns({
        "competitor_min_price": c("competitor_avg_price") * COMPETITOR_MIN_MULT,
        "competitor_max_price": c("competitor_avg_price") * COMPETITOR_MAX_MULT,
        "has_event": (c("event_magnitude") > 0).cast("int"),
        "high_demand": ((c("occupancy_rate") > 0.80) & (c("demand_score") > 0.85)).cast("int"),
        "month_sin": F.sin(two_pi * c("month") / 12.0),
        "month_cos": F.cos(two_pi * c("month") / 12.0),
        "dow_sin": F.sin(two_pi * c("day_of_week") / 7.0),
        "dow_cos": F.cos(two_pi * c("day_of_week") / 7.0),
    })
    out = out.withColumn("price_comp_spread", c("competitor_max_price") - c("competitor_min_price"))
    return out.withColumns({k: F.lit(v) for k, v in CONSTANT_FEATURES.items()})


def rule_price(req: DataFrame, occ: str = "occupancy_rate", lead: str = "lead_time_days",
               mag: str = "event_magnitude", base: str = "base_price", out: str = "rule_price") -> DataFrame:
    """Fallback multiplier from occupancy, lead time and event size,
    clipped to [0.8, 1.5], times the base price (2 places)."""
    occ_pct = F.col(occ) * 100
    mult = (F.lit(1.0) + (occ_pct - 50) / 100 * 0.3
            + F.greatest(F.lit(0.0), (30 - F.col(lead)) / 30 * 0.15)
            + map_lookup(mag, RULE_EVENT_BONUS, 0.0))
    lo, hi = RULE_MULT_RANGE
    return req.withColumn(out, fin_row(F.col(base) * F.least(F.greatest(mult, F.lit(lo)), F.lit(hi)), 2))


def pricing_factors(req: DataFrame, occ: str = "occupancy_rate", lead: str = "lead_time_days",
                    mag: str = "event_magnitude", event: str = "event_type",
                    weekend: str = "is_weekend") -> DataFrame:
    """The explanation texts whose condition holds, as ``array<string>``."""
    occ_pct = F.round(F.col(occ).cast("decimal(18,8)") * 100, 0).cast("int")
    texts = F.array(
        F.when(occ_pct >= 80, F.format_string(FACTOR_TEXTS["occupancy"], occ_pct)),
        F.when(F.col(lead) <= 3, F.format_string(FACTOR_TEXTS["lead"], F.col(lead))),
        F.when(F.col(mag) > 0, F.format_string(FACTOR_TEXTS["event"], F.lower(F.col(event)),
                                               (F.col(mag) * 15).cast("int"))),
        F.when(F.col(weekend) == 1, F.lit(FACTOR_TEXTS["weekend"])),
    )
    return req.withColumn("factors", F.array_compact(texts))


def price_context(req: DataFrame, rec: str, base: str = "base_price",
                  comp: str = "competitor_avg_price", occ: str = "occupancy_rate",
                  nights: str = "length_of_stay") -> DataFrame:
    """P5: recommended vs base %, vs competitor %, expected revenue."""
    r = F.col(rec)
    return req.withColumns({
        "vs_base_pct": fin_row((r - F.col(base)) / F.col(base) * 100),
        "vs_comp_pct": fin_row((r - F.col(comp)) / F.col(comp) * 100),
        "expected_revenue": fin_row(r * F.col(occ) * F.col(nights)),
    })


def recommendation_report(df: DataFrame, rec: str = "rule_price", actual: str = "actual_price") -> DataFrame:
    """Recommended vs actual per row (diff %) and the total uplift."""
    diff = (F.col(rec) - F.col(actual)) / F.col(actual) * 100
    return df.agg(F.count(F.lit(1)).alias("n"), fin(F.avg(diff)).alias("mean_diff_pct"),
                  fin(F.sum(rec), 2).alias("total_recommended"), fin(F.sum(actual), 2).alias("total_actual"),
                  fin((F.sum(rec) - F.sum(actual)) / F.sum(actual) * 100).alias("uplift_pct"))


def rule_flags(df: DataFrame) -> DataFrame:
    """Rule-sheet flags (competitor parity band, undercut, last-minute
    premium, low season)."""
    parity = F.abs(F.col("actual_price") - F.col("competitor_avg_price")) / F.col("competitor_avg_price")
    return df.withColumns({
        "outside_parity": (parity > 0.05).cast("int"),
        "undercut": (F.col("occupancy_rate") < 0.70).cast("int"),
        "last_minute_premium": ((F.col("lead_time_days") <= 3) & (F.col("occupancy_rate") > 0.70)).cast("int"),
        "low_season": F.col("month").isin(1, 2).cast("int"),
    })


def deviation_flags(df: DataFrame, pred: str, actual: str = "actual_price", tol: float = 0.20) -> DataFrame:
    """Prices more than ``tol`` away from the predicted norm."""
    dev = F.abs(F.col(actual) - F.col(pred)) / F.col(pred)
    return df.filter(F.col(pred).isNotNull() & (F.col(pred) != 0) & (dev > tol))

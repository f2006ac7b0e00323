"""Feature engineering (F1-F19), all column expressions in one projection.

Fitted encoders (F14 label codes, F15 scaler, F18 quantile edges) compute
their statistics with one aggregation and then apply them as a projection.
Label codes are a small mapping table joined back on the category value;
Spark's own size check (AQE) broadcasts it when it is small, and it stays a
shuffle join when a column has many distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.columns import (
    EVENT_PREMIUM, cyclic, lead_time_bucket, map_lookup, rnd,
)
from ratewise.operators.quantiles import column_quantiles, prefix_sums

# --- fixed values: model feature list and encoded columns -----------------
FEATURE_COLS = [
    "month", "day_of_week", "week_of_year", "is_weekend", "is_holiday",
    "month_sin", "month_cos", "dow_sin", "dow_cos",
    "lead_time_days", "length_of_stay",
    "competitor_avg_price", "competitor_min_price", "competitor_max_price",
    "base_vs_comp_avg", "base_vs_comp_min", "price_comp_spread",
    "occupancy_rate", "demand_score", "high_demand",
    "event_magnitude", "has_event", "weather_score",
    "reviews_score", "repeat_guest",
    "hotel_name_enc", "room_type_enc", "channel_enc",
    "guest_type_enc", "event_type_enc", "season_enc", "lead_time_bucket_enc",
]
ENCODED_COLS = ["hotel_name", "room_type", "channel", "guest_type",
                "event_type", "season", "day_of_week_name", "lead_time_bucket"]
# Columns computed from the target: analysis only, never model inputs.
LEAKY_COLS = ["price_vs_comp_avg", "price_vs_comp_min", "price_premium", "price_per_person",
              "revenue_efficiency", "revenue_per_night", "revpar", "total_stay_revenue",
              "actual_price", "is_test"]
# --------------------------------------------------------------------------


def calendar(df: DataFrame, date_col: str = "checkin_date") -> DataFrame:
    """Weekday name, ISO week and day of year (year/month/weekday are in the table)."""
    d = F.col(date_col)
    return df.withColumns({
        "day_of_week_name": F.date_format(d, "EEEE"),
        "week_of_year": F.weekofyear(d).cast("int"),
        "day_of_year": F.dayofyear(d).cast("int"),
    })


def competitor_features(df: DataFrame, ref: str = "base_price") -> DataFrame:
    """F1-F3."""
    return df.withColumns({
        "base_vs_comp_avg": rnd((F.col(ref) - F.col("competitor_avg_price")) / F.col("competitor_avg_price"), 4),
        "base_vs_comp_min": rnd((F.col(ref) - F.col("competitor_min_price")) / F.col("competitor_min_price"), 4),
        "price_comp_spread": rnd(F.col("competitor_max_price") - F.col("competitor_min_price"), 2),
    })


def demand_features(df: DataFrame) -> DataFrame:
    """Lead-time bucket; high demand needs both occupancy and demand (strict)."""
    return df.withColumns({
        "lead_time_bucket": lead_time_bucket("lead_time_days"),
        "high_demand": ((F.col("occupancy_rate") > 0.80) & (F.col("demand_score") > 0.85)).cast("int"),
    })


def event_features(df: DataFrame) -> DataFrame:
    """``'None'`` is a category, not a missing value."""
    return df.withColumns({
        "has_event": (F.col("event_type") != "None").cast("int"),
        "event_premium_est": map_lookup("event_magnitude", EVENT_PREMIUM, 0.0),
    })


def temporal_features(df: DataFrame) -> DataFrame:
    """F8-F9."""
    ms, mc = cyclic("month", 12)
    ds, dc = cyclic("day_of_week", 7)
    return df.withColumns({"month_sin": ms, "month_cos": mc, "dow_sin": ds, "dow_cos": dc})


def revenue_features(df: DataFrame) -> DataFrame:
    """F10-F11."""
    return df.withColumns({
        "revenue_efficiency": rnd(F.col("revpar") / (F.col("actual_price") + 1e-9), 4),
        "total_stay_revenue": rnd(F.col("actual_price") * F.col("length_of_stay"), 2),
    })


def price_position(df: DataFrame) -> DataFrame:
    """F12-F13 (analysis only: they use the target)."""
    return df.withColumns({
        "price_vs_comp_avg": (F.col("actual_price") - F.col("competitor_avg_price")) / F.col("competitor_avg_price"),
        "price_vs_comp_min": (F.col("actual_price") - F.col("competitor_min_price")) / F.col("competitor_min_price"),
        "price_premium": F.col("actual_price") / F.col("base_price"),
        "price_per_person": rnd(F.col("actual_price") / 1.8, 2),
    })


FEATURE_STEPS = [calendar, competitor_features, demand_features, event_features,
                 temporal_features, revenue_features]


def engineer(df: DataFrame, with_analysis: bool = False) -> DataFrame:
    """all feature steps in order (one projection after Catalyst collapses them)."""
    out = df
    for step in FEATURE_STEPS:
        out = step(out)
    return price_position(out) if with_analysis else out


def engineer_report(df: DataFrame) -> DataFrame:
    """F19 report: the columns each step adds (schema only, no data read)."""
    rows = []
    cur = df
    for step in FEATURE_STEPS:
        nxt = step(cur)
        added = [c for c in nxt.columns if c not in cur.columns]
        rows.append((step.__name__, len(added), ",".join(added)))
        cur = nxt
    return df.sparkSession.createDataFrame(rows, "step string, n_added int, added string")


def label_maps(df: DataFrame, cols: Sequence[str] = ENCODED_COLS) -> DataFrame:
    """F14 mapping table: (column, value, code), codes alphabetical from 0.

    Distinct values come from a grouped aggregation. Their codes are their places
    among the column's sorted values, counted over range partitions
    (``prefix_sums``): no task holds a column's values.
    """
    cols = [c for c in cols if c in df.columns]
    vals = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                               for c in cols]))
    distinct = df.select(vals.alias("v")).select("v.*").filter(F.col("value").isNotNull()).distinct()
    return prefix_sums(distinct, ["column"], ["value"]).select("column", "value", F.col("_before").cast("int").alias("code"))


def label_encode(df: DataFrame, cols: Sequence[str] = ENCODED_COLS, maps: DataFrame | None = None) -> DataFrame:
    """``<col>_enc`` codes from the mapping table.

    Each column is joined to its mapping rows, written once; Spark's own size
    check decides whether a mapping is broadcast.
    """
    from ratewise.session import cut_lineage
    cols = [c for c in cols if c in df.columns]
    maps = cut_lineage(maps if maps is not None else label_maps(df, cols))
    out = df
    for c in cols:
        m = (maps.filter(F.col("column") == c)
             .select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"{c}_enc")))
        out = (out.join(m, F.col(c).cast("string") == F.col(f"__v_{c}"), "left")
               .drop(f"__v_{c}"))
    return out


def scaler_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std of every column (nulls as 0), one pass."""
    # Two passes with small aggregation buffers: means, then centred squares.
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    means = df.agg(F.count(F.lit(1)).alias("__n"), *[F.avg(x[c]).alias(c) for c in cols]).first()
    n = means["__n"]
    if not n:
        return {c: (None, None) for c in cols}
    sq = df.agg(*[F.sum((x[c] - F.lit(means[c])) * (x[c] - F.lit(means[c]))).alias(c) for c in cols]).first()
    return {c: (means[c], (sq[c] / n) ** 0.5) for c in cols}


def standardize(df: DataFrame, cols: Sequence[str], stats: dict | None = None) -> DataFrame:
    """``<col>_scaled = (x - mean) / std_pop``; nulls first 0; constant -> 0."""
    cols = [c for c in cols if c in df.columns]
    stats = stats or scaler_stats(df, cols)
    exprs = {}
    for c in cols:
        m, s = stats[c]
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        exprs[f"{c}_scaled"] = (x - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
    return df.withColumns(exprs)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """F16: feature vector of the present columns, nulls as 0."""
    from pyspark.ml.feature import VectorAssembler
    present = [c for c in cols if c in df.columns]
    filled = df.fillna(0, subset=present)
    return VectorAssembler(inputCols=present, outputCol=out).transform(filled)


def _dedupe_edges(edges) -> list[float]:
    out: list[float] = []
    for e in edges:
        if not out or e != out[-1]:
            out.append(e)
    return out


def qcut_edges(df: DataFrame, col: str, q: int) -> list[float]:
    """exact quantile edges at 0, 1/q, ..., 1, duplicates dropped."""
    return qcut_edges_many(df, [col], q)[col]


def qcut_edges_many(df: DataFrame, cols: Sequence[str], q: int) -> dict[str, list[float]]:
    """F18 for several columns in one aggregation pass."""
    probs = [i / q for i in range(q + 1)]
    got = column_quantiles(df, cols, probs)
    return {c: _dedupe_edges([e for e in got[c] if e is not None]) for c in cols}


def qcut(df: DataFrame, col: str, q: int, name: str | None = None,
         edges: Sequence[float] | None = None) -> DataFrame:
    """``pd.qcut(labels=False)``: right-closed bins, lowest edge included."""
    edges = list(edges) if edges is not None else qcut_edges(df, col, q)
    x = F.col(col)
    expr = None
    for i in range(1, len(edges)):
        cond = x <= F.lit(edges[i])
        if i == 1:
            cond = (x >= F.lit(edges[0])) & cond
        expr = F.when(cond, F.lit(i - 1)) if expr is None else expr.when(cond, F.lit(i - 1))
    if expr is None:
        expr = F.lit(None).cast("int")
    return df.withColumn(name or f"{col}_bin", expr.cast("int"))

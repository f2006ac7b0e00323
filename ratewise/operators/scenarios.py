"""Scenarios and ROI.

Scenario and strategy tables are a handful of fixed rows, so every scenario
is evaluated as its own aggregate expression over one pass of the bookings
(no cross join that would multiply the rows), and grids are generated with
``sequence`` + ``explode`` from the one-row KPI frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.columns import clip, fin

# --- fixed values --------------------------------------------------------
SCENARIOS = [("conservative (-10%)", 0.90), ("current", 1.00), ("optimised (+10%)", 1.10),
             ("peak (+25%)", 1.25), ("event (+40%)", 1.40)]
STRATEGIES = [("static (current)", 1.00, 0.00), ("conservative dynamic (+10%)", 1.10, -0.05),
              ("optimal dynamic (+18%)", 1.18, -0.02), ("aggressive dynamic (+30%)", 1.30, -0.12)]
SURFACE_OCC = (0.40, 1.00, 50)
SURFACE_PRICE = (50.0, 400.0, 50)
CURVE_OCC = [0.50, 0.70, 0.85, 0.95]
CURVE_PRICE = (50.0, 450.0, 100)
ROI_IMPLEMENTATION_COST = 15000
ROI_ANNUAL_LICENSE = 3000
ROI_LIFT_PCT = 0.18
# -------------------------------------------------------------------------


def current_kpis(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("actual_price").alias("avg_price"), F.avg("occupancy_rate").alias("avg_occ"))


def price_scenarios(df: DataFrame, scenarios: Sequence[tuple[str, float]] = SCENARIOS) -> DataFrame:
    """RevPAR of each price multiplier at the mean occupancy."""
    k = current_kpis(df)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("scenario"),
                                        F.lit(float(m)).alias("mult")) for i, (n, m) in enumerate(scenarios)]))
    s = k.select("*", rows.alias("s")).select("avg_price", "avg_occ", "s.*")
    return s.select("i", "scenario", "mult", fin(F.col("avg_price") * F.col("mult")).alias("price"),
                    fin(F.col("avg_price") * F.col("mult") * F.col("avg_occ")).alias("revpar")).orderBy("i")


def _linspace(lo: float, hi: float, n: int):
    """``np.linspace`` as an exploded array column: lo + i*(hi-lo)/(n-1)."""
    step = (hi - lo) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(lo) + i * F.lit(step))


def revenue_surface(df: DataFrame) -> DataFrame:
    """revenue = occupancy x price over a 50 x 50 grid, and each cell
    against the current average RevPAR."""
    k = current_kpis(df)
    g = (k.select("*", F.posexplode(_linspace(*SURFACE_OCC)).alias("i_occ", "occ"))
         .select("*", F.posexplode(_linspace(*SURFACE_PRICE)).alias("i_price", "price")))
    cur = F.col("avg_price") * F.col("avg_occ")
    return g.select("i_occ", "i_price", fin("occ").alias("occ"), fin("price").alias("price"),
                    fin(F.col("occ") * F.col("price")).alias("revenue"),
                    fin((F.col("occ") * F.col("price") / cur - 1) * 100).alias("vs_current_pct"))


def revpar_curves(df: DataFrame) -> DataFrame:
    """RevPAR for fixed occupancy levels over 100 price points, and the
    price at which each curve meets the current RevPAR."""
    k = current_kpis(df)
    g = (k.select("*", F.explode(F.array(*[F.lit(o) for o in CURVE_OCC])).alias("occ"))
         .select("*", F.posexplode(_linspace(*CURVE_PRICE)).alias("i_price", "price")))
    cur = F.col("avg_price") * F.col("avg_occ")
    return g.select(fin("occ").alias("occ"), "i_price", fin("price").alias("price"),
                    fin(F.col("price") * F.col("occ")).alias("revpar"),
                    fin(cur / F.col("occ")).alias("breakeven_price"))


def strategy_lift(df: DataFrame, strategies: Sequence[tuple[str, float, float]] = STRATEGIES) -> DataFrame:
    """Re-priced total revenue per strategy (occupancy shifted, clipped to
    [0, 1]) and the lift over the actual stay revenue; one pass, one sum each."""
    aggs = [F.sum("revenue_per_night").alias("base_revenue")]
    for i, (_, mult, eff) in enumerate(strategies):
        occ = clip(F.col("occupancy_rate") + F.lit(eff), 0.0, 1.0)
        aggs.append(F.sum(F.col("actual_price") * F.lit(mult) * occ * F.col("length_of_stay")).alias(f"s{i}"))
    row = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("strategy"),
                                        F.col(f"s{i}").alias("revenue")) for i, (n, _, _) in enumerate(strategies)]))
    out = row.select("base_revenue", rows.alias("r")).select("base_revenue", "r.*")
    return out.select("i", "strategy", fin(F.col("revenue") / 1000, 4).alias("revenue_k"),
                      fin((F.col("revenue") - F.col("base_revenue")) / F.col("base_revenue") * 100)
                      .alias("lift_pct")).orderBy("i")


def properties_from(df: DataFrame) -> DataFrame:
    """Properties table for N5: one row per hotel from the bookings."""
    return df.groupBy(F.col("hotel_name").alias("property")).agg(
        F.count_distinct("market_segment").cast("int").alias("num_rooms"),
        F.avg("occupancy_rate").alias("avg_occupancy"),
        F.avg("actual_price").alias("current_avg_rate"))


def roi(props: DataFrame, lift: float = ROI_LIFT_PCT, impl: float = ROI_IMPLEMENTATION_COST,
        license_: float = ROI_ANNUAL_LICENSE) -> DataFrame:
    """current/projected/incremental revenue, payback months (999 when
    there is no increment) and the 5-year return per dollar."""
    cur = F.col("num_rooms") * 365 * F.col("avg_occupancy") * F.col("current_avg_rate")
    new = cur * (1 + lift)
    inc = new - cur
    year1 = impl + license_
    cost5 = impl + license_ * 5
    net5 = inc * 5 - cost5
    payback = F.when(inc > 0, fin(F.lit(float(year1)) / inc * 12, 1)).otherwise(F.lit(999.0))
    return props.select("property", fin(cur, 0).alias("current_revenue"), fin(new, 0).alias("projected_revenue"),
                        fin(inc, 0).alias("incremental_revenue"), payback.alias("payback_months"),
                        fin(net5 / F.lit(float(cost5)), 2).alias("five_year_roi_ratio"))

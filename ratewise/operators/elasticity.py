"""Price elasticity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.columns import clip, fin
from ratewise.operators.features import qcut
from ratewise.operators.quantiles import exact_quantiles


def row_elasticity(df: DataFrame) -> DataFrame:
    """Price change vs base price (or mean price), demand change vs mean
    occupancy, ratio (null where the price change is 0), clipped to [-5, 5].

    The means are one broadcast row.
    """
    has_base = "base_price" in df.columns
    means = df.agg(F.avg("occupancy_rate").alias("_occ_mean"), F.avg("actual_price").alias("_price_mean"))
    ref = F.col("base_price") if has_base else F.col("_price_mean")
    out = df.crossJoin(F.broadcast(means)).withColumns({
        "price_change_pct": (F.col("actual_price") - ref) / ref * 100,
        "demand_change_pct": (F.col("occupancy_rate") - F.col("_occ_mean")) / F.col("_occ_mean") * 100,
    })
    ratio = F.when(F.col("price_change_pct") != 0, F.col("demand_change_pct") / F.col("price_change_pct"))
    return out.withColumn("elasticity", clip(ratio, -5, 5)).drop("_occ_mean", "_price_mean")


def elasticity_by(df: DataFrame, by: str, elastic_cut: float = -1.0) -> DataFrame:
    """Median elasticity per group and its class."""
    med = (df.select(by).distinct()
           .join(exact_quantiles(df, "elasticity", [0.5], [by]).withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left")
           .select(by, F.col("q")[0].alias("median_elasticity")))
    m = F.col("median_elasticity")
    cls = F.when(m < elastic_cut, "elastic").when(m < 0, "inelastic").otherwise("positive")
    return med.select(by, fin(m).alias("median_elasticity"), cls.alias("class")).orderBy("median_elasticity", by)


def arc_elasticity(df: DataFrame, q: int = 10) -> DataFrame:
    """E5: average price and occupancy per price decile, step-to-step percent
    changes and their ratio (the decile table has ``q`` rows)."""
    base = df.filter(F.col("actual_price").isNotNull() & F.col("occupancy_rate").isNotNull()
                     & (F.col("actual_price") > 0))
    binned = qcut(base, "actual_price", q, name="price_bin")
    agg = binned.groupBy("price_bin").agg(F.avg("actual_price").alias("avg_price"),
                                          F.avg("occupancy_rate").alias("avg_occ"))
    w = Window.orderBy("price_bin")
    p_prev, o_prev = F.lag("avg_price").over(w), F.lag("avg_occ").over(w)
    out = agg.select("price_bin", "avg_price", "avg_occ",
                     (F.col("avg_price") / p_prev - 1).alias("pct_change_price"),
                     (F.col("avg_occ") / o_prev - 1).alias("pct_change_occ"))
    out = out.withColumn("elasticity", F.when(F.col("pct_change_price") != 0,
                                              F.col("pct_change_occ") / F.col("pct_change_price")))
    return out.select("price_bin", *[fin(c).alias(c) for c in
                                     ("avg_price", "avg_occ", "pct_change_price", "pct_change_occ", "elasticity")])


def median_of(df: DataFrame, col: str, name: str) -> DataFrame:
    return exact_quantiles(df, col, [0.5]).select(fin(F.col("q")[0]).alias(name))


def elasticity_slope(df: DataFrame) -> DataFrame:
    """Fitted slope of demand change on price change (all rows)."""
    return df.agg(fin(F.regr_slope("demand_change_pct", "price_change_pct")).alias("slope"),
                  fin(F.regr_intercept("demand_change_pct", "price_change_pct")).alias("intercept"))

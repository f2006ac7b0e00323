"""Registered elasticity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions.columns import fin
from ratewise.operators import aggregates as A
from ratewise.operators import elasticity as E
from ratewise.plans.catalog import query
from ratewise.plans.oracle import R, with_bookings
from ratewise.plans.q_aggregates import sql_histogram
from ratewise.sources.bookings import KEY_COLS, bookings, written_bookings

ELAS_CTE = """elas AS (
  SELECT *, CASE WHEN pcp <> 0 THEN least(greatest(dcp / pcp, -5e0), 5e0) END AS elasticity
  FROM (SELECT bookings.*, (actual_price - base_price) / base_price * 100 AS pcp,
               (occupancy_rate - m.occ_mean) / m.occ_mean * 100 AS dcp
        FROM bookings, (SELECT avg(occupancy_rate) AS occ_mean FROM bookings) m) t)"""


def _elas(spark, d):
    return E.row_elasticity(bookings(spark, d))


def _elas_by(spark, d, by):
    """The elasticities over one narrow written table: groups, means and quantiles read it."""
    return E.row_elasticity(written_bookings(spark, d, by, "actual_price", "base_price", "occupancy_rate"))


@query("e01_row_elasticity", with_bookings(
    f"SELECT {', '.join(KEY_COLS)}, {R('pcp')} AS price_change_pct, {R('dcp')} AS demand_change_pct, "
    f"{R('elasticity')} AS elasticity FROM elas", ELAS_CTE))
def e01_row_elasticity(spark, d):
    return _elas(spark, d).select(*KEY_COLS, *[fin(c).alias(c) for c in
                                               ("price_change_pct", "demand_change_pct", "elasticity")])


def _sql_by(by, cut):
    return with_bookings(f"""
SELECT {by}, {R('m')} AS median_elasticity,
       CASE WHEN m < {cut}e0 THEN 'elastic' WHEN m < 0 THEN 'inelastic' ELSE 'positive' END AS class
FROM (SELECT {by}, quantile_cont(elasticity, 0.5) AS m FROM elas GROUP BY {by}) t""", ELAS_CTE)


@query("e02_elasticity_by_room_type", _sql_by("room_type", -1.0))
def e02_elasticity_by_room_type(spark, d):
    return E.elasticity_by(_elas_by(spark, d, "room_type"), "room_type", -1.0)


@query("e03_elasticity_by_month", _sql_by("month", -0.5))
def e03_elasticity_by_month(spark, d):
    return E.elasticity_by(_elas_by(spark, d, "month"), "month", -0.5)


@query("e04_elasticity_histogram", sql_histogram("elasticity", 80, source="elas", extra_ctes=(ELAS_CTE,)))
def e04_elasticity_histogram(spark, d):
    return A.histogram(_elas(spark, d), "elasticity", 80)


@query("e04_elasticity_median", with_bookings(
    f"SELECT {R('quantile_cont(elasticity, 0.5)')} AS median_elasticity FROM elas", ELAS_CTE))
def e04_elasticity_median(spark, d):
    return E.median_of(_elas(spark, d), "elasticity", "median_elasticity")


_DECILE_PROBS = ", ".join(repr(i / 10) for i in range(11))
_DECILE_CASE = " ".join(
    (f"WHEN actual_price >= e[1] AND actual_price <= e[2] THEN 0" if i == 1
     else f"WHEN actual_price <= e[{i + 1}] THEN {i - 1}") for i in range(1, 11))
ARC_CTES = (
    f"""de AS (SELECT quantile_cont(actual_price, [{_DECILE_PROBS}]) AS e FROM bookings
        WHERE actual_price IS NOT NULL AND occupancy_rate IS NOT NULL AND actual_price > 0)""",
    f"""arc AS (SELECT price_bin, avg_price, avg_occ,
          avg_price / lag(avg_price) OVER (ORDER BY price_bin) - 1 AS pcp,
          avg_occ / lag(avg_occ) OVER (ORDER BY price_bin) - 1 AS pco
        FROM (SELECT CAST(CASE {_DECILE_CASE} END AS INT) AS price_bin, avg(actual_price) AS avg_price,
                     avg(occupancy_rate) AS avg_occ
              FROM bookings, de WHERE actual_price IS NOT NULL AND occupancy_rate IS NOT NULL AND actual_price > 0
              GROUP BY 1) t)""",
)


@query("e05_arc_elasticity", with_bookings(f"""
SELECT price_bin, {R('avg_price')} AS avg_price, {R('avg_occ')} AS avg_occ, {R('pcp')} AS pct_change_price,
       {R('pco')} AS pct_change_occ, {R('CASE WHEN pcp <> 0 THEN pco / pcp END')} AS elasticity FROM arc""", *ARC_CTES))
def e05_arc_elasticity(spark, d):
    return E.arc_elasticity(bookings(spark, d), 10)


@query("e05_arc_elasticity_median", with_bookings(
    f"SELECT {R('quantile_cont(CASE WHEN pcp <> 0 THEN pco / pcp END, 0.5)')} AS median_elasticity FROM arc",
    *ARC_CTES))
def e05_arc_elasticity_median(spark, d):
    """E5 headline: median of the decile elasticities (the raw ratios)."""
    from ratewise.operators.features import qcut
    from pyspark.sql import Window
    base = bookings(spark, d).filter(F.col("actual_price") > 0)
    binned = qcut(base, "actual_price", 10, name="price_bin")
    agg = binned.groupBy("price_bin").agg(F.avg("actual_price").alias("p"), F.avg("occupancy_rate").alias("o"))
    w = Window.orderBy("price_bin")
    pcp = F.col("p") / F.lag("p").over(w) - 1
    pco = F.col("o") / F.lag("o").over(w) - 1
    ratios = agg.select(F.when(pcp != 0, pco / pcp).alias("e"))
    return ratios.agg(fin(F.percentile("e", 0.5)).alias("median_elasticity"))


@query("e06_elasticity_slope", with_bookings(f"""
SELECT {R('regr_slope(dcp, pcp)')} AS slope, {R('regr_intercept(dcp, pcp)')} AS intercept FROM elas""", ELAS_CTE))
def e06_elasticity_slope(spark, d):
    return E.elasticity_slope(_elas(spark, d))

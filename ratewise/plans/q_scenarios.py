"""Registered scenario and ROI queries."""

from __future__ import annotations

from ratewise.operators import scenarios as N
from ratewise.plans.catalog import query
from ratewise.plans.oracle import D, R, with_bookings
from ratewise.sources.bookings import bookings

KPI_CTE = "k AS (SELECT avg(actual_price) AS avg_price, avg(occupancy_rate) AS avg_occ FROM bookings)"


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else D(v) if isinstance(v, float)
                                     else str(v) for v in r) + ")" for r in rows)


@query("n01_price_scenarios", with_bookings(f"""
SELECT s.i, s.scenario, s.mult, {R('avg_price * s.mult')} AS price, {R('avg_price * s.mult * avg_occ')} AS revpar
FROM k, (VALUES {_values([(i, n, m) for i, (n, m) in enumerate(N.SCENARIOS)])}) s(i, scenario, mult)
ORDER BY s.i""", KPI_CTE))
def n01_price_scenarios(spark, d):
    return N.price_scenarios(bookings(spark, d))


def _lin(lo, hi, n, var):
    return f"{D(lo)} + {var} * {D((hi - lo) / (n - 1))}"


@query("n02_revenue_surface", with_bookings(f"""
SELECT CAST(a.range AS INT) AS i_occ, CAST(b.range AS INT) AS i_price,
       {R(_lin(*N.SURFACE_OCC, 'a.range'))} AS occ, {R(_lin(*N.SURFACE_PRICE, 'b.range'))} AS price,
       {R(f'({_lin(*N.SURFACE_OCC, "a.range")}) * ({_lin(*N.SURFACE_PRICE, "b.range")})')} AS revenue,
       {R(f'(({_lin(*N.SURFACE_OCC, "a.range")}) * ({_lin(*N.SURFACE_PRICE, "b.range")}) / (avg_price * avg_occ) - 1) * 100')}
         AS vs_current_pct
FROM k, range(0, {N.SURFACE_OCC[2]}) a, range(0, {N.SURFACE_PRICE[2]}) b""", KPI_CTE))
def n02_revenue_surface(spark, d):
    return N.revenue_surface(bookings(spark, d))


@query("n03_revpar_curves", with_bookings(f"""
SELECT {R('o.occ')} AS occ, CAST(b.range AS INT) AS i_price, {R(_lin(*N.CURVE_PRICE, 'b.range'))} AS price,
       {R(f'({_lin(*N.CURVE_PRICE, "b.range")}) * o.occ')} AS revpar, {R('avg_price * avg_occ / o.occ')} AS breakeven_price
FROM k, (VALUES {', '.join(f'({D(o)})' for o in N.CURVE_OCC)}) o(occ), range(0, {N.CURVE_PRICE[2]}) b""", KPI_CTE))
def n03_revpar_curves(spark, d):
    return N.revpar_curves(bookings(spark, d))


@query("n04_strategy_lift", with_bookings(f"""
SELECT s.i, s.strategy, {R('rev / 1000', 4)} AS revenue_k, {R('(rev - base_revenue) / base_revenue * 100')} AS lift_pct
FROM (VALUES {_values([(i, n, m, e) for i, (n, m, e) in enumerate(N.STRATEGIES)])}) s(i, strategy, mult, eff)
JOIN (SELECT s2.i, sum(actual_price * s2.mult *
             CASE WHEN occupancy_rate + s2.eff IS NOT NULL THEN least(greatest(occupancy_rate + s2.eff, 0e0), 1e0) END
             * length_of_stay) AS rev
      FROM bookings, (VALUES {_values([(i, m, e) for i, (_, m, e) in enumerate(N.STRATEGIES)])}) s2(i, mult, eff)
      GROUP BY s2.i) r USING (i),
     (SELECT sum(revenue_per_night) AS base_revenue FROM bookings) b
ORDER BY s.i"""))
def n04_strategy_lift(spark, d):
    return N.strategy_lift(bookings(spark, d))


@query("n05_roi_by_property", with_bookings(f"""
SELECT property, {R('cur', 0)} AS current_revenue, {R(f'cur * {D(1 + N.ROI_LIFT_PCT)}', 0)} AS projected_revenue,
       {R('inc', 0)} AS incremental_revenue,
       CASE WHEN inc > 0 THEN {R(f'{D(N.ROI_IMPLEMENTATION_COST + N.ROI_ANNUAL_LICENSE)} / inc * 12', 1)} ELSE 999e0 END
         AS payback_months,
       {R(f'(inc * 5 - {N.ROI_IMPLEMENTATION_COST + 5 * N.ROI_ANNUAL_LICENSE}) / {D(N.ROI_IMPLEMENTATION_COST + 5 * N.ROI_ANNUAL_LICENSE)}', 2)}
         AS five_year_roi_ratio
FROM (SELECT property, cur, cur * {D(1 + N.ROI_LIFT_PCT)} - cur AS inc FROM (
  SELECT hotel_name AS property, CAST(count(DISTINCT market_segment) AS INT) * 365 * avg(occupancy_rate) * avg(actual_price) AS cur
  FROM bookings GROUP BY hotel_name) a) t"""))
def n05_roi_by_property(spark, d):
    return N.roi(N.properties_from(bookings(spark, d)))

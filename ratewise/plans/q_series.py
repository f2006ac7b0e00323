"""Registered window / time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions.columns import fin
from ratewise.operators import series as S
from ratewise.plans.catalog import query
from ratewise.plans.oracle import R, with_bookings
from ratewise.session import cut_lineage
from ratewise.sources.bookings import bookings

DAILY = "daily AS (SELECT checkin_date AS ds, avg(revenue_per_night) AS y FROM bookings GROUP BY checkin_date)"
MONTHLY = """monthly AS (SELECT CAST(row_number() OVER (ORDER BY year, month) - 1 AS INT) AS t, year, month,
  sum(revenue_per_night) AS revenue FROM bookings GROUP BY year, month)"""


@query("w01_daily_series", with_bookings(f"SELECT ds, {R('y')} AS y FROM daily", DAILY))
def w01_daily_series(spark, d):
    s = S.daily_series(bookings(spark, d))
    return s.select("ds", fin("y").alias("y"))


@query("w02_rolling_stats", with_bookings(f"""
SELECT ds, CAST(datediff('day', min(ds) OVER (), ds) AS INT) AS t_days, {R('y', 4)} AS y,
       {R('roll7', 4)} AS roll7, {R('roll30', 4)} AS roll30, {R('std30', 4)} AS std30,
       {R('roll30 - 1.5e0 * std30', 4)} AS band_lo, {R('roll30 + 1.5e0 * std30', 4)} AS band_hi
FROM (SELECT ds, y, avg(y) OVER w7 AS roll7, avg(y) OVER w30 AS roll30,
             coalesce(stddev_samp(y) OVER w30, 0e0) AS std30 FROM daily
      WINDOW w7 AS (ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
             w30 AS (ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) t""", DAILY))
def w02_rolling_stats(spark, d):
    return S.rolling_stats(S.daily_series(bookings(spark, d)), digits=4)


# The cubic in an orthogonal basis of the days (1, u1, u2, u3), then as powers of the scaled day.
CUBIC = (
    "cub0 AS (SELECT ds, datediff('day', min(ds) OVER (), ds) AS t_days, y FROM daily)",
    "cub1 AS (SELECT *, t_days / CAST(max(t_days) OVER () AS DOUBLE) AS t, max(t_days) OVER () AS span, avg(y) OVER () AS c0 FROM cub0)",
    "cub2 AS (SELECT *, avg(t) OVER () AS a10, t - avg(t) OVER () AS u1, avg(t * t) OVER () AS a20, avg(t * t * t) OVER () AS a30 FROM cub1)",
    "cub3 AS (SELECT *, sum(t * t * u1) OVER () / sum(u1 * u1) OVER () AS a21, sum(t * t * t * u1) OVER () / sum(u1 * u1) OVER () AS a31 FROM cub2)",
    "cub4 AS (SELECT *, t * t - a20 - a21 * u1 AS u2 FROM cub3)",
    "cub5 AS (SELECT *, sum(t * t * t * u2) OVER () / sum(u2 * u2) OVER () AS a32 FROM cub4)",
    "cub6 AS (SELECT *, t * t * t - a30 - a31 * u1 - a32 * u2 AS u3 FROM cub5)",
    """cub7 AS (SELECT min(ds) AS d0, max(ds) AS d1, any_value(span) AS span, any_value(c0) AS c0, any_value(a10) AS a10, any_value(a20) AS a20,
         any_value(a30) AS a30, any_value(a21) AS a21, any_value(a31) AS a31, any_value(a32) AS a32, sum(y * u1) / sum(u1 * u1) AS c1,
         sum(y * u2) / sum(u2 * u2) AS c2, sum(y * u3) / sum(u3 * u3) AS c3 FROM cub6)""",
    """cubic AS (SELECT d0, d1, CAST(span AS DOUBLE) AS span,
         c0 - c1 * a10 + c2 * (a21 * a10 - a20) + c3 * (a31 * a10 - a30 - a32 * (a21 * a10 - a20)) AS k0,
         c1 - c2 * a21 + c3 * (a32 * a21 - a31) AS k1, c2 - c3 * a32 AS k2, c3 AS k3 FROM cub7)""")


@query("w05_poly_trend", with_bookings(f"""
SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS power, unnest([{R('k0', 4)}, {R('k1', 4)}, {R('k2', 4)}, {R('k3', 4)}]) AS coef, span AS t_scale
FROM cubic""", DAILY, *CUBIC))
def w05_poly_trend(spark, d):
    """Cubic trend coefficients of the daily series (normal equations)."""
    s = cut_lineage(S.rolling_stats(S.daily_series(bookings(spark, d))).select("ds", "t_days", "y"))   # a row a day
    model, t_max = S.poly_fit(s, 3)
    coef = [float(model.intercept)] + [float(x) for x in model.coefficients]
    out = spark.createDataFrame([(i, c, t_max) for i, c in enumerate(coef)], "power int, coef double, t_scale double")
    return out.withColumn("coef", fin("coef", 4))


@query("w06_forecast_30d", with_bookings(f"""
SELECT ds, {R('k0 + t * (k1 + t * (k2 + t * k3))', 4)} AS forecast
FROM (SELECT CAST(d1 + CAST(i AS INT) AS DATE) AS ds, datediff('day', d0, d1 + CAST(i AS INT)) / span AS t, k0, k1, k2, k3
      FROM cubic, range(1, 31) r(i)) x""", DAILY, *CUBIC))
def w06_forecast_30d(spark, d):
    s = cut_lineage(S.rolling_stats(S.daily_series(bookings(spark, d))).select("ds", "t_days", "y"))   # a row a day
    model, t_max = S.poly_fit(s, 3)
    return S.forecast(s, model, t_max, 30).withColumn("forecast", fin("forecast", 4))


@query("w07_trend_seasonal", with_bookings(f"""
SELECT t, {R('revenue')} AS revenue, {R('trend')} AS trend, {R('revenue - trend')} AS seasonal
FROM (SELECT t, revenue, intercept + slope * t AS trend FROM monthly,
      (SELECT regr_slope(revenue, t) AS slope, regr_intercept(revenue, t) AS intercept FROM monthly) f) x""",
    MONTHLY))
def w07_trend_seasonal(spark, d):
    return S.trend_seasonal(_monthly_raw(spark, d))


def _monthly_raw(spark, d):
    from pyspark.sql import Window
    m = bookings(spark, d).groupBy("year", "month").agg(F.sum("revenue_per_night").alias("revenue"))
    return m.select((F.row_number().over(Window.orderBy("year", "month")) - 1).alias("t"), "year", "month", "revenue")


@query("w08_pct_change", with_bookings(f"""
SELECT t, {R('CASE WHEN lag(revenue) OVER (ORDER BY t) <> 0 THEN revenue / lag(revenue) OVER (ORDER BY t) - 1 END')}
  AS pct_change FROM monthly""", MONTHLY))
def w08_pct_change(spark, d):
    m = _monthly_raw(spark, d)
    return m.select("t", fin(S.pct_change("revenue", "t")).alias("pct_change"))


@query("w09_lead_price_curve", with_bookings(f"""
SELECT channel, lead_time_days, {R('avg_price')} AS avg_price,
       {R('avg(avg_price) OVER (PARTITION BY channel ORDER BY lead_time_days ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')}
         AS rolling_price
FROM (SELECT channel, lead_time_days, avg(actual_price) AS avg_price FROM bookings
      WHERE lead_time_days <= 120 GROUP BY channel, lead_time_days) t"""))
def w09_lead_price_curve(spark, d):
    return S.lead_price_curve(bookings(spark, d))


@query("w10_cum_share", with_bookings(f"""
SELECT room_type, {R('revenue', 4)} AS revenue,
       {R('sum(revenue) OVER (ORDER BY revenue DESC, room_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 4)} AS cum_value,
       {R('sum(revenue) OVER (ORDER BY revenue DESC, room_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(revenue) OVER () * 100')} AS cum_share_pct
FROM (SELECT room_type, sum(revenue_per_night) AS revenue FROM bookings GROUP BY room_type) t"""))
def w10_cum_share(spark, d):
    sums = bookings(spark, d).groupBy("room_type").agg(F.sum("revenue_per_night").alias("revenue"))
    return S.cum_share(sums, "room_type", "revenue")


@query("w11_competitor_drop_alerts", with_bookings(f"""
SELECT room_type, checkin_date, {R('comp')} AS comp, {R('prev_comp')} AS prev_comp,
       {R('(prev_comp - comp) / prev_comp * 100')} AS drop_pct
FROM (SELECT room_type, checkin_date, comp, lag(comp) OVER (PARTITION BY room_type ORDER BY checkin_date) AS prev_comp
      FROM (SELECT room_type, checkin_date, avg(competitor_avg_price) AS comp FROM bookings
            GROUP BY room_type, checkin_date) a) t
WHERE prev_comp IS NOT NULL AND (prev_comp - comp) / prev_comp > 0.05e0"""))
def w11_competitor_drop_alerts(spark, d):
    return S.competitor_drop_alerts(bookings(spark, d), 0.05)

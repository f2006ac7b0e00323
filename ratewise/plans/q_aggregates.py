"""Registered grouped-aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions.columns import DAY_ABBR, LEAD_BUCKET_ORDER, MONTH_ABBR, PPF_FAR, PPF_MIDDLE, PPF_NEAR
from ratewise.operators import aggregates as A
from ratewise.plans.catalog import query
from ratewise.plans.oracle import R, with_bookings
from ratewise.session import cut_lineage
from ratewise.sources.bookings import bookings

CORR_COLS = ["actual_price", "base_price", "competitor_avg_price", "occupancy_rate",
             "demand_score", "lead_time_days", "length_of_stay", "event_magnitude",
             "reviews_score"]
TARGET_CORR_COLS = ["base_price", "competitor_avg_price", "competitor_min_price",
                    "competitor_max_price", "occupancy_rate", "demand_score",
                    "lead_time_days", "length_of_stay", "event_magnitude",
                    "weather_score", "reviews_score", "repeat_guest", "month",
                    "day_of_week", "is_weekend"]
MOMENT_COLS = ["actual_price", "base_price", "competitor_avg_price", "revenue_per_night"]


def sql_price_by(by: str, y: str = "actual_price", name: str = "avg_price",
                 where: str = "", desc: bool = False) -> str:
    return with_bookings(f"""
SELECT {by}, {R(f'avg({y})')} AS {name} FROM bookings {where}
GROUP BY {by} ORDER BY {name} {'DESC' if desc else 'ASC'}, {by}""")


def sql_pivot_mean(row: str, col: str, values, labels, y: str, fill: bool = True) -> str:
    cells = []
    for v, lab in zip(values, labels):
        lit = f"'{v}'" if isinstance(v, str) else str(v)
        e = f"avg(CASE WHEN {col} = {lit} THEN {y} END)"
        if fill:
            e = f"coalesce({e}, 0e0)"
        cells.append(f"{R(e)} AS {lab}")
    return with_bookings(f"SELECT {row}, {', '.join(cells)} FROM bookings GROUP BY {row} ORDER BY {row}")


def sql_histogram(x: str, bins: int, by: str | None = None, density: bool = False,
                  source: str = "bookings", extra_ctes: tuple = ()) -> str:
    k = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    join_rng = f"JOIN h_rng USING ({by})" if by else "CROSS JOIN h_rng"
    dens = (f", {R('coalesce(h_cnt.count, 0) / (n_group * width)')} AS density"
            if density else "")
    return with_bookings(f"""
SELECT {k}s.bin, {R('lo + s.bin * width')} AS bin_lo, {R('lo + (s.bin + 1) * width')} AS bin_hi,
       coalesce(h_cnt.count, 0) AS count{dens}
FROM (SELECT {k}lo, width, n_group, CAST(r.range AS INT) AS bin
      FROM h_rng CROSS JOIN range(0, {bins}) r) s
LEFT JOIN h_cnt USING ({k}bin)
ORDER BY {k}s.bin""",
        *extra_ctes,
        f"h_src AS (SELECT {k}{x} AS value FROM {source} WHERE {x} IS NOT NULL)",
        f"""h_rng AS (SELECT {k}min(value) AS lo, max(value) AS hi, count(*) AS n_group,
                 (max(value) - min(value)) / {bins} AS width FROM h_src {gb})""",
        f"""h_cnt AS (SELECT {k}CAST(CASE WHEN width > 0 THEN least(floor((value - lo) / width), {bins - 1})
                              ELSE 0 END AS INT) AS bin, count(*) AS count
             FROM h_src {join_rng} GROUP BY ALL)""")


def _b(spark, d):
    return bookings(spark, d)


@query("g01_kpis", with_bookings(f"""
SELECT {R('avg(actual_price)')} AS avg_price, {R('avg(occupancy_rate) * 100')} AS avg_occupancy_pct,
       {R('avg(lead_time_days)')} AS avg_lead_time FROM bookings"""))
def g01_kpis(spark, d):
    return A.kpis(_b(spark, d))


@query("g02_revenue_by_month", with_bookings(f"""
SELECT month, {R('sum(revenue_per_night)', 4)} AS total_revenue,
       ['{"','".join(MONTH_ABBR)}'][month] AS month_name
FROM bookings GROUP BY month ORDER BY month"""))
def g02_revenue_by_month(spark, d):
    return A.revenue_by_month(_b(spark, d))


@query("g03_price_by_room_type", sql_price_by("room_type"))
def g03_price_by_room_type(spark, d):
    return A.price_by(_b(spark, d), "room_type")


@query("g04_occ_heatmap", sql_pivot_mean("month", "day_of_week", range(7), DAY_ABBR, "occupancy_rate"))
def g04_occ_heatmap(spark, d):
    return A.occ_heatmap(_b(spark, d))


@query("g05_price_by_channel", sql_price_by("channel", desc=True))
def g05_price_by_channel(spark, d):
    return A.price_by(_b(spark, d), "channel", descending=True)


@query("g06_monthly_summary", with_bookings(f"""
SELECT month, {R('avg(actual_price)')} AS avg_price,
       {R('sum(revenue_per_night)', 4)} AS total_revenue,
       {R('avg(occupancy_rate)')} AS avg_occupancy
FROM bookings GROUP BY month ORDER BY month"""))
def g06_monthly_summary(spark, d):
    return A.monthly_summary(_b(spark, d))


@query("g07_price_by_event_flag", with_bookings(f"""
SELECT has_event, {R('avg(actual_price)')} AS avg_price,
       CASE has_event WHEN 0 THEN 'no event' ELSE 'event day' END AS label
FROM (SELECT CAST(event_type <> 'None' AS INT) AS has_event, actual_price FROM bookings) t
GROUP BY has_event ORDER BY has_event"""))
def g07_price_by_event_flag(spark, d):
    return A.price_by_event_flag(_b(spark, d))


def _sql_corr_matrix(cols):
    n = len(cols)
    aggs = ", ".join(f"corr({cols[i]}, {cols[j]}) AS c{i}_{j}" for i in range(n) for j in range(i + 1))
    cells = " UNION ALL ".join(
        f"SELECT '{cols[i]}' AS col_a, '{cols[j]}' AS col_b, {R(f'c{max(i, j)}_{min(i, j)}')} AS corr, "
        f"{int(j < i)} AS lower FROM cm"
        for i in range(n) for j in range(n))
    return with_bookings(cells, f"cm AS (SELECT {aggs} FROM bookings)")


@query("g08_corr_matrix", _sql_corr_matrix(CORR_COLS))
def g08_corr_matrix(spark, d):
    return A.corr_matrix(_b(spark, d), CORR_COLS)


@query("g09_corr_with_target", with_bookings(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'corr({c}, actual_price)')} AS corr FROM bookings"
                       for c in TARGET_CORR_COLS)))
def g09_corr_with_target(spark, d):
    return A.corr_with(_b(spark, d), TARGET_CORR_COLS)


@query("g10_price_histogram", sql_histogram("actual_price", 50))
def g10_price_histogram(spark, d):
    return A.histogram(_b(spark, d), "actual_price", 50)


@query("g11_price_density_by_event", sql_histogram(
    "actual_price", 40, by="has_event", density=True, source="hb",
    extra_ctes=("hb AS (SELECT CAST(event_type <> 'None' AS INT) AS has_event, actual_price FROM bookings)",)))
def g11_price_density_by_event(spark, d):
    b = _b(spark, d).withColumn("has_event", (F.col("event_type") != "None").cast("int"))
    return A.histogram(b, "actual_price", 40, by="has_event", density=True)


@query("g12_price_histogram_by_hotel", sql_histogram("actual_price", 50, by="hotel_name"))
def g12_price_histogram_by_hotel(spark, d):
    return A.histogram(_b(spark, d), "actual_price", 50, by="hotel_name")


def _sql_box(by, y="actual_price"):
    return with_bookings(f"""
SELECT {by}, {R('any_value(q1)')} AS q1, {R('any_value(median)')} AS median, {R('any_value(q3)')} AS q3,
       {R(f'min(CASE WHEN {y} >= lo_fence AND {y} <= hi_fence THEN {y} END)')} AS whisker_lo,
       {R(f'max(CASE WHEN {y} >= lo_fence AND {y} <= hi_fence THEN {y} END)')} AS whisker_hi,
       CAST(sum(CASE WHEN {y} IS NOT NULL AND NOT ({y} >= lo_fence AND {y} <= hi_fence) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
       count({y}) AS n
FROM bookings JOIN bq USING ({by}) GROUP BY {by} ORDER BY {by}""",
        f"""bq AS (SELECT {by}, q1, median, q3, q1 - 1.5e0 * (q3 - q1) AS lo_fence, q3 + 1.5e0 * (q3 - q1) AS hi_fence
        FROM (SELECT {by}, quantile_cont({y}, 0.25) AS q1, quantile_cont({y}, 0.5) AS median,
                     quantile_cont({y}, 0.75) AS q3 FROM bookings GROUP BY {by}) t)""")


@query("g13_box_by_season", _sql_box("season"))
def g13_box_by_season(spark, d):
    return A.box_stats(_b(spark, d), "season")


@query("g13_box_by_room_type", _sql_box("room_type"))
def g13_box_by_room_type(spark, d):
    return A.box_stats(_b(spark, d), "room_type")


@query("g14_moments", with_bookings(" UNION ALL ".join(
    f"SELECT '{c}' AS column, {R(f'avg({c})')} AS mean, {R(f'quantile_cont({c}, 0.5)')} AS median, "
    f"{R(f'skewness({c})')} AS skew FROM bookings" for c in MOMENT_COLS)))
def g14_moments(spark, d):
    return A.moments(_b(spark, d), MOMENT_COLS)


@query("g15_price_by_month", with_bookings(f"""
SELECT month, {R('avg_price')} AS avg_price, {R('std_price')} AS std_price,
       {R('avg_price - std_price')} AS band_lo, {R('avg_price + std_price')} AS band_hi,
       CAST(avg_price = max(avg_price) OVER () AS INT) AS is_peak
FROM (SELECT month, avg(actual_price) AS avg_price, stddev_samp(actual_price) AS std_price
      FROM bookings GROUP BY month) t ORDER BY month"""))
def g15_price_by_month(spark, d):
    return A.price_by_month(_b(spark, d))


@query("g16_price_by_weekday", sql_price_by("day_of_week"))
def g16_price_by_weekday(spark, d):
    return A.price_by(_b(spark, d), "day_of_week")


@query("g17_price_by_season", sql_price_by("season"))
def g17_price_by_season(spark, d):
    return A.price_by(_b(spark, d), "season")


@query("g18_price_yoy", with_bookings(f"""
SELECT year, month, {R('avg(actual_price)')} AS avg_price FROM bookings GROUP BY year, month ORDER BY year, month"""))
def g18_price_yoy(spark, d):
    return A.price_yoy(_b(spark, d))


@query("g19_price_by_event_type", sql_price_by("event_type"))
def g19_price_by_event_type(spark, d):
    return A.price_by(_b(spark, d), "event_type")


@query("g20_price_by_magnitude", sql_price_by("event_magnitude", where="WHERE event_magnitude > 0"))
def g20_price_by_magnitude(spark, d):
    return A.price_by_magnitude(_b(spark, d))


@query("g21_event_count_by_month", with_bookings("""
SELECT month, count(*) AS n_event_bookings FROM bookings WHERE event_type <> 'None' GROUP BY month ORDER BY month"""))
def g21_event_count_by_month(spark, d):
    return A.event_count_by_month(_b(spark, d))


@query("g22_price_level_comparison", with_bookings(" UNION ALL ".join(
    f"SELECT '{c}' AS price_kind, {R(f'avg({c})')} AS avg_price FROM bookings" for c in A.PRICE_LEVEL_COLS)))
def g22_price_level_comparison(spark, d):
    return A.price_level_comparison(_b(spark, d))


@query("g23_position_histogram", sql_histogram(
    "(actual_price - competitor_avg_price) / competitor_avg_price * 100", 60))
def g23_position_histogram(spark, d):
    pos = (F.col("actual_price") - F.col("competitor_avg_price")) / F.col("competitor_avg_price") * 100
    return A.histogram(_b(spark, d), pos, 60)


@query("g23_position_mean", with_bookings(f"""
SELECT {R('avg((actual_price - competitor_avg_price) / competitor_avg_price * 100)')} AS mean_position_pct
FROM bookings"""))
def g23_position_mean(spark, d):
    from ratewise.functions.columns import fin
    pos = (F.col("actual_price") - F.col("competitor_avg_price")) / F.col("competitor_avg_price") * 100
    return _b(spark, d).agg(fin(F.avg(pos)).alias("mean_position_pct"))


@query("g25_price_by_occ_band", with_bookings(f"""
SELECT occ_band, {R('avg(actual_price)')} AS avg_price, count(*) AS n FROM (
  SELECT actual_price, CASE WHEN occupancy_rate > 0 AND occupancy_rate <= 0.5e0 THEN '<50%'
    WHEN occupancy_rate > 0.5e0 AND occupancy_rate <= 0.65e0 THEN '50–65%'
    WHEN occupancy_rate > 0.65e0 AND occupancy_rate <= 0.75e0 THEN '65–75%'
    WHEN occupancy_rate > 0.75e0 AND occupancy_rate <= 0.85e0 THEN '75–85%'
    WHEN occupancy_rate > 0.85e0 AND occupancy_rate <= 0.95e0 THEN '85–95%'
    WHEN occupancy_rate > 0.95e0 AND occupancy_rate <= 1.01e0 THEN '>95%' END AS occ_band
  FROM bookings) t WHERE occ_band IS NOT NULL GROUP BY occ_band"""))
def g25_price_by_occ_band(spark, d):
    return A.price_by_occ_band(_b(spark, d))


@query("g26_ols_occupancy_price", with_bookings(f"""
SELECT {R('regr_slope(actual_price, occupancy_rate)')} AS slope,
       {R('regr_intercept(actual_price, occupancy_rate)')} AS intercept,
       {R('regr_r2(actual_price, occupancy_rate)')} AS r2,
       CAST(regr_count(actual_price, occupancy_rate) AS BIGINT) AS n FROM bookings"""))
def g26_ols_occupancy_price(spark, d):
    return A.ols_line(_b(spark, d), "occupancy_rate", "actual_price")


@query("g27_revenue_by_ym", with_bookings(f"""
SELECT CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym,
       {R('avg(revenue_per_night)')} AS avg_revenue FROM bookings GROUP BY ym ORDER BY ym"""))
def g27_revenue_by_ym(spark, d):
    return A.revenue_by_ym(_b(spark, d))


@query("g28_revenue_by_channel", with_bookings(f"""
SELECT channel, {R('avg(revenue_per_night)')} AS avg_revenue,
       {R('sum(revenue_per_night) / 1e6')} AS total_revenue_m
FROM bookings GROUP BY channel ORDER BY total_revenue_m DESC"""))
def g28_revenue_by_channel(spark, d):
    return A.revenue_by_channel(_b(spark, d))


@query("g29_revenue_pivot", sql_pivot_mean("room_type", "season", A.SEASONS, A.SEASONS,
                                           "revenue_per_night", fill=False))
def g29_revenue_pivot(spark, d):
    return A.revenue_pivot(_b(spark, d))


@query("g30_revpar_by_hotel", with_bookings(f"""
SELECT hotel_name, {R('avg(revpar)')} AS avg_revpar, {R('sum(revenue_per_night)', 4)} AS total_revenue
FROM bookings GROUP BY hotel_name ORDER BY hotel_name"""))
def g30_revpar_by_hotel(spark, d):
    return A.revpar_by_hotel(_b(spark, d))


_LEAD_SQL = ("CASE WHEN lead_time_days <= 3 THEN 'Last_Minute' WHEN lead_time_days <= 14 THEN 'Short_Term' "
             "WHEN lead_time_days <= 60 THEN 'Medium_Term' ELSE 'Long_Term' END")


@query("g31_price_by_lead_bucket", with_bookings(f"""
SELECT dim.bucket_order, dim.lead_time_bucket, {R('coalesce(a.avg_price, 0e0)')} AS avg_price
FROM (VALUES {', '.join(f"({i}, '{b}')" for i, b in enumerate(LEAD_BUCKET_ORDER))}) dim(bucket_order, lead_time_bucket)
LEFT JOIN (SELECT {_LEAD_SQL} AS lead_time_bucket, avg(actual_price) AS avg_price FROM bookings GROUP BY 1) a
  USING (lead_time_bucket)
ORDER BY dim.bucket_order"""))
def g31_price_by_lead_bucket(spark, d):
    return A.price_by_lead_bucket(_b(spark, d))


@query("g32_price_by_guest_type", sql_price_by("guest_type", desc=True))
def g32_price_by_guest_type(spark, d):
    return A.price_by(_b(spark, d), "guest_type", descending=True)


@query("g33_share_by_room_type", with_bookings(f"""
SELECT room_type, n, {R('n / (sum(n) OVER ()) * 100')} AS share_pct
FROM (SELECT room_type, count(*) AS n FROM bookings GROUP BY room_type) t ORDER BY n DESC, room_type"""))
def g33_share_by_room_type(spark, d):
    return A.share_by(_b(spark, d), "room_type")


@query("g34_occ_weekend_pivot", sql_pivot_mean("room_type", "is_weekend", [0, 1], ["weekday", "weekend"],
                                               "occupancy_rate", fill=False))
def g34_occ_weekend_pivot(spark, d):
    return A.occ_weekend_pivot(_b(spark, d))


@query("g35_revenue_by_year", with_bookings(f"""
SELECT year, {R('sum(revenue_per_night)', 4)} AS total_revenue FROM bookings GROUP BY year ORDER BY year"""))
def g35_revenue_by_year(spark, d):
    return A.sum_by(_b(spark, d), "year")


@query("g36_revenue_share", with_bookings(f"""
SELECT room_type, {R('revenue', 4)} AS revenue, {R('revenue / (sum(revenue) OVER ()) * 100')} AS share_pct
FROM (SELECT room_type, sum(revenue_per_night) AS revenue FROM bookings GROUP BY room_type) t
ORDER BY revenue DESC, room_type"""))
def g36_revenue_share(spark, d):
    return A.revenue_share(_b(spark, d))


@query("g37_revenue_year_month", sql_pivot_mean("year", "month", range(1, 13), A.MONTH_COLS,
                                                "revenue_per_night"))
def g37_revenue_year_month(spark, d):
    return A.year_month_matrix(_b(spark, d), "revenue_per_night")


@query("g37_occupancy_year_month", sql_pivot_mean("year", "month", range(1, 13), A.MONTH_COLS,
                                                  "occupancy_rate"))
def g37_occupancy_year_month(spark, d):
    return A.year_month_matrix(_b(spark, d), "occupancy_rate")


@query("g38_revenue_by_guest", with_bookings(f"""
SELECT guest_type, {R('sum(revenue_per_night)', 4)} AS total_revenue FROM bookings GROUP BY guest_type ORDER BY guest_type"""))
def g38_revenue_by_guest(spark, d):
    return A.sum_by(_b(spark, d), "guest_type")


@query("g39_cancel_rate", with_bookings(f"""
SELECT channel, {R('avg(cancellation) * 100')} AS cancel_rate_pct FROM bookings GROUP BY channel ORDER BY channel"""))
def g39_cancel_rate(spark, d):
    return A.cancel_rate(_b(spark, d))


@query("g40_premium_histogram", sql_histogram("actual_price / base_price", 50))
def g40_premium_histogram(spark, d):
    return A.histogram(_b(spark, d), F.col("actual_price") / F.col("base_price"), 50)


@query("g40_premium_mean", with_bookings(f"""
SELECT {R('avg(actual_price / base_price)')} AS mean_premium FROM bookings"""))
def g40_premium_mean(spark, d):
    from ratewise.functions.columns import fin
    return _b(spark, d).agg(fin(F.avg(F.col("actual_price") / F.col("base_price"))).alias("mean_premium"))


@query("g41_monthly_series", with_bookings(f"""
SELECT CAST(row_number() OVER (ORDER BY year, month) - 1 AS INT) AS t, year, month,
       {R('revenue', 4)} AS revenue, bookings, {R('avg_price')} AS avg_price
FROM (SELECT year, month, sum(revenue_per_night) AS revenue, count(*) AS bookings,
             avg(actual_price) AS avg_price FROM bookings GROUP BY year, month) t"""))
def g41_monthly_series(spark, d):
    return A.monthly_series(_b(spark, d))


_FLAG_SQL = {
    "weekend": "is_weekend = 1",
    "event_day": "event_type <> 'None'",
    "last_minute": "lead_time_days <= 3",
    "jul_aug": "month IN (7, 8)",
}


@query("g45_premium_pct", with_bookings(" UNION ALL ".join(
    f"""SELECT '{n}' AS flag, {R(f'avg(CASE WHEN {c} THEN actual_price END)')} AS avg_in,
       {R(f'avg(CASE WHEN NOT ({c}) THEN actual_price END)')} AS avg_out,
       {R(f'(avg(CASE WHEN {c} THEN actual_price END) / avg(CASE WHEN NOT ({c}) THEN actual_price END) - 1) * 100')} AS premium_pct
FROM bookings""" for n, c in _FLAG_SQL.items())))
def g45_premium_pct(spark, d):
    return A.premium_pct(_b(spark, d))


# --- G24 / G44 point sets, G42 Q-Q points, G43 kernel density -------------
def _sql_hash_order(keys, seed):
    from ratewise.plans.q_clean import _sql_hash
    return _sql_hash(keys, seed)


_PKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("g24_competitor_points", with_bookings(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {R('competitor_max_price - competitor_min_price')} AS comp_spread,
       {R('actual_price / base_price')} AS price_premium, actual_price, competitor_avg_price FROM bookings
ORDER BY {_sql_hash_order(_PKEYS, 42)}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 2000"""))
def g24_competitor_points(spark, d):
    from ratewise.functions.columns import fin
    from ratewise.operators.clean import sample_n
    s = sample_n(_b(spark, d), 2000, 42, _PKEYS)
    return s.select(*_PKEYS, fin(F.col("competitor_max_price") - F.col("competitor_min_price")).alias("comp_spread"),
                    fin(F.col("actual_price") / F.col("base_price")).alias("price_premium"),
                    "actual_price", "competitor_avg_price")


@query("g44_points", with_bookings(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, occupancy_rate, demand_score, event_magnitude, actual_price
FROM bookings ORDER BY {_sql_hash_order(_PKEYS, 99)}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 3000"""))
def g44_points(spark, d):
    from ratewise.operators.clean import sample_n
    s = sample_n(_b(spark, d), 3000, 99, _PKEYS)
    return s.select(*_PKEYS, "occupancy_rate", "demand_score", "event_magnitude", "actual_price")


def _sql_ratio(r, parts):
    def poly(coefs):
        out, *rest = [repr(a) if "e" in repr(a) else f"{a!r}e0" for a in reversed(coefs)]
        for a in rest:
            out = f"({out} * {r} + {a})"
        return out
    return f"({poly(parts[0])} / {poly(parts[1])})"


def _sql_qq(col):
    """(select, CTEs): all order statistics of ``col`` and their normal quantiles ``z``."""
    middle, near, far = _sql_ratio("r0", PPF_MIDDLE), _sql_ratio("(r1 - 1.6e0)", PPF_NEAR), _sql_ratio("(r1 - 5e0)", PPF_FAR)
    return (f"SELECT i - 1 AS i, {R('p')} AS p, {R('z')} AS theoretical, {R('sample')} AS sample FROM qqz",
            f"""qq0 AS (SELECT CAST({col} AS DOUBLE) AS sample, row_number() OVER (ORDER BY {col}) AS i, count(*) OVER () AS n
                FROM bookings WHERE {col} IS NOT NULL)""",
            """qq1 AS (SELECT *, CASE WHEN i = n THEN pow(5e-1, 1e0 / n) WHEN i = 1 THEN 1 - pow(5e-1, 1e0 / n)
                ELSE (i - 3175e-4) / (n + 365e-3) END AS p FROM qq0)""",
            "qq2 AS (SELECT *, 180625e-6 - (p - 5e-1) * (p - 5e-1) AS r0, sqrt(-ln(least(p, 1 - p))) AS r1 FROM qq1)",
            f"""qqz AS (SELECT *, CASE WHEN abs(p - 5e-1) <= 425e-3 THEN (p - 5e-1) * {middle}
                ELSE sign(p - 5e-1) * CASE WHEN r1 <= 5 THEN {near} ELSE {far} END END AS z FROM qq2)""")


@query("g42_qq_points", with_bookings(*_sql_qq("actual_price")))
def g42_qq_points(spark, d):
    return A.qq_points(_b(spark, d), "actual_price")


@query("g42_qq_fit", with_bookings(
    f"SELECT {R('regr_slope(sample, z)')} AS slope, {R('regr_intercept(sample, z)')} AS intercept, {R('corr(sample, z)')} AS r, "
    "count(*) AS n FROM qqz", *_sql_qq("actual_price")[1:]))
def g42_qq_fit(spark, d):
    return A.qq_fit(_b(spark, d), "actual_price")


def _sql_kde(col, by, k=""):
    """(select, CTEs): the density of ``col`` by group; ``k`` keeps CTE names apart."""
    return (f"""
SELECT {by}, gi, {R('lo + gi * step')} AS x,
       {R('sum(exp(-0.5e0 * ((lo + gi * step - v) / h) * ((lo + gi * step - v) / h))) / (n * h * 2.5066282746310002e0)')} AS density
FROM (SELECT b.{by}, b.{col} AS v, k.n, k.h, k.lo, k.step, CAST(g.range AS INT) AS gi
      FROM bookings b JOIN kst{k} k USING ({by}), range(0, 200) g WHERE b.{col} IS NOT NULL) t
GROUP BY {by}, gi, lo, step, n, h""",
            f"""kst0{k} AS (SELECT {by}, count({col}) AS n, stddev_samp({col}) * pow(count({col}), -0.2e0) AS h,
                min({col}) AS mn, max({col}) AS mx FROM bookings GROUP BY {by})""",
            f"""kst{k} AS (SELECT {by}, n, h, mn - 3e0 * h AS lo, ((mx + 3e0 * h) - (mn - 3e0 * h)) / 199 AS step FROM kst0{k})""")


@query("g43_kde_by_hotel", with_bookings(*_sql_kde("actual_price", "hotel_name")))
def g43_kde_by_hotel(spark, d):
    return A.kde(_b(spark, d), "actual_price", "hotel_name", 200, 3.0)


_PAIR = ["actual_price", "occupancy_rate", "lead_time_days", "competitor_avg_price"]
_PAIR_SQL = [_sql_kde(c, "room_type", f"_{i}") for i, c in enumerate(_PAIR)]


@query("g43_kde_by_room_type", with_bookings(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, * FROM ({q[0]}) t{i}" for i, (c, q) in enumerate(zip(_PAIR, _PAIR_SQL))),
    *[cte for q in _PAIR_SQL for cte in q[1:]]))
def g43_kde_by_room_type(spark, d):
    """One density per column and room type."""
    from functools import reduce
    b = cut_lineage(_b(spark, d).select("room_type", *_PAIR))
    return reduce(lambda x, y: x.unionByName(y),
                  [A.kde(b, c, "room_type", 200, 3.0).withColumn("feature", F.lit(c)) for c in _PAIR])


@query("g43_pair_sample", with_bookings(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(_PAIR)}, room_type FROM bookings
ORDER BY {_sql_hash_order(_PKEYS, 1)}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1500"""))
def g43_pair_sample(spark, d):
    """The sample behind the pair plot (the limit is the feature)."""
    from ratewise.operators.clean import sample_n
    return sample_n(_b(spark, d), 1500, 1, _PKEYS).select(*_PKEYS, *_PAIR, "room_type")


@query("g12_price_histogram_by_room_type", sql_histogram("actual_price", 50, by="room_type"))
def g12_price_histogram_by_room_type(spark, d):
    return A.histogram(_b(spark, d), "actual_price", 50, by="room_type")


_COMP = ["competitor_price_1", "competitor_price_2", "competitor_price_3"]


@query("g12_competitor_histograms", sql_histogram(
    "price", 50, by="competitor", source="cu",
    extra_ctes=("cu AS (" + " UNION ALL ".join(f"SELECT '{c}' AS competitor, {c} AS price FROM bookings"
                                              for c in _COMP) + ")",)))
def g12_competitor_histograms(spark, d):
    """One histogram per competitor price column (columns unpivoted to rows)."""
    long = _b(spark, d).unpivot([], _COMP, "competitor", "price")
    return A.histogram(long, "price", 50, by="competitor")

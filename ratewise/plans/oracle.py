"""Oracle SQL text (DuckDB dialect) for the correctness gate.

The ``bookings`` CTE mirrors ``ratewise.sources.bookings`` expression by
expression; each registered query appends its own SELECT to it. Result
columns are rounded through a wide decimal by ``R`` so both engines hash the
same values.
"""

from __future__ import annotations


def R(expr: str, n: int = 6) -> str:
    """Result rounding, same as ``ratewise.functions.fin``."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,12)), {n}) AS DOUBLE)"


def RR(expr: str, n: int = 6) -> str:
    """Result rounding of rows, same as ``ratewise.functions.columns.fin_row``."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(18,8)), {n}) AS DOUBLE)"


def RND(expr: str, n: int = 2) -> str:
    """Stage rounding, same as ``ratewise.functions.rnd``."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(18,8)), {n}) AS DOUBLE)"


_JOIN = """
b_join AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
         l.l_quantity, l.l_discount, l.l_returnflag, l.l_shipdate,
         o.o_custkey, o.o_orderdate, o.o_orderpriority, c.c_mktsegment,
         p.p_type, p.p_brand, p.p_retailprice, p.p_size, r.r_name
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

_L1 = f"""
b_l1 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         CAST(l_shipdate AS DATE) AS checkin_date,
         CAST(year(l_shipdate) AS INT) AS year,
         CAST(month(l_shipdate) AS INT) AS month,
         CAST(isodow(l_shipdate) - 1 AS INT) AS day_of_week,
         0 AS is_holiday,
         r_name AS hotel_name, p_type AS room_type, o_orderpriority AS channel,
         c_mktsegment AS guest_type, p_brand AS market_segment,
         CAST(abs(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 366 AS INT) AS lead_time_days,
         CAST(greatest(CAST(l_quantity AS INT) % 14, 1) AS INT) AS length_of_stay,
         (l_orderkey*31 + l_linenumber*17 + l_partkey*13) % 1009 / 1009e0 AS u1,
         (l_orderkey*37 + l_linenumber*19 + l_partkey*11) % 1013 / 1013e0 AS u2,
         (l_orderkey*41 + l_linenumber*23 + l_partkey*7) % 1019 / 1019e0 AS u3,
         (l_suppkey*7 + l_orderkey*3) % 100 AS ev,
         {RND('p_retailprice/10e0 + 2*p_size', 2)} AS base_price,
         CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END AS repeat_guest,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS cancellation,
         l_returnflag, l_discount
  FROM b_join
)"""

_L2 = f"""
b_l2 AS (
  SELECT *,
         CASE WHEN day_of_week >= 4 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN month IN (12,1,2) THEN 'Winter' WHEN month <= 5 THEN 'Spring'
              WHEN month <= 8 THEN 'Summer' ELSE 'Fall' END AS season,
         {RND('base_price*(90e-2+20e-2*u1)', 2)} AS competitor_price_1,
         {RND('base_price*(85e-2+30e-2*u2)', 2)} AS competitor_price_2,
         {RND('base_price*(80e-2+40e-2*u3)', 2)} AS competitor_price_3,
         CASE WHEN ev<45 THEN 'None' WHEN ev<55 THEN 'Concert' WHEN ev<65 THEN 'Sports'
              WHEN ev<77 THEN 'Conference' WHEN ev<85 THEN 'Festival' ELSE 'Holiday' END AS event_type,
         CAST(CASE WHEN ev<45 THEN 0 ELSE 1 + l_partkey % 5 END AS INT) AS event_magnitude,
         CAST(1 + l_orderkey % 5 AS INT) AS weather_score,
         {RND('35e-1 + (l_suppkey % 16)/10e0', 1)} AS reviews_score,
         {RND('least(98e-2, greatest(20e-2, 60e-2 + CASE WHEN month IN (7,8) THEN 20e-2 WHEN month IN (6,12) THEN 15e-2 ELSE 0e0 END + (u1+u2+u3-15e-1)*16e-2))', 4)} AS occupancy_rate
  FROM b_l1
)"""

_L3 = f"""
b_l3 AS (
  SELECT *,
         {RND('(competitor_price_1+competitor_price_2+competitor_price_3)/3e0', 2)} AS competitor_avg_price,
         least(competitor_price_1, competitor_price_2, competitor_price_3) AS competitor_min_price,
         greatest(competitor_price_1, competitor_price_2, competitor_price_3) AS competitor_max_price,
         {RND('least(1e0, greatest(10e-2, (occupancy_rate-20e-2)/80e-2))', 4)} AS demand_score,
         CASE WHEN l_returnflag='A' AND l_discount=0 THEN 0e0
              ELSE {RND('base_price*(1e0-l_discount)*(1e0+5e-2*event_magnitude)+l_extendedprice/5000e0', 2)} END AS actual_price
  FROM b_l2
)"""

_COLS = """l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    checkin_date, year, month, day_of_week, is_weekend, is_holiday, season,
    hotel_name, room_type, channel, guest_type, market_segment,
    lead_time_days, length_of_stay, base_price,
    competitor_price_1, competitor_price_2, competitor_price_3,
    competitor_avg_price, competitor_min_price, competitor_max_price,
    event_type, event_magnitude, weather_score, reviews_score,
    occupancy_rate, demand_score, repeat_guest, cancellation,
    actual_price, revenue_per_night, revpar"""

_L4 = f"""
b_all AS (
  SELECT {_COLS} FROM (
    SELECT *,
           {RND('actual_price*length_of_stay', 2)} AS revenue_per_night,
           {RND('actual_price*occupancy_rate', 2)} AS revpar
    FROM b_l3) t
)"""

_SPLIT = """
b_valid AS (SELECT * FROM b_all WHERE actual_price > 5e0),
b_daily AS (SELECT checkin_date, count(*) AS n_day FROM b_valid GROUP BY checkin_date),
b_cum AS (
  SELECT checkin_date,
         sum(n_day) OVER (ORDER BY checkin_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         sum(n_day) OVER () AS n
  FROM b_daily),
b_cut AS (SELECT min(checkin_date) AS split_date FROM b_cum WHERE cum > floor(n * 0.8e0)),
bookings AS (
  SELECT b_valid.*, CAST(b_valid.checkin_date >= b_cut.split_date AS INT) AS is_test
  FROM b_valid CROSS JOIN b_cut
)"""

_DIRTY = """
b_nulled AS (
  SELECT * REPLACE (
    CASE WHEN (l_orderkey*7 + l_linenumber*3 + l_partkey) % 100 <> 0 THEN occupancy_rate END AS occupancy_rate,
    CASE WHEN (l_orderkey*7 + l_linenumber*3 + l_partkey) % 100 <> 1 THEN reviews_score END AS reviews_score,
    CASE WHEN (l_orderkey*7 + l_linenumber*3 + l_partkey) % 100 <> 2 THEN weather_score END AS weather_score,
    CASE WHEN (l_orderkey*7 + l_linenumber*3 + l_partkey) % 100 <> 3 THEN lead_time_days END AS lead_time_days,
    CASE WHEN (l_orderkey*7 + l_linenumber*3 + l_partkey) % 100 <> 4 THEN competitor_price_2 END AS competitor_price_2,
    CASE WHEN (l_orderkey*7 + l_linenumber*3 + l_partkey) % 100 <> 5 THEN guest_type END AS guest_type,
    CASE WHEN (l_orderkey*3 + l_suppkey) % 4001 = 0 THEN actual_price * 4 ELSE actual_price END AS actual_price
  ) FROM b_all),
bookings_dirty AS (
  SELECT * FROM b_nulled
  UNION ALL
  SELECT * FROM b_nulled WHERE (l_orderkey + l_partkey*3) % 331 = 0
)"""


def with_bookings(select_sql: str, *ctes: str, dirty: bool = False) -> str:
    """Full oracle statement: the bookings CTEs, extra CTEs, then the query."""
    parts = [_JOIN, _L1, _L2, _L3, _L4, _DIRTY if dirty else _SPLIT]
    parts += [f"\n{c.strip()}" for c in ctes]
    return "WITH " + ",".join(parts) + "\n" + select_sql.strip()


def D(x: float) -> str:
    """A double literal DuckDB will not read as DECIMAL (round-trip repr + e0)."""
    s = repr(float(x))
    return s if ("e" in s or "inf" in s or "nan" in s) else s + "e0"

"""Registered pricing-policy queries."""

from __future__ import annotations

from ratewise.functions.columns import fin
from ratewise.operators import policy as B
from ratewise.plans.catalog import query
from ratewise.plans.oracle import D, R, with_bookings
from ratewise.sources.bookings import KEY_COLS, bookings

KEYS = ", ".join(KEY_COLS)
_Q = "[0.0, 0.25, 0.5, 0.75, 1.0]"


def _bin(col, e):
    return (f"CAST(CASE WHEN {col} >= {e}[1] AND {col} <= {e}[2] THEN 0 WHEN {col} <= {e}[3] THEN 1 "
            f"WHEN {col} <= {e}[4] THEN 2 WHEN {col} <= {e}[5] THEN 3 END AS INT)")


STATE_CTES = (
    f"""qe AS (SELECT quantile_cont(demand_score, {_Q}) AS ed, quantile_cont(occupancy_rate, {_Q}) AS eo,
               quantile_cont(competitor_avg_price, {_Q}) AS ec FROM bookings)""",
    f"""st0 AS (SELECT bookings.*, {_bin('demand_score', 'ed')} AS s_dem, {_bin('occupancy_rate', 'eo')} AS s_occ,
          {_bin('competitor_avg_price', 'ec')} AS s_cmp, CAST(event_type <> 'None' AS INT) AS s_evt FROM bookings, qe)""",
    """states AS (SELECT *, concat_ws('-', CAST(coalesce(s_dem, 0) AS VARCHAR), CAST(coalesce(s_occ, 0) AS VARCHAR),
          CAST(coalesce(s_cmp, 0) AS VARCHAR), CAST(s_evt AS VARCHAR)) AS state FROM st0)""",
)


def _acts(actions):
    return "(VALUES " + ", ".join(f"({i}, {D(m)})" for i, m in enumerate(actions)) + ") a(action, mult)"


REWARD_CTE = f"""rw AS (SELECT state, a.action, a.mult,
  base_price * a.mult * occupancy_rate
    - greatest(0e0, base_price * a.mult - competitor_avg_price * {D(B.COMP_PENALTY_RATIO)}) * occupancy_rate * {D(B.COMP_PENALTY_WEIGHT)}
    AS reward FROM states, {_acts(B.ACTIONS_11)})"""
VALUES_CTE = "vals AS (SELECT state, action, mult, avg(reward) AS value, count(*) AS n FROM rw GROUP BY state, action, mult)"
POLICY_CTE = """pol AS (SELECT state, action, mult, value FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY value DESC, action ASC) AS r FROM vals) t WHERE r = 1)"""


def _states(spark, d):
    return B.policy_state(bookings(spark, d), "market")


@query("b01_policy_state", with_bookings(f"SELECT {KEYS}, s_dem, s_occ, s_cmp, s_evt, state FROM states", *STATE_CTES))
def b01_policy_state(spark, d):
    return _states(spark, d).select(*KEY_COLS, "s_dem", "s_occ", "s_cmp", "s_evt", "state")


@query("b01_policy_state_occ_price", with_bookings(f"""
SELECT {KEYS}, CAST(least(floor(occupancy_rate * 5), 4) AS INT) AS s_occ,
       CAST(least(floor(base_price / 100), 4) AS INT) AS s_price,
       CAST(least(floor(occupancy_rate * 5), 4) AS INT) || '-' || CAST(least(floor(base_price / 100), 4) AS INT) AS state
FROM bookings"""))
def b01_policy_state_occ_price(spark, d):
    return B.policy_state(bookings(spark, d), "occ_price").select(*KEY_COLS, "s_occ", "s_price", "state")


@query("b02_action_rewards", with_bookings(f"""
SELECT action, mult, count(*) AS n, {R('avg(reward)')} AS avg_reward FROM rw GROUP BY action, mult""",
    *STATE_CTES, REWARD_CTE))
def b02_action_rewards(spark, d):
    from pyspark.sql import functions as F
    rw = B.action_rewards(_states(spark, d))
    return rw.groupBy("action", "mult").agg(F.count(F.lit(1)).alias("n"), fin(F.avg("reward")).alias("avg_reward"))


@query("b03_policy_values", with_bookings(
    f"SELECT state, action, mult, {R('value')} AS value, n FROM vals", *STATE_CTES, REWARD_CTE, VALUES_CTE))
def b03_policy_values(spark, d):
    v = B.policy_values(B.action_rewards(_states(spark, d)))
    return v.select("state", "action", "mult", fin("value").alias("value"), "n")


@query("b04_greedy_policy", with_bookings(
    f"SELECT state, action, mult, {R('value')} AS value FROM pol", *STATE_CTES, REWARD_CTE, VALUES_CTE, POLICY_CTE))
def b04_greedy_policy(spark, d):
    pol = B.greedy_policy(B.policy_values(B.action_rewards(_states(spark, d))))
    return pol.select("state", "action", "mult", fin("value").alias("value"))


@query("b05_evaluate_policy", with_bookings(f"""
SELECT count(*) AS n, {R('sum(reward)', 4)} AS total_reward, {R('avg(ape) * 100')} AS mape_vs_competitor,
       {R('avg(price)')} AS avg_policy_price
FROM (SELECT base_price * p.mult AS price,
        base_price * p.mult * occupancy_rate
          - greatest(0e0, base_price * p.mult - competitor_avg_price * {D(B.COMP_PENALTY_RATIO)}) * occupancy_rate * {D(B.COMP_PENALTY_WEIGHT)} AS reward,
        abs(competitor_avg_price - base_price * p.mult) / greatest(abs(competitor_avg_price), 1e-9) AS ape
      FROM states JOIN pol p USING (state)) t""", *STATE_CTES, REWARD_CTE, VALUES_CTE, POLICY_CTE))
def b05_evaluate_policy(spark, d):
    st = _states(spark, d)
    pol = B.greedy_policy(B.policy_values(B.action_rewards(st)))
    return B.evaluate_policy(st, pol)


MAPE_CTES = (
    """st2 AS (SELECT *, CAST(least(floor(occupancy_rate * 5), 4) AS INT) || '-' ||
          CAST(least(floor(base_price / 100), 4) AS INT) AS state FROM bookings)""",
    f"""vals2 AS (SELECT state, a.action, a.mult, avg(-abs(base_price * a.mult - actual_price) / actual_price * 100) AS value
        FROM st2, {_acts(B.ACTIONS_17)} GROUP BY state, a.action, a.mult)""",
)


@query("b04_greedy_policy_mape", with_bookings(f"""
SELECT state, action, mult, {R('value')} AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY value DESC, action ASC) AS r FROM vals2) t WHERE r = 1""",
    *MAPE_CTES))
def b04_greedy_policy_mape(spark, d):
    st = B.policy_state(bookings(spark, d), "occ_price")
    rw = B.action_rewards(st, B.ACTIONS_17, kind="mape", ref="actual_price")
    pol = B.greedy_policy(B.policy_values(rw))
    return pol.select("state", "action", "mult", fin("value").alias("value"))

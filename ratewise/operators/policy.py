"""Pricing policy from logged bookings.

The reference trains a tabular Q-learner whose next state is simply the next
row whatever the action, so every action leads to the same future and the
learned greedy action is the one with the best mean immediate reward in each
state. That policy is computed exactly here, with one grouped aggregation
over (state, action) -- no episode loop, no simulator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.columns import fin
from ratewise.operators.features import qcut, qcut_edges_many

# --- fixed values --------------------------------------------------------
ACTIONS_11 = [0.80, 0.85, 0.90, 0.95, 1.00, 1.05, 1.10, 1.15, 1.20, 1.25, 1.30]
ACTIONS_17 = [0.70 + i * (1.50 - 0.70) / 16 for i in range(17)]  # linspace(0.70, 1.50, 17)
COMP_PENALTY_RATIO = 1.20
COMP_PENALTY_WEIGHT = 0.5
# -------------------------------------------------------------------------


def policy_state(df: DataFrame, kind: str = "market") -> DataFrame:
    """B1: ``market`` = demand/occupancy/competitor quartile + event flag;
    ``occ_price`` = occupancy fifth and base-price hundred, both capped at 4."""
    if kind == "occ_price":
        return df.withColumns({
            "s_occ": F.least(F.floor(F.col("occupancy_rate") * 5), F.lit(4)).cast("int"),
            "s_price": F.least(F.floor(F.col("base_price") / 100), F.lit(4)).cast("int"),
        }).withColumn("state", F.concat_ws("-", F.col("s_occ").cast("string"), F.col("s_price").cast("string")))
    out = df
    pairs = (("demand_score", "s_dem"), ("occupancy_rate", "s_occ"), ("competitor_avg_price", "s_cmp"))
    edges = qcut_edges_many(df, [src for src, _ in pairs], 4)  # one pass for the three edge sets
    for src, name in pairs:
        out = qcut(out, src, 4, name=name, edges=edges[src])
    out = out.withColumn("s_evt", (F.col("event_type") != "None").cast("int"))
    return out.withColumn("state", F.concat_ws("-", *[F.coalesce(F.col(c), F.lit(0)).cast("string")
                                                      for c in ("s_dem", "s_occ", "s_cmp", "s_evt")]))


def action_rewards(df: DataFrame, actions: Sequence[float] = ACTIONS_11, kind: str = "revenue",
                   ref: str = "competitor_avg_price") -> DataFrame:
    """B2: one row per (booking, action) with its reward.

    ``revenue``: price x occupancy minus half the occupancy-weighted excess
    over 1.2 x the competitor average. ``mape``: minus the percent distance
    to ``ref``. The explode stays inside the scan stage; aggregation after it
    is partial, so only (state, action) partials are shuffled.
    """
    acts = F.explode(F.array(*[F.struct(F.lit(i).alias("action"), F.lit(float(m)).alias("mult"))
                               for i, m in enumerate(actions)]))
    x = df.select("*", acts.alias("a")).select("*", "a.action", "a.mult").drop("a")
    price = F.col("base_price") * F.col("mult")
    if kind == "mape":
        reward = -F.abs(price - F.col(ref)) / F.col(ref) * 100
    else:
        penalty = (F.greatest(F.lit(0.0), price - F.col(ref) * COMP_PENALTY_RATIO)
                   * F.col("occupancy_rate") * COMP_PENALTY_WEIGHT)
        reward = price * F.col("occupancy_rate") - penalty
    return x.withColumns({"price": price, "reward": reward})


def policy_values(rewards: DataFrame) -> DataFrame:
    """Mean reward per (state, action)."""
    return rewards.groupBy("state", "action", "mult").agg(F.avg("reward").alias("value"),
                                                          F.count(F.lit(1)).alias("n"))


def greedy_policy(values: DataFrame) -> DataFrame:
    """Best action per state, lowest action index on ties."""
    w = Window.partitionBy("state").orderBy(F.col("value").desc(), F.col("action").asc())
    return (values.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select("state", "action", "mult", "value"))


def evaluate_policy(states: DataFrame, policy: DataFrame, ref: str = "competitor_avg_price",
                    floor: float = 1e-9) -> DataFrame:
    """Apply the policy to every booking; total reward and MAPE of the
    policy price against the competitor average.

    The policy has one row per state; ``market`` states are at most
    4 x 4 x 4 x 2 = 128 and ``occ_price`` 25 by construction, a proven
    bound, so it is broadcast.
    """
    j = states.join(F.broadcast(policy.select("state", "mult")), "state")
    price = F.col("base_price") * F.col("mult")
    penalty = (F.greatest(F.lit(0.0), price - F.col(ref) * COMP_PENALTY_RATIO)
               * F.col("occupancy_rate") * COMP_PENALTY_WEIGHT)
    reward = price * F.col("occupancy_rate") - penalty
    ape = F.abs(F.col(ref) - price) / F.greatest(F.abs(F.col(ref)), F.lit(floor))
    return j.agg(F.count(F.lit(1)).alias("n"), fin(F.sum(reward), 4).alias("total_reward"),
                 fin(F.avg(ape) * 100).alias("mape_vs_competitor"),
                 fin(F.avg(price)).alias("avg_policy_price"))

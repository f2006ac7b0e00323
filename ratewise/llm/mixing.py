"""A training mix: sources at target weights, on a curriculum that varies in time.

Sources in code-point order (null last) weigh ``WEIGHTS``, repeating, and share
``SHARE`` of all words. A target stops at ``REPEATS`` times its source's words;
what that leaves over goes to the others by weight. With sources by rising
limit per weight, the level that all uncapped sources reach is found from
prefix sums: the first source whose share of the rest lies within its limit.

A source's documents follow each other in the order of a hash of their id, the
same in every run. Its target takes that sequence from the start, up to
``REPEATS`` times over; the last document it reaches is taken up to the word at
which the target is met, so a source's taken words equal its target rounded.

Each source's weight is a schedule over training progress 0-1, linear between
knots. Its integral, scaled to the target, is the demand up to any moment; the
position of a document's copy is the moment at which the demand reaches the
words before it: the integral inverted, a square root per segment.

Only DataFrame functions. Words are summed per source and hash range first, so
no window holds more than one of 4096 ranges of one source, whatever the
source's share of all rows.

Null texts and texts without words have size 0 and are never taken. Null ids
come first in their source's order, rows with equal ids in order of size. A
source without words has target 0. An empty table gives an empty result.
Columns named like an output are replaced; other extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import cut_lineage, ordered

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)                 # 150 % as a fraction of whole numbers
REPEATS = 2
# Weight at training progress 0, 1/2 and 1, by place in WEIGHTS: heavy sources
# early, light ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
WORD = r"[^\x20\x09-\x0D]+"
OUTPUTS = ("size", "source_size", "target", "taken", "position", "last_position")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, place, target) from (source, source_size)."""
    n = len(WEIGHTS)
    placed = ordered(sizes, [F.col("source").asc_nulls_last()], {})
    placed = (placed.withColumn("place", (F.col("position") % n).cast("int")).drop("position")
              .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("place") + 1))
              .withColumn("cap", REPEATS * F.col("source_size"))
              .withColumn("_ratio", F.col("cap") / F.col("weight")))
    placed = cut_lineage(ordered(placed, [F.col("_ratio").asc(), F.col("source").asc_nulls_last()],
                                 {"caps_before": "cap", "weight_before": "weight"}))
    every = placed.agg(F.sum("source_size").alias("_words"), F.sum("weight").alias("_weight"))
    with_all = placed.crossJoin(F.broadcast(every))            # one row
    num = F.col("_words") * SHARE[0] / F.lit(SHARE[1]) - F.col("caps_before")
    den = F.col("_weight") - F.col("weight_before")
    level = (with_all.withColumns({"_num": num, "_den": den})
             .where(F.col("_num") * F.col("weight") <= F.col("cap") * F.col("_den").cast("double"))
             .agg(F.min_by(F.struct("_num", "_den"), "position").alias("_level")))
    share = F.col("weight") * F.col("_level._num") / F.col("_level._den")
    return (placed.crossJoin(F.broadcast(level))               # one row
            .select("source", "source_size", "weight", "place",
                    F.least(F.col("cap").cast("double"), F.coalesce(share, F.col("cap").cast("double"))).alias("target")))


def progress(demand: Column, place: Column) -> Column:
    """The training progress at which a source's schedule, integrated and scaled
    to 1, reaches ``demand`` (0 to 1)."""
    out = None
    for k, knots in enumerate(SCHEDULES):
        step = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:])]
        need, before, at = demand * sum(areas), 0.0, None
        for i, (a, b, area) in enumerate(zip(knots, knots[1:], areas)):
            y = need - before
            slope = (b - a) / step
            h = 2.0 * y / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2.0 * slope * y, F.lit(0.0))))
            t = F.lit(i * step) + h
            before += area
            last = i == len(areas) - 1
            at = (F.when(need <= before, t) if at is None else at.otherwise(t) if last else at.when(need <= before, t))
        out = F.when(place == k, at) if out is None else out.when(place == k, at)
    return F.least(out, F.lit(1.0))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row with ``size``, its source's ``source_size`` and ``target``,
    ``taken`` words, and the training positions of its first and last copy."""
    h = F.md5(F.col(key).cast("string").cast("binary"))
    rows = (docs.drop(*[c for c in OUTPUTS if c in docs.columns])
            .withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
            .withColumns({"_key": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")), "_h": h,
                          "_range": F.coalesce(F.substring(h, 1, 3), F.lit(""))}))
    ranges = cut_lineage(rows.groupBy(F.col(source).alias("source"), "_key", "_range").agg(F.sum("size").alias("words")))
    aimed = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranges.withColumn("_start", F.coalesce(F.sum("words").over(before), F.lit(0)))
              .join(aimed.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source"), "_key")
              .select("_key", "_range", "_start", "source_size", "place", "target"))
    inside = (Window.partitionBy("_key", "_range").orderBy("_h", key, "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    c = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.floor(F.col("target") + 0.5)
    part = lambda e: F.least(F.greatest(whole - e * F.col("source_size") - F.col("_c"), F.lit(0)), F.col("size"))
    demand = lambda e: (F.col("_c") + e * F.col("source_size")) / F.greatest(whole, F.lit(1))
    copies = F.array(*[F.struct(part(e).alias("words"), progress(demand(e), F.col("place")).alias("position"))
                       for e in range(REPEATS)])
    return (rows.join(starts, ["_key", "_range"]).withColumn("_c", c)
            .withColumn("copies", F.filter(copies, lambda x: x["words"] > 0))
            .withColumns({"taken": F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"]),
                          "position": F.get("copies", F.lit(0))["position"],
                          "last_position": F.array_max(F.col("copies")["position"])})
            .drop("_key", "_range", "_h", "_start", "_c", "place"))


def mix(docs: DataFrame, **names: str) -> DataFrame:
    """One row a document copy that the mix takes, range-sorted by position."""
    out = (plan(docs, **names).withColumn("_copy", F.explode("copies"))
           .withColumns({"position": F.col("_copy.position"), "taken": F.col("_copy.words")})
           .drop("copies", "_copy", "last_position"))
    return out.repartitionByRange("position").sortWithinPartitions("position")

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from ratewise.llm import mixing
from ratewise.llm.mixing import mix, plan, progress

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_targets(sizes):
    """Reshares round by round until no target is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = Fraction(3, 2) * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * Fraction(sizes[s]) if s in over else weight[s] * level
        open_ -= over or open_
    return target


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sizes = defaultdict(int)
    for r, n in zip(rows, size):
        sizes[r[3]] += n
    target, out, at = brute_targets(dict(sizes)), [], defaultdict(int)
    key = lambda i: (rows[i][0] is not None, hashlib.md5(str(rows[i][0]).encode()).hexdigest(), size[i])
    for i in sorted(range(len(rows)), key=key):
        s = rows[i][3]
        whole = math.floor(float(target[s]) + 0.5)
        c = at[s]
        at[s] += size[i]
        out.append((rows[i][0], size[i], sizes[s], round(float(target[s]), 6),
                    sum(min(max(whole - e * sizes[s] - c, 0), size[i]) for e in (0, 1))))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:3], round(r[3], 6), r[4]) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def docs(seed, n=200):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = r.choice([0, 1, 5, 30, 300]) if i else 5000
        text = r.choice([" ", "\n", "\t \r"]).join("wé" for _ in range(words)) if words else r.choice([None, "", " \n"])
        out.append((i, text, "en", r.choice(["a", "a", "a", "a", "b", "Z", "é", "\U0001F600", "", None, f"s{r.randint(0, 9)}"]), 0))
    return out


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = docs(seed)
        assert got(plan(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_targets_are_met_and_copies_bounded(spark):
    rows = docs(5)
    out = plan(spark.createDataFrame(rows, SCHEMA)).groupBy("source", "target").agg(
        F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= 0.5 and r.over <= 0 for r in out)
    copies = mix(spark.createDataFrame(rows, SCHEMA))
    assert copies.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert copies.agg(F.sum("taken")).first()[0] == sum(r.taken for r in out)
    at = [r.position for r in copies.select("position").collect()]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (None, "x y", "en", "a", 0), (None, "x y", "en", None, 0), (2, "x y z", "en", "a", 0),
            (2, "x y z", "en", "a", 0), (3, "w " * 100_000, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"taken": F.lit("x"), "place": F.lit(1), "copy": F.lit(2)})
    assert got(plan(df.drop("place"))) == brute(rows)
    assert plan(spark.createDataFrame([], SCHEMA)).count() == 0 and mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(plan(spark.createDataFrame([(1, "", "en", "a", 0)], SCHEMA))) == [(1, 0, 0, 0.0, 0)]


def test_progress_inverts_the_schedule(spark):
    """The integral of the schedule up to the position gives the demand back."""
    u = spark.range(101).select((F.col("id") / 100).alias("u"), F.explode(F.array(*map(F.lit, range(3)))).alias("place"))
    for r in u.withColumn("t", progress(F.col("u"), F.col("place"))).collect():
        knots = mixing.SCHEDULES[r.place]
        grid = [r.t * (i + 0.5) / 2000 for i in range(2000)]
        weight = lambda t: knots[0] + (knots[1] - knots[0]) * 2 * t if t <= 0.5 else knots[1] + (knots[2] - knots[1]) * 2 * (t - 0.5)
        area = sum(map(weight, grid)) * r.t / 2000
        assert abs(area / ((knots[0] + 2 * knots[1] + knots[2]) / 4) - r.u) < 1e-6

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ratewise.llm import queries
from ratewise.llm.common import read
from ratewise.llm.periodic_runs import find_runs, periodic_runs
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    """Every maximal stretch per period, by comparing all words; the smallest period of equal stretches."""
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
            i += 1 if i == s else 0
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def texts(rng):
    letters = "abcd"[:rng.choice([1, 2, 2, 3, 4])]
    n, kind = rng.randint(0, 80), rng.random()
    if kind < 0.3:
        return [rng.choice(letters) for _ in range(n)]
    if kind < 0.7:                       # nested and cut-off periods
        x, w = [rng.choice(letters) for _ in range(rng.randint(1, 9))], []
        while len(w) < n:
            w += x * rng.randint(1, 5)
            if rng.random() < 0.4:
                w.append(rng.choice("abcd"))
            if rng.random() < 0.3:
                x = x * 2 + [rng.choice(letters)]
        return w
    a, b = "a", "ab"                     # Fibonacci words: as many runs as there can be
    for _ in range(rng.randint(1, 7)):
        a, b = b, b + a
    w = list(b[:100])
    if rng.random() < 0.5:
        w[rng.randrange(len(w))] = "z"
    return w


@pytest.mark.parametrize("least", [2, 4, 12])
def test_all_runs_of_many_texts(least):
    rng = random.Random(least)
    for _ in range(700):
        some = [[c.encode() for c in texts(rng)] for _ in range(rng.randint(1, 4))]
        for w, got in zip(some, find_runs(some, least)):
            assert [tuple(r) for r in got.tolist()] == brute(w, least), w


def test_edge_cases(spark):
    long = " ".join(["x", "y", "z"] * 50_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 12), (4, "a " * 12), (5, "a " * 11), (None, long), (6, "é ü é ü " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("other", F.lit(7))
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed, r.other) for r in periodic_runs(df).collect()), key=str)
    want = sorted(((i or 0, brute(w, 12) if i else [(0, 150_000, 3)], brute_collapsed(w, brute(w, 12)) if i else "x y z", 7)
                   for i, t in rows for w in [WORD.findall(t or "")]), key=str)
    assert got == want
    assert periodic_runs(df.where("false")).collect() == []


def test_query_against_brute_force(spark):
    want = []
    for r in read(spark, SMALL, "documents").select("doc_id", "text").collect():
        w = WORD.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(runs), *best, best[1] and best[1] * 1000 // best[2],
                     digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(brute_collapsed(w, runs))))
    got = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[1] > 0 for x in want) > 10

import random

import pytest
from pyspark.sql import functions as F

from ratewise.llm import jaccard
from ratewise.llm.components import components
from ratewise.llm.jaccard import jaccard_components
from tests.llm.helpers import jaccard_rows, roots

SCHEMA = "doc_id long, text string"


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, n=160):
    """Random texts, copies, near copies at many distances, subsets, shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    texts, base = [], None
    for i in range(n):
        kind = r.random()
        if base is None or kind < 0.2:
            base = [word() for _ in range(r.choice([3, 8, 40, 120, 400]))]
            t = list(base)
        elif kind < 0.3:
            t = list(base)
        elif kind < 0.75:
            t = list(r.choice(texts)) if r.random() < 0.3 else list(base)
            for _ in range(r.randint(1, 1 + len(t) // r.choice([8, 15, 40]))):
                t[r.randrange(len(t))] = word()
        elif kind < 0.85:
            t = base[: max(1, int(len(base) * r.uniform(0.7, 1)))]
        else:
            t = passage.split() + [word() for _ in range(r.randint(0, 30))]
        texts.append(t)
    return [(i, (" " if i % 3 else "\n").join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,long", [(1, 10_000), (2, 10_000), (3, 2), (4, 2)])
def test_against_brute_force(spark, monkeypatch, seed, long):
    monkeypatch.setattr(jaccard, "LONG_LIST", long)        # also with lists counted in parts
    docs = corpus(seed)
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    assert got(jaccard_components(df)) == jaccard_rows(docs)


def test_undecided_followers(spark, monkeypatch):
    """Chains of near copies: links between followers of different leaders."""
    for shared in (1, 4, 1_000):
        monkeypatch.setattr(jaccard, "SHARED", shared)
        w = [f"w{i}" for i in range(200)]
        docs = []
        for k in range(25):                                # each drifts a little from the last
            w = list(w)
            for j in range(3):
                w[(k * 7 + j * 31) % 200] = f"x{k}_{j}"
            docs.append((100 - k, " ".join(w)))
            docs.append((200 + k, " ".join(w[:-k - 1])))
        assert got(jaccard_components(spark.createDataFrame(docs, SCHEMA))) == jaccard_rows(docs)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    docs = [(5, None), (3, ""), (4, " \n\t "), (9, "One two"), (7, "one  TWO\n"), (8, "one two three"), (None, "one two"),
            (11, "a b c d e"), (11, "a b c d e"), (12, "A B C D E"), (20, long), (21, long + " end"), (22, "x" * 300_000)]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("fp", F.lit(1)).withColumn("comp", F.lit("z"))
    assert got(jaccard_components(df)) == jaccard_rows(docs)
    assert got(jaccard_components(spark.createDataFrame([], SCHEMA))) == []
    assert got(jaccard_components(spark.createDataFrame([(1, None)], SCHEMA))) == [(1, 0, 1)]


def test_threshold_is_exact(spark):
    """Sets whose similarity is exactly 0.8, and just below."""
    w = [f"w{i}" for i in range(104)]                      # 100 shingles
    at = w[:-10] + []                                       # 90 of 100: 0.9
    docs = [(1, " ".join(w)), (2, " ".join(w[:84])), (3, " ".join(w[:83] + ["q"])), (4, " ".join(at))]
    assert got(jaccard_components(spark.createDataFrame(docs[:2], SCHEMA))) == [(1, 100, 1), (2, 80, 1)]
    assert got(jaccard_components(spark.createDataFrame([docs[0], docs[2]], SCHEMA))) == [(1, 100, 1), (3, 80, 3)]
    assert got(jaccard_components(spark.createDataFrame(docs, SCHEMA))) == jaccard_rows(docs)


def test_components_of_a_long_path(spark):
    r = random.Random(7)
    ids = list(range(300))
    r.shuffle(ids)
    links = list(zip(ids, ids[1:200])) + [(ids[250], ids[251]), (ids[250], ids[250])]
    out = dict(tuple(x) for x in components(spark.createDataFrame(links + links, "a long, b long")).collect())
    want = {i: c for i, c in roots(ids, links).items() if any(i in l and l[0] != l[1] for l in links)}
    assert out == want

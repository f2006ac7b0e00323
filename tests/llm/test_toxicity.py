import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.llm import toxicity
from ratewise.llm.common import read

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
BAD = ["idiot", "scum", "blorgzap", "blorgzum", "blorgfex"]


def corpus(seed, n=500):
    r = random.Random(seed)
    common = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.choice([15, 60, 300]))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(r.randrange(len(words)), r.choice([*BAD, BAD[2][:5] + r.choice(common)]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1)
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    out = toxicity.score(d, toxicity.learn(d, l)).withColumn("held_out", toxicity.held_out()).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out) and len(held) > 60
    assert sum(truth[r.doc_id] == r.predicted for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def counts_of(model):
    return sorted(tuple(r) for r in model.counts.collect())


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(2, 200)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    d = spark.createDataFrame(docs, DOCS)
    a, b = (toxicity.learn(d, spark.createDataFrame(x, LABELS)) for x in (labels, flip))
    assert counts_of(a) == counts_of(b)
    assert (a.slope, a.shift) == (b.slope, b.shift)


class Brute:
    """The two Kneser-Ney models by their definition, over whole words."""

    def __init__(self, texts, without=None):
        """texts: (text, toxic, remainder) of the labelled rows."""
        self.count = {}                                 # (history, byte) -> [ordinary, toxic, places]
        distinct = set()
        for text, toxic, part in texts:
            for w in self.words(text):
                for g in self.grams(w):
                    c = self.count.setdefault(g, [0, 0, 0])
                    c[toxic] += part != without
                    c[2] += w not in distinct
                distinct.add(w)
        self.after = {}
        for (h, x), c in self.count.items():
            self.after.setdefault(h, []).append(c)

    @staticmethod
    def words(text):
        return (text or "").encode().lower().split()

    @staticmethod
    def grams(word):
        s = b" " + word + b" "
        return [(s[:i], s[i:i + 1]) for i in range(1, len(s))]

    def p(self, h, x, c):
        """The class's probability of x after h, next to what shorter histories (shared) would give an unseen x."""
        seen = self.after[h]
        n, places = sum(k[c] for k in seen), sum(k[2] for k in seen)
        freed = sum(min(k[c], 0.75) for k in seen) / n if n else 1.0
        k = self.count.get((h, x))
        if k is None:
            return max(freed, 1e-9)
        return (max(k[c] - 0.75, 0) / n if n else 0.0) + freed * k[2] / places

    def ratio(self, word):
        return sum(math.log(self.p(h, x, 1) / self.p(h, x, 0)) for h, x in self.grams(word) if h in self.after)

    def feature(self, text):
        w = self.words(text)
        return math.log(0.001 + sum(min(max(self.ratio(x) - 3, 0), 3) for x in w) / (len(w) + 20))


@pytest.mark.parametrize("size", [250_000, 7])       # one range, and many whose ends share histories
def test_scores_equal_the_definition(spark, monkeypatch, size):
    monkeypatch.setattr(toxicity, "RANGE", size)
    docs, labels = corpus(7, 150)
    docs = [(i, t + (" unbelievablethings" if i % 3 else " unbelieverstogether idiotically")) for i, t in docs]
    labels = labels[:130]                               # the rest brings words that were never seen
    part = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in docs}
    toxic = {i: t for i, _, t in labels}
    train = [(t, toxic[i], part[i]) for i, t in docs if i in toxic and part[i]]
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.learn(d, l)
    brute = Brute(train)
    for h in list(brute.after)[:300]:                   # after each history the probabilities of either class sum to one
        for c in (0, 1):
            assert sum(brute.p(h, x, c) for g, x in brute.count if g == h) == pytest.approx(1.0)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    for i, t in docs:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * brute.feature(t) + model.shift))), abs=1e-6)
    # the curve: each training row by the model without its part
    apart = {k: Brute(train, k) for k in (1, 2, 3, 4)}
    x = np.array([apart[p].feature(t) for t, _, p in train])
    y = np.array([float(c) for _, c, _ in train])
    order = np.lexsort((y, x))
    assert toxicity._fit_curve(x[order], y[order]) == pytest.approx((model.slope, model.shift), rel=1e-4)


def test_every_byte_is_read_once():
    for n in (1, 5, 29, 30, 31, 32, 33, 63, 64, 65, 1000):
        word = bytes(33 + i % 90 for i in range(n))
        grams = []
        for w in toxicity.words(word):
            first = 1 if w.startswith(b" ") else toxicity.HISTORY
            grams += [(w[max(0, i - 8):i], w[i:i + 1]) for i in range(first, len(w))]
        whole = b" " + word.lower() + b" "
        assert grams == [(whole[max(0, i - 8):i], whole[i:i + 1]) for i in range(1, len(whole))]


def test_odd_rows(spark):
    docs, labels = corpus(4, 150)
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "x" * 300_000), (1004, "idiot " * 50_000), (None, "idiot scum"), (3, docs[3][1])]
    labels += [(3, 1, 0), (None, 1, 1), (5, None, None), (6, 1, 7)]
    d, l = spark.createDataFrame(docs, DOCS).withColumn("word", F.lit(1)), spark.createDataFrame(labels, LABELS)
    out = {r.doc_id: r for r in toxicity.score(d, toxicity.learn(d, l)).collect()}
    assert len(out) == 156 and all(r.score is not None for r in out.values())
    assert out[1000].score == out[1001].score == out[1002].score < 0.5 <= out[1004].score
    assert toxicity.score(d, toxicity.learn(d.limit(0), l)).count() == len(docs)
    none = toxicity.score(d, toxicity.learn(d, l.limit(0)))
    assert {(r.score, r.predicted) for r in none.collect()} == {(0.0, 0)}
    blank = spark.createDataFrame([(i, "") for i in range(150)], DOCS)
    assert 0 < toxicity.learn(blank, l).constant < 1


def test_on_the_given_documents(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, labels)).where(toxicity.held_out()).join(labels, "doc_id")
    r = out.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"),
                F.avg(F.when(F.col("predicted") == 1, F.col("toxic"))).alias("precision")).first()
    assert r.recall >= 0.9 and r.precision >= 0.9


def test_words_in_place_and_by_ranges_have_the_same_evidence(spark, monkeypatch):
    r = random.Random(6)
    docs = [(i, " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(60))
             + (" idiot once%d" % i if i % 5 == 0 else "") + " " + "語言文字" * 9) for i in range(250)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(250)]
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    want = sorted(map(tuple, toxicity.score(d, toxicity.learn(d, l)).select("doc_id", "score", "predicted").collect()))
    monkeypatch.setattr(toxicity, "COMMON", 2)
    monkeypatch.setattr(toxicity, "RANGE", 900)
    few = toxicity.learn(d, l)
    assert len(few.common) <= 2
    assert sorted(map(tuple, toxicity.score(d, few).select("doc_id", "score", "predicted").collect())) == want


class Shorter(Brute):
    """As above, where the shared counts back off to shorter histories of at most two bytes."""

    def __init__(self, texts, without=None):
        super().__init__(texts, without)
        spaced = {b" " + w + b" " for t, _, _ in texts for w in self.words(t)}
        grams = {w[i:i + n] for w in spaced for n in (2, 3, 4) for i in range(len(w) - n + 1)}
        self.before = {}                                # (shorter history, byte) -> number of distinct bytes before them
        for g in grams:
            self.before[g[1:-1], g[-1:]] = self.before.get((g[1:-1], g[-1:]), 0) + 1
        self.follow = {}
        for (h, _), n in self.before.items():
            self.follow.setdefault(h, []).append(n)

    def low(self, h, x):
        if h not in self.follow:
            return self.low(h[1:], x)
        n = self.follow[h]
        rest = self.low(h[1:], x) if h else 1 / 256
        return (max(self.before.get((h, x), 0) - 0.75, 0) + 0.75 * len(n) * rest) / sum(n)

    def p(self, h, x, c):
        seen = self.after[h]
        n, places = sum(k[c] for k in seen), sum(k[2] for k in seen)
        freed = sum(min(k[c], 0.75) for k in seen) / n if n else 1.0
        k = self.count.get((h, x), [0, 0, 0])
        shared = (max(k[2] - 0.75, 0) + 0.75 * len(seen) * self.low(h[1:][-2:], x)) / places
        return (max(k[c] - 0.75, 0) / n if n else 0.0) + freed * shared


@pytest.mark.parametrize("size", [250_000, 7])       # one range, and many whose ends share histories
def test_shared_counts_back_off_to_shorter_histories(spark, monkeypatch, size):
    monkeypatch.setattr(toxicity, "RANGE", size)
    docs, labels = corpus(8, 150)
    docs = [(i, t + (" unbelievablethings" if i % 3 else " unbelieverstogether a")) for i, t in docs]
    labels = labels[:130]
    part = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in docs}
    toxic = {i: t for i, _, t in labels}
    train = [(t, toxic[i], part[i]) for i, t in docs if i in toxic and part[i]]
    brute = Shorter(train)
    for h in list(brute.after)[:40]:                    # over all bytes, seen or not
        for c in (0, 1):
            assert sum(brute.p(h, bytes([x]), c) for x in range(256)) == pytest.approx(1.0)
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.learn(d, l, toxicity.ORDER)
    for n, (grams, p) in enumerate(model.shorter.value, 1):
        got = {int(g).to_bytes(n, "big"): x for g, x in zip(grams, p)}
        assert got == pytest.approx({h + x: brute.low(h, x) for h, x in brute.before if len(h) == n - 1})
    apart = {k: Shorter(train, k) for k in (1, 2, 3, 4)}
    x, y = np.array([apart[p].feature(t) for t, _, p in train]), np.array([float(c) for _, c, _ in train])
    order = np.lexsort((y, x))
    assert toxicity._fit_curve(x[order], y[order]) == pytest.approx((model.slope, model.shift), rel=1e-4)
    for r in toxicity.score(d, model).collect():
        want = 1 / (1 + math.exp(-(model.slope * brute.feature(dict(docs)[r.doc_id]) + model.shift)))
        assert r.score == pytest.approx(want, abs=1e-6)


def test_the_query_backs_off_to_shorter_histories(spark):
    from ratewise.llm.queries import QUERIES
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    out = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").cache()
    r = (out.where("held_out").join(labels, "doc_id")
         .agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"),
              F.avg(F.when(F.col("predicted") == 1, F.col("toxic"))).alias("precision")).first())
    print(r)
    assert r.recall >= 0.9 and r.precision >= 0.9
    model = toxicity.learn(docs.select("doc_id", "text"), labels, toxicity.ORDER)
    assert model.shorter is not None and [len(g) > 0 for g, _ in model.shorter.value] == [True] * toxicity.ORDER
    scores = toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", F.col("score").alias("want"))
    assert out.join(scores, "doc_id").where("abs(score - want) > 1e-9").count() == 0


def test_shorter_histories_where_all_words_are_short(spark):
    docs = [(i, "a b" if i % 4 else "a z") for i in range(100)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(100)]
    d, l = spark.createDataFrame(docs + [(1000, "abcdefgh" * 9)], DOCS), spark.createDataFrame(labels, LABELS)
    scores = {r.doc_id: r.score for r in toxicity.score(d, toxicity.learn(d, l, toxicity.ORDER)).collect()}
    assert scores[0] > scores[1] and 0 <= scores[1000] <= 1
    with pytest.raises(ValueError):
        toxicity.learn(d, l, toxicity.ORDER + 1)

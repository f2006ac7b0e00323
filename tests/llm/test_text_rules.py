"""Licence rules, URL lists and training-order shards."""
import datetime
import glob
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ratewise.llm import bpe, licences, training_order as to
from ratewise.llm.training_order import Permutation, read_shards, write_shards
from ratewise.llm.url_lists import filter_captures, intervals, keys


# licences ------------------------------------------------------------------

def brute_licences(text):
    parts = re.sub(r"([.!?;])[ \t]+", r"\1\n", text or "").split("\n")
    ids = [licences.SENTENCES[s] for s in (re.sub(r"[^a-z0-9]+", " ", p.lower()).strip(" ") for p in parts) if s in licences.SENTENCES]
    left, found = ids, set()
    for name, rule in sorted(licences.RULES, key=lambda r: -len(r[1])):
        i, out = 0, []
        while i < len(left):
            if left[i:i + len(rule)] == rule:
                found.add(name)
                out.append(None)                       # what a rule used stands in the way of others
                i += len(rule)
            else:
                out.append(left[i])
                i += 1
        left = out
    return ids, sorted(found)


def test_licences_against_brute_force(spark):
    r = random.Random(3)
    said = list(licences.SENTENCES)
    rows = [(0, None), (1, ""), (2, "Not a licence."), (3, "All rights reserved. " * 40_000)]
    for i in range(4, 150):
        parts = []
        for _ in range(r.randint(1, 6)):
            if r.random() < 0.5:
                parts += [s for s in r.choice(licences.RULES)[1]]
            else:
                parts.append(None)
        back = {v: k for k, v in licences.SENTENCES.items()}
        sentence = lambda p: r.choice(["Some text", "Ünknown", ""]) if p is None else back[p].upper() if r.random() < 0.3 else back[p].replace(" ", ", ", 1)
        rows.append((i, r.choice([". ", ".\n", "\n", "!  ", ".\t"]).join(sentence(p) for p in parts) + "."))
    rows += [rows[-1], (900, said[5] + " " + said[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licences", F.lit(1))
    for x in licences.scan(df).collect():
        assert (x.sentence_ids, x.licences) == brute_licences(x.text), x.doc_id
    assert licences.scan(df.limit(0)).count() == 0


def test_longer_rules_come_first(spark):
    back = {v: k for k, v in licences.SENTENCES.items()}
    bsd = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]
    rows = [(1, ".\nsomething else\n".join(back[i] for i in bsd)), (2, "\n".join(back[i] for i in reversed(bsd)))]
    out = {x.doc_id: x.licences for x in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ["BSD-3-Clause"], 2: []}


def test_wrapped_notices(spark):
    import textwrap
    back = {v: k for k, v in licences.SENTENCES.items()}
    rows, want = [], {}
    for name, ids in licences.RULES:
        for width in (70, 75, 80):
            lines = textwrap.wrap(". ".join(back[i].capitalize() for i in ids) + ".", width)
            for mark in ("", "# ", " * ", "// "):
                want[len(rows)] = ids
                rows.append((len(rows), "int x = 1;\n\n" + "\r\n".join(mark + x for x in lines) + "\n\nOther text"))
    rows.append((len(rows), back["bsd-grant"].replace(" ", "\n", 3) + ":\n\n1. " + back["bsd-source"]))
    want[len(rows) - 1] = ["bsd-grant", "bsd-source"]
    for x in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert x.sentence_ids == want[x.doc_id], x.text
    apart = spark.createDataFrame([("All rights\n\nreserved",), ("All rights.\nreserved",), ("not all rights\nreserved",)], "text string")
    assert licences.scan(apart).where(F.size("sentence_ids") > 0).count() == 0


# URL lists -----------------------------------------------------------------

D = datetime.date
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_keys(spark):
    urls = ["https://u:p@A.b.Example.com:8080/x/y/z/?q=1#f", "http://h/", "http://h.org?x", "nonsense", "/a/b", "", None,
            "http://e.com/" + "s/" * 5000]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "url string").select(keys(F.col("url")).alias("k")).collect()]
    assert got[0] == ["d:a.b.example.com", "d:b.example.com", "d:example.com", "p:a.b.example.com/x/", "p:a.b.example.com/x/y/",
                      "p:a.b.example.com/x/y/z/", "u:a.b.example.com/x/y/z/?q=1"]
    assert got[1] == ["d:h", "u:h/"] and got[2] == ["d:h.org", "u:h.org?x"] and got[3:7] == [[]] * 4 and len(got[7]) == 6


def test_lists_against_brute_force(spark):
    r = random.Random(5)
    day = lambda: D(2022, 1, 1) + datetime.timedelta(days=r.randrange(700))
    hosts = ["a.hot.com", "a.hot.com", "a.hot.com", "b.org", "c.net"]
    caps = [(i, f"http://{r.choice(hosts)}/{r.choice('xy')}/{r.choice('pq')}", day()) for i in range(400)]
    caps += [(400, None, day()), (401, "http://b.org/x", None), (402, "rel/ative", day())]
    names = ["d:a.hot.com", "d:hot.com", "d:b.org", "p:a.hot.com/x/", "p:b.org/y/", "u:c.net/x/p", "u:a.hot.com/x/q"]
    events = [(r.choice(names), r.choice(["block", "allow", "remove"]), day(), k) for k in range(60)]
    events += [(None, "block", day(), 0), ("d:b.org", None, day(), 0), ("d:b.org", "block", None, 0), ("d:b.org", "other", day(), 0)]
    cdf = spark.createDataFrame(caps, "page_id long, url string, fetched_at date").withColumn("key", F.lit("x"))
    edf = spark.createDataFrame(events, "key string, action string, at date, seq int")
    got = {x.page_id: (x.active, x.matched, x.blocked) for x in filter_captures(cdf, edf).collect()}
    every = {x.page_id: x.k for x in cdf.select("page_id", keys(F.col("url")).alias("k")).collect()}
    want = {}
    for i, _, at in caps:
        state = {}
        for k in set(every[i]):
            past = sorted((e[2], e[3], e[1]) for e in events if e[0] == k and e[1] in ("block", "allow", "remove") and e[2] and at and e[2] <= at)
            if past and past[-1][2] != "remove":
                state[k] = past[-1][2]
        rank = lambda k: ({"u": 3, "p": 2, "d": 1}[k[0]], len(k), state[k] == "block", k)
        top = max(state, key=rank, default=None)
        want[i] = (len(state), top, top is not None and state[top] == "block")
    assert got == want
    assert filter_captures(cdf, edf.limit(0)).where("blocked or active > 0").count() == 0
    assert filter_captures(cdf.limit(0), edf).count() == 0


def test_deep_paths_and_late_captures(spark):
    caps = [(1, "http://h.com/a/b/c/d/e/f", D(2022, 5, 1)), (2, "http://h.com///a//b/c/d/e/", D(2030, 5, 1)),
            (3, "http://h.com/a/b/c/d/x", D(2030, 5, 1)), (4, "http://late.org/", D(2031, 1, 1))]
    entries = [("p:h.com/a/b/c/d/e/", "block", D(2022, 1, 1)), ("d:late.org", "block", D(2022, 1, 1))]
    out = filter_captures(spark.createDataFrame(caps, "page_id long, url string, fetched_at date"),
                          spark.createDataFrame(entries, "key string, action string, at date"))
    assert {x.page_id for x in out.where("blocked").collect()} == {1, 2, 4}


def test_verdicts_do_not_depend_on_ids(spark):
    d = D(2022, 5, 1)
    caps = [(1, "http://a.com/x", d), (1, "http://b.com/y", d), (None, "http://a.com/z", d), (None, None, d), (2, "http://a.com/x", D(2021, 1, 1)),
            (3, "http://a.com/x", d), (3, "http://a.com/x", d)]
    entries = spark.createDataFrame([("d:a.com", "block", D(2022, 1, 1))], "key string, action string, at date")
    out = filter_captures(spark.createDataFrame(caps, "page_id long, url string, fetched_at date").withColumn("matched", F.lit(1)), entries)
    want = [(*c, int(b), "d:a.com" if b else None, b) for c, b in zip(caps, [True, False, True, False, False, True, True])]
    assert out.columns == ["page_id", "url", "fetched_at", "active", "matched", "blocked"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))


def test_intervals_meet_without_overlap(spark):
    e = [("k", "block", D(2022, 1, 1)), ("k", "allow", D(2022, 2, 1)), ("k", "remove", D(2022, 3, 1)), ("k", "block", D(2022, 4, 1)), ("k", "block", D(2022, 4, 1))]
    got = intervals(spark.createDataFrame(e, "key string, action string, at date")).orderBy("valid_from").collect()
    assert [(x.action, x.valid_from, x.valid_to) for x in got] == [("block", D(2022, 1, 1), D(2022, 2, 1)), ("allow", D(2022, 2, 1), D(2022, 3, 1)), ("block", D(2022, 4, 1), None)]


# training order ------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutation(n):
    p = Permutation(n, 7)
    slots = p.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (p.sequence(slots) == np.arange(n)).all()
    if n >= 1000:
        assert (slots != Permutation(n, 8).slot(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.1


def brute_sequences(partitions, length):
    out = []
    for docs in partitions:
        stream = [(i, b) for i, t in docs for b in ([*t.encode(), to.END] if t else [])]
        out += [stream[k:k + length] for k in range(0, len(stream), length)]
    return [(s[0][0], bytes(b for _, b in s)) for s in out]


def test_shards_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    docs = [(i, r.choice([None, "", "é\n" * r.randint(1, 60), "abc " * r.randint(1, 40)])) for i in range(300)]
    docs += [(300, "long " * 20_000), (None, "no id"), (7, "same"), (7, "same")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit(3)).repartition(5).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    rows = df.select(F.spark_partition_id().alias("p"), "doc_id", "text").collect()
    parts = [[(to.NO_ID if x.doc_id is None else x.doc_id, x.text) for x in rows if x.p == p] for p in sorted({x.p for x in rows})]
    want = brute_sequences(parts, 64)
    out = f"{tmp_path}/out"
    total = write_shards(df, out, key=11, length=64, per_shard=100)
    assert total == len(want)
    order = Permutation(total, 11)
    got = read_shards(spark, out, length=64, per_shard=100).orderBy("slot").collect()
    assert [x.slot for x in got] == list(range(total))
    for x in got:
        assert x.sequence == order.sequence([x.slot])[0] and (x.first_doc, bytes(x.ids)) == want[x.sequence] and x.n_tokens == len(x.ids)
    # a reader resumes at a slot with one seek
    size, slot = to.stride(64), total // 2
    with open(glob.glob(f"{out}/shard={slot // 100}/*.txt")[0], "rb") as f:
        f.seek(slot % 100 * size)
        record = f.read(size)
    assert np.frombuffer(record[:to.HEADER.itemsize], dtype=to.HEADER)["sequence"][0] == got[slot].sequence
    assert len(glob.glob(f"{out}/shard=*/*.txt")) == -(-total // 100)


def test_no_sequences(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    assert write_shards(df, f"{tmp_path}/a", 1) == 0 and to.training_order(df, 1, RANKS, public_tokenizers.PATTERN).count() == 0
    assert to.training_order(df.limit(0), 1, RANKS, public_tokenizers.PATTERN).count() == 0


def test_tokens_in_training_order_give_the_texts_back(spark, tmp_path):
    r = random.Random(8)
    docs = [(i, r.choice([None, "", "Ünïcode 文字 🙂\n" * r.randint(1, 30), "some words <|endoftext|> " * r.randint(1, 400)])) for i in range(120)]
    docs += [(None, "no id"), (7, "same"), (7, "same")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    rows = to.training_order(df, 5, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(x.slot for x in rows) == list(range(len(rows))) and sorted(x.sequence for x in rows) == list(range(len(rows)))
    with open(RANKS, "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    found, ids = [], []
    for x in sorted(rows, key=lambda x: x.sequence):        # a document may run on in the next sequence
        part = np.frombuffer(bytes(x.ids), dtype=np.uint16).tolist()
        assert len(part) == x.n_tokens <= to.LENGTH and to.TOKEN_PAD not in part
        for i in part:
            if i == to.TOKEN_END:
                found.append(codec.decode(ids).decode())
                ids = []
            else:
                ids.append(i)
    assert ids == [] and sorted(found) == sorted(t for _, t in docs if t)

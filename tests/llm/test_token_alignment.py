import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ratewise.llm import queries
from ratewise.llm import token_alignment as T
from ratewise.llm.common import read
from tests.conftest import SMALL

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", "  ", " a  b\n", "\n\nx", "a\n", "a\n b", "a \n b\t\tc  ", "x▁y", "▁", " ▁ a", "日本語 テキスト\n\n です。", "a\r\nb\r\n",
       "<s> </s> <|endoftext|> [INST]", "a b 　c  d", "é é ñ", "\x00a\x01", "😀 👨‍👩‍👧 x", "don't  I'll\n\n\n  we've   ",
       "a \x85 b", "１２３ ４", "a\x1cb \x1d c", "  \n  ", "﻿x", "<0x41> <0x0A>", "z" * 3000, "ab " * 900, "End.Of,words. a.b, (x).\nq.\n", "a.,b ,c .d"]


@pytest.fixture(scope="module")
def pair():
    with open(A, "rb") as a, open(B, "rb") as b:
        return T.Pair(a.read(), b.read())


def brute(pair, text):
    """(a, b, links, groups) of the whole text encoded at once."""
    text = text or ""
    raw = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    if not text or b"".join(x) != raw or b"".join(y) != raw:
        return [], [], [], None
    end_a, end_b = np.cumsum([len(i) for i in x]).tolist(), np.cumsum([len(i) for i in y]).tolist()
    at_a, at_b = [0, *end_a[:-1]], [0, *end_b[:-1]]
    links, j = [], 0
    for i in range(len(a)):
        while j and at_b[j] >= at_a[i]:
            j -= 1
        while j < len(b) and at_b[j] < end_a[i]:
            if end_b[j] > at_a[i]:
                links.append((b[j], a[i]))
            j += 1
        j = min(j, len(b) - 1)
    cuts, groups = sorted(set(end_a) & set(end_b)), []
    ka = kb = 0
    for c in cuts:
        na, nb = ka, kb
        while ka < len(a) and end_a[ka] <= c:
            ka += 1
        while kb < len(b) and end_b[kb] <= c:
            kb += 1
        groups.append(",".join(map(str, a[na:ka])) + "|" + ",".join(map(str, b[nb:kb])))
    return a, b, links, groups


def rows_wanted(pair, rows):
    found = [(i, *brute(pair, t)) for i, t in rows]
    count = Counter(k for f in found for k in f[3])
    most = defaultdict(int)
    for (b, _), n in count.items():
        most[b] = max(most[b], n)
    return [(i, len(a), len(b), len(g or []), len(k), sum(count[x] == most[x[0]] for x in k), sum(count[x] for x in k),
             "" if g is None else hashlib.sha256(";".join(g).encode()).hexdigest()) for i, a, b, k, g in found], count, most


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_pieces_equal_whole_texts(pair):
    assert pair.cuts
    for text, found in zip(ODD, pair.texts(ODD)):
        a, b, links, groups = brute(pair, text)
        got = pair.pairs()[np.frombuffer(b"".join(x.links for x in found), dtype=np.int32)].tolist()
        assert [(k >> 32, k & 0xFFFFFFFF) for k in got] == links, text
        assert (sum(x.n_a for x in found), sum(x.n_b for x in found)) == (len(a), len(b))
        assert ";".join(x.groups for x in found) == ";".join(groups or [])


def test_runs_and_merge():
    rng = np.random.default_rng(3)
    runs, want = [], Counter()
    for _ in range(7):
        keys = np.unique(rng.integers(0, 40, 5000) << 32 | rng.integers(0, 300, 5000))
        n = rng.integers(1, 5, len(keys))
        want.update(dict(zip(keys.tolist(), n.tolist())))
        runs.append(T._pack(keys, n))
        assert [x.tolist() for x in T._unpack(runs[-1])] == [keys.tolist(), n.tolist()]
    pair, n, best = T.merge(runs)
    assert dict(zip(pair.tolist(), n.tolist())) == want and (np.diff(pair) > 0).all()
    most = defaultdict(int)
    for k, v in want.items():
        most[k >> 32] = max(most[k >> 32], v)
    assert best.tolist() == [v == most[k >> 32] for k, v in sorted(want.items())]
    assert [len(x) for x in T.merge([])] == [0, 0, 0]


def test_documents_and_pairs(spark, pair, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, ODD[2]), (101, ODD[2]), (None, "some words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash")).withColumn("lang", F.lit("x"))
    want, count, most = rows_wanted(pair, rows)
    docs, pairs = T.align(df.repartition(3), A, B, keep=("doc_id", "lang", "n_a"), parts=4)
    assert docs.columns == ["doc_id", "lang", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(str, (tuple(r) for r in docs.select("doc_id", *COLS).collect()))) == sorted(map(str, want))
    assert {(r.b, r.a): (r.n, r.best) for r in pairs.collect()} == {k: (n, n == most[k[0]]) for k, n in count.items()}
    docs, pairs = T.align(df.where("false"), A, B)
    assert docs.collect() == [] and pairs.collect() == []


def test_query_against_whole_texts(spark, pair):
    rows = [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_token_alignment"](spark, SMALL).select("doc_id", *COLS).collect()
    assert sorted(tuple(r) for r in got) == sorted(rows_wanted(pair, rows)[0])

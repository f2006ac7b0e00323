import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.llm import bit_slices, near_vectors as nv
from ratewise.llm.bit_slices import top_k
from ratewise.llm.near_vectors import near_vectors
from tests.llm.helpers import roots

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0] * 7 + [None], 1), (903, [1.0] * 7 + [float("nan")], 1),
       (904, [1.0] * 7 + [float("inf")], 1), (905, [1.0] * 8, None), (906, [], 1), (907, [1.0] * 3, 1), (908, [2.0] * 3, 1),
       (909, [1e-40] * 8, 1), (910, [3e38] * 8, 1), (None, [1.0] * 8, 1)]


def vectors(seed, n=260, dim=8):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, dim))
    out = []
    for i in range(n):
        v = centre[r.integers(6)] + r.normal(size=dim) * r.choice([0, 0.02, 0.1, 0.2, 1.0])
        out.append((i, [float(x) for x in np.float32(v * r.choice([1, 5]))], int(r.choice([1, 1, 1, 2, 3]))))
    return out


def valid(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows):
    ids = sorted(i for i, _, _ in rows if i is not None)
    use = [(i, np.float32(v).astype(float), l) for i, v, l in rows if i is not None and valid(v) and l is not None and any(v)]
    links = []
    for a, (i, v, l) in enumerate(use):
        for j, w, m in use[a + 1:]:
            if l == m and len(v) == len(w):
                x, y = v / np.abs(v).max(), w / np.abs(w).max()
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                    links.append((i, j))
    c = roots(ids, links)
    n = {i: 0 for i in ids}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return [(i, n[i], c[i], c[i] == i) for i in ids]


@pytest.mark.parametrize("tile,rows,check", [(2048, 512, 65_536), (16, 8, 7)])
def test_near_vectors(spark, monkeypatch, tile, rows, check):
    monkeypatch.setattr(nv, "TILE", tile)
    data = vectors(3) + ODD
    df = spark.createDataFrame(data, SCHEMA).withColumns({"dim": F.lit(1), "copies": F.lit("x")})
    got = sorted(tuple(r) for r in near_vectors(df).where("vec_id is not null").collect())
    assert got == brute_links(data)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    # the same links whatever the size of the blocks that are multiplied and checked again
    monkeypatch.setattr(nv, "ROWS", rows)
    monkeypatch.setattr(nv, "CHECK", check)
    u = nv.unit(np.array([v for _, v, l in data[:260] if l == 1]))
    pairs = {(a, b) for i, j in nv.tile_links(u, None, 0.98) for a, b in zip(i.tolist(), j.tolist())}
    assert pairs == {(a, b) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.98, 1)))}


def test_a_null_id_has_no_component(spark):
    rows = [(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == got[2] == (1, 1) and got[None][1] is None


def test_quantisation_bound_holds():
    r = np.random.default_rng(1)
    u = nv.unit(r.normal(size=(400, 64)) * r.choice([1e-3, 1, 50], size=(400, 64)))
    q, s, size, err = nv.quantise(u)
    approx = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    bound = size[:, None] * err + err[:, None] * size + err[:, None] * err
    assert (np.abs(u @ u.T - approx) <= bound).all() and bound.max() < 0.05


def test_a_large_group_of_copies_and_near_copies(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=16)
    data = [(i, [float(x) for x in base], 1) for i in range(600)]
    data += [(1000 + i, [float(x) for x in base + r.normal(size=16) * 0.01], 1) for i in range(900)]
    got = near_vectors(spark.createDataFrame(data, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(1499, 0)} and sum(r.kept for r in got) == 1


def brute_top(rows, k):
    use = {i: [math.floor(Fraction(float(x)) * 64) for x in np.float32(v)] for i, v, _ in sorted(
        (r for r in rows if r[0] is not None and valid(r[1])), key=lambda r: r[0])}
    out = []
    for q, v in use.items():
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in use.items() if i != q and len(w) == len(v))
            out += [(q, n + 1, i, max(-2 ** 63, min(2 ** 63 - 1, -x))) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,queries,k", [(8192, 512, 20), (40, 3, 20), (70, 5, 1)])
def test_top_k(spark, monkeypatch, block, queries, k):
    monkeypatch.setattr(bit_slices, "BLOCK", block)
    monkeypatch.setattr(bit_slices, "QUERIES", queries)
    data = vectors(4) + [(i, [0.5, -0.25] * 4, 1) for i in range(300, 340)] + [r for r in ODD if r[0] not in (910, None)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("dim", F.lit("x"))
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, k).collect())
    assert got == brute_top(data, k)


@pytest.mark.parametrize("cell", [1, 8 * 4 * 40 * 3])
def test_top_k_in_cells_of_few_blocks(spark, monkeypatch, cell):
    for name, value in (("BLOCK", 40), ("QUERIES", 3), ("CELL", cell), ("GROUPS", 2), ("MOST_PARTS", 5)):
        monkeypatch.setattr(bit_slices, name, value)
    data = vectors(6, n=400) + [(i, [0.5, -0.25] * 4, 1) for i in range(500, 560)]
    data += [(i, [3e7 * (i % 3 - 1), 1.5] * 4, 1) for i in range(600, 650)]         # wide rows
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute_top(data, 20)


@pytest.mark.parametrize("n", [63, 64, 128])
def test_a_block_of_whole_words(n):
    data = vectors(7, n=n)
    code = np.floor(np.array([v for _, v, _ in data]) * 64).astype(np.int64)
    block = bit_slices.Block(np.arange(n), code)
    want = sorted(range(1, n), key=lambda i: (-(code[i] @ code[0]), i))[:5]
    ids, scores = block.top(code[0], 0, 5)
    assert sorted(ids) == sorted(want) and set(scores) == {code[i] @ code[0] for i in want}


def test_a_block_is_not_sent_to_every_group_of_queries(spark):
    n, dim, tasks = 1_500_000, 98, 24
    blocks = spark.createDataFrame([(dim, False, -(-n // bit_slices.BLOCK))], "dim int, block_wide boolean, blocks long")
    queries = spark.createDataFrame([(dim, False, -(-n // 20 // bit_slices.QUERIES))], "dim int, query_wide boolean, querys long")
    (cell,) = bit_slices.grid(blocks, queries, tasks).collect()
    sent = n * dim * cell.across + n // 20 * dim * cell.down        # bytes, at one a code
    assert sent < n * dim * 4 and cell.across * cell.down >= tasks
    rows = bit_slices.usable(spark.createDataFrame([(i, [i / 100 - 1, 0.5], 1) for i in range(100)], SCHEMA), "vec_id", "embedding")
    (block,) = bit_slices._packed(rows, bit_slices._counts(rows, 8192, "block"), "block").collect()
    assert len(block.block_codes) == 100 * 2                        # a byte a code where that is enough


def test_top_k_of_few_rows(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    assert top_k(spark.createDataFrame([(20, [1.0], 1)], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    three = spark.createDataFrame([(20, [1.0], 1), (3, [-2.0], 1), (7, [-2.0], None)], SCHEMA)
    assert [tuple(r) for r in top_k(three, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(20, 1, 3, -8192), (20, 2, 7, -8192)]


def test_codes_of_any_size(spark):
    wide = "vec_id long, embedding array<double>, label long"
    rows = [(0, [1.0, 0.0]), (1, [2e6, 0.0]), (2, [3e6, 0.0]), (3, [1e300, 0.0]), (4, [1.7e308, 1.0]), (5, [-1e300, 5.0]), (20, [1e300, -7.5]),
            (6, [2.0 ** 20, 0.3]), (7, [-(2.0 ** 20), 0.3]), (8, [0.25, 1e-300]), (40, [-1e18, 3.0]), (9, [1e18, 3.0])]
    use = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in rows}
    want = []
    for q in (0, 20, 40):
        s = sorted((-sum(a * b for a, b in zip(use[q], w)), i) for i, w in use.items() if i != q)
        want += [(q, n + 1, i, max(-2 ** 63, min(2 ** 63 - 1, -x))) for n, (x, i) in enumerate(s)]
    df = spark.createDataFrame([(*r, 1) for r in rows], wide)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == sorted(want) and (0, 11, 5, -2 ** 63) in got and (0, 5, 2, 64 * 64 * 3_000_000) in got

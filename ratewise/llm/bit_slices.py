"""Exact top-k inner products with a bit-sliced index.

Each component x becomes the whole number floor(64 x). The index holds, per
block of about ``BLOCK`` rows, one bitmap over the block's rows for every bit of
every attribute (component), counted from the block's least value of the
attribute. A query adds its score to all rows of a block at once, with bitmap
arithmetic only: bit i of an attribute, times bit j of the query's component,
is a bitmap of weight 2^(i+j); a negative component takes the complemented
bitmaps, and constants make up for it. Carry-save adders reduce the bitmaps of
each weight to one, which are the slices of the score.

The top rows are then selected from the most significant slice downward: rows
that are set in a slice come before those that are not, until exactly k rows are
in, or rows with equal scores stand at the boundary; of these the smallest ids
are taken, and the scores of the chosen rows are products computed in full.
Blocks' answers meet in one top-k per query.

The queries are a stated set of rows against all rows. Index blocks and groups of
``QUERIES`` queries are dealt to a grid of cells: a task holds one cell, of at most
``CELL`` bytes of blocks and of queries (or one block and one group), and keeps the k best rows of a
query over the cell's blocks. A block is sent once a column of the grid, a group of queries once
a row of it, in as few bytes a code as the largest needs.

A vector takes no part, as query or candidate, when it is null or empty or holds
a null or non-finite component. Only vectors of equal length meet. An id that
repeats is one row, the smallest vector in array order; a null id takes no
part. A query's own id is no candidate. Ties go to the smaller id. Extra
columns are ignored; an empty table gives an empty result.

Codes have no bound: a finite double is a whole number times a power of two, and rows
with a code of 2^26 or more lie in blocks of their own, which get as many
slices as they need and whole-number products of any length. Ranks follow the true
scores. A score outside a long's range is shown as the nearest long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import cut_lineage, ship_package

SCALE = 64
BLOCK = 8192
QUERIES = 512
CELL = 2 ** 26          # bytes of codes, at four a code, that a task holds of blocks, and of queries
GROUPS = 64             # groups of queries that a task holds at most: their best rows are held, too
MOST_PARTS = 2000       # partitions that cells are dealt to
LIMIT = 2 ** 26
_WORD = 64


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, wide): the vectors that take part; ``wide`` if a code is beyond +-``LIMIT``."""
    x = F.col("v")
    whole = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size(x) > 0)
    return (df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(whole).alias("v"))
            .where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
            .groupBy("id").agg(F.min("v").alias("v"))
            .withColumn("wide", F.exists("v", lambda e: F.abs(e) >= LIMIT / SCALE)))


def _codes(packed: bytes, rows: int, dim: int, wide: bool) -> np.ndarray:
    """The whole numbers floor(64 x) of packed vectors: int64, or Python's numbers of any length."""
    if not wide:
        size = len(packed) // (rows * dim)
        return np.frombuffer(packed, dtype=f"i{size}").astype(np.int64).reshape(rows, dim)
    v = np.frombuffer(packed, dtype=np.float64)     # from 2^46 on a double is whole, and times 64 might be none
    return np.array([int(x) * SCALE if abs(x) >= 2.0 ** 46 else math.floor(x * SCALE) for x in v.tolist()],
                    dtype=object).reshape(rows, -1)


def _order_key(score: int) -> bytes:
    """Bytes that sort as whole numbers of any size do."""
    size = (abs(score).bit_length() + 7) // 8
    digits = abs(score).to_bytes(size, "big")
    if score >= 0:
        return b"\x01" + size.to_bytes(4, "big") + digits
    return b"\x00" + (2 ** 32 - 1 - size).to_bytes(4, "big") + bytes(255 - b for b in digits)


def _pack(rows: np.ndarray) -> np.ndarray:
    """Booleans (..., rows) to bitmaps (..., words)."""
    n = rows.shape[-1]
    pad = -n % _WORD
    rows = np.concatenate([rows, np.zeros((*rows.shape[:-1], pad), dtype=bool)], axis=-1) if pad else rows
    # a transposed array packs to one whose last axis is not in one piece, which has no other view
    return np.ascontiguousarray(np.packbits(rows, axis=-1, bitorder="little")).view(np.uint64)


class Block:
    """A block's bitmaps: ``slices[i]`` (attributes, words) holds bit i."""

    def __init__(self, ids: np.ndarray, code: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.code = ids[order], code[order]
        self.low = self.code.min(axis=0)
        up = self.code - self.low
        self.bits = max(1, int(up.max()).bit_length())
        self.slices = np.stack([_pack(((up >> i) & 1).astype(bool).T) for i in range(self.bits)])
        self.all = _pack(np.ones(len(ids), dtype=bool))

    def scores(self, q: np.ndarray) -> list[np.ndarray]:
        """The slices of q . row (plus a constant), least significant first."""
        size, negative = np.abs(q), (q < 0).astype(bool)
        base = self.slices ^ np.where(negative, ~np.uint64(0), np.uint64(0))[None, :, None]
        planes: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max()).bit_length()):
            has = np.flatnonzero(((size >> j) & 1).astype(bool))
            if len(has):
                for i in range(self.bits):
                    planes.setdefault(i + j, []).append(base[i][has])
        out, weight = [], 0
        while planes:
            p = planes.pop(weight, None)
            if p is None:
                out.append(np.zeros_like(self.all))
                weight += 1
                continue
            p = np.concatenate(p)
            carries = []
            while len(p) > 1:                       # full adders: three bitmaps to a sum and a carry
                n = len(p) // 3
                if n:
                    a, b, c = p[:n], p[n:2 * n], p[2 * n:3 * n]
                    ab = a ^ b
                    carries.append((a & b) | (ab & c))
                    p = np.concatenate([ab ^ c, p[3 * n:]])
                else:                               # two left: a half adder
                    carries.append((p[:1] & p[1:]))
                    p = p[:1] ^ p[1:]
            if carries:
                planes.setdefault(weight + 1, []).extend(carries)
            out.append(p[0])
            weight += 1
        return out

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, the query's own id left out."""
        rest = self.all.copy()
        at = np.searchsorted(self.ids, own)
        if at < len(self.ids) and self.ids[at] == own:
            rest[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        chosen = np.zeros_like(rest)
        for s in reversed(self.scores(q)):
            x = chosen | (rest & s)
            n = int(np.bitwise_count(x).sum())
            if n > k:
                rest &= s
            else:
                chosen = x
                rest &= ~s
                if n == k:
                    break
        rows = self._rows(chosen)
        if len(rows) < k:                           # equal scores at the boundary: rows are in order of id
            rows = np.concatenate([rows, self._rows(rest)[:k - len(rows)]])
        return self.ids[rows], self.code[rows] @ q

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:len(self.ids)])


_NO_ID = np.iinfo(np.int64).max
_NO_SCORE = -(2 ** 63 - 1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line's candidates the k best, smaller ids first where scores are equal."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _search(k: int):
    """The k best rows of every query of a cell over the cell's blocks."""
    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table, asked: pa.Table) -> pa.Table:
        dim, wide_rows, wide_queries = (x.as_py() for x in key[:3])
        wide = wide_rows or wide_queries
        own, queries = [], []
        for r in (asked.to_pylist() if len(blocks) else []):
            ids = np.frombuffer(r["query_ids"], dtype=np.int64)
            own.append(ids)
            queries.append(_codes(r["query_codes"], len(ids), dim, wide_queries))
        own = np.concatenate(own) if own else np.empty(0, dtype=np.int64)
        best_ids = np.full((len(own), k), _NO_ID)
        best_scores = np.full((len(own), k), _NO_SCORE)
        lists: list[list] = [[] for _ in own] if wide else []
        for i in range(len(blocks) if len(own) else 0):
            ids = np.frombuffer(blocks["block_ids"][i].as_py(), dtype=np.int64)
            block = Block(ids, _codes(blocks["block_codes"][i].as_py(), len(ids), dim, wide_rows))
            more_ids, more_scores = np.full((len(own), k), _NO_ID), np.full((len(own), k), _NO_SCORE)
            for n, q in enumerate(q for group in queries for q in group):
                found, score = block.top(q.astype(object) if wide else q, own[n], k)
                if wide:
                    lists[n] = sorted(lists[n] + [(-int(x), int(y)) for x, y in zip(score, found)])[:k]
                else:
                    more_ids[n, :len(found)], more_scores[n, :len(found)] = found, score
            if not wide:
                best_ids, best_scores = _best(np.hstack([best_ids, more_ids]), np.hstack([best_scores, more_scores]), k)
        if wide:
            a = np.repeat(own, [len(x) for x in lists])
            found = [x for each in lists for x in each]
            out = [a, [y for _, y in found], [max(-2 ** 63, min(2 ** 63 - 1, -x)) for x, _ in found], [_order_key(-x) for x, _ in found]]
        else:
            a = np.repeat(own, k)
            has = best_ids.ravel() != _NO_ID
            has |= best_scores.ravel() != _NO_SCORE
            out = [a[has], best_ids.ravel()[has], best_scores.ravel()[has], [None] * int(has.sum())]
        return pa.table([pa.array(x, t) for x, t in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.binary()])],
                        names=["query_id", "vec_id", "score", "key"])
    return run


def _packed(rows: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Rows dealt to the blocks that ``counts`` has for their length by a hash of their id, one row a block; wide rows lie apart."""
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows_ = table.combine_chunks()
        dim, wide, number = (x.as_py() for x in key)
        v = rows_["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows_), -1)
        if not wide:
            v = np.floor(v * SCALE)
            v = v.astype(np.min_scalar_type(min(int(v.min()), -1 - int(v.max()), -1)))
        return pa.table({f"{name}_ids": pa.array([rows_["id"].to_numpy().tobytes()], pa.binary()), f"{name}_codes": pa.array([v.tobytes()], pa.binary()),
                         "dim": pa.array([dim], pa.int32()), f"{name}_wide": pa.array([wide], pa.bool_()),
                         f"{name}_no": pa.array([number], pa.int64())})
    dealt = (rows.withColumn("dim", F.size("v")).join(counts.withColumnRenamed(f"{name}_wide", "wide"), ["dim", "wide"])
             .withColumn("block", F.pmod(F.xxhash64("id", F.lit(name)), F.col(f"{name}s"))).select("id", "v", "dim", "wide", "block"))
    return dealt.groupBy("dim", "wide", "block").applyInArrow(
        pack, f"{name}_ids binary, {name}_codes binary, dim int, {name}_wide boolean, {name}_no long")


def _counts(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(dim, <name>_wide, <name>s): the number of blocks of about ``size`` rows for each vector length."""
    return (rows.groupBy(F.size("v").alias("dim"), F.col("wide").alias(f"{name}_wide"))
            .agg(F.ceil(F.count(F.lit(1)) / size).alias(f"{name}s")))


def grid(blocks: DataFrame, queries: DataFrame, tasks: int) -> DataFrame:
    """(dim, block_wide, query_wide, across, down): the grid of cells for each vector length.
    Blocks are dealt to ``down`` rows, query groups to ``across`` columns, as many as memory asks
    for, and more where they are fewer than ``tasks`` cells."""
    most = F.greatest(F.lit(1), F.floor(F.lit(CELL) / (F.col("dim") * 4 * BLOCK)))
    most_q = F.greatest(F.lit(1), F.least(F.lit(GROUPS), F.floor(F.lit(CELL) / (F.col("dim") * 4 * QUERIES))))
    least = blocks.join(queries, "dim").withColumns({"down": F.ceil(F.col("blocks") / most), "across": F.ceil(F.col("querys") / most_q)})
    least = least.withColumn("down", F.least("blocks", F.greatest("down", F.ceil(tasks / F.col("across")))))
    return (least.withColumn("across", F.least("querys", F.greatest("across", F.ceil(tasks / F.col("down")))))
            .select("dim", "block_wide", "query_wide", F.col("across").cast("int"), F.col("down").cast("long")))


def top_k(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every row that
    ``queries`` (a condition on ``vec_id``) names."""
    ship_package(df.sparkSession)
    rows = cut_lineage(usable(df, key, vector))
    asked = rows.withColumn(key, F.col("id")).where(queries).drop(key)
    n_blocks, n_queries = _counts(rows, BLOCK, "block"), _counts(asked, QUERIES, "query")
    cells = cut_lineage(grid(n_blocks, n_queries, 4 * df.sparkSession.sparkContext.defaultParallelism))  # few rows a vector length
    n_cells = cells.agg(F.sum(F.col("across") * F.col("down"))).first()[0] or 1
    at = ["dim", "block_wide", "query_wide", "_down", "_across"]
    held = (_packed(rows, n_blocks, "block").join(cells, ["dim", "block_wide"])
            .withColumn("_down", F.pmod("block_no", "down")).withColumn("_across", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
            .select(*at, "block_ids", "block_codes"))
    come = (_packed(asked, n_queries, "query").join(cells, ["dim", "query_wide"])
            .withColumn("_across", F.pmod("query_no", "across").cast("int"))
            .withColumn("_down", F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)))
            .select(*at, "query_ids", "query_codes"))
    # small cells are much work, so partitions are not to be merged by their bytes
    held, come = (x.repartition(min(n_cells, MOST_PARTS), *at) for x in (held, come))
    found = held.groupBy(*at).cogroup(come.groupBy(*at)).applyInArrow(_search(k), "query_id long, vec_id long, score long, key binary")
    if rows.where("wide").take(1):              # scores of any length
        exact = F.udf(_order_key, "binary")
        found = found.withColumn("key", F.coalesce("key", exact("score")))
    else:
        found = found.withColumn("key", F.col("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

"""Vectors of one label whose cosine reaches a threshold, and their components.

Distinct vectors are dealt to tiles of about ``TILE`` rows of their label and
dimension; every pair of a label's tiles is one task's work. There each vector,
scaled to length 1 in double precision, is quantised to int8 with a scale of
its own. With x = s q + e, the true product differs from the quantised one by
at most |sq_x| |e_y| + |e_x| |sq_y| + |e_x| |e_y|, all measured, so a pair whose
quantised product plus this bound stays under the threshold is certainly no
link, one whose product minus the bound reaches it certainly is, and only the
others are computed again from the double-precision vectors.

A task returns no pairs: per vector the number of its links, and a spanning
forest of the links between its two tiles, so the output stays in proportion to
the rows even where thousands of vectors are close to each other. Equal vectors
of a label count as one with a multiplicity.

A vector takes no part (no links, its own component) when it or its label is
null, it is empty or zero, or holds a null or non-finite component. Only
vectors of equal length are compared. An id that repeats is one vector, the
smallest of its rows in array order. A null id takes no part and has a null
component. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import cut_lineage, ship_package
from ratewise.llm.components import components

TILE = 2048
ROWS = 512              # of a tile that are multiplied at once
CHECK = 65_536          # pairs that are computed again at once


def usable(v: str) -> Column:
    """The vector is not null, empty or zero and all its components are finite."""
    x = F.col(v)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda e: e != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; a power of two keeps extreme rows from over- or underflow."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    v = np.ldexp(vectors, -np.frexp(top)[1])
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, the length of the coded vector and of the error."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    coded = q * scale[:, None]
    slack = 1e-12                                   # covers the rounding of these sums themselves
    return q, scale, np.sqrt((coded ** 2).sum(axis=1)) + slack, np.sqrt(((u - coded) ** 2).sum(axis=1)) + slack


class _Forest:
    """A spanning forest of links, so far, over 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while (p[p] != p).any():
            p = p[p]
        self.parent = p
        return p.copy()

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Takes links in; returns those that joined two trees."""
        out = []
        while True:
            root = self.roots()
            ri, rj = root[i], root[j]
            open_ = ri != rj
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            if not len(i):
                return out
            # each larger root hangs on a smaller one: no cycle can arise
            high, take = np.unique(np.maximum(ri, rj), return_index=True)
            self.parent[high] = np.minimum(ri, rj)[take]
            out += zip(i[take].tolist(), j[take].tolist())


def tile_links(left: np.ndarray, right: np.ndarray | None, threshold: float):
    """Yields (i, j) index arrays of the links between the rows of two tiles,
    or within ``left`` (i < j) when ``right`` is None."""
    same = right is None
    a, b = left, left if same else right
    qa, qb = quantise(a), quantise(b)
    kind = np.float32 if a.shape[1] * 127 ** 2 < 2 ** 24 else np.float64     # products of codes stay whole numbers
    bt = np.ascontiguousarray(qb[0].astype(kind).T)
    for at in range(0, len(a), ROWS):
        q, s, size, err = (x[at:at + ROWS] for x in qa)
        product = (q.astype(kind) @ bt).astype(np.float64) * s[:, None] * qb[1]
        bound = size[:, None] * qb[3] + err[:, None] * qb[2] + err[:, None] * qb[3]
        maybe = product + bound >= threshold - 1e-9
        if same:
            maybe &= np.arange(len(b)) > (at + np.arange(len(q)))[:, None]
        i, j = np.nonzero(maybe)
        sure = (product - bound)[i, j] >= threshold + 1e-9
        i += at
        keep = sure.copy()
        open_ = np.flatnonzero(~sure)
        for k in range(0, len(open_), CHECK):
            p = open_[k:k + CHECK]
            keep[p] = np.einsum("ij,ij->i", a[i[p]], b[j[p]]) >= threshold
        yield i[keep], j[keep]


def _compare(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return pd.DataFrame({"id": [], "links": [], "other": []}, dtype="int64")
        u = unit(np.array(rows["vector"].tolist(), dtype=np.float64))
        ids, copies, first = rows["id"].to_numpy(), rows["copies"].to_numpy(), rows["first"].to_numpy()
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        within = not len(right)
        links, edges, forest = np.zeros(len(ids), dtype=np.int64), [], _Forest(len(ids))
        for i, j in tile_links(u[left], None if within else u[right], threshold):
            i, j = left[i], (left if within else right)[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            edges += forest.add(i, j)
        got = np.flatnonzero(links)
        e = ids[np.array(edges, dtype=np.int64).reshape(-1, 2)]
        none = np.arange(len(got) + len(e)) < len(got)
        other = np.concatenate([np.zeros(len(got), dtype=np.int64), e[:, 1]])
        return pd.DataFrame({"id": np.concatenate([ids[got], e[:, 0]]),
                             "links": np.concatenate([links[got], np.zeros(len(e), dtype=np.int64)]),
                             "other": pd.arrays.IntegerArray(other, none)})
    return run


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 threshold: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept): how many other vectors link to it,
    the smallest id that links reach, and whether that is its own."""
    ship_package(df.sparkSession)
    one = (df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
           .groupBy("id").agg(F.min(F.when(usable("vector") & F.col("label").isNotNull(), F.struct("vector", "label"))).alias("v"))
           .select("id", "v.vector", "v.label"))
    one = cut_lineage(one)
    # equal vectors as one
    distinct = cut_lineage(one.where(F.col("vector").isNotNull() & F.col("id").isNotNull())
                           .groupBy("label", F.size("vector").alias("dim"), "vector")
                           .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    tiles = distinct.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    dealt = (distinct.join(tiles, ["label", "dim"])
             .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("long"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
             .select("label", "dim", "id", "copies", "vector",
                     F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"),
                     (F.col("tile") <= F.col("other")).alias("first")))
    found = cut_lineage(dealt.groupBy("label", "dim", "a", "b")
                        .applyInPandas(_pair(threshold), "id long, links long, other long"))
    links = found.where(F.col("other").isNull()).groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where(F.col("other").isNotNull()).select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = (distinct.join(links, "id", "left").join(roots, "id", "left")
             .select("label", "vector", F.col("copies") - 1 + F.coalesce("links", F.lit(0)),
                     F.coalesce("root", "id")).toDF("label", "vector", "n_links", "component_id"))
    return (one.join(known, ["label", "vector"], "left")
            .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
            .withColumn("kept", F.col(key) == F.col("component_id")))


def _pair(threshold: float):
    """Compares the two tiles of a task; a tile paired with itself marks all its rows ``first``."""
    compare = _compare(threshold)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[2] != key[3] and (rows["first"].all() or not rows["first"].any()):
            rows = rows.iloc[:0]                    # the other tile got no row
        return compare(rows)
    return run

"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and at least max(``min_words``, 2 q) words that no neighbouring
word extends keeping period q.

Every factor (stretch of words) of a power-of-two length L gets a name, equal
names for equal factors of one text; a name of length 2 L is the pair of the
names of its halves, and factors that occur once are forgotten, as nothing
longer over them can repeat. Per L the occurrences of a name, in order of place,
form arithmetic progressions where neighbours are at most L / 2 apart (their
difference is then the factor's period); what lies between two progressions is
more than L / 2, so at most three of them follow within 2 L. A run of period q
with L <= q < 2 L repeats a factor of length L at distance q, and then for some
name either

* the last members of two progressions, or
* a member of one and the first member of another

are q apart: where the run holds an end of a progression, the same end comes
again q later; where it holds none, the second progression starts with the
run's second period. These distances are proposed, each is extended to both
sides through the dictionary (a few comparisons per power of two), and of equal
stretches the smallest period stays. So no run is lost, and the work of a text
of n words is O(n log n) at worst, far less where little repeats.

Several texts are worked on at once (names differ between texts); a text longer
than ``SLICE_WORDS`` is a slice of its own, whole. Memory is linear in the words
of a slice times the powers of two that repeat.

Null and empty texts and texts without words have no runs and collapse to the
empty string. Repeated rows each get their row; an empty table gives an empty
table. Columns of the input pass through, those named ``runs`` or ``collapsed``
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import ship_package

SLICE_WORDS = 60_000
RUNS_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _names(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Names of single words (other ones in every text) and the texts' bounds."""
    out, base, bounds = [], 0, [0]
    for words in texts:
        seen: dict[bytes, int] = {}
        ids = [seen.setdefault(w, len(seen)) for w in words]
        out.append(np.array(ids, dtype=np.int64) + base)
        base += len(seen)
        bounds.append(bounds[-1] + len(words))
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(bounds, dtype=np.int64)


def _repeated(where: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Dense names of the keys at the places ``where``; -1 elsewhere and for keys that occur once."""
    level = np.full(n + 1, -1, dtype=np.int64)
    if len(where):
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[name] > 1
        level[where[again]] = name[again]
    return level


def _proposals(level: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs with size <= period < 2 * size, see the module's text."""
    at = np.flatnonzero(level >= 0)
    at = at[np.argsort(level[at], kind="stable")]
    name = level[at]
    near = (name[1:] == name[:-1]) & (2 * (at[1:] - at[:-1]) <= size)
    lo = np.flatnonzero(np.concatenate([[True], ~near]))
    hi = np.concatenate([lo[1:], [len(at)]]) - 1
    first, last, of = at[lo], at[hi], name[lo]
    places, periods = [], []
    for step in (1, 2, 3):
        if len(lo) <= step:
            break
        g = np.flatnonzero((of[:-step] == of[step:]) & (first[step:] - last[:-step] < 2 * size))
        h = g + step
        many = hi[g] - lo[g] + 1
        member = np.repeat(lo[g] - np.cumsum(many) + many, many) + np.arange(many.sum())
        places += [at[member], last[g]]
        periods += [np.repeat(first[h], many) - at[member], last[h] - last[g]]
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, period = np.concatenate(places), np.concatenate(periods)
    fits = (period >= size) & (period < 2 * size)
    return place[fits], period[fits]


def _extend(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretch around x on which every word equals the one y - x after it: its first place and the place behind its last."""
    left, right, apart = x.copy(), x.copy(), y - x
    for k in range(len(levels) - 1, -1, -1):
        level, size = levels[k], 1 << k
        a = level[right]
        right += np.where((a >= 0) & (a == level[np.minimum(right + apart, n)]), size, 0)
        back = np.where(left >= size, left - size, n)
        a = level[back]
        left -= np.where((a >= 0) & (a == level[np.minimum(back + apart, n)]), size, 0)
    return left, right


def find_runs(texts: list[list[bytes]], min_words: int = 12) -> list[np.ndarray]:
    """Per text its runs, an array of rows (start, length, period) by start, then period."""
    names, bounds = _names(texts)
    n = len(names)
    end = np.repeat(bounds[1:], np.diff(bounds))
    levels, places, periods = [], [], []
    level, size = _repeated(np.arange(n), names, n), 1
    while (level >= 0).any():
        levels.append(level)
        place, period = _proposals(level, size)
        places.append(place)
        periods.append(period)
        at = np.flatnonzero(level >= 0)
        at = at[at + 2 * size <= end[at]]
        at = at[level[at + size] >= 0]
        level, size = _repeated(at, level[at] * (n + 1) + level[at + size], n), 2 * size
    if not levels:
        return [np.zeros((0, 3), np.int64) for _ in texts]
    key = np.unique(np.concatenate(periods) * (n + 1) + np.concatenate(places))
    key = key[np.diff(key, prepend=-2) != 1]        # one of the neighbours that lie in one stretch
    period, place = np.divmod(key, n + 1)
    start, stop = _extend(levels, place, place + period, n)
    length = stop + period - start
    fits = length >= np.maximum(min_words, 2 * period)
    start, length, period = start[fits], length[fits], period[fits]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = (np.diff(start, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0)
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    rows = np.column_stack([start, length, period])[order]
    cuts = np.searchsorted(rows[:, 0], bounds)
    return [rows[cuts[i]:cuts[i + 1]] - [bounds[i], 0, 0] for i in range(len(texts))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    turn = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(turn, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turn, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(turn[:-1]) == 0)])


def _slices(texts):
    out, size = [], 0
    for text in texts:
        words = (text.as_py() or b"").split()       # at bytes 0x20 and 0x09-0x0D
        if out and size + len(words) > SLICE_WORDS:
            yield out
            out, size = [], 0
        out.append(words)
        size += len(words)
    if out:
        yield out


def periodic_runs(df: DataFrame, text: str | Column = "text", min_words: int = 12) -> DataFrame:
    """Adds ``runs`` (start in words, length, period; by start, then period) and
    ``collapsed``, the text's words without those that repeat a run's first period."""
    ship_package(df.sparkSession)

    @F.arrow_udf(f"struct<runs: {RUNS_TYPE}, collapsed: binary>")
    def run(column: pa.Array) -> pa.Array:
        parts, counts, short = [np.zeros((0, 3), np.int64)], [0], []
        for texts in _slices(column):
            for words, runs in zip(texts, find_runs(texts, min_words)):
                parts.append(runs)
                counts.append(len(runs))
                short.append(collapse(words, runs))
        rows = np.concatenate(parts)
        found = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), found)
        return pa.StructArray.from_arrays([lists, pa.array(short, pa.binary())], ["runs", "collapsed"])
    column = F.col(text) if isinstance(text, str) else text
    out = df.withColumn("_runs", run(column.cast("binary")))
    return out.withColumns({"runs": F.col("_runs.runs"), "collapsed": F.col("_runs.collapsed").cast("string")}).drop("_runs")

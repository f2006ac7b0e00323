"""Toxicity by class-conditional Kneser-Ney models.

A text is read word by word (lower-cased A-Z, cut at white space, a space before and
after each), and every byte to the word's end is predicted from its history, the bytes
of the word before it. With c the class's count of a history or of a history and its
next byte, D the discount and b the number of distinct words of either class that hold
them (the shared backoff counts),

    P_c(next | history) = max(c(history next) - D, 0) / c(history)
                          + spared_c(history) * b(history next) / b(history)

where ``spared`` is what the discount freed after the history. With ``order`` the shared
counts are discounted too, and what that frees goes to the next shorter histories, of at
most ``order`` - 1 bytes: b(history next) / b(history) becomes P(next | history) with

    P(next | history) = max(b(history next) - D, 0) / b(history)
                        + spared_b(history) * P(next | shorter history)

where the b of a shorter history and a byte is the number of distinct bytes before them
in the words of either class (the continuation counts), and no history at all shares out
over the 256 bytes. These are at most 256 ** ``ORDER`` numbers whatever the corpus, so every
task has all of them; a longer history backs off to them at once. Histories begin with
the word: with those that reach into the words before, rare neighbours hide what is toxic
(README). A class that never saw a history has the shared counts alone. A byte that neither class saw after a history is
left to shorter histories, whose counts are shared, so that only what each class freed
for it differs; after a history that neither class saw, nothing does. So rare
expressions get nearly the same probability from either class.

A word's log ratio is the sum of its bytes' log ratios. Toxic documents are ordinary
text with toxic expressions mixed in, so a word's evidence is how far its log ratio
exceeds ``FLOOR``, at most ``SPAN``: neither the many words that are a little likelier
in one class nor single words that are far likelier outweigh the rest. A document's
evidence is the sum over its words divided by their number (plus ``SHORT``, which damps
very short texts): the length-normalised difference of the log-likelihoods. A logistic
curve maps its logarithm to 0-1; it is fitted on training rows, each scored by a
model that left its fold out.

A word of more than ``STRETCH`` bytes (scripts without spaces, encoded data) is read in
stretches that are judged like words, each with ``HISTORY`` bytes before it as its first
history, so every byte of every text is read once.

Counts cover every labelled training row and stay in a table of distinct words. Words to
be judged are sorted together with them into ranges of about ``RANGE`` words, where
words with a common beginning are neighbours, so a range knows all histories but
those at its two ends; what each range has of these is added up over the ranges
before. No history becomes a row, and a beginning that many words share only takes more
ranges. A text's words that are among the ``COMMON`` most frequent are looked up in
place (a bounded table of finished evidence, the same numbers). Evidence is summed in
whole numbers, so the order of rows changes nothing. Equal texts are told by their
md5. The curve is fitted on about ``FIT_ROWS`` rows.

Texts without words score as text without evidence. Null texts count as empty. Rows
that share an id or a text are scored each; a null id is never learnt from. Columns of the input
pass through, those named ``score`` or ``predicted`` are replaced; an empty
documents table gives an empty result and (with labels) learns nothing. Labels other
than 0 and 1 are ignored; a document labelled twice is toxic if any label says so.
Without labels of both classes every score is the share of toxic labels (0.0 without any).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import cut_lineage, ship_package
from ratewise.session import scratch_path

HISTORY = 8
ORDER = 3                # bytes of a shorter history and the next one, at most
STRETCH = 32
DISCOUNT = 0.75
FLOOR = 3.0
SPAN = 3.0
LEAST = 0.001            # evidence a word that every text has, so that there is a logarithm
SHORT = 20
COMMON = 100_000
RANGE = 250_000
BITS = 2 ** 22
UNIT = 2 ** 24
FIT_ROWS = 20_000
FOLDS = 5
FLUSH = 300_000
PARTS = tuple(range(1, FOLDS))        # the remainders that are learnt from
CELLS = tuple(f"{c}{k}" for c in "ot" for k in PARTS)   # ordinary and toxic by remainder


def words(text: bytes | None) -> list[bytes]:
    """What is judged as a word: its bytes between two spaces. A later stretch of a
    long word starts with its history instead of a space."""
    out = []
    for w in (text or b"").lower().split():
        w = b" %b " % w
        if len(w) <= STRETCH + 2:
            out.append(w)
        else:
            out.append(w[:STRETCH])
            out += [w[i - HISTORY:i + STRETCH] for i in range(STRETCH, len(w), STRETCH)]
    return out


def _cut(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for the tables with a row a word of a text, packed tighter."""
    spark = df.sparkSession
    path = scratch_path(spark, "words")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def _class_labels(labels: DataFrame) -> DataFrame:
    return (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic")))


def _count(batches):
    """Word counts by cell, summed per task, and the rows of the fitting sample."""
    counts: tuple[Counter, ...] = tuple(Counter() for _ in CELLS)
    schema = pa.schema([("word", pa.binary()), ("cell", pa.int32()), ("n", pa.int64()), ("text", pa.binary())])

    def flush():
        w = [x for c in counts for x in c]
        out = pa.record_batch([pa.array(w, pa.binary()),
                               pa.array([k for k, c in enumerate(counts) for _ in range(len(c))], pa.int32()),
                               pa.array([n for c in counts for n in c.values()], pa.int64()),
                               pa.nulls(len(w), pa.binary())], schema=schema)
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        texts, cells, fit = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for text, cell in zip(texts, cells):
            counts[cell].update(words(text.as_py()))
            if sum(map(len, counts)) > FLUSH:
                yield flush()
        take = [i for i, f in enumerate(fit) if f]
        if take:
            yield pa.record_batch([pa.nulls(len(take), pa.binary()), pa.array([cells[i] for i in take], pa.int32()),
                                   pa.nulls(len(take), pa.int64()), texts.take(take)], schema=schema)
    yield flush()


@dataclass
class Model:
    """``counts`` is a table in the shared folder: every training word with its counts by
    cell; ``shorter`` has the shared counts' probabilities after shorter histories; ``common`` holds the evidence of the most frequent words, so that most
    words of a text need no look-up there, in whole numbers of 1 / ``UNIT``."""
    counts: DataFrame | None = None
    shorter: Broadcast | None = None      # by length: sorted grams and P(last byte | those before it)
    common: dict[bytes, int] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def _constant(share: float) -> Model:
    return Model(constant=share)


def feature(evidence: float) -> float:
    return math.log(LEAST + evidence)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature, by Newton's steps with a weak ridge."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _group(kind: str, without: int | None = None) -> tuple[str, ...]:
    return tuple(f"{kind}{k}" for k in PARTS if k != without)


GROUPS = tuple(_group(kind, k) for k in (None, *PARTS) for kind in "ot")


# Groups of cells as sums over the cells: all training rows, then without each part; ordinary and toxic by turns.
_SUMS = np.array([[float(c in g) for g in GROUPS] for c in CELLS])
_ENDS = ([f"g{k}" for k in range(len(CELLS))] + ["places"] + [f"h{k}" for k in range(len(CELLS))] + ["history_places"]
         + [f"s{k}" for k in range(len(GROUPS) + 1)])      # the last: of the places


class Range:
    """A table of sorted distinct words with their counts (cells; places: 1 for a training word), level by level."""

    def __init__(self, table: pa.Table):
        self.words = table.column("word").to_pylist()
        self.cells = np.column_stack([table.column(c).to_numpy() for c in CELLS]).astype(float)
        self.places = table.column("places").to_numpy().astype(float)
        self.length = np.array([len(w) for w in self.words])
        grid = np.zeros((len(self.words), self.length.max()), dtype=np.uint8)
        grid[np.arange(grid.shape[1]) < self.length[:, None]] = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        differ = np.ones((len(self.words), grid.shape[1] + 1), dtype=bool)
        differ[1:, :-1] = grid[1:] != grid[:-1]
        self.common = np.minimum(differ.argmax(axis=1), np.minimum(self.length, np.roll(self.length, 1)))    # bytes shared with the word before
        self.common[0] = 0
        self.grid = grid
        self.first = np.where([w.startswith(b" ") for w in self.words], 2, HISTORY + 1)

    def levels(self):
        """Per level (length of history and byte): the rows that reach it, the number of each
        one's node there and of its history, and the nodes' cells and places."""
        before = np.zeros(len(self.words), dtype=np.int64)
        for level in range(1, int(self.length.max()) + 1):
            rows = np.flatnonzero(self.length >= level)
            new = self.common[rows] < level
            node = np.cumsum(new) - 1
            used = np.flatnonzero(self.first[rows] <= level)
            if len(used):
                r, n = rows[used], node[used]
                starts = np.flatnonzero(np.diff(n, prepend=-1))
                small = np.cumsum(np.diff(n, prepend=-1) != 0) - 1
                up = before[r[starts]]
                history = np.cumsum(np.diff(up, prepend=-1) != 0) - 1
                yield (level, r, small, history, np.add.reduceat(self.cells[r], starts), np.add.reduceat(self.places[r], starts))
            before = np.full(len(self.words), -1)
            before[rows] = node

    def grams(self, level: int, rows: np.ndarray, small: np.ndarray, n: int) -> np.ndarray:
        """The last ``n`` bytes of a level's nodes as numbers."""
        at = rows[np.diff(small, prepend=-1) != 0]
        return sum(self.grid[at, level - 1 - i].astype(np.int64) << 8 * i for i in range(n))

    def ends(self, level: int, rows: np.ndarray, small: np.ndarray) -> dict[int, bytes]:
        """Nodes of a level that may go on in another range: beginnings of the first or last word."""
        out = {}
        for at in (0, -1):
            word = self.words[at]
            if len(word) >= level and len(rows) and rows[at] == (0 if at == 0 else len(self.words) - 1):
                out[int(small[at])] = word[:level]
        return out


def _end_rows(r: Range, number: int) -> pa.Table:
    """What a range has of the histories at its two ends."""
    found: dict[bytes, np.ndarray] = {}
    k, g = len(CELLS), len(GROUPS) + 1
    for level, rows, small, history, cells, places in r.levels():
        ends = r.ends(level, rows, small)
        if not ends:
            continue
        free = np.minimum(np.column_stack([cells @ _SUMS, places]), DISCOUNT)
        for node, name in ends.items():
            row = found.setdefault(name, np.zeros(2 * k + 2 + g))
            row[:k] += cells[node]
            row[k] += places[node]
        free[list(ends)] = 0
        for h in {int(history[n]) for n in ends}:           # the histories of the nodes at the ends
            kids = np.flatnonzero(history == h)
            row = found.setdefault(next(name for n, name in ends.items() if history[n] == h)[:-1], np.zeros(2 * k + 2 + g))
            row[k + 1:2 * k + 1] += cells[kids].sum(axis=0)
            row[2 * k + 1] += places[kids].sum()
            row[2 * k + 2:] += free[kids].sum(axis=0)
    data = np.array(list(found.values())).reshape(len(found), 2 * k + 2 + g)
    return pa.table({"range": pa.array(np.full(len(found), number), pa.int32()), "blob": pa.nulls(len(found), pa.binary()),
                     "node": pa.array(list(found), pa.binary()), **{n: data[:, i] for i, n in enumerate(_ENDS)}})


def _pack_range(batches):
    """A range of words -> a row with all of it, packed, and the rows of its ends."""
    from pyspark import TaskContext
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table.column("word"))).combine_chunks()
        number, sink = TaskContext.get().partitionId(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        ends = _end_rows(Range(table), number)
        whole = pa.table({f.name: pa.nulls(1, f.type) for f in ends.schema})
        whole = whole.set_column(0, "range", pa.array([number], pa.int32())).set_column(1, "blob", pa.array([sink.getvalue().to_pybytes()], pa.binary()))
        yield from pa.concat_tables([whole, ends]).combine_chunks().to_batches()


def _grams(order: int):
    """Words -> the distinct runs of 2 to ``order`` + 1 bytes in them, as numbers with their length above 32 bits."""
    def run(batches):
        held = np.zeros(0, dtype=np.int64)
        for column in (batch.column(0).to_pylist() for batch in batches if batch.num_rows):
            length = np.array([len(w) for w in column], dtype=np.int64)
            data = np.frombuffer(b"".join(column), dtype=np.uint8).astype(np.int64)
            place = np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)
            found = [held]
            for n in range(2, order + 2):
                code = data.copy()
                for i in range(1, n):
                    code[i:] |= data[:-i] << 8 * i
                found.append(code[place >= n - 1] | n << 32)
            held = np.unique(np.concatenate(found))
            if len(held) > 4 * FLUSH:
                yield pa.record_batch([pa.array(held)], ["gram"])
                held = held[:0]
        yield pa.record_batch([pa.array(held)], ["gram"])
    return run


def _shorter(counts: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length from 1 to ``order``: the sorted grams that follow another byte in some word, and
    P(last byte | those before it) by the numbers of distinct bytes that they follow."""
    n = "cast(shiftright(gram, 32) - 1 as int)"
    table = (counts.select("word").mapInArrow(_grams(order), "gram long").distinct()
             .groupBy(F.expr(n).alias("n"), F.expr(f"gram & (shiftleft(1L, 8 * {n}) - 1)").alias("gram"))
             .agg(F.count(F.lit(1)).alias("b")).toArrow())           # at most 256 ** order rows and those of the lengths below
    size, gram, b = (table[c].to_numpy() for c in ("n", "gram", "b"))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, order + 1):
        at = np.flatnonzero(size == k)
        at = at[np.argsort(gram[at])]
        keys, seen = gram[at], b[at].astype(float)
        history = keys >> 8
        new = np.diff(history, prepend=-1) != 0
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        low = _after(out[-1], keys & ((1 << 8 * (k - 1)) - 1)) if out else 1 / 256
        if len(keys):
            around = np.add.reduceat(seen, starts)
            spared = np.add.reduceat(np.minimum(seen, DISCOUNT), starts)
            seen = (np.maximum(seen - DISCOUNT, 0) + spared[group] * low) / around[group]
        out.append((keys, seen))
    return out


def _after(table: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> np.ndarray:
    """The probabilities of ``grams``; 0 for those that no training word has."""
    keys, p = table
    if not len(keys):
        return np.zeros(len(grams))
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    return np.where(keys[at] == grams, p[at], 0.0)


def _judge(which: tuple[int, ...], shorter: Broadcast | None):
    """One range and the sums for its ends -> the evidence of its words that are asked for."""
    k = len(CELLS)

    def run(packed: pa.Table, ends: pa.Table) -> pa.Table:
        with pa.ipc.open_stream(packed.column("blob")[0].as_py()) as reader:
            table = reader.read_all()
        r = Range(table)
        total = dict(zip(ends.column("node").to_pylist(), np.column_stack([ends.column(c).to_numpy() for c in _ENDS])))
        ratio = np.zeros((len(r.words), len(which)))
        for level, rows, small, history, cells, places in r.levels():
            groups = cells @ _SUMS
            starts = np.flatnonzero(np.diff(history, prepend=-1))
            sums, spared = np.add.reduceat(groups, starts), np.add.reduceat(np.minimum(np.column_stack([groups, places]), DISCOUNT), starts)
            around = np.add.reduceat(places, starts)
            for node, name in r.ends(level, rows, small).items():
                row, past = total[name], total[name[:-1]]
                groups[node], places[node] = row[:k] @ _SUMS, row[k]
                h = history[node]
                sums[h], around[h], spared[h] = past[k + 1:2 * k + 1] @ _SUMS, past[2 * k + 1], past[2 * k + 2:]
            with np.errstate(divide="ignore", invalid="ignore"):
                freed = np.where(sums > 0, spared[:, :-1] / sums, 1.0)
                part = np.where(around > 0, 1 / around, 0.0)[history]
                if shorter is None:
                    back = part * places
                else:
                    n = min(level - 1, len(shorter.value))
                    back = part * (np.maximum(places - DISCOUNT, 0) + spared[history, -1] * _after(shorter.value[n - 1], r.grams(level, rows, small, n)))
                p = np.where(sums > 0, 1 / sums, 0.0)[history] * np.maximum(groups - DISCOUNT, 0) + freed[history] * back[:, None]
                free = np.maximum(freed, 1e-9)[history]
                p = np.where((places > 0)[:, None], p, np.where((around > 0)[history][:, None], free, 1.0))
            step = np.log(p[:, 1::2] / p[:, ::2])[:, list(which)]
            ratio[rows] += step[small]
        value = np.rint(np.clip(ratio - FLOOR, 0.0, SPAN) * UNIT).astype(np.int64)
        asked = table.column("asked").to_numpy() > 0
        return pa.table({"word": pa.array([w for w, a in zip(r.words, asked) if a], pa.binary()),
                         "value": pa.array(list(value[asked]), pa.list_(pa.int64()))})
    return run


def _word_evidence(words_: DataFrame, model: Model, which: tuple[int, ...]) -> DataFrame:
    """(word, value): the evidence of each of the different ``words_``, once for each of ``which``."""
    zero = F.lit(0).cast("long")
    rows = (model.counts.select("word", *CELLS, F.lit(1).alias("places"), F.lit(0).alias("asked"))
            .unionByName(words_.select("word", *[zero.alias(c) for c in CELLS], F.lit(0).alias("places"), F.lit(1).alias("asked")))
            .groupBy("word").agg(*[F.sum(c).alias(c) for c in CELLS], F.max("places").alias("places"), F.max("asked").alias("asked")))
    n = sum(df.agg(F.approx_count_distinct("word")).first()[0] for df in (model.counts, words_))
    kinds = "range int, blob binary, node binary, " + ", ".join(f"{c} double" for c in _ENDS)
    # a task a range: written once, as the bounds of the ranges are drawn anew for every run
    packed = cut_lineage(rows.repartitionByRange(max(1, math.ceil(n / RANGE)), "word").mapInArrow(_pack_range, kinds))
    ends = packed.where(F.col("node").isNotNull()).drop("blob")                      # two words' beginnings a range
    sums = ends.groupBy("node").agg(*[F.sum(c).alias(c) for c in _ENDS])
    held = [_sum(lambda c: F.col(f"g{CELLS.index(c)}"), g) for g in GROUPS] + [F.col("places")]
    least = [F.sum(F.least(c, F.lit(DISCOUNT))).alias(f"a{k}") for k, c in enumerate(held)]
    kids = sums.groupBy(F.expr("substring(node, 1, length(node) - 1)").alias("past")).agg(*least)
    sums = (sums.join(kids, F.col("node") == F.col("past"), "left")
            .select("node", *[c for c in _ENDS if c[0] != "s"],
                    *[(F.col(f"s{k}") + F.coalesce(f"a{k}", F.lit(0.0))).alias(f"s{k}") for k in range(len(held))]))
    known = ends.select(F.col("range").alias("of"), "node").join(sums, "node").select("of", "node", *_ENDS)
    return (packed.where(F.col("node").isNull()).select("range", "blob").groupBy("range").cogroup(known.groupBy("of"))
            .applyInArrow(_judge(which, model.shorter), "word binary, value array<bigint>"))


def _sum(of, g: tuple[str, ...]) -> Column:
    return sum((of(c) for c in g[1:]), of(g[0]))


def _spread(common: Broadcast):
    """For each text a row with its number of words and the evidence of those
    in ``common``, and a row for each distinct other word."""
    schema = pa.schema([("key", pa.binary()), ("which", pa.int32()), ("word", pa.binary()), ("n", pa.int64()),
                        ("known", pa.int64()), ("total", pa.int64())])

    def run(batches):
        known = common.value
        for batch in batches:
            rows: list[tuple] = []
            for (key, which, text), copies in Counter(zip(*(batch.column(i).to_pylist() for i in range(3)))).items():
                counts = Counter(words(text))
                if not counts:
                    continue
                total = got = 0
                for w, n in counts.items():
                    total += n
                    v = known.get(w)
                    if v is None:
                        rows.append((key, which, w, n * copies, 0, 0))
                    else:
                        got += n * v
                rows.append((key, which, None, total * copies, got * copies, total))
                if len(rows) > FLUSH:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def _text_features(texts: DataFrame, model: Model, which: tuple[int, ...]) -> DataFrame:
    """(key, which, x): the curve's variable for each distinct (key, which) of
    ``texts`` (key, which, text) that has words; ``which`` is a place in the
    argument ``which``, and equal keys mean equal texts."""
    common = texts.sparkSession.sparkContext.broadcast(model.common)
    spread = _cut(texts.mapInArrow(_spread(common), "key binary, which int, word binary, n long, known long, total long"))
    common.destroy()
    other = spread.where(F.col("word").isNotNull()).select("key", "which", "word", "n")
    # most words have none: only those with evidence are met, and a bit set of fixed size keeps most others out of the shuffle
    values = cut_lineage(_word_evidence(other.select("word"), model, which).where(F.exists("value", lambda v: v != 0)))
    slot, place = f"cast(floor(pmod(xxhash64(word), {BITS}) / 64) as int)", f"cast(pmod(xxhash64(word), {BITS}) % 64 as int)"
    bits = (values.groupBy(F.expr(slot).alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, {place}))").alias("b"))
            .agg(F.map_from_entries(F.collect_list(F.struct("i", "b"))).alias("bits")))       # at most BITS / 64 numbers
    filled = dict(bits.first().bits or {})
    every = spread.sparkSession.createDataFrame([([filled.get(i, 0) for i in range(BITS // 64)],)], "bits array<bigint>")
    has = F.expr(f"bit_get(bits[{slot}], {place}) = 1")
    rest = (other.join(F.broadcast(every), has).select("key", "which", "word", "n").join(values, "word")
            .select("key", "which", F.lit(0).cast("long").alias("n"), (F.col("n") * F.col("value")[F.col("which")]).alias("v"),
                    F.lit(0).cast("long").alias("total")))
    sums = (spread.where(F.col("word").isNull()).select("key", "which", "n", F.col("known").alias("v"), "total").unionByName(rest)
            .groupBy("key", "which").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max("total").alias("total")))
    copies = F.col("n") / F.col("total")
    return sums.select("key", "which", feature_column(F.col("v") / UNIT / copies / (F.col("total") + SHORT)).alias("x"))


def feature_column(evidence: Column) -> Column:
    return F.log(LEAST + evidence)


def learn(docs: DataFrame, labels: DataFrame, order: int = 0) -> Model:
    """Counts the labelled documents whose remainder is not 0 and fits the model. The shared
    counts back off to shorter histories of up to ``order`` - 1 bytes (``ORDER`` - 1 at most; 0: they stand alone)."""
    if not 0 <= order <= ORDER:
        raise ValueError(f"order must be from 0 to {ORDER}")
    spark = docs.sparkSession
    ship_package(spark)
    marked = _class_labels(labels).where(remainder() != 0)
    total = marked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("t")).first()
    if not total.t or total.t == total.n:
        return _constant(total.t / total.n if total.n else 0.0)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    train = (docs.where(remainder() != 0).select("doc_id", F.col("text").cast("binary").alias("text"))
             .join(marked.hint("shuffle_hash"), "doc_id")      # one plan at every size: the labels grow with the documents
             .select("text", (F.col("_toxic") * len(PARTS) + remainder() - 1).cast("int").alias("cell"),
                     (h < int(1e6 * min(1.0, FIT_ROWS / total.n))).alias("fit")))
    counted = _cut(train.mapInArrow(_count, "word binary, cell int, n long, text binary"))
    seen_words = counted.where(F.col("word").isNotNull())
    model = Model(cut_lineage(seen_words.groupBy("word").agg(
        *[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(CELLS)])))
    if not model.counts.take(1):                        # not one word in the labelled rows
        return _constant(total.t / total.n)
    if order:
        model.shorter = spark.sparkContext.broadcast(_shorter(model.counts, order))
    # the sample's evidence is taken by joins where its rows are, without their own part; only the numbers come here
    sample = (counted.where(F.col("word").isNull())
              .select(F.concat(F.col("cell").cast("string").cast("binary"), F.unhex(F.md5("text"))).alias("key"),
                      (F.col("cell") % len(PARTS)).alias("which"), (F.col("cell") >= len(PARTS)).cast("double").alias("y"),
                      F.coalesce("text", F.lit(b"")).alias("text")))
    features = _text_features(sample.select("key", "which", "text"), model, tuple(range(1, FOLDS)))
    fit = (sample.select("key", "y").join(features, "key", "left")
           .select(F.coalesce("x", F.lit(feature(0.0))).alias("x"), "y").toArrow())
    x, y = fit["x"].to_numpy(), fit["y"].to_numpy()
    order = np.lexsort((y, x))
    if len(y) == 0 or y.min() == y.max():
        return _constant(total.t / total.n)
    model.slope, model.shift = _fit_curve(x[order], y[order])
    if model.slope <= 0:                                # too few rows to tell: more evidence must not lower a score
        model.slope, model.shift = 1e-3, math.log(total.t / (total.n - total.t))
    model.common = _common(seen_words, model)
    return model


def _common(seen_words: DataFrame, model: Model) -> dict[bytes, int]:
    """The evidence of at most ``COMMON`` words, the most frequent ones of the training rows."""
    counts = cut_lineage(seen_words.groupBy("word").agg(F.sum("n").alias("n"))
                         .select("word", F.floor(F.log2("n") * 8).alias("level")))
    least, kept = 0, 0
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():    # a few hundred levels at most
        kept += r["count"]
        if kept > COMMON:
            least = r["level"] + 1
            break
    table = _word_evidence(counts.where(F.col("level") >= least).select("word"), model, (0,)).toArrow()
    return dict(zip(table["word"].to_pylist(), (v[0] for v in table["value"].to_pylist())))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row."""
    spark = docs.sparkSession
    ship_package(spark)
    if model.constant is not None:
        out = docs.withColumn("score", F.lit(float(model.constant)))
    else:
        text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
        key = F.unhex(F.md5(text))
        features = _text_features(docs.select(key.alias("key"), F.lit(0).alias("which"), text.alias("text")), model, (0,))
        z = model.slope * F.coalesce("_x", F.lit(feature(0.0))) + model.shift
        z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))
        out = (docs.withColumn("_key", key).join(features.select(F.col("key").alias("_key"), F.col("x").alias("_x")), "_key", "left")
               .withColumn("score", 1 / (1 + F.exp(-z))).drop("_key", "_x"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out() -> Column:
    """Never learnt from; a null doc_id has no label."""
    return F.coalesce(remainder() == 0, F.lit(True))

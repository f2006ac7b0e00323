"""Alignment of two tokenizers' tokens over whole texts, with corpus-wide pair counts.

Every text is encoded by A (a ``tokenizers`` byte-level BPE file, of space +
text) and by B (a ``sentencepiece`` model, which adds the space itself). Byte
offsets where tokens of both end cut them into groups; every A-B pair of token
occurrences whose byte ranges overlap is a link. How often an (A id, B id) pair
is linked in the whole corpus is counted by external spill counting:

1. A task aligns slices of documents of about ``SLICE_BYTES``. A slice counts its
   distinct pairs and spills, radix-partitioned by B id, runs of (B id, A id, count)
   sorted by B id, then A id, delta-coded and zstd-compressed. What ties the pairs to
   the slice's documents stays in a body of its own, which never moves by pair.
2. A radix partition merges its runs with a k-way heap. As B ids come one after the
   other, each one's highest count is known when its pairs are through; then the
   runs are read once more and every run hands back a blob with the totals of its
   pairs and marks for the highest ones.
3. A slice's body meets the blobs of its runs and every document gets its sums.

Runs hold one entry a distinct pair of a slice, however many documents and
occurrences it has, so a pair or B id that holds a third of all links weighs no
more than the A ids it meets (at most A's vocabulary) a slice. A merge holds its
compressed runs, a chunk of each and the partition's distinct pairs, which the
vocabularies bound. Nothing is collected or broadcast but the vocabularies. A slice
ends at a document; one very long text is a slice of its own.
Documents that occur again are counted again.

Encoding in pieces: a text is cut before a space or line end that follows a
character that is no white space, and between a word of ASCII letters and a full stop
or comma. No match of A's splitting pattern and no piece of
B's vocabulary crosses such a place (both are checked when the files are loaded,
else texts are not cut), so both sides have a token end there and a piece's
groups and links do not depend on the rest of the text. Frequent pieces are
aligned once a worker.

Texts that are null or empty, or whose joined token bytes of A or of B differ from
space + text, have no tokens: zeros and an empty ``groups``. Special tokens' strings
are plain text. An empty table gives an empty table. The result has the columns
of ``keep`` (others are left out) and the operator's own; clashing names are the
operator's.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import cut_lineage, ship_package
from ratewise.llm.shingles import mix

SLICE_BYTES = 4_000_000
CACHED = 300_000
CACHED_CHARS = 48
RESULT_TYPES = [("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("groups_sha256", "string"),
                ("n_best", "bigint"), ("count_sum", "bigint")]
RESULTS = [n for n, _ in RESULT_TYPES]
CHUNK = 4_096                # pairs of a run that a merge holds at once
_PIECE = re.compile(r"\s*+[A-Za-z]++(?=[.,])|\s*+\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")


class Aligned(NamedTuple):
    """What one piece (or text) adds: counts, links (the worker's numbers of the pairs, as int32 bytes, in order) and the groups' digest text."""
    n_a: int
    n_b: int
    n_groups: int
    links: bytes
    groups: str


def aligned(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes], number: dict[int, int]) -> Aligned:
    """Walks both token lists once; their byte lengths add up to the same. ``number``
    gives each pair (b << 32 | a) the next free number when it is met first."""
    i = j = n_groups = 0
    x, y = a[0], b[0]
    end_a, end_b = len(a_bytes[0]), len(b_bytes[0])
    last = len(a) - 1
    k = y << 32 | x
    links, left, right, groups = [number.setdefault(k, len(number))], f"{x}", f"{y}", ""
    while True:
        if end_a == end_b:
            groups = f"{groups}{left}|{right}"
            n_groups += 1
            if i == last:
                break
            i += 1
            j += 1
            x, y = a[i], b[j]
            end_a += len(a_bytes[i])
            end_b += len(b_bytes[j])
            left, right = f";{x}", f"{y}"
        elif end_a < end_b:
            i += 1
            x = a[i]
            end_a += len(a_bytes[i])
            left = f"{left},{x}"
        else:
            j += 1
            y = b[j]
            end_b += len(b_bytes[j])
            right = f"{right},{y}"
        k = y << 32 | x
        links.append(number.setdefault(k, len(number)))
    return Aligned(len(a), len(b), n_groups, array("i", links).tobytes(), groups)


class Pair:
    """The two tokenizers, from the contents of their files."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in chars} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(chars)))}
        self.a_bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                        for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        spec = json.loads(a_file)
        split = spec.get("pre_tokenizer") or {}
        self.cuts = (spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                     and not split.get("add_prefix_space") and self.b.encode("x  y\nz., ") == [i for ids in self._b([" x", "  y", "\nz", ".,", " "]) for i in ids]
                     and not any(re.search("[^▁](▁|\n)|.\n|[A-Za-z][.,]", p) for i, p in enumerate(pieces)
                                 if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))))
        self.number: dict[int, int] = {}                    # every pair met, at most as many as the vocabularies have
        self.known: dict[str, Aligned | None] = {}          # frequent pieces: what came last and what came before
        self.old: dict[str, Aligned | None] = {}

    def _b(self, pieces: list[str]) -> list[list[int]]:
        """B's tokens of pieces: B adds the space of those that start with one."""
        out = self.b.encode([p[1:] if p[0] == " " else p if p[0] == "\n" else "\n" + p for p in pieces], num_threads=1)
        for k, p in enumerate(pieces):
            if p == " ":
                out[k] = [self.space]
            elif p[0] != " ":                               # without what stands for the start: B's space (and the line end)
                out[k] = out[k][1 if p[0] == "\n" else 2:]
        return out

    def align(self, pieces: list[str]) -> list[Aligned | None]:
        """None where the joined bytes of a side are not the piece's."""
        out, a_of, b_of, number = [], self.a_bytes.__getitem__, self.b_bytes.__getitem__, self.number
        for piece, got, b in zip(pieces, self.a.encode_batch_fast(pieces, add_special_tokens=False), self._b(pieces)):
            a = got.ids
            x, y = [*map(a_of, a)], [*map(b_of, b)]
            out.append(aligned(a, b, x, y, number) if a and b and b"".join(x) == b"".join(y) == piece.encode() else None)
        return out

    def pairs(self) -> np.ndarray:
        """The pairs by their numbers."""
        return np.fromiter(self.number, dtype=np.int64, count=len(self.number))

    def pieces(self, text: str) -> list[str]:
        text = " " + text
        return _PIECE.findall(text) if self.cuts else [text]

    def texts(self, texts: list[str | None]) -> list[list[Aligned]]:
        """The aligned pieces of each text; none if the text has no tokens by definition."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.old, self.known = self.known, {}
        seen = {p for c in cut for p in c}
        here = {p: x for p in seen if (x := self.known.get(p) or self.old.get(p))}
        new = list(seen - here.keys())
        for lo in range(0, len(new), 10_000):
            here.update(zip(new[lo:lo + 10_000], self.align(new[lo:lo + 10_000])))
        self.known.update((p, x) for p, x in here.items() if len(p) <= CACHED_CHARS)
        out = []
        for text, c in zip(texts, cut):
            found = [here[p] for p in c]
            if any(x is None for x in found):               # the whole text decides
                x = self.align([" " + text])[0]
                found = [] if x is None else [x]
            out.append(found)
        return out


_pairs: dict[bytes, Pair] = {}


def _pair(shared) -> Pair:
    key = hashlib.sha256(shared.value[0] + shared.value[1]).digest()
    if key not in _pairs:
        _pairs[key] = Pair(*shared.value)
    return _pairs[key]


# --- runs and bodies -----------------------------------------------------------

def _radix(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each pair: a hash of its B id."""
    return (mix((keys >> 32).astype(np.uint64), 21) % np.uint64(parts)).astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """zstd frames of int64 columns; the first is sorted and stored as differences."""
    first = np.diff(columns[0], prepend=0)
    out = []
    for i, column in enumerate((first, *columns[1:])):
        wide = column.astype(np.int64)
        low, high = (int(wide.min()), int(wide.max())) if len(wide) else (0, 0)
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        blob = zstandard.ZstdCompressor(level=1).compress(wide.astype(kind).tobytes())
        out += [np.array([len(wide), np.dtype(kind).itemsize, len(blob)], dtype=np.int64).tobytes(), blob]
    return b"".join(out)


def _frames(blob: bytes) -> list[tuple[int, int, bytes]]:
    out, at = [], 0
    while at < len(blob):
        n, width, size = np.frombuffer(blob, dtype=np.int64, count=3, offset=at).tolist()
        out.append((n, width, blob[at + 24:at + 24 + size]))
        at += 24 + size
    return out


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for i, (_, width, data) in enumerate(_frames(blob)):
        x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=f"i{width}").astype(np.int64)
        out.append(np.cumsum(x) if i == 0 else x)
    return out


def _stream(blob: bytes) -> Iterator[tuple[int, int]]:
    """The (key, value) rows of a packed run, a chunk in memory at a time."""
    (n, wk, keys), (_, wv, values) = _frames(blob)[:2]
    k = zstandard.ZstdDecompressor().stream_reader(keys)
    v = zstandard.ZstdDecompressor().stream_reader(values)
    last = 0
    for lo in range(0, n, CHUNK):
        m = min(CHUNK, n - lo)
        part = np.cumsum(np.frombuffer(k.read(m * wk), dtype=f"i{wk}").astype(np.int64)) + last
        last = int(part[-1])
        yield from zip(part.tolist(), np.frombuffer(v.read(m * wv), dtype=f"i{wv}").tolist())


def _spill(shared, parts: int):
    """Per slice a row a radix partition (its run) and one with radix -1: the body
    (which document holds which pair how often; pairs by their place in the order of
    the runs) and, as Arrow IPC, the documents' own columns."""
    def flush(pair, rows, number, task):
        found = pair.texts([t for t, _ in rows])
        links = [b"".join([x.links for x in f]) for f in found]
        size = np.array([len(x) // 4 for x in links], dtype=np.int64)
        number = np.frombuffer(b"".join(links), dtype=np.int32)
        every = pair.pairs()
        total = np.bincount(number, minlength=len(every))
        met = np.flatnonzero(total)
        met = met[np.lexsort((every[met], _radix(every[met], parts)))]
        place = np.zeros(len(every), dtype=np.int64)
        place[met] = np.arange(len(met))
        keys, total = every[met], total[met]
        groups = [";".join([x.groups for x in f]) for f in found]
        table = pa.RecordBatch.from_arrays(
            [*[pa.array([sum(map(itemgetter(k), f)) for f in found], pa.int64()) for k in range(3)], pa.array(size),
             pa.array([hashlib.sha256(g.encode()).hexdigest() if f else "" for g, f in zip(groups, found)], pa.string())],
            names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        kept = pa.RecordBatch.from_struct_array(pa.concat_arrays([k for _, k in rows])).drop_columns(["_"])
        kept = pa.RecordBatch.from_arrays([*kept.columns, *table.columns], names=[*kept.schema.names, *table.schema.names])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema) as w:
            w.write_batch(kept)
        where = f"{task}-{number}"
        radix = _radix(keys, parts)
        cuts = np.searchsorted(radix, np.arange(parts + 1))
        full = [r for r in range(parts) if cuts[r] < cuts[r + 1]]
        doc = np.repeat(np.arange(len(rows)), size)
        pairs, times = np.unique(doc * max(len(keys), 1) + place[number], return_counts=True)
        yield pa.record_batch(
            [pa.array([where] * (len(full) + 1), pa.string()), pa.array([-1, *full], pa.int32()),
             pa.array([_pack(pairs, times), *[_pack(keys[cuts[r]:cuts[r + 1]], total[cuts[r]:cuts[r + 1]]) for r in full]],
                      pa.binary()),
             pa.array([sink.getvalue().to_pybytes()] + [None] * len(full), pa.binary())],
            names=["slice", "radix", "blob", "docs"])

    def run(batches):
        from pyspark import TaskContext
        pair, rows, held, number = _pair(shared), [], 0, 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            kept = batch.column(1)
            for i, text in enumerate(batch.column(0)):
                text = text.as_py()
                rows.append((None if text is None else text.decode("utf-8", "replace"), kept.slice(i, 1)))
                held += 64 + len(text or b"")
                if held >= SLICE_BYTES:
                    yield from flush(pair, rows, number, task)
                    rows, held, number = [], 0, number + 1
        if rows:
            yield from flush(pair, rows, number, task)
    return run


def merge(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted runs -> every pair, its total and whether that is its B id's highest: a
    k-way heap merge that adds up equal pairs as they meet; B ids come one after
    another, so the highest is known when the next one starts."""
    keys, totals, best = array("q"), array("q"), bytearray()
    at, n, top, start = -1, 0, 0, 0

    def close():
        nonlocal start
        best.extend(t == top for t in totals[start:])
        start = len(totals)

    for key, count in heapq.merge(*map(_stream, runs)):
        if key != at:
            if at >= 0:
                keys.append(at)
                totals.append(n)
                top = max(top, n)
                if key >> 32 != at >> 32:
                    close()
                    top = 0
            at, n = key, 0
        n += count
    if at >= 0:
        keys.append(at)
        totals.append(n)
        top = max(top, n)
        close()
    return np.frombuffer(keys, np.int64), np.frombuffer(totals, np.int64), np.frombuffer(bytes(best), np.uint8).astype(bool)


def _contribute(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One radix partition: its runs are merged, then streamed once more for what
    each hands back to its slice: every pair's total and mark. A last row (no
    slice) holds the partition's pairs."""
    runs = table.column("blob").to_pylist()
    pair, n, best = merge(runs)
    blobs = []
    for run in runs:
        place = np.searchsorted(pair, _unpack(run)[0])
        blobs.append(_pack(n[place], best[place]))
    return pa.table({"slice": pa.array([*table.column("slice").to_pylist(), None], pa.string()),
                     "radix": pa.array([key[0].as_py()] * (len(runs) + 1), pa.int32()),
                     "blob": pa.array([*blobs, _pack(pair, n, best)], pa.binary())})


def _pairs_of(batches):
    for batch in batches:
        for blob in batch.column(0):
            pair, n, best = _unpack(blob.as_py())
            yield pa.record_batch([pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array((pair >> 32).astype(np.int32)),
                                   pa.array(n), pa.array(best.astype(bool))], names=["a", "b", "n", "best"])


def _settle(table: pa.Table) -> pa.Table:
    """A slice's body and contributions -> its documents."""
    rows = sorted(table.to_pylist(), key=lambda r: r["radix"])
    body, parts = rows[0], [_unpack(r["blob"]) for r in rows[1:]]
    pairs, times = _unpack(body["blob"])
    with pa.ipc.open_stream(body["docs"]) as reader:
        docs = reader.read_all()
    total = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
    best = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
    doc, place = np.divmod(pairs, max(len(total), 1))
    sums = []
    for weight in (best, total):
        out = np.zeros(docs.num_rows, dtype=np.int64)
        np.add.at(out, doc, times * weight[place])
        sums.append(out)
    return docs.append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): per row ``keep``, n_a, n_b, n_groups, n_links, groups_sha256,
    n_best, count_sum; and every linked id pair (a, b) with its count ``n`` and
    whether that is the highest of its B id (``best``). ``parts``: radix partitions,
    by default ``spark.sql.shuffle.partitions``."""
    spark = docs.sparkSession
    ship_package(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = []
    for path in (a_path, b_path):           # vocabularies, of fixed size, read on the driver
        with open(path, "rb") as f:
            files.append(f.read())
    shared = spark.sparkContext.broadcast(tuple(files))
    keep = tuple(c for c in keep if c not in RESULTS)
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept"))
    spilled = cut_lineage(rows.mapInArrow(_spill(shared, parts), "slice string, radix int, blob binary, docs binary"))
    runs = spilled.where("radix >= 0").select("slice", "radix", "blob")
    back = cut_lineage(runs.groupBy("radix").applyInArrow(_contribute, "slice string, radix int, blob binary"))
    nothing = F.lit(None).cast("binary").alias("docs")
    settled = spilled.where("radix < 0").unionByName(back.where("slice is not null").withColumn("docs", nothing))
    types = [(f.name, f.dataType.simpleString()) for f in docs.select(*[f"`{c}`" for c in keep]).schema] + RESULT_TYPES
    found = settled.groupBy("slice").applyInArrow(_settle, ", ".join(f"`{n}` {t}" for n, t in types))
    return found, back.where("slice is null").select("blob").mapInArrow(_pairs_of, "a int, b int, n bigint, best boolean")

"""Token ids written to disk in training order.

Documents' ids, each followed by an end mark, are packed into sequences of a
fixed length. Sequence i of N goes to slot P(i), where P is a keyed Feistel
network over the least power of four that holds N, walked along its cycle until
the value is under N: a permutation of 0..N-1 that needs no table, only the key,
and that can be inverted to find what stands at a slot.

Slots are cut into shards of a fixed number of records. A record has a fixed
stride: a header (sequence number, first document's id, number of tokens), the
ids, padded, and a line end; so slot s is at byte (s mod per_shard) * stride of
shard s div per_shard, and a reader resumes at any slot with one seek. Spark's
own text sink writes the shards, so any Hadoop file system will do, a lost
executor's files are written again, and a failed job leaves none.

``training_order`` encodes texts once, by byte-level BPE, into a table of 16-bit ids in
the shared folder; counting and packing read that table, so nothing is encoded twice.
Two ids that the vocabulary leaves free mark a document's end and the padding.

Sequences follow the rows of the input as Spark scans its files: the input must
be read from files, and the same files and split settings give the same numbers.
The counting pass and the writing pass are checked against each other. Every shard
is written by one task, which holds nothing but its records to sort.

Null and empty texts have no ids and leave no trace. A document longer than a
sequence runs on in the next. A null document id is written as ``NO_ID``. An
empty table gives an empty folder. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.llm import bpe
from ratewise.llm.common import ship_package
from ratewise.llm.shingles import mix
from ratewise.session import scratch_path

LENGTH = 2048
PER_SHARD = 8192
ROUNDS = 6
NO_ID = -2 ** 63
HEADER = np.dtype([("sequence", "<i8"), ("first_doc", "<i8"), ("tokens", "<i4")])

# Without a tokenizer, ids are the bytes of the UTF-8 text; these two bytes never occur in UTF-8.
END, PAD, KIND = 0xFF, 0xFE, np.uint8
# With one: 16-bit ids, of which a vocabulary of at most 65,534 leaves the last two free.
TOKEN_END, TOKEN_PAD, TOKEN_KIND = 0xFFFE, 0xFFFF, np.uint16


def utf8_ids(text: bytes) -> np.ndarray:
    return np.frombuffer(text, dtype=np.uint8)


def token_ids(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype=TOKEN_KIND)


def encode(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): every text's token ids as 16-bit numbers, a table in the shared folder."""
    shared = bpe._share(docs, rank_path, pattern)

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        codec = bpe._codec(shared)
        if len(codec.names) > TOKEN_END:
            raise ValueError("the vocabulary does not fit 16 bits and two marks")
        return pa.array([np.array(codec.encode(x), dtype=TOKEN_KIND).tobytes() for x in bpe._texts(column)], pa.binary())
    path = scratch_path(docs.sparkSession, "tokens")
    (docs.select(F.col(doc_id).cast("long").alias("doc_id"), run(F.col(text).cast("binary")).alias("ids"))
     .write.option("compression", "zstd").parquet(path))
    return docs.sparkSession.read.parquet(path)


class Permutation:
    """A keyed permutation of 0..n-1, on arrays."""

    def __init__(self, n: int, key: int):
        self.n, self.key = n, key
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)

    def _round(self, x: np.ndarray, k: int) -> np.ndarray:
        return mix(x ^ mix(np.array([self.key * ROUNDS + k], dtype=np.int64).view(np.uint64), 50), 51 + k) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        a, b = x >> shift, x & self.mask
        for k in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
            if back:
                a, b = b ^ self._round(a, k), a
            else:
                a, b = b, a ^ self._round(b, k)
        return (a << shift) | b

    def _walk(self, i, back: bool) -> np.ndarray:
        x = self._once(np.asarray(i, dtype=np.uint64), back)
        while len(out := np.flatnonzero(x >= self.n)):
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slot(self, sequence) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot) -> np.ndarray:
        return self._walk(slot, True)


def stride(length: int = LENGTH, kind=KIND) -> int:
    return HEADER.itemsize + length * np.dtype(kind).itemsize + 1


def _pack(offsets, order: Permutation, length: int, per_shard: int, ids_of, end: int, pad: int, kind):
    """Packs a task's documents into records; yields (shard, slot, zstd of the record)."""
    def run(batches):
        from pyspark import TaskContext
        me = TaskContext.get().partitionId()
        start, expected = offsets.value.get(me, (0, 0))
        squeeze = zstandard.ZstdCompressor(level=1)
        room, used, first, made = np.full(length, pad, dtype=kind), 0, NO_ID, 0
        out: tuple[list, list] = ([], [])

        def close():
            nonlocal room, used, made
            head = np.array([(start + made, first, used)], dtype=HEADER)
            out[0].append(start + made)
            out[1].append(squeeze.compress(head.tobytes() + room.tobytes() + b"\n"))
            room, used, made = np.full(length, pad, dtype=kind), 0, made + 1

        def flush():
            slots = order.slot(np.array(out[0], dtype=np.int64))
            batch = pa.record_batch([pa.array((slots // per_shard).astype(np.int32)), pa.array(slots),
                                     pa.array(out[1], pa.binary())], names=["shard", "slot", "record"])
            out[0].clear()
            out[1].clear()
            return batch
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                doc = doc.as_py()
                ids = np.append(ids_of(text), kind(end))
                at = 0
                while at < len(ids):
                    if not used:
                        first = NO_ID if doc is None else doc
                    n = min(length - used, len(ids) - at)
                    room[used:used + n] = ids[at:at + n]
                    used, at = used + n, at + n
                    if used == length:
                        close()
                if len(out[0]) > 4096:
                    yield flush()
        if used:
            close()
        if out[0]:
            yield flush()
        if made != expected:
            raise RuntimeError(f"input partition {me} gave {made} sequences, {expected} when they were counted")
    return run


def write_shards(docs: DataFrame, path: str, key: int, length: int = LENGTH, per_shard: int = PER_SHARD, doc_id: str = "doc_id",
                 text: str = "text", ids_of: Callable[[bytes], np.ndarray] = utf8_ids, count=None,
                 end: int = END, pad: int = PAD, kind=KIND) -> int:
    """Writes the shards under ``path`` and returns the number of sequences.
    ``count``: a column that gives the number of ids of a text, for another
    ``ids_of`` than bytes."""
    spark = docs.sparkSession
    ship_package(spark)
    n = F.octet_length(text) if count is None else count
    sizes = (docs.where(F.octet_length(text) > 0).select(F.spark_partition_id().alias("p"), (n + 1).cast("long").alias("n"))
             .groupBy("p").agg(F.ceil(F.sum("n") / length).alias("n")).orderBy("p").collect())   # one row a task
    offsets, total = {}, 0
    for r in sizes:
        offsets[r.p] = (total, r.n)
        total += r.n
    order = Permutation(total, key)
    shared = spark.sparkContext.broadcast(offsets)
    shards = max(1, -(-total // per_shard))

    @F.arrow_udf("binary")
    def open_(records: pa.Array) -> pa.Array:
        loose = zstandard.ZstdDecompressor()
        return pa.array([loose.decompress(x.as_py())[:-1] for x in records], pa.binary())
    (docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary"))
     .mapInArrow(_pack(shared, order, length, per_shard, ids_of, end, pad, kind), "shard int, slot long, record binary")
     .repartitionById(shards, "shard").withColumn("value", open_("record")).drop("record")
     .sortWithinPartitions("shard", "slot")
     .select("shard", F.col("value").cast("string").alias("value"))
     .write.partitionBy("shard").option("lineSep", "\n").text(path))
    return total


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, kind=KIND) -> DataFrame:
    """(slot, sequence, first_doc, n_tokens, ids) of every record, ids as bytes without padding."""
    ship_package(spark)
    size = stride(length, kind)

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(content.as_buffer(), dtype=np.uint8).reshape(-1, size)
                for at in range(0, len(data), 1024):
                    part = data[at:at + 1024]
                    head = np.ascontiguousarray(part[:, :HEADER.itemsize]).view(HEADER)[:, 0]
                    ids = [r[HEADER.itemsize:HEADER.itemsize + n * np.dtype(kind).itemsize].tobytes()
                           for r, n in zip(part, head["tokens"])]
                    yield pa.record_batch([pa.array(shard * per_shard + at + np.arange(len(part), dtype=np.int64)),
                                           pa.array(head["sequence"]), pa.array(head["first_doc"]),
                                           pa.array(head["tokens"]), pa.array(ids, pa.binary())],
                                          names=["slot", "sequence", "first_doc", "n_tokens", "ids"])
    schema = "slot long, sequence long, first_doc long, n_tokens int, ids binary"
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, shard int")
    return files.load(path).select("shard", "content").mapInArrow(run, schema)


def training_order(docs: DataFrame, key: int, rank_path: str, pattern: str) -> DataFrame:
    """Writes the texts' tokens in training order under the shared folder and reads the
    records back (``ids``: 16-bit little-endian numbers)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    if not write_shards(encode(docs, rank_path, pattern), path, key, text="ids", ids_of=token_ids,
                        count=F.octet_length("ids") / 2, end=TOKEN_END, pad=TOKEN_PAD, kind=TOKEN_KIND):
        return spark.createDataFrame([], "slot long, sequence long, first_doc long, n_tokens int, ids binary")
    return read_shards(spark, path, kind=TOKEN_KIND)

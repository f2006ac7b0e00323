"""Byte-level BPE with the tiktoken library over a local rank file.

``encode`` adds the ids of every whole text, ``decode`` the bytes of an id
column, ``round_trip`` both as digests in one pass. Each match of the
splitting pattern is encoded separately, no special token is ever produced.

Long texts are encoded in pieces. A piece ends only between a printable ASCII
character and a following space or line end: no alternative of the pattern
matches across such a place or looks beyond it to the left, so the pieces'
ids concatenate to the ids of the whole.

Null texts count as empty (no ids). Bytes that are not UTF-8 are read as
U+FFFD. Extra columns pass through; columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import ship_package

PIECE_CHARS = 20_000
_CUT = re.compile(r"(?<=[!-~])(?=[ \n])")


class Codec:
    """A tiktoken encoding made from the bytes of a rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken
        table = {}
        for line in ranks.splitlines():
            if line.strip():
                token, rank = line.split()
                table[base64.b64decode(token)] = int(rank)
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.names = [str(i) for i in range(max(table.values(), default=-1) + 1)]

    def pieces(self, text: str):
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = _CUT.search(text, at + PIECE_CHARS)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE_CHARS:
            return self.encoding.encode_ordinary(text)
        return [i for piece in self.pieces(text) for i in self.encoding.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


_codecs: dict[bytes, Codec] = {}


def _codec(shared) -> Codec:
    """One codec a Python worker."""
    ranks, pattern = shared.value
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _share(df: DataFrame, rank_path: str, pattern: str):
    """The rank file (a vocabulary, of fixed size) is read once, on the driver."""
    ship_package(df.sparkSession)
    with open(rank_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def _texts(column: pa.Array):
    for x in column:
        x = x.as_py()
        yield "" if x is None else x.decode("utf-8", "replace")


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``, array<int>."""
    shared = _share(df, rank_path, pattern)

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        codec = _codec(shared)
        return pa.array([codec.encode(x) for x in _texts(column)], pa.list_(pa.int32()))
    return df.withColumn(ids, run(F.col(text).cast("binary")))


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the raw bytes of the ids (null: no bytes)."""
    shared = _share(df, rank_path, pattern)

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        codec = _codec(shared)
        return pa.array([codec.decode(x or []) for x in column.to_pylist()], pa.binary())
    return df.withColumn(out, run(F.col(ids)))


def round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256`` (the bytes that the ids decode to)."""
    shared = _share(df, rank_path, pattern)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def run(column: pa.Array) -> pa.Array:
        codec = _codec(shared)
        name = codec.names.__getitem__
        n, a, b = [], [], []
        for x in _texts(column):
            ids = codec.encode(x)
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                          ["n_tokens", "ids_sha256", "decoded_sha256"])
    out = df.withColumn("_bpe", run(F.col(text).cast("binary")))
    return out.withColumns({c: F.col(f"_bpe.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("_bpe")

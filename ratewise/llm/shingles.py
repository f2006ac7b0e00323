"""Word-shingle sets of whole texts, vectorised over an Arrow batch.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z read as
a-z. A set holds a 64-bit hash of each distinct run of ``width`` words; a text
with fewer words has its whole sequence as its only element, a text without
words (or a null) has the empty set. Everything runs on the UTF-8 bytes of a
slice of the batch at once, so no per-word Python objects are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20_240_817))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_POSITION = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    h = h + _U((0x632BE59BD9B4E019 * (salt + 1)) % 2**64)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = 1 << max(n - 1, SLICE_BYTES).bit_length()
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _powers[key] = np.multiply.accumulate(t)
    return _powers["p"], _powers["q"]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in ``data`` (uint8), and how many words each text
    ``data[bounds[i]:bounds[i+1]]`` has. Words never cross a bound."""
    n = len(data)
    counts = np.zeros(len(bounds) - 1, dtype=np.int64)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), counts
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]                      # a text's first byte starts a word
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    p, q = _power_table(n)
    total = np.cumsum(_BYTE[data] * p[:n])
    before = np.where(start > 0, total[start - 1], _U(0))
    hashes = mix((total[end] - before) * q[start], 1) + (end - start).astype(np.uint64)
    counts[:] = np.diff(np.searchsorted(start, bounds))
    return mix(hashes, 2), counts


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a (large) binary or string array."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        hashes, counts = word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        m = max(0, len(hashes) - width + 1)
        runs = np.zeros(m, dtype=np.uint64)
        for k in range(width):
            runs += hashes[k:k + m] * _POSITION[k]
        runs = mix(runs, 3)
        at = 0
        for c in counts:
            if c >= width:
                yield np.unique(runs[at:at + c - width + 1])
            elif c:
                yield mix((hashes[at:at + c] * _POSITION[8:8 + c]).sum(dtype=np.uint64, keepdims=True), 4 + int(c))
            else:
                yield np.zeros(0, dtype=np.uint64)
            at += c
        i = j

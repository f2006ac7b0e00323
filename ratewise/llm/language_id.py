"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, derived from its code point
alone, so every worker draws the same. A letter trigram (the letter with its
neighbours, or the edge of the word) is bound: the elementwise product of the
three vectors, shifted in a circle by two places, one and none. A text or a
language is the bundle, the sum of its trigrams' vectors over whole texts. The
common part of all languages (the mean of the prototypes scaled to length one)
is taken off documents and prototypes, and a document gets the language whose
prototype has the largest cosine with it; ties go to the language that comes
first by code point. The score is that cosine, at least 0.

Letters are lower-cased code points of Unicode's categories L and M. A text has a
letter if one is of category L; nulls and texts without any are ``und`` with
score 0, as is every text if nothing was learnt.

Learning adds up trigram counts by language inside each slice of a task and
bundles them once, so a task hands over one vector a language, and those are
added up by (language, place): no row count and no hot language or source
matters. Sums are whole numbers, so their order does not matter either. The
prototypes (languages x ``DIM`` numbers) are the only thing that is collected;
they do not grow with the rows.

Repeated rows count as often as they occur. Texts are read whole, long ones in
chunks. Empty tables learn nothing and give no rows. Columns pass through;
``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import ship_package
from ratewise.llm.shingles import mix

DIM = 1024
CHUNK = 500_000          # letters bundled at once
OWNERS = 256             # documents bundled at once
TABLE = 1 << 22          # entries of a lookup table
BLOCK = 2_048            # trigrams whose vectors are held at once
UNDETERMINED = "und"


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Signs (int8) of each code point; 0 stands for the edge of a word."""
    words = np.arange(dim // 64, dtype=np.uint64)
    bits = mix(mix(codes.astype(np.uint64)[:, None] * np.uint64(0x1000003) + words, 11), 12)
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


class Letters:
    """Which code points belong to words, asked once each."""

    def __init__(self):
        self.kind = np.full(0x110000, 255, dtype=np.uint8)     # 0 no, 1 mark, 2 letter

    def of(self, codes: np.ndarray) -> np.ndarray:
        kind = self.kind[codes]
        if (kind == 255).any():
            for c in np.unique(codes[kind == 255]).tolist():
                self.kind[c] = {"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0)
            kind = self.kind[codes]
        return kind


_letters: list[Letters] = []


def _chunks(texts, owners):
    """(codes, owner) arrays of lower-cased texts, a mark between texts; a long text comes in several chunks."""
    codes, owner, size = [], [], 0
    for text, o in zip(texts, owners):
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        if len(c):
            codes += [c, np.zeros(1, np.uint32)]
            owner += [o, len(c) + 1]
            size += len(c) + 1
        if size >= CHUNK:
            yield np.concatenate(codes), np.repeat(owner[::2], owner[1::2])
            codes, owner, size = [], [], 0
    if size:
        yield np.concatenate(codes), np.repeat(owner[::2], owner[1::2])


def _number(x: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (below ``bound``) in order, always with 0, and each value's place among them."""
    if bound > TABLE:
        known, place = np.unique(np.concatenate([[0], x]), return_inverse=True)
        return known, place[1:]
    seen = np.zeros(bound, dtype=bool)
    seen[x] = True
    seen[0] = True
    known = np.flatnonzero(seen)
    place = np.zeros(bound, dtype=np.int32)
    place[known] = np.arange(len(known))
    return known, place[x]


def bundles(texts: list[str], owners: list[int], n: int, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each of ``n`` owners' texts and whether any had a letter."""
    if not _letters:
        _letters.append(Letters())
    total, lettered = np.zeros((n, dim)), np.zeros(n, dtype=bool)
    for codes, owner in _chunks(texts, owners):
        kind = _letters[0].of(codes)
        lettered[owner[kind == 2]] = True
        codes = np.where(kind > 0, codes, 0)
        known, small = _number(codes, 0x110000)
        k = len(known)
        at = np.flatnonzero(small)
        ends = np.concatenate([[0], small, [0]])
        gram = (ends[at] * k + ends[at + 1]) * k + ends[at + 2]
        of = owner[at]
        for i in range(0, len(at), CHUNK):
            _bundle(total, letter_vectors(known, dim), gram[i:i + CHUNK], of[i:i + CHUNK], k)
    return total, lettered


def _bundle(total: np.ndarray, letters: np.ndarray, gram: np.ndarray, owner: np.ndarray, k: int) -> None:
    """Adds counts x trigram vectors, a block of distinct trigrams at a time."""
    n = len(total)
    grams, name = _number(gram, k ** 3)
    order = None
    if len(grams) * n > TABLE:              # many rare trigrams: only their blocks' rows at a time
        order = np.argsort(name, kind="stable")
        name, owner = name[order], owner[order]
    else:
        table = np.bincount(name * n + owner, minlength=len(grams) * n).reshape(len(grams), n)
    before, middle = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    for lo in range(0, len(grams), BLOCK):
        g = grams[lo:lo + BLOCK]
        bound = (before[g // (k * k)] * middle[g // k % k] * letters[g % k]).astype(np.float32)
        if order is None:
            counts = table[lo:lo + BLOCK]
        else:
            i, j = np.searchsorted(name, [lo, lo + BLOCK])
            counts = np.bincount((name[i:j] - lo) * n + owner[i:j], minlength=len(g) * n).reshape(len(g), n)
        total += counts.T.astype(np.float32) @ bound                 # whole numbers below 2^24: exact


def _text(x) -> str:
    x = x.as_py()
    return "" if x is None else x.decode("utf-8", "replace")


def _learn(dim: int):
    def run(batches):
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(dim, dtype=np.int64))
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            for lo in range(0, len(names), OWNERS):
                rows = [i for i, x in enumerate(langs) if lo <= number[x] < lo + OWNERS]
                found, _ = bundles([_text(batch.column(0)[i]) for i in rows], [number[langs[i]] - lo for i in rows],
                                   min(OWNERS, len(names) - lo), dim)
                for i, v in enumerate(found):
                    sums[names[lo + i]] += v.astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                              names=["lang", "v"])
    return run


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """The prototype of every language of the rows with a non-null ``lang``: sums of trigram vectors."""
    ship_package(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("binary").alias("text"), F.col(lang).cast("string").alias("lang"))
    sums = (rows.mapInArrow(_learn(dim), "lang string, v array<bigint>")
            .select("lang", F.posexplode("v").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
            .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v")))
    return {r["lang"]: np.array(r["v"], dtype=np.float64) for r in sums.collect()}       # a row a language


class Profiles:
    """Prototypes made ready for comparison."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.names = sorted(x for x, v in sums.items() if np.any(v))
        self.dim = len(next(iter(sums.values()))) if sums else DIM
        units = np.array([sums[x] / np.linalg.norm(sums[x]) for x in self.names]).reshape(len(self.names), self.dim)
        common = units.mean(axis=0) if len(units) > 1 else np.zeros(self.dim)
        self.common = common / (np.linalg.norm(common) or 1.0)
        self.units = self._apart(units)

    def _apart(self, v: np.ndarray) -> np.ndarray:
        """Without the part along the common direction, scaled to length one."""
        v = v - np.outer(v @ self.common, self.common)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(length > 0, length, 1.0)

    def compare(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found, lettered = bundles(texts, list(range(len(texts))), len(texts), self.dim)
        if not self.names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        cosine = np.round(self._apart(found) @ self.units.T, 9)
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0)
        return ([self.names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0).tolist())


def predict(docs: DataFrame, sums: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row."""
    ship_package(docs.sparkSession)
    profiles = docs.sparkSession.sparkContext.broadcast(Profiles(sums))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(column: pa.Array) -> pa.Array:
        names: list[str] = []
        scores: list[float] = []
        for lo in range(0, len(column), OWNERS):
            a, b = profiles.value.compare([_text(x) for x in column[lo:lo + OWNERS]])
            names += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
    out = docs.withColumn("_lang", run(F.col(text).cast("binary")))
    return out.withColumns({c: F.col(f"_lang.{c}") for c in ("lang_pred", "score")}).drop("_lang")

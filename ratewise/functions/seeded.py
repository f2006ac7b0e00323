"""Reproducible pseudo-random columns (D4, D7, D8), re-aimed as pure
functions of the row key.

``rand(seed)`` depends on how rows fall into partitions, so a retried task or
a different cluster size would change the values. Here every draw is an
integer hash of the key columns salted by a draw id: the same row gets the
same value on every run, engine and partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewise.functions.columns import map_lookup
from ratewise.operators.clean import HASH_BITS, row_hash

# --- fixed values (room-type rate ranges, event classes and weights) -------
ROOM_BASE_PRICE = {"A": (80, 130), "B": (80, 130), "C": (130, 200), "D": (130, 200),
                   "E": (160, 250), "F": (180, 280), "G": (220, 350), "H": (180, 280),
                   "L": (160, 250), "P": (80, 130)}
DEFAULT_PRICE_RANGE = (100, 180)
EVENT_TYPES = ["None", "Concert", "Sports", "Conference", "Festival", "Holiday"]
EVENT_WEIGHTS = [0.45, 0.10, 0.10, 0.12, 0.08, 0.15]
# ---------------------------------------------------------------------------


def uniform01(keys: Sequence[str], salt: int) -> Column:
    """A value in [0, 1) from the key hash: its upper 53 bits, exact in a double."""
    return F.shiftright(row_hash(keys, salt), HASH_BITS - 53) / F.lit(float(2 ** 53))


def seeded_uniform(keys: Sequence[str], lo, hi, salt: int) -> Column:
    """Uniform in [lo, hi); ``lo``/``hi`` may be columns (per-row ranges)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    return lo_c + (hi_c - lo_c) * uniform01(keys, salt)


def room_base_price(room: str | Column, keys: Sequence[str], salt: int = 42) -> Column:
    """Base rate drawn from the room type's range (default range when the
    type is not in the lookup), rounded to 2 places."""
    r = F.upper(F.col(room) if isinstance(room, str) else room)
    lo = map_lookup(r, {k: float(v[0]) for k, v in ROOM_BASE_PRICE.items()}, float(DEFAULT_PRICE_RANGE[0]))
    hi = map_lookup(r, {k: float(v[1]) for k, v in ROOM_BASE_PRICE.items()}, float(DEFAULT_PRICE_RANGE[1]))
    return F.round(seeded_uniform(keys, lo, hi, salt).cast("decimal(18,8)"), 2).cast("double")


def seeded_choice(keys: Sequence[str], labels: Sequence[str], weights: Sequence[float], salt: int) -> Column:
    """Weighted categorical draw (cumulative weights against one uniform)."""
    u = uniform01(keys, salt)
    acc = 0.0
    out = None
    for lab, w in zip(labels[:-1], weights[:-1]):
        acc += w
        out = F.when(u < acc, lab) if out is None else out.when(u < acc, lab)
    return out.otherwise(labels[-1]) if out is not None else F.lit(labels[-1])


def seeded_int(keys: Sequence[str], lo: int, hi: int, salt: int) -> Column:
    """Integer in [lo, hi)."""
    return (F.lit(lo) + row_hash(keys, salt) % (hi - lo)).cast("int")


def seeded_event(keys: Sequence[str], salt: int = 7) -> tuple[Column, Column]:
    """Event type by the class weights and, when there is an event, a
    magnitude 1..5."""
    ev = seeded_choice(keys, EVENT_TYPES, EVENT_WEIGHTS, salt)
    mag = F.when(ev == "None", F.lit(0)).otherwise(seeded_int(keys, 1, 6, salt + 1))
    return ev, mag

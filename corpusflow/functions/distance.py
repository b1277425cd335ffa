"""Edit distance of two sequences, for words as well as characters."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def sequence_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Least number of insertions, deletions and replacements, by the bit-parallel row update of Myers and Hyyrö.

    Sequences may have any length and any number of different members. What both begin or
    end with is left out; the longer rest is a row of bits, which each member of the
    shorter one updates.
    """
    first, last_a, last_b = 0, len(a), len(b)
    while first < last_a and first < last_b and a[first] == b[first]:
        first += 1
    while last_a > first and last_b > first and a[last_a - 1] == b[last_b - 1]:
        last_a, last_b = last_a - 1, last_b - 1
    x, y = a[first:last_a], b[first:last_b]
    if len(x) < len(y):
        x, y = y, x
    if not y:
        return len(x)
    at: dict[Hashable, int] = {}
    bit = 1
    for w in x:
        at[w] = at.get(w, 0) | bit
        bit <<= 1
    full, top = bit - 1, bit >> 1
    up, down, score = full, 0, len(x)
    for w in y:
        match = at.get(w, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
    return score


@F.arrow_udf(LongType())
def word_distance(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Edit distance over the blank-separated words of two texts; a null text has no words."""
    pairs = zip(reference.to_pylist(), hypothesis.to_pylist(), strict=True)
    return pa.array([0 if r == h else sequence_distance((r or "").split(), (h or "").split()) for r, h in pairs], pa.int64())

"""Merged intervals against a plain sweep, and the defined edge cases."""

import random

import numpy as np
import pytest

from corpusflow.operators import intervals
from corpusflow.operators.intervals import disjoint, merged, merged_intervals

SCHEMA = "entity string, start_time double, end_time double, kind string, s int"


def sweep(rows):
    by = {}
    for entity, a, b in rows:
        if entity is None or a is None or b is None or not (abs(a) < 1e12 and abs(b) < 1e12):
            continue
        a, b = round(a * 1000), round(b * 1000)
        if a < b:
            by.setdefault(entity, []).append((a, b))
    out = set()
    for entity, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(entity, "period", a, b) for a, b in merged}
        out |= {(entity, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)}
    return out


def run(spark, rows, slice_ms=600_000, block_slices=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in merged_intervals(df, "entity", "start_time", "end_time", slice_ms, block_slices).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("slice_ms", [50, 5_000, 600_000])
def test_random_against_sweep(spark, slice_ms):
    rng = random.Random(slice_ms)
    rows = []
    for e in range(6):
        for _ in range(rng.choice([1, 5, 60])):
            a = rng.randint(0, 4000) / 100
            rows.append((f"e{e}", a, a + rng.choice([0.01, 0.5, 3, 30, -1, 0])))
    rows += rows[:20]
    assert run(spark, rows, slice_ms) == sweep(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, 0.0, 1.0), ("a", None, 1.0), ("a", 1.0, None), ("a", nan, 2.0), ("a", 0.0, inf), ("a", 2.0, 1.0), ("a", 1.0, 1.0), ("b", -5.0, -1.0), ("b", -1.0, 0.5)]
    assert run(spark, rows) == {("b", "period", -5000, 500)}
    assert run(spark, [("d", 0.0, 1.0), ("d", 1.0, 2.0), ("d", 2.001, 3.0)]) == {("d", "period", 0, 2000), ("d", "period", 2001, 3000), ("d", "gap", 2000, 2001)}


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_one_entity_with_most_rows(spark):
    rows = [("hot", i * 0.5, i * 0.5 + 0.4) for i in range(3000)] + [("cold", 0.0, 1.0)]
    assert run(spark, rows, 10_000) == sweep(rows)


def test_times_far_out(spark):
    rows = [("a", 5e12, 6e12), ("a", 5.5e12, 7e12), ("a", -9e14, -8e14)]
    assert run(spark, rows, 1 << 40) == {("a", "period", 5 * 10**15, 7 * 10**15), ("a", "period", -9 * 10**17, -8 * 10**17), ("a", "gap", -8 * 10**17, 5 * 10**15)}
    with pytest.raises(Exception, match="64-bit"):
        run(spark, [("c", 1e300, 2e300)])


def test_states_merge_in_any_order():
    rng = random.Random(5)

    def state():
        spans = sorted((a, a + rng.randint(1, 9)) for a in (rng.randint(0, 120) for _ in range(rng.randint(0, 12))))
        return disjoint(np.array([s for s, _ in spans], np.int64), np.array([e for _, e in spans], np.int64))

    for _ in range(300):
        a, b, c = state(), state(), state()
        same = lambda x, y: all(np.array_equal(p, q) for p, q in zip(x, y, strict=True))
        assert same(merged(a, b), merged(b, a)) and same(merged(a, a), a)
        assert same(merged(merged(a, b), c), merged(a, merged(b, c)))
        covered = {t for s in (a, b) for x, y in zip(*s, strict=True) for t in range(2 * x, 2 * y + 1)}
        assert {t for x, y in zip(*merged(a, b), strict=True) for t in range(2 * x, 2 * y + 1)} == covered


def test_a_task_passes_states_on(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HELD", 10)
    rng = random.Random(9)
    rows = [(rng.choice("ab"), a, a + rng.choice([0.5, 40.0])) for a in (rng.randint(0, 3000) / 10 for _ in range(400))]
    assert run(spark, rows, 7_000) == sweep(rows)

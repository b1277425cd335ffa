"""Continuous periods and gaps of overlapping time intervals.

The aggregate's state is a sorted list of disjoint intervals, and two states merge in one
linear pass. States are combined in a tree: rows to a state per task and time slice, the
tasks' states of a slice in two levels, then the slices of a block and the blocks of an
entity. Times carry from slice to slice as one running maximum, so the upper levels only
hand on the borders of what they have finished and no list of a whole entity is ever held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.sizing import saved

#: Length of a time slice; a state holds at most the disjoint intervals that start in one slice.
SLICE_MS = 600_000
#: Slices in a block, the level above.
BLOCK_SLICES = 1024
#: States of a slice are merged in this many parts before they meet, so a hot slice isn't one task's work.
FAN = 16
#: Intervals a task holds in its states before it passes them on.
HELD = 500_000
#: Times of this many milliseconds and beyond raise an error; the sums with a slice must fit in 64 bits.
MAX_MS = 1 << 62

State = tuple[np.ndarray, np.ndarray]
_STATE = "entity string, slice bigint, starts array<bigint>, ends array<bigint>"


def disjoint(start: np.ndarray, end: np.ndarray) -> State:
    """Intervals sorted by start as a state: those that overlap or touch become one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    opens = np.append(0, np.flatnonzero(start[1:] > reach[:-1]) + 1)
    return start[opens], reach[np.append(opens[1:], len(start)) - 1]


def merged(a: State, b: State) -> State:
    """Two states as one: a linear merge by start, then one pass that joins what overlaps or touches.

    Associative and commutative, and merging a state with itself changes nothing.
    """
    n = len(a[0]) + len(b[0])
    at = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))  # where the second list's intervals go
    from_b = np.zeros(n, bool)
    from_b[at] = True
    both = (np.empty(n, np.int64), np.empty(n, np.int64))
    for out, x, y in zip(both, a, b, strict=True):
        out[from_b], out[~from_b] = y, x
    return disjoint(*both)


def _combined(states: list[State]) -> State:
    """Many states as one, merged pairwise, so an interval takes part in as many merges as the tree is deep."""
    while len(states) > 1:
        pairs = [merged(*states[i : i + 2]) for i in range(0, len(states) - 1, 2)]
        states = pairs + states[len(pairs) * 2 :]
    return states[0]


def _state_rows(states: dict[tuple, State]) -> pa.RecordBatch:
    columns = [pa.array([k[0] for k in states], pa.string()), pa.array([k[1] for k in states], pa.int64())]
    lists = [pa.array([s[i] for s in states.values()], pa.list_(pa.int64())) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, *lists], names=["entity", "slice", "starts", "ends"])


def _of_task(slice_ms: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Level one: rows of ``entity, s, e`` to the task's states; repeats and overlaps never reach the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, State] = {}
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            start, end = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            part = start // slice_ms
            order = np.lexsort((start, part, code))
            code, part, start, end = code[order], part[order], start[order], end[order]
            edges = np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1
            known = names.dictionary.to_pylist()
            for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(code)).tolist(), strict=True):
                key, new = (known[code[a]], int(part[a])), disjoint(start[a:b], end[a:b])
                old = states.get(key)
                states[key] = new if old is None else merged(old, new)
                held += len(states[key][0]) - (len(old[0]) if old is not None else 0)
            if held > most:
                yield _state_rows(states)
                states, held = {}, 0
        if states:
            yield _state_rows(states)

    return run


def _merge_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level two: the states of a slice, which come one after the other, merged in a binary tree.

    ``waiting`` holds at most one state of each depth, as a binary counter does.
    """
    key, waiting = None, {}

    def done() -> dict[tuple, State]:
        return {key: _combined(list(waiting.values()))} if waiting else {}

    for batch in batches:
        out: dict[tuple, State] = {}
        lists = [(batch.column(i).offsets.to_numpy(), batch.column(i).values.to_numpy(zero_copy_only=False)) for i in (2, 3)]
        for i, here in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if here != key:
                out |= done()
                key, waiting = here, {}
            state, depth = tuple(values[at[i] : at[i + 1]] for at, values in lists), 0
            while depth in waiting:
                state, depth = merged(waiting.pop(depth), state), depth + 1
            waiting[depth] = state
        yield _state_rows(out)
    yield _state_rows(done())


def _one_state_per(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.repartition(*keys).sortWithinPartitions(*keys).select("entity", "slice", "starts", "ends").mapInArrow(_merge_states, _STATE)


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's intervals without those that an earlier slice's intervals cover whole."""
    for batch in batches:
        for entity, part, starts, ends, carry in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            s, e = np.array(starts, np.int64), np.array(ends, np.int64)
            left = np.ones(len(s), bool) if carry is None else e > carry
            n = int(left.sum())
            columns = [pa.array([entity] * n, pa.string()), pa.array(np.full(n, part)), pa.array(s[left]), pa.array(e[left]), pa.array(np.zeros(n, bool))]
            yield pa.RecordBatch.from_arrays(columns, names=["entity", "slice", "s", "e", "inner"])


def _stitched(keys: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A node's intervals in time order to finished periods and gaps, and to its borders for the level above.

    Rows start with ``keys`` key columns, then have ``s, e, inner``; ``inner`` says that the gap before the row
    is finished already. Result rows have the kinds period, gap, border and inner; at the ``last`` level no borders are left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, entity, first, period = None, None, True, None

        def ended(out: list) -> None:
            if period is not None:
                out.append((entity, "period" if last else "border" if first else "inner", *period))

        def rows(out: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["entity", "kind", "s", "e"])

        for batch in batches:
            out: list = []
            for *key, s, e, inner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    ended(out)
                    node, entity, first, period = key, key[0], True, None
                if period is not None and s <= period[1]:
                    period = (period[0], max(period[1], e))
                    continue
                if period is not None:
                    out.append((entity, "border" if first and not last else "period", *period))
                    if not inner:
                        out.append((entity, "gap", period[1], s))
                    first = False
                period = (s, e)
            yield rows(out)
        out = []
        ended(out)
        yield rows(out)

    return run


def valid_intervals(rows: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """``entity, s, e`` in whole milliseconds, of rows with an entity, both times, and the end later than the start.

    NaN and infinity are no times; a finite time of ``MAX_MS`` or more raises an error.
    """

    def ms(name: str) -> Column:
        value = F.col(name).cast("double")
        far = F.raise_error(F.lit("a time beyond 64-bit milliseconds")).cast("bigint")
        is_time = ~F.isnan(value) & (F.abs(value) != float("inf"))
        return F.when(is_time, F.when(F.abs(value) * 1000 >= float(MAX_MS), far).otherwise(F.round(value * 1000).cast("bigint")))

    return rows.select(F.col(entity).cast("string").alias("entity"), ms(start).alias("s"), ms(end).alias("e")).filter("entity is not null and s < e")


def merged_intervals(rows: DataFrame, entity: str, start: str, end: str, slice_ms: int = SLICE_MS, block_slices: int = BLOCK_SLICES) -> DataFrame:
    """``entity, kind, start_ms, end_ms``: the periods that intervals cover without a break, and the gaps between them.

    ``start`` and ``end`` are in seconds and rounded to milliseconds. Rows without entity
    or time, and empty or reversed ones, don't count; repeats, ties and nested intervals
    change nothing; touching intervals continue each other. Other columns are ignored. An
    empty table gives an empty result. The merged states are written once, so this runs a job.
    """
    states = valid_intervals(rows, entity, start, end).mapInArrow(_of_task(slice_ms, HELD), _STATE)
    states = _one_state_per(states.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN))), ["entity", "slice", "part"])
    states = saved(_one_state_per(states, ["entity", "slice"]))
    # How far the earlier slices reach into a slice: a running maximum over slices inside blocks, and over blocks.
    block = F.floor(F.col("slice") / F.lit(block_slices))
    reach = states.select("entity", "slice", block.alias("block"), F.element_at("ends", -1).alias("reach"))
    earlier = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = reach.groupBy("entity", "block").agg(F.max("reach").alias("reach")).select("entity", "block", F.max("reach").over(earlier).alias("far"))
    inside = Window.partitionBy("entity", "block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = reach.withColumn("near", F.max("reach").over(inside)).join(blocks, ["entity", "block"]).select("entity", "slice", F.greatest("near", "far").alias("carry"))
    carried = states.join(carry, ["entity", "slice"]).select("entity", "slice", "starts", "ends", "carry")
    pieces = carried.mapInArrow(_uncovered, "entity string, slice bigint, s bigint, e bigint, inner boolean").select("entity", block.alias("block"), "s", "e", "inner")
    # Level three: the slices of a block. Level four: the borders of the blocks.
    kinds = "entity string, kind string, s bigint, e bigint"
    in_blocks = saved(pieces.repartition("entity", "block").sortWithinPartitions("entity", "block", "s").mapInArrow(_stitched(2, False), kinds))
    borders = in_blocks.filter("kind in ('border', 'inner')").select("entity", "s", "e", (F.col("kind") == "inner").alias("inner"))
    over_blocks = borders.repartition("entity").sortWithinPartitions("entity", "s").mapInArrow(_stitched(1, True), kinds)
    found = in_blocks.filter("kind in ('period', 'gap')").unionByName(over_blocks)
    return found.select("entity", "kind", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))

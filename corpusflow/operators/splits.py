"""Exact stratified splits and duration budgets, in an order fixed by hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.operators.timing import streamed
from corpusflow.sizing import lookup, prefix_totals, saved


def hash_key(salt: str, *keys: Column) -> Column:
    """The hash that orders rows: md5 of the salt and the keys."""
    return F.md5(F.concat_ws("|", F.lit(salt), *keys))


def check_ratios(*ratios: float) -> None:
    """Ratios must not be negative and add up to one."""
    if not all(r >= 0 for r in ratios) or abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("split ratios must not be negative and add up to 1")


def exact_split(df: DataFrame, leaf: str, key: str, seed: int = 42, train: float = 0.7, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """``df`` with ``new_split``: exactly the floor of each share of a leaf to train and val, the rest to test.

    Rows stand in the order of a seeded hash. A row's ordinal is its place within a hash
    bucket plus the rows of earlier buckets, so a leaf of any size is never one sort task.
    A null leaf is a leaf of its own.
    """
    check_ratios(train, val, test)
    order = hash_key(f"{seed}", F.coalesce(F.col(leaf), F.lit("")), F.col(key).cast("string"))
    # 4,096 buckets by the first digits of the hash, all of like size.
    keyed = df.withColumns({"_leaf": F.coalesce(F.col(leaf), F.lit("")), "_hash": order, "_one": F.lit(1)}).withColumn("_bucket", F.substring("_hash", 1, 3))
    placed = prefix_totals(keyed, ["_leaf"], "_bucket", [F.col("_hash"), F.col(key)], "_one", "_ordinal")
    sizes = keyed.groupBy("_leaf").agg(F.count("*").alias("_n"))
    n_train, n_val = F.floor(F.col("_n") * F.lit(float(train))), F.floor(F.col("_n") * F.lit(float(val)))
    split = F.when(F.col("_ordinal") <= n_train, "train").when(F.col("_ordinal") <= n_train + n_val, "val").otherwise("test")
    return placed.join(sizes, "_leaf").withColumn("new_split", split).drop("_leaf", "_hash", "_one", "_bucket", "_ordinal", "_n")


def first_in_hash_order(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """The first ``n`` rows in the order of a salted hash."""
    return df.orderBy(hash_key(salt, F.col(key)), F.col(key)).limit(n)


def _taken(lengths: np.ndarray, total: float, seconds: float) -> tuple[np.ndarray, float]:
    """Which rows, one after the other, fit what is left of the budget, and the total after them.

    A run of rows that fit is found at once, and after a row that doesn't fit only those
    short enough are looked at, so the work is a few passes and not one step a row. The
    total grows row by row, as a plain loop would let it.
    """
    chosen = np.zeros(len(lengths), bool)
    open_rows = np.flatnonzero(total + lengths <= seconds)
    while len(open_rows):
        upto = np.add.accumulate(np.concatenate(([total], lengths[open_rows])))[1:]
        n = int(np.searchsorted(upto > seconds, True))
        chosen[open_rows[:n]] = True
        if n:
            total = float(upto[n - 1])
        open_rows = open_rows[n:]
        open_rows = open_rows[total + lengths[open_rows] <= seconds]
    return chosen, total


def greedy_budget(df: DataFrame, duration: str, key: str, seconds: float, salt: str, group: str | None = None) -> DataFrame:
    """Rows chosen in hash order while they fit the budget; one that doesn't fit is skipped, the first is always taken.

    Rows without a positive duration are never chosen. With ``group`` each group has the
    budget; ``key`` is unique. Sums over 4,096 ranges of the hash tell in which range the
    budget runs out. The rule goes through the rows up to there, and then only through those
    later ones that are short enough for what is left, so a group is never one task's work.
    """
    rows = df.withColumns({"_group": F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit(""), "_seconds": F.col(duration).cast("double"), "_hash": hash_key(salt, F.col(key))})
    rows = rows.filter("_seconds > 0 and not isnan(_seconds)").withColumn("_bucket", F.substring("_hash", 1, 3))

    def start() -> Callable:
        total, begun = 0.0, False

        def choose(lengths: np.ndarray) -> np.ndarray:
            nonlocal total, begun
            head = np.zeros(0, bool)
            if not begun and len(lengths):
                begun, total, head = True, float(lengths[0]), np.ones(1, bool)
            if total >= seconds:
                return np.append(head, np.zeros(len(lengths) - len(head), bool))
            chosen, total = _taken(lengths[len(head) :], total, seconds)
            return np.append(head, chosen)

        return choose

    def passed(offers: DataFrame) -> DataFrame:
        return streamed(offers, "_group", [F.col("_hash"), F.col(key)], ["_seconds"], start, "_chosen boolean").filter("_chosen").drop("_chosen")

    slack = 1e-6 * seconds  # sums in another order differ in their last digits
    sums = rows.groupBy("_group", "_bucket").agg(F.sum("_seconds").alias("_sum"))
    upto = sums.select("_group", "_bucket", F.sum("_sum").over(Window.partitionBy("_group").orderBy("_bucket")).alias("_upto"))
    edges = upto.filter(F.col("_upto") > F.lit(seconds - slack)).groupBy("_group").agg(F.min("_bucket").alias("_edge"))
    marked = lookup(rows, saved(edges), ["_group"], "left")
    before = saved(passed(marked.filter("_edge is null or _bucket <= _edge")))
    left = before.groupBy("_group").agg((F.lit(seconds + slack) - F.sum("_seconds")).alias("_left"))
    after = lookup(marked.filter("_bucket > _edge"), saved(left), ["_group"]).filter("_seconds <= _left").select(*before.columns)
    return passed(before.unionByName(after)).drop("_group", "_seconds", "_hash", "_bucket", "_edge")


def three_phase_budget(df: DataFrame, duration: str, key: str, seconds: float, seed_rows: Column, n_seed: int) -> DataFrame:
    """``df``'s chosen rows with their ``phase``, never over the budget.

    Phase 1 takes up to ``n_seed`` seed rows in hash order, phase 2 the longest others that
    fit, phase 3 the shortest of what is left. Phase 2 skips a row only when it is longer
    than what is left, and what is left only shrinks, so phase 3 adds none, whatever the
    rows. ``key`` is unique. Rows of one length are alike to the rule: it goes through the
    lengths and says how many rows of each it takes, which are then the first by hash.
    """
    base = df.withColumns({"_seconds": F.col(duration).cast("double"), "_all": F.lit("")}).filter("_seconds > 0 and not isnan(_seconds)")
    first = base.filter(seed_rows).withColumn("_hash", hash_key("seed", F.col(key))).orderBy("_hash", key).limit(n_seed)
    first = first.select(key, "_seconds", "_hash", "_all")

    def start() -> Callable:
        total = 0.0

        def choose(lengths: np.ndarray) -> np.ndarray:
            nonlocal total
            chosen, total = _taken(lengths, total, seconds)
            return chosen

        return choose

    seeded = saved(streamed(first, "_all", [F.col("_hash"), F.col(key)], ["_seconds"], start, "_chosen boolean").filter("_chosen").select(key, "_seconds", "_hash"))
    used = float(np.add.accumulate([0.0, *(r["_seconds"] for r in seeded.orderBy("_hash", key).collect())])[-1])  # at most n_seed rows
    rest = saved(lookup(base, seeded.select(key), [key], "left_anti").select(key, "_seconds"))
    lengths = rest.groupBy("_seconds").agg(F.count("*").alias("_n"))
    counts = _offered(lengths, used, seconds).coalesce(1).sortWithinPartitions(F.desc("_seconds")).mapInArrow(_rows_per_length(used, seconds), "_seconds double, _takes bigint")
    offers = lookup(rest, saved(counts), ["_seconds"]).withColumns({"_hash": hash_key("longest", F.col(key)), "_one": F.lit(1)})
    ranked = prefix_totals(offers.withColumn("_bucket", F.substring("_hash", 1, 3)), ["_seconds"], "_bucket", [F.col("_hash"), F.col(key)], "_one", "_rank")
    second = ranked.filter("_rank <= _takes").select(key, F.lit(2).alias("phase"))
    return lookup(df, seeded.select(key, F.lit(1).alias("phase")).unionByName(second), [key])


def _offered(lengths: DataFrame, used: float, seconds: float) -> DataFrame:
    """Lengths of which the rule may take rows: those that go into the budget whole, longest first, the one at which it runs out, and all that fit after the whole ones."""
    summed = lengths.withColumns({"_sum": F.col("_n") * F.col("_seconds"), "_bucket": -F.floor("_seconds")})
    upto = prefix_totals(summed, [], "_bucket", [F.desc("_seconds")], "_sum", "_upto")
    slack = 1e-6 * seconds
    whole = F.col("_upto") <= F.lit(seconds - used - slack)
    taken, edge = upto.agg(F.coalesce(F.max(F.when(whole, F.col("_upto"))), F.lit(0.0)), F.max(F.when(~whole, F.col("_seconds")))).first()
    return lengths if edge is None else lengths.filter((F.col("_seconds") >= F.lit(edge)) | (F.col("_seconds") <= F.lit(seconds - used - taken + slack)))


def _rows_per_length(used: float, seconds: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lengths, longest first, with their numbers of rows, to those of which rows are taken, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = used
        for batch in batches:
            length, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            out = []
            at = np.flatnonzero(total + length <= seconds)
            while len(at):
                i = at[0]
                most = min(int(n[i]), int((seconds - total) / length[i]) + 1)
                chosen, total = _taken(np.full(most, length[i]), total, seconds)
                out.append((length[i], int(chosen.sum())))
                at = at[1:][total + length[at[1:]] <= seconds]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.float64(), pa.int64()))], names=["_seconds", "_takes"])

    return run


def split_counts(df: DataFrame, leaf: str, split: str) -> DataFrame:
    """Planned and actual rows of each leaf and split."""
    n = F.col("n_rows")
    counts = df.groupBy(leaf).agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(split) == s).alias(f"n_{s}") for s in ("train", "val", "test")))
    planned = {"planned_train": F.floor(n * F.lit(0.7)), "planned_val": F.floor(n * F.lit(0.15))}
    return counts.withColumns(planned).withColumn("planned_test", n - F.col("planned_train") - F.col("planned_val"))

"""Splits that keep related records together: grouped iterative stratification.

Records that share a recording or a speaker, directly or through others, form a group.
Groups get label vectors, and the groups with the rarest outstanding label are placed
first, into the split that lacks most of it. Every group is placed so, at every size: a
label is a round, and in a round groups with as many records of the label and as many
records in all are a class, of which only the number that each split gets is found in
order. A class is then dealt out to its groups without gathering them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.reading import source_name, speaker_name, split_name
from corpusflow.llm.components import connected_components
from corpusflow.sizing import BROADCAST_ROWS, lookup, prefix_totals, release, saved, saved_with

#: The label that every record has.
ALL = ""


@dataclass(frozen=True)
class Groups:
    """``records``: uid, group, split and labels, a row per uid. ``vectors``: group, label, n; the present splits are labels too."""

    records: DataFrame
    vectors: DataFrame


def _node(recording: Column, speaker: Column, uid: Column) -> Column:
    """Name of what ties a record to others; speakers sort before recordings, so they name the groups."""
    return F.coalesce(F.concat(F.lit("1"), recording), F.concat(F.lit("0"), speaker), F.concat(F.lit("2"), uid))


def find_groups(segments: DataFrame, labels: tuple[str, ...] = ("source", "dialect")) -> tuple[Groups, DataFrame]:
    """Groups of ``segments`` and their label vectors.

    A record is a distinct uid, rows without one are left out; of repeated rows any counts
    once. Null and blank speakers and null recordings tie nothing; a record with neither
    is its own group. A null label or split has no place in the vector. Other columns,
    whatever their names, are ignored.
    """
    read = segments.filter("uid is not null").select(
        F.col("uid").cast("string").alias("uid"),
        F.col("recording_id").cast("string").alias("recording"),
        speaker_name(F.col("speaker_id")).alias("speaker"),
        split_name(F.col("split")).alias("split"),
        *(source_name(F.col(c)).alias(f"label_{c}") if c == "source" else F.col(c).cast("string").alias(f"label_{c}") for c in labels),
    )
    links = read.select(F.concat(F.lit("0"), "speaker").alias("a"), F.concat(F.lit("1"), "recording").alias("b"))
    groups = connected_components(links, "a", "b")
    named = [f"label_{c}" for c in labels]
    records = read.withColumn("node", _node(F.col("recording"), F.col("speaker"), F.col("uid")))
    records = records.groupBy("uid").agg(F.min_by(F.struct("node", "recording", "split", *named), F.struct("node", "split")).alias("r")).select("uid", "r.*")
    # Rows of a node are counted before they meet the group table, so a hot recording is a few rows there.
    parts = F.array(
        F.struct(F.lit("").alias("kind"), F.lit("").alias("value")),
        F.struct(F.lit("split").alias("kind"), F.col("split").alias("value")),
        *(F.struct(F.lit(c).alias("kind"), F.col(f"label_{c}").alias("value")) for c in labels),
    )
    records = saved(records)
    counted = records.select("node", F.inline(parts)).filter("value is not null").groupBy("node", "kind", "value").agg(F.count("*").alias("n"))
    group = F.coalesce("component", "node").alias("group")
    vectors = counted.join(groups, "node", "left").select(group, "kind", "value", "n").groupBy("group", "kind", "value").agg(F.sum("n").alias("n"))
    nodes = saved(records.select("node", "recording").distinct().join(groups, "node", "left").select("node", "recording", group))
    return Groups(lookup(records, nodes.select("node", "group").distinct(), ["node"]), saved(vectors)), nodes


def torn_groups(segments: DataFrame) -> DataFrame:
    """``group_id, recording_id, n_splits``: recordings of groups with a speaker whose rows stand in two or more splits."""
    groups, nodes = find_groups(segments, ())
    torn = groups.vectors.filter("kind = 'split' and value in ('train', 'val', 'test') and group like '0%'")
    torn = torn.groupBy("group").agg(F.count("*").alias("n_splits")).filter("n_splits >= 2")
    held = nodes.filter("recording is not null").select("group", "recording").distinct()
    return lookup(held, saved(torn), ["group"]).select(F.substring("group", 2, 1 << 30).alias("group_id"), F.col("recording").alias("recording_id"), "n_splits")


def most_needed(held: list[int], size: int, shares: list[float], room: list[float], n: int) -> list[int]:
    """How many of ``n`` groups of ``size`` each split gets when one after the other goes where least of the share is ``held``.

    A split takes at most ``room`` groups. Ties go to the first. The level to which the
    splits rise is searched first, so the work does not grow with ``n``.
    """
    n = int(min(n, sum(room)))

    def under(level: float) -> list[int]:
        return [int(min(r, max(0, ceil((level * p - h) / size)))) for h, p, r in zip(held, shares, room, strict=True)]

    low, high = 0.0, 1.0
    while sum(under(high)) < n:
        high *= 2
    for _ in range(100):
        level = (low + high) / 2
        low, high = (level, high) if sum(under(level)) <= n else (low, level)
    taken = [max(0, k - 1) for k in under(low)]  # the last ones are dealt in turn, so that rounding decides no tie
    queue = [((h + k * size) / p, i) for i, (h, p, k, r) in enumerate(zip(held, shares, taken, room, strict=True)) if k < r]
    heapq.heapify(queue)
    for _ in range(n - sum(taken)):
        _, i = heapq.heappop(queue)
        taken[i] += 1
        if taken[i] < room[i]:
            heapq.heappush(queue, ((held[i] + taken[i] * size) / shares[i], i))
    return taken


def class_shares(size: int, records: int, n: int, held: list[int], held_all: list[int], shares: list[float], total: int) -> list[int]:
    """Splits of ``n`` groups with ``size`` records of the label and ``records`` in all; adds them to both ``held``.

    A group goes to the split with the largest part of its share of the label outstanding,
    among the splits that lack all of the group's records, or among all if none does.
    """
    counts = [0] * len(shares)
    for room in ([max(0, floor((p * total - a) / records)) for p, a in zip(shares, held_all, strict=True)], [float("inf")] * len(shares)):
        left = n - sum(counts)
        if left:
            for i, k in enumerate(most_needed(held, size, shares, room, left)):
                counts[i] += k
                held[i] += k * size
                held_all[i] += k * records
    return counts


def _dealt(held: list[int], held_all: list[int], shares: list[float], total: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Classes in their order, largest first, to the number of their groups that each split gets; keeps a number for each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, now_all = list(held), list(held_all)
        for batch in batches:
            counts = [class_shares(*row, now, now_all, shares, total) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.list_(pa.int64()))], names=["size", "records", "gets"])

    return run


def _with_splits(ranked: DataFrame, names: list[str]) -> DataFrame:
    """``new_split`` by the ``ordinal`` of a group in its class: a split's groups lie evenly among those the earlier splits left."""
    out = ranked.withColumns({"i": F.col("ordinal"), "left": F.aggregate("gets", F.lit(0).cast("bigint"), lambda a, x: a + x), "new_split": F.lit(None).cast("string")})
    for at, name in enumerate(names):
        upto, before = (F.expr(f"({i} * gets[{at}]) div greatest(left, 1)") for i in ("i", "(i - 1)"))
        out = out.withColumns({"upto": upto, "new_split": F.coalesce("new_split", F.when(upto > before, F.lit(name)))})
        out = out.withColumns({"i": F.col("i") - F.col("upto"), "left": F.col("left") - F.col("gets")[at]})
    return out


def place(groups: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``group, new_split`` of ``group, records, counts``, the last a map of labels to record numbers above 0.

    Rounds go from label to label, the one with fewest outstanding records first. The
    driver holds a number for each label and split; a round's classes, at most one for each
    pair of sizes, pass through one task that keeps a number for each split. Inside a
    class, groups lie in the order of their vectors, so like ones are dealt out evenly.
    """
    names = sorted((s for s, x in shares.items() if x > 0), key=lambda s: (-shares[s], s))
    parts = [shares[s] for s in names]
    groups, figures = saved_with(groups.withColumn("vector", F.md5(F.to_json(F.array_sort(F.map_entries("counts"))))), total=F.sum("records"))
    label = F.explode("counts").alias("label", "n")
    left = {r["label"]: r["n"] for r in groups.select(label).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    total = left[ALL] = figures["total"] or 0
    held = {x: [0] * len(names) for x in left}
    done: list[str] = []
    placed: list[DataFrame] = []
    while left[ALL] > 0:
        rare = min((x for x, n in left.items() if n > 0 and x != ALL), key=lambda x: (left[x], x), default=ALL)
        seen = F.arrays_overlap(F.map_keys("counts"), F.array(*map(F.lit, done)).cast("array<string>"))
        having = groups.filter(~seen).withColumn("size", F.col("records") if rare == ALL else F.try_element_at("counts", F.lit(rare))).filter("size > 0")
        classes = having.groupBy("size", "records").agg(F.count("*").alias("n")).coalesce(1).sortWithinPartitions(F.desc("size"), F.desc("records"))
        gets, figures = saved_with(classes.mapInArrow(_dealt(held[rare], held[ALL], parts, total), "size bigint, records bigint, gets array<bigint>"), n=F.count("*"))
        # Buckets by vector and then by group, so neither a hot class nor a hot vector is one sort task.
        keyed = having.withColumns({"one": F.lit(1), "key": F.md5("group")}).withColumn("bucket", F.concat(F.substring("vector", 1, 2), F.substring("key", 1, 2)))
        ranked = prefix_totals(keyed, ["size", "records"], "bucket", [F.col("vector"), F.col("key"), F.col("group")], "one", "ordinal")
        # Counted while it was written: so few rows of a few numbers may be broadcast.
        told = ranked.join(F.broadcast(gets), ["size", "records"]) if figures["n"] <= BROADCAST_ROWS else lookup(ranked, gets, ["size", "records"])
        got = saved(_with_splits(told, names).select("group", "records", "counts", "new_split"))
        release(gets)
        every = F.explode(F.map_concat("counts", F.create_map(F.lit(ALL), F.col("records")))).alias("label", "n")
        for r in got.select("new_split", every).groupBy("new_split", "label").agg(F.sum("n").alias("n")).collect():
            held[r["label"]][names.index(r["new_split"])] += r["n"]
            left[r["label"]] -= r["n"]
        done.append(rare)
        placed.append(got.select("group", "new_split"))
    return reduce(DataFrame.unionByName, placed) if placed else groups.select("group", F.lit("").alias("new_split"))


def assign_splits(segments: DataFrame, targets: DataFrame, labels: tuple[str, ...] = ("source", "dialect")) -> DataFrame:
    """``uid, group_id, old_split, new_split``: one split per record, the same for all records of a group.

    ``labels`` are columns of few values: each value is a round of ``place``. Shares are
    scaled to one; a null share counts as none. Ties go to the larger share, then by name. An empty table
    gives an empty result. Components and rounds run jobs while the query is built.
    """
    shares = {r["split_name"]: float(r["target_share"] or 0) for r in targets.select("split_name", "target_share").collect() if r["split_name"]}
    if not shares or sum(shares.values()) <= 0:
        raise ValueError("split targets need a positive share")
    shares = {s: x / sum(shares.values()) for s, x in shares.items()}
    groups, _ = find_groups(segments, labels)
    label = F.concat_ws("=", "kind", "value")
    vectors = groups.vectors.filter("kind != 'split'").groupBy("group").agg(
        F.sum(F.when(F.col("kind") == "", F.col("n"))).alias("records"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") != "", F.struct(label, "n")))).alias("counts"),  # a group's labels, not its records
    )
    split_of = place(vectors, shares)
    group_id = F.when(F.col("group").startswith("0"), F.substring("group", 2, 1 << 30)).otherwise(F.col("group"))
    return lookup(groups.records, split_of, ["group"]).select("uid", group_id.alias("group_id"), F.col("split").alias("old_split"), "new_split")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """``split_name, target_share, n_records, actual_share``, a row per target split."""
    counts = assigned.groupBy(F.col("new_split").alias("split_name")).agg(F.count("*").alias("n_records"))
    joined = targets.select("split_name", "target_share").join(counts, "split_name", "left")
    n = F.coalesce("n_records", F.lit(0))
    total = F.sum(n).over(Window.partitionBy())  # a row per target
    return joined.select("split_name", "target_share", n.alias("n_records"), F.coalesce(n / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("actual_share"))

"""Segment times, their validity, and the shards that rows are written to."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.sizing import lookup, prefix_totals

MIN_SEGMENT_SECONDS = 0.05


def next_start(recording: str, order: Sequence[str], start: str) -> Column:
    """The next known start within the recording, after the row itself."""
    after = Window.partitionBy(recording).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return F.first(F.col(start), ignorenulls=True).over(after)


def resolved_times(df: DataFrame, recording: str, order: Sequence[str], start: str, end: str, audio_duration: str) -> DataFrame:
    """``df`` with ``resolved_start`` and ``resolved_end``.

    A missing start is the previous end; a missing end is the next known start if it isn't
    earlier, for the last row the recording's duration, else the start. Ends are held to the
    duration and starts to zero, and no end precedes its start. The recurrence over previous
    ends is a running maximum between known starts, so it needs no fold over a recording.
    """
    rows = Window.partitionBy(recording).orderBy(*order)
    duration, a, b = F.col(audio_duration).cast("double"), F.col(start).cast("double"), F.col(end).cast("double")
    marked = df.withColumn("_next", next_start(recording, order, start).cast("double")).withColumn("_last", F.lead(F.lit(1)).over(rows).isNull())
    after = F.when(F.col("_next") >= a, F.col("_next")).when(F.col("_last"), duration).otherwise(a)
    fixed_end = F.greatest(F.greatest(F.lit(0.0), a), F.least(duration, F.coalesce(b, after)))
    given = F.coalesce(b, F.col("_next"), F.when(F.col("_last"), duration))
    open_end = F.when(given.isNotNull(), F.least(duration, given))
    marked = marked.withColumn("_reach", F.when(a.isNotNull(), fixed_end).otherwise(F.greatest(F.lit(0.0), open_end)))
    marked = marked.withColumn("_run", F.count(a).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy(recording, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_end", F.greatest(F.lit(0.0), F.max("_reach").over(in_run)))
    previous = F.coalesce(F.lag("_end").over(rows), F.lit(0.0))
    begin = F.greatest(F.lit(0.0), F.coalesce(a, previous))
    out = marked.withColumn("resolved_start", begin).withColumn("resolved_end", F.greatest(F.col("resolved_start"), F.col("_end")))
    return out.drop("_next", "_last", "_reach", "_run", "_end")


def frame_range(start: Column, end: Column, rate: Column, total: Column) -> tuple[Column, Column]:
    """First frame and the frame after the last, held to the audio."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor(start * rate)), F.least(total, F.ceil(end * rate))


def segment_fault(transcript: Column, start: Column, end: Column, first: Column, after: Column, rate: Column) -> Column:
    """Why a segment isn't emitted: the first rule that holds, or null."""
    return (
        F.when(F.coalesce(F.trim(transcript), F.lit("")) == "", "empty_transcript")
        .when(start.isNull() | end.isNull() | (end <= start), "invalid")
        .when(after <= first, "invalid")
        .when((after - first) / rate < MIN_SEGMENT_SECONDS, "too_short")
    )


def segmenter_counters(recordings: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """The ten counters of a segmenting run, in one row.

    ``recordings`` has ``key, has_annotation, is_malformed``, a row per audio file;
    ``segments`` has ``key, fault, seconds``, the fault null where a segment is emitted.
    Segments are counted per recording before they meet the recordings.
    """
    fault = F.col("fault")
    emitted = fault.isNull()
    per = segments.groupBy(key).agg(
        F.count_if(fault == "empty_transcript").alias("empty"), F.count_if(fault == "invalid").alias("invalid"), F.count_if(fault == "too_short").alias("short"),
        F.count_if(emitted).alias("emitted"), F.sum(F.when(emitted, F.col("seconds"))).alias("seconds"),
    )
    read = F.col("has_annotation") & ~F.col("is_malformed")
    joined = lookup(recordings.select(key, "has_annotation", "is_malformed"), per, [key], "left")
    total = lambda c: F.coalesce(F.sum(F.when(read, F.col(c))), F.lit(0))
    return joined.agg(
        F.count("*").alias("audio_files_seen"), F.count_if("has_annotation").alias("audio_files_with_xml"), F.count_if(~F.col("has_annotation")).alias("audio_files_without_xml"),
        F.count_if(read & (F.col("emitted") > 0)).alias("audio_files_with_segments"), F.count_if(F.col("has_annotation") & F.col("is_malformed")).alias("malformed_xml_files"),
        total("empty").alias("empty_transcript_segments"), total("invalid").alias("invalid_segments"), total("short").alias("too_short_segments"),
        total("emitted").alias("emitted_segments"), F.round(total("seconds"), 3).alias("emitted_seconds"),
    )


def with_speaker(segments: DataFrame, speakers: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``segments`` with ``fields`` of their speaker's record, null where the speaker has none; ``speakers`` has a row per ``keys``.

    A speaker of a third of all segments is spread over tasks.
    """
    return lookup(segments, speakers.select(*keys, *fields), list(keys), "left")


def leaf_ordinals(df: DataFrame, leaf: str, file: str, row: str) -> DataFrame:
    """``df`` with the row's ``ordinal`` in its leaf, from 0, in path and row order.

    Rows are numbered inside their file and files add the rows before them, so a leaf that
    holds most of the data is not one sort task. A null leaf or file is one of its own.
    """
    placed = prefix_totals(df.withColumn("_one", F.lit(1)), [leaf], file, [F.col(row)], "_one", "ordinal")
    return placed.withColumn("ordinal", F.col("ordinal") - 1).drop("_one")


def row_shards(df: DataFrame, leaf: str, file: str, row: str, rows_per_shard: int) -> DataFrame:
    """``df`` with ``ordinal`` and the ``shard_id`` of fixed row count within its leaf."""
    return leaf_ordinals(df, leaf, file, row).withColumn("shard_id", F.floor(F.col("ordinal") / rows_per_shard))


def streamed(df: DataFrame, group: str, order: Sequence[Column], columns: Sequence[str], step: Callable[[], Callable], added: str) -> DataFrame:
    """Rows of each group passed in order through a sequential rule that keeps only its state.

    ``step()`` starts a group and returns a function from arrays of its next rows' ``columns``
    to an array of ``added`` (``name type``), so the rule runs once a batch and not once a
    row. Rows are sorted with spill and streamed, never gathered; a group is one task's work.
    """
    sorted_rows = df.repartition(group).sortWithinPartitions(F.col(group), *order)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [added])
    name, kind = added.split()
    arrow = {"bigint": pa.int64(), "boolean": pa.bool_()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rule = object(), None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(group)).to_pylist()
            cells = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            values = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if rule is None or keys[i] != current:
                    current, rule = keys[i], step()
                values.append(rule(*(c[i:j] for c in cells)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values) if values else [], arrow)], names=[*batch.schema.names, name])

    return sorted_rows.mapInArrow(run, ddl)


def byte_budget_shards(df: DataFrame, group: str, order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """``df`` with ``shard_id``: a shard closes after the row that brings it to ``budget`` bytes; a null size is 0."""

    def start() -> Callable:
        held, shard = 0, 0

        def place(sizes: np.ndarray) -> np.ndarray:
            nonlocal held, shard
            upto = np.cumsum(np.nan_to_num(sizes.astype(np.float64)).astype(np.int64))
            out = np.empty(len(upto), np.int64)
            at, before = 0, -held
            while at < len(upto):  # from one shard's end to the next
                end = int(np.searchsorted(upto, before + budget, "left"))
                out[at : end + 1] = shard
                if end >= len(upto):
                    break
                at, before, shard = end + 1, int(upto[end]), shard + 1
            held = (int(upto[-1]) if len(upto) else 0) - before
            return out

        return place

    return streamed(df, group, order, [size], start, "shard_id bigint")


def shard_index(df: DataFrame, keys: Sequence[str], size: str, duration: str) -> DataFrame:
    """Row count, bytes and duration of each shard."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), F.sum(size).alias("n_bytes"), F.sum(F.col(duration).cast("double")).alias("duration_seconds"))

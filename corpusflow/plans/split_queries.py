"""Queries on exact splits, budgets, shards and segment times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.reading import source_name
from corpusflow.operators import splits, timing
from corpusflow.plans import sql
from corpusflow.plans.tables import table
from corpusflow.sizing import lookup

SECONDS, ROWS_PER_SHARD, SHARD_BYTES = 3600.0, 100, 4096


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", source_name(F.col("source")).alias("source"), "n_chars", "source_file")


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    """The exact split of documents by source."""
    return splits.exact_split(_documents(spark, folder), "source", "doc_id").select("doc_id", "source", "new_split")


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Planned and actual rows of the exact split."""
    return splits.split_counts(stratified_split(spark, folder), "source", "new_split")


def split_disjointness(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in more than one split, of which there must be none, and those in exactly one."""
    per = stratified_split(spark, folder).groupBy("doc_id").agg(F.count_distinct("new_split").alias("n"))
    return per.agg(F.count_if(F.col("n") == 1).alias("n_one"), F.count_if(F.col("n") > 1).alias("n_several"))


def hash_order_first_n(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty documents in hash order."""
    return splits.first_in_hash_order(_documents(spark, folder), "doc_id", 50, "eval").select("doc_id")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segments").select("uid", "source", "duration").dropDuplicates(["uid"])
    return rows.select("uid", source_name(F.col("source")).alias("source"), F.round(F.col("duration").cast("double"), 3).alias("seconds"))


def budget_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Records chosen in hash order within an hour for each source."""
    return splits.greedy_budget(_records(spark, folder), "seconds", "uid", SECONDS, "greedy", "source").select("uid", "source")


def budget_three_phase(spark: SparkSession, folder: str) -> DataFrame:
    """Records of an hour: seeds of one source, then the longest, then the shortest."""
    rows = _records(spark, folder)
    return splits.three_phase_budget(rows, "seconds", "uid", SECONDS, F.col("source") == "layla", 20).select("uid", "phase")


def fixed_row_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, first and last document of each fixed-size shard."""
    placed = timing.row_shards(_documents(spark, folder), "source", "source_file", "doc_id", ROWS_PER_SHARD)
    return placed.groupBy("source", "shard_id").agg(F.count("*").alias("row_count"), F.min("doc_id").alias("first_doc"), F.max("ordinal").alias("last_ordinal"))


def leaf_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ordinal in its source."""
    return timing.leaf_ordinals(_documents(spark, folder), "source", "source_file", "doc_id").select("doc_id", "ordinal")


def byte_budget_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document under a byte budget per file."""
    rows = table(spark, folder, "documents").select("doc_id", "source_file", F.octet_length("text").alias("size"))
    return timing.byte_budget_shards(rows, "source_file", [F.col("doc_id")], "size", SHARD_BYTES).select("doc_id", "shard_id")


def shard_index(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, bytes and seconds of each segment file."""
    rows = table(spark, folder, "segments").withColumn("size", F.octet_length("audio"))
    out = timing.shard_index(rows, ["source_file"], "size", "duration")
    return out.select("source_file", "row_count", "n_bytes", F.round("duration_seconds", 4).alias("duration_seconds"))


def _specs(spark: SparkSession, folder: str) -> DataFrame:
    specs = table(spark, folder, "segment_specs").select("recording_id", "segment_id", "raw_start_time", "raw_end_time").distinct()
    lengths = table(spark, folder, "recordings").select("recording_id", F.coalesce(F.nanvl("audio_duration", F.lit(None).cast("double")), F.lit(1e9)).alias("audio_duration"))
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    joined = lookup(specs.select("recording_id", "segment_id", clean("raw_start_time"), clean("raw_end_time")), lengths, ["recording_id"], "left")
    return joined.withColumn("audio_duration", F.coalesce("audio_duration", F.lit(1e9)))


def next_start(spark: SparkSession, folder: str) -> DataFrame:
    """The next known start after each segment."""
    return _specs(spark, folder).select("recording_id", "segment_id", timing.next_start("recording_id", ["segment_id"], "raw_start_time").alias("next_start"))


def segment_times(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved start and end of each segment."""
    out = timing.resolved_times(_specs(spark, folder), "recording_id", ["segment_id"], "raw_start_time", "raw_end_time", "audio_duration")
    return out.select("recording_id", "segment_id", "resolved_start", "resolved_end")


def segment_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Segments by the fault that keeps them from being emitted."""
    return _judged(spark, folder).groupBy(F.coalesce("fault", F.lit("emitted")).alias("fate")).agg(F.count("*").alias("n_segments"), F.sum("frames").alias("n_frames"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    times = segment_times(spark, folder)
    texts = table(spark, folder, "segments").filter("recording_id is not null").groupBy("recording_id", "segment_id").agg(F.max("transcript").alias("transcript"))
    rows = times.join(texts, ["recording_id", "segment_id"], "left")
    first, after = timing.frame_range(F.col("resolved_start"), F.col("resolved_end"), F.lit(16000), F.lit(16_000_000_000_000))
    fault = timing.segment_fault(F.col("transcript"), F.col("resolved_start"), F.col("resolved_end"), first, after, F.lit(16000))
    return rows.select("recording_id", fault.alias("fault"), (after - first).alias("frames"))


def segmenter_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of a segmenting run over all recordings; one without the name of its service stands for a malformed one."""
    noted = table(spark, folder, "segment_specs").select("recording_id").distinct().withColumn("noted", F.lit(True))
    recordings = lookup(table(spark, folder, "recordings").select("recording_id", "service_name"), noted, ["recording_id"], "left")
    recordings = recordings.select("recording_id", F.col("noted").isNotNull().alias("has_annotation"), F.col("service_name").isNull().alias("is_malformed"))
    segments = _judged(spark, folder).withColumn("seconds", F.col("frames") / 16000.0)
    return timing.segmenter_counters(recordings, segments, "recording_id")


_DOCS = f"(select doc_id, {sql.source_name('source')} as source, n_chars, source_file from documents)"
_SPLIT = f"""
with keyed as (select *, md5('42|' || coalesce(source, '') || '|' || doc_id::varchar) as h from {_DOCS}), placed as (
  select *, row_number() over (partition by source order by h, doc_id) as i, count(*) over (partition by source) as n from keyed
), split as (
  select doc_id, source, case when i <= floor(n * 0.7::double) then 'train' when i <= floor(n * 0.7::double) + floor(n * 0.15::double) then 'val' else 'test' end as new_split from placed
)
"""
_RECORDS = f"""records as (
  select uid, any_value({sql.source_name('source')}) as source, round(any_value(duration)::double, 3) as seconds from segments group by uid
), usable as (select * from records where seconds > 0 and not isnan(seconds))"""
_SPECS = """specs as (
  select s.recording_id, s.segment_id, case when not isnan(raw_start_time) then raw_start_time end as a, case when not isnan(raw_end_time) then raw_end_time end as b,
    coalesce(case when not isnan(audio_duration) then audio_duration end, 1e9::double) as dur
  from (select distinct recording_id, segment_id, raw_start_time, raw_end_time from segment_specs) s left join recordings using (recording_id)
), ordered as (
  select *, row_number() over w as i, count(*) over (partition by recording_id) as n,
    first_value(a ignore nulls) over (partition by recording_id order by segment_id rows between 1 following and unbounded following) as nx
  from specs window w as (partition by recording_id order by segment_id)
)"""
_TIMES = (
    "with recursive "
    + _SPECS
    + """, walk as (
  select recording_id, 0::bigint as i, null::varchar as segment_id, 0.0::double as st, 0.0::double as en from ordered where i = 1
  union all
  select o.recording_id, o.i, o.segment_id, greatest(0.0, coalesce(o.a, w.en)),
    greatest(greatest(0.0, coalesce(o.a, w.en)), least(o.dur, coalesce(o.b, case when o.nx >= coalesce(o.a, w.en) then o.nx when o.i = o.n then o.dur else coalesce(o.a, w.en) end)))
  from ordered o join walk w on o.recording_id = w.recording_id and o.i = w.i + 1
), times as (select recording_id, segment_id, st as resolved_start, en as resolved_end from walk where i > 0)
"""
)
_JUDGED = (
    _TIMES
    + """, texts as (select recording_id, segment_id, max(transcript) as transcript from segments group by all
), framed as (
  select t.*, x.transcript, greatest(0, floor(resolved_start * 16000)) as f, least(16000000000000, ceil(resolved_end * 16000)) as l from times t left join texts x using (recording_id, segment_id)
), judged as (
  select *, case when coalesce(trim(transcript, ' '), '') = '' then 'empty_transcript' when resolved_end <= resolved_start then 'invalid' when l <= f then 'invalid'
    when (l - f) / 16000 < 0.05 then 'too_short' end as fault from framed
)
"""
)

QUERIES = {
    f.__name__: f
    for f in (
        stratified_split, split_counts, split_disjointness, hash_order_first_n, budget_greedy, budget_three_phase, fixed_row_shards, leaf_ordinals, byte_budget_shards,
        shard_index, next_start, segment_times, segment_validity, segmenter_counters,
    )
}
SQL = {
    "stratified_split": _SPLIT + "select doc_id, source, new_split from split",
    "split_counts": _SPLIT
    + """select source, count(*) as n_rows, count_if(new_split = 'train') as n_train, count_if(new_split = 'val') as n_val, count_if(new_split = 'test') as n_test,
  floor(count(*) * 0.7::double)::bigint as planned_train, floor(count(*) * 0.15::double)::bigint as planned_val,
  (count(*) - floor(count(*) * 0.7::double) - floor(count(*) * 0.15::double))::bigint as planned_test from split group by source""",
    "split_disjointness": _SPLIT + "select count_if(n = 1) as n_one, count_if(n > 1) as n_several from (select doc_id, count(distinct new_split) as n from split group by doc_id)",
    "hash_order_first_n": "select doc_id from documents order by md5('eval|' || doc_id::varchar), doc_id limit 50",
    "budget_greedy": f"""
with recursive {_RECORDS}, ordered as (select *, row_number() over (partition by source order by md5('greedy|' || uid), uid) as i from usable
), walk as (
  select source, i, uid, true as chosen, seconds as total from ordered where i = 1
  union all
  select o.source, o.i, o.uid, w.total < 3600 and w.total + o.seconds <= 3600, case when w.total < 3600 and w.total + o.seconds <= 3600 then w.total + o.seconds else w.total end
  from ordered o join walk w on o.source is not distinct from w.source and o.i = w.i + 1
) select uid, source from walk where chosen""",
    "budget_three_phase": f"""
with recursive {_RECORDS}, offers as (
  select uid, seconds, row_number() over (order by phase, rk, h, uid) as i, phase from (
    select * from (select uid, seconds, 1 as phase, 0.0::double as rk, md5('seed|' || uid) as h from usable where source = 'layla' order by h, uid limit 20)
    union all select uid, seconds, 2, -seconds, md5('longest|' || uid) from usable
    union all select uid, seconds, 3, seconds, md5('topoff|' || uid) from usable)
), walk as (
  select 0::bigint as i, ''::varchar as uid, 0 as phase, false as chosen, 0.0::double as total, []::varchar[] as taken
  union all
  select o.i, o.uid, o.phase, ok, case when ok then w.total + o.seconds else w.total end, case when ok then list_append(w.taken, o.uid) else w.taken end
  from walk w join offers o on o.i = w.i + 1, lateral (select not list_contains(w.taken, o.uid) and w.total + o.seconds <= 3600 as ok)
) select uid, phase from walk where chosen""",
    "fixed_row_shards": f"""with placed as (select *, row_number() over (partition by source order by source_file nulls first, doc_id) - 1 as ordinal from {_DOCS})
select source, floor(ordinal / 100)::bigint as shard_id, count(*) as row_count, min(doc_id) as first_doc, max(ordinal) as last_ordinal from placed group by all""",
    "leaf_ordinals": f"select doc_id, row_number() over (partition by source order by source_file nulls first, doc_id) - 1 as ordinal from {_DOCS}",
    "byte_budget_shards": """
with recursive ordered as (select doc_id, source_file, strlen(text) as size, row_number() over (partition by source_file order by doc_id) as i from documents
), walk as (
  select source_file, i, doc_id, 0::bigint as shard_id, case when size >= 4096 then 0 else size end as held, case when size >= 4096 then 1 else 0 end::bigint as nxt from ordered where i = 1
  union all
  select o.source_file, o.i, o.doc_id, w.nxt, case when w.held + o.size >= 4096 then 0 else w.held + o.size end, w.nxt + case when w.held + o.size >= 4096 then 1 else 0 end
  from ordered o join walk w on o.source_file is not distinct from w.source_file and o.i = w.i + 1
) select doc_id, shard_id from walk""",
    "shard_index": "select source_file, count(*) as row_count, sum(octet_length(audio))::bigint as n_bytes, round(sum(duration::double), 4) as duration_seconds from segments group by all",
    "next_start": "with " + _SPECS + " select recording_id, segment_id, nx as next_start from ordered",
    "segment_times": _TIMES + "select * from times",
    "segment_validity": _JUDGED + "select coalesce(fault, 'emitted') as fate, count(*) as n_segments, sum(l - f)::bigint as n_frames from judged group by all",
    "segmenter_counters": _JUDGED
    + """, per as (select recording_id, fault, (l - f) / 16000.0::double as seconds from judged join recordings using (recording_id) where service_name is not null)
select (select count(*) from recordings) as audio_files_seen, (select count(*) from recordings where recording_id in (select recording_id from segment_specs)) as audio_files_with_xml,
  (select count(*) from recordings where recording_id not in (select recording_id from segment_specs)) as audio_files_without_xml,
  (select count(distinct recording_id) from per where fault is null) as audio_files_with_segments,
  (select count(*) from recordings where service_name is null and recording_id in (select recording_id from segment_specs)) as malformed_xml_files,
  (select count(*) from per where fault = 'empty_transcript') as empty_transcript_segments, (select count(*) from per where fault = 'invalid') as invalid_segments,
  (select count(*) from per where fault = 'too_short') as too_short_segments, (select count(*) from per where fault is null) as emitted_segments,
  (select round(coalesce(sum(seconds), 0), 3) from per where fault is null) as emitted_seconds""",
}

"""Queries on the cleaning pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import chars
from corpusflow.functions.reading import source_name
from corpusflow.operators import cleaning
from corpusflow.plans import sql
from corpusflow.plans.tables import table

FLAGS = ["flag_contains_bracket_token", "flag_contains_english", "flag_contains_number", "flag_audio_too_short", "flag_missing_duration"]


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.flagged(table(spark, folder, "segments"), "transcript", "duration")


def clean_report_by_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of the cleaning pass per source and over all."""
    return cleaning.report(_flagged(spark, folder).withColumn("dataset", source_name(F.col("source"))), "dataset")


def clean_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every row's flags and drop reason."""
    return _flagged(spark, folder).select("uid", "ingested_at", *FLAGS, "drop_reason")


def clean_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that are kept."""
    return _flagged(spark, folder).filter("drop_reason is null").select("uid", "ingested_at", "transcript", "duration")


def dropped_by_reason(spark: SparkSession, folder: str) -> DataFrame:
    """Dropped rows per language and reason."""
    return _flagged(spark, folder).filter("drop_reason is not null").groupBy("language", "drop_reason").agg(F.count("*").alias("n_rows"))


def dropped_with_missing_duration(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons where a missing duration drops a row too."""
    rows = cleaning.flagged(table(spark, folder, "row_probabilities"), "text", "duration_sec")
    reason = F.coalesce(cleaning.drop_reason(True), F.lit("clean"))
    return rows.groupBy(reason.alias("disposition")).agg(F.count("*").alias("n_rows"))


def clean_per_shard(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each shard by disposition."""
    return cleaning.per_shard(_flagged(spark, folder), "source_file")


def missing_transcript_shard(spark: SparkSession, folder: str) -> DataFrame:
    """A table without a text column: every row is dropped for one reason."""
    rows = cleaning.flagged(table(spark, folder, "recordings"))
    return rows.groupBy(source_name(F.col("source")).alias("source"), "drop_reason").agg(F.count("*").alias("n_rows"))


def mixture_skip_router(spark: SparkSession, folder: str) -> DataFrame:
    """Why the mixture export skips rows, and how many it takes."""
    seconds = F.col("duration").cast("double")
    reason = cleaning.skip_reason(F.col("transcript"), F.col("flag_audio_too_short"), F.col("flag_missing_duration"), seconds, 2.0)
    return _flagged(spark, folder).groupBy(F.coalesce(reason, F.lit("taken")).alias("disposition")).agg(F.count("*").alias("n_rows"))


def filter_equality_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Kept and total rows of an equality filter per source file."""
    return table(spark, folder, "documents").groupBy("source_file").agg(F.count_if(F.col("doc_type") == "caption").alias("kept"), F.count("*").alias("total"))


_SECONDS = "case when not isnan(duration::double) then duration::double end"
_FLAGGED = f"""
with flagged as (
  select *, {sql.has('transcript', chars.BRACKET_TOKEN)} as flag_contains_bracket_token, {sql.has('transcript', chars.LATIN)} as flag_contains_english,
    {sql.has('transcript', chars.DIGITS)} as flag_contains_number, coalesce({_SECONDS} < 0.5, false) as flag_audio_too_short,
    ({_SECONDS}) is null as flag_missing_duration
  from segments
), routed as (
  select *, case when flag_contains_english then 'contains_english' when flag_contains_number then 'contains_number'
    when flag_audio_too_short then 'audio_too_short' end as drop_reason from flagged
)
"""
_COUNTED = {
    "kept": "drop_reason is null", "dropped_total": "drop_reason is not null", "flag_english": "flag_contains_english", "flag_number": "flag_contains_number",
    "flag_bracket": "flag_contains_bracket_token", "flag_short": "flag_audio_too_short", "flag_no_duration": "flag_missing_duration",
} | {f"dropped_{reason}": f"drop_reason = '{reason}'" for reason in ("contains_english", "contains_number", "audio_too_short")}

QUERIES = {
    f.__name__: f
    for f in (
        clean_report_by_dataset, clean_flags, clean_rows, dropped_by_reason, dropped_with_missing_duration, clean_per_shard, missing_transcript_shard, mixture_skip_router,
        filter_equality_counts,
    )
}
SQL = {
    "clean_report_by_dataset": _FLAGGED
    + f"""select {sql.source_name('source')} as dataset, grouping({sql.source_name('source')})::int as is_total, count(*) as total,
  count_if(drop_reason is null) as kept, count_if(flag_contains_english) as flag_english, count_if(flag_contains_number) as flag_number,
  count_if(flag_contains_bracket_token) as flag_bracket, count_if(flag_audio_too_short) as flag_short, count_if(flag_missing_duration) as flag_no_duration,
  count_if(drop_reason = 'contains_english') as dropped_contains_english, count_if(drop_reason = 'contains_number') as dropped_contains_number,
  count_if(drop_reason = 'audio_too_short') as dropped_audio_too_short, count_if(drop_reason is not null) as dropped_total,
  {', '.join(f"count_if({rule}) / count(*) * 100.0::double as {name}_percent" for name, rule in _COUNTED.items())}
from routed group by rollup({sql.source_name('source')})""",
    "clean_flags": _FLAGGED + f"select uid, ingested_at, {', '.join(FLAGS)}, drop_reason from routed",
    "clean_rows": _FLAGGED + "select uid, ingested_at, transcript, duration from routed where drop_reason is null",
    "dropped_by_reason": _FLAGGED + "select language, drop_reason, count(*) as n_rows from routed where drop_reason is not null group by all",
    "dropped_with_missing_duration": f"""select case when {sql.has('text', chars.LATIN)} then 'contains_english' when {sql.has('text', chars.DIGITS)} then 'contains_number'
  when coalesce(duration_sec < 0.5 and not isnan(duration_sec), false) then 'audio_too_short'
  when duration_sec is null or isnan(duration_sec) then 'missing_duration' else 'clean' end as disposition, count(*) as n_rows
from row_probabilities group by all""",
    "clean_per_shard": _FLAGGED + "select source_file as shard, coalesce(drop_reason, 'clean') as disposition, count(*) as n_rows, " + ", ".join(f"count_if({f}) as n_{f}" for f in FLAGS) + " from routed group by all",
    "missing_transcript_shard": f"select {sql.source_name('source')} as source, 'missing_transcript' as drop_reason, count(*) as n_rows from recordings group by all",
    "mixture_skip_router": _FLAGGED
    + """select case when coalesce(trim(transcript, ' '), '') = '' then 'empty_text' when flag_audio_too_short then 'flag_audio_too_short'
  when flag_missing_duration then 'flag_missing_duration' when duration::double < 2.0 then 'below_min_audio_seconds' else 'taken' end as disposition, count(*) as n_rows
from routed group by all""",
    "filter_equality_counts": "select source_file, count_if(coalesce(doc_type = 'caption', false)) as kept, count(*) as total from documents group by all",
}

"""Queries on overlapping and gapped time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.intervals import merged_intervals
from corpusflow.plans.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous speech periods and the gaps between them, per recording."""
    found = merged_intervals(table(spark, folder, "segment_specs"), "recording_id", "start_time", "end_time")
    return found.withColumnRenamed("entity", "recording_id")


def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per recording: periods, gaps, speech and silence in milliseconds."""

    def of(kind: str, value):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))

    length = F.col("end_ms") - F.col("start_ms")
    return p2_found(spark, folder).groupBy("recording_id").agg(
        of("period", F.lit(1)).alias("n_periods"), of("gap", F.lit(1)).alias("n_gaps"), of("period", length).alias("speech_ms"), of("gap", length).alias("silence_ms")
    )


_PERIODS = """
with rows as (
  select recording_id, cast(round(start_time * 1000) as bigint) as s, cast(round(end_time * 1000) as bigint) as e
  from segment_specs
  where recording_id is not null and isfinite(start_time) and isfinite(end_time)
), reach as (
  select *, max(e) over (partition by recording_id order by s, e rows between unbounded preceding and 1 preceding) as before
  from rows where s < e
), numbered as (
  select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by recording_id order by s, e) as k from reach
), periods as (
  select recording_id, k, min(s) as start_ms, max(e) as end_ms from numbered group by recording_id, k
), found as (
  select recording_id, 'period' as kind, start_ms, end_ms from periods
  union all
  select recording_id, 'gap', end_ms, nxt from (
    select *, lead(start_ms) over (partition by recording_id order by k) as nxt from periods) where nxt is not null
)
"""

QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage}
SQL = {
    "p2_found": _PERIODS + "select * from found",
    "p2_coverage": _PERIODS
    + """select recording_id, sum(case when kind = 'period' then 1 else 0 end)::bigint as n_periods,
  sum(case when kind = 'gap' then 1 else 0 end)::bigint as n_gaps,
  sum(case when kind = 'period' then end_ms - start_ms else 0 end)::bigint as speech_ms,
  sum(case when kind = 'gap' then end_ms - start_ms else 0 end)::bigint as silence_ms
from found group by recording_id""",
}

"""The cleaning pass: flags, one drop reason per row, routing and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.chars import LATIN
from corpusflow.functions.text import has_bracket_token, has_digit, has_latin
from corpusflow.operators.columns import DURATION_CANDIDATES, TEXT_CANDIDATES, first_present, safe_double

MIN_SECONDS = 0.5
REASONS = ("contains_english", "contains_number", "audio_too_short", "missing_duration")


def flagged(df: DataFrame, text: str | None = None, duration: str | None = None, min_seconds: float = MIN_SECONDS, letters: str = LATIN) -> DataFrame:
    """``df`` with the five audit flags and ``drop_reason``.

    The first rule that holds names the reason: latin letters, digits, too short. A missing
    duration is flagged and drops nothing unless ``routed`` is told so. A table without a
    text column drops every row as ``missing_transcript``.
    """
    text = text or first_present(df, TEXT_CANDIDATES)
    duration = duration or first_present(df, DURATION_CANDIDATES)
    if text is None:
        no = F.lit(None).cast("boolean")
        flags = {f"flag_{x}": no for x in ("contains_bracket_token", "contains_english", "contains_number", "audio_too_short", "missing_duration")}
        return df.withColumns(flags | {"drop_reason": F.lit("missing_transcript")})
    raw, seconds = F.col(text).cast("string"), safe_double(F.col(duration)) if duration else F.lit(None).cast("double")
    out = df.withColumns(
        {
            "flag_contains_bracket_token": has_bracket_token(raw),
            "flag_contains_english": has_latin(raw, letters),
            "flag_contains_number": has_digit(raw),
            "flag_audio_too_short": F.coalesce(seconds < min_seconds, F.lit(False)),
            "flag_missing_duration": seconds.isNull(),
        }
    )
    return out.withColumn("drop_reason", drop_reason())


def drop_reason(drop_missing_duration: bool = False) -> Column:
    """The first rule that drops a flagged row, or null."""
    out = F.when(F.col("flag_contains_english"), F.lit(REASONS[0])).when(F.col("flag_contains_number"), F.lit(REASONS[1])).when(F.col("flag_audio_too_short"), F.lit(REASONS[2]))
    return out.when(F.col("flag_missing_duration"), F.lit(REASONS[3])) if drop_missing_duration else out


def report(flagged_rows: DataFrame, dataset: str) -> DataFrame:
    """Counters per dataset and, where ``is_total``, over all rows, in one pass, each with its percent of the rows."""

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    reason = F.col("drop_reason")
    counted = flagged_rows.withColumn("dataset", F.col(dataset)).rollup("dataset").agg(
        F.grouping("dataset").cast("int").alias("is_total"),
        F.count("*").alias("total"),
        n(reason.isNull()).alias("kept"),
        n(F.col("flag_contains_english")).alias("flag_english"),
        n(F.col("flag_contains_number")).alias("flag_number"),
        n(F.col("flag_contains_bracket_token")).alias("flag_bracket"),
        n(F.col("flag_audio_too_short")).alias("flag_short"),
        n(F.col("flag_missing_duration")).alias("flag_no_duration"),
        *(n(reason == r).alias(f"dropped_{r}") for r in REASONS[:3]),
    )
    counted = counted.withColumn("dropped_total", F.col("total") - F.col("kept"))
    parts = [c for c in counted.columns if c not in ("dataset", "is_total", "total")]
    return counted.withColumns({f"{c}_percent": F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100.0).otherwise(0.0) for c in parts})


def per_shard(flagged_rows: DataFrame, shard: str) -> DataFrame:
    """Rows of each shard and disposition, and how many of them bear each flag."""
    flags = [c for c in flagged_rows.columns if c.startswith("flag_")]
    grouped = flagged_rows.groupBy(F.col(shard).alias("shard"), F.coalesce("drop_reason", F.lit("clean")).alias("disposition"))
    return grouped.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(c)).alias(f"n_{c}") for c in flags))


def skip_reason(text: Column, too_short: Column, no_duration: Column, seconds: Column, min_seconds: float) -> Column:
    """Why the mixture export skips a row: the first that holds, or null."""
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_text")
        .when(too_short, "flag_audio_too_short")
        .when(no_duration, "flag_missing_duration")
        .when(seconds < min_seconds, "below_min_audio_seconds")
    )

"""Score cutoffs that keep a target fraction of each source: iterative histogram refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.reading import source_name
from corpusflow.sizing import lookup, saved

#: Bins that each round cuts the range of a target into.
BINS = 1024
#: Rounds after which a search gives up. Each parts the ends of its range, so even scores that halve
#: from one to the next end within the exponents of a double; evenly spread ones need two or three.
MAX_ROUNDS = 1100


def scored_records(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``uid, source, score_field, score``: records scored in a field by a number from 0 to 1.

    A record is a distinct uid; rows without uid or source are left out. Lines written
    again count once, and where they differ the highest valid score counts. Nulls, NaN
    and numbers outside 0 to 1 are no scores.
    """

    def valid(field: str):
        value = F.col(field).cast("double")
        return F.max(F.when(~F.isnan(value) & value.between(0.0, 1.0), value + F.lit(0.0))).alias(field)

    once = rows.withColumn("_source", source_name(F.col("source"))).filter("uid is not null and _source is not null")
    once = once.select(F.col("uid").cast("string").alias("uid"), F.col("_source"), *fields)
    once = once.groupBy("uid").agg(F.min("_source").alias("source"), *(valid(f) for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("score_field"), F.col(f).alias("score")) for f in fields))
    return once.select("uid", "source", F.inline(pairs)).filter("score is not null")


def _targets(targets: DataFrame) -> DataFrame:
    """One row per source and field: of repeated targets the largest fraction counts; fractions are held to 0 to 1."""
    named = targets.select(source_name(F.col("source")).alias("source"), "score_field", F.col("target_fraction").cast("double").alias("target_fraction"))
    named = named.filter("source is not null and score_field is not null and target_fraction is not null and not isnan(target_fraction)")
    return named.groupBy("source", "score_field").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("target_fraction"))).alias("target_fraction"))


def wanted_rank(fraction: Column, n: Column) -> Column:
    """The least whole number of ``n`` records whose share, as the report divides it, is at least ``fraction``.

    The product of a fraction and a count may be off by its last digit either way, so its
    floor is tried first; no tolerance grows with the count.
    """
    low = F.floor(fraction * n)
    return F.when(n == 0, F.lit(0)).when(low / n >= fraction, low).otherwise(low + 1).cast("bigint")


def find_cutoffs(scored: DataFrame, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """``source, score_field, target_fraction, n_scored, n_wanted, cutoff``: the highest score that keeps the fraction.

    Round by round, each target's range is cut into bins, scores in it are counted per bin
    before the shuffle, and the range shrinks to the bin that holds the wanted rank, until
    that bin holds one value; ties stay together. A target whose source has no scored
    record, or whose fraction is 0, gets a null cutoff and keeps nothing.
    """
    keys = ["source", "score_field"]
    counts = scored.groupBy(*keys).agg(F.count("*").alias("n_scored"), F.min("score").alias("low"), F.max("score").alias("high"))
    state = _targets(targets).join(counts, keys, "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    state = saved(state.withColumn("n_wanted", wanted_rank(F.col("target_fraction"), F.col("n_scored"))).withColumn("above", F.lit(0).cast("bigint")))
    done = state.filter("n_wanted <= 0 or low = high or low is null").withColumn("cutoff", F.when(F.col("n_wanted") > 0, F.col("low")))
    out = ["source", "score_field", "target_fraction", "n_scored", "n_wanted", "cutoff"]
    found, open_targets = done.select(*out), state.filter("n_wanted > 0 and low < high")
    for _ in range(MAX_ROUNDS):
        if open_targets.isEmpty():
            return found
        near = lookup(scored, open_targets.select(*keys, "low", "high"), keys).filter("score between low and high")
        step = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) * bins))
        tally = near.groupBy(*keys, step.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("bin_low"), F.max("score").alias("bin_high"))
        # At most `bins` rows per target enter the window.
        downward = Window.partitionBy(*keys).orderBy(F.desc("bin"))
        ranked = tally.withColumn("upto", F.sum("n").over(downward)).join(open_targets, keys)
        ranked = ranked.filter((F.col("above") + F.col("upto") >= F.col("n_wanted")) & (F.col("above") + F.col("upto") - F.col("n") < F.col("n_wanted")))
        state = saved(
            ranked.select(
                *keys, "target_fraction", "n_scored", "n_wanted", (F.col("above") + F.col("upto") - F.col("n")).alias("above"), F.col("bin_low").alias("low"), F.col("bin_high").alias("high")
            )
        )
        found = found.unionByName(state.filter("low = high").withColumn("cutoff", F.col("low")).select(*out))
        open_targets = state.filter("low < high")
    raise RuntimeError("a cutoff did not settle")


def score_fields(columns: list[str], targets: DataFrame) -> list[str]:
    """The score fields that the targets name; one that is no column raises an error."""
    named = targets.select("score_field").distinct().filter("score_field != ''")
    is_column = F.col("score_field").isin(*columns)
    if (missing := named.filter(~is_column).first()) is not None:
        raise ValueError(f"no such score column: {missing['score_field']}")
    return sorted(r["score_field"] for r in named.filter(is_column).collect())  # at most the columns of the table


def kept_records(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept records (``score_field, source, uid, score``) and the report of the cutoffs.

    The report has ``source, score_field, target_fraction, n_scored, cutoff, n_kept, kept_fraction``.
    Targets naming a field that the table lacks raise an error.
    """
    fields = score_fields(rows.columns, targets)
    if not fields:
        empty = rows.sparkSession.createDataFrame([], "score_field string, source string, uid string, score double")
        return empty, empty.selectExpr("source", "score_field", "score target_fraction", "0L n_scored", "score cutoff", "0L n_kept", "score kept_fraction")
    scored = saved(scored_records(rows, fields))
    cutoffs = find_cutoffs(scored, targets)
    kept = lookup(scored, cutoffs.select("source", "score_field", "cutoff"), ["source", "score_field"]).filter("score >= cutoff")
    kept = kept.select("score_field", "source", "uid", "score")
    sizes = kept.groupBy("source", "score_field").agg(F.count("*").alias("n_kept"))
    report = cutoffs.join(sizes, ["source", "score_field"], "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    share = F.when(F.col("n_scored") > 0, F.col("n_kept") / F.col("n_scored"))
    return kept, report.select("source", "score_field", "target_fraction", "n_scored", "cutoff", "n_kept", share.alias("kept_fraction"))

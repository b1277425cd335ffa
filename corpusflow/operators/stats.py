"""Duration, text and mixture statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.text import collapsed, word_units
from corpusflow.sizing import is_small, prefix_totals


def exact_quantiles(counted: DataFrame, group: str, value: str, n: str, quantiles: dict[str, float]) -> DataFrame:
    """``group`` and a column for each named quantile, linear between neighbours, from rows of group, value and its number ``n``.

    Ranks come from running totals over buckets of one unit of the value, so no group's
    values are held or sorted in one place; the two values next to each quantile's place
    are then picked out of the counted ones.
    """
    keyed = counted.withColumn("_bucket", F.floor(value))
    ranked = prefix_totals(keyed, [group], "_bucket", [F.col(value)], n, "_upto")
    sizes = counted.groupBy(group).agg(F.sum(n).alias("_all")).withColumnRenamed(group, "_group")
    joined = ranked.join(F.broadcast(sizes) if is_small(sizes) else sizes, F.col(group).eqNullSafe(F.col("_group")))
    out = []
    for name, q in quantiles.items():
        place = F.lit(float(q)) * (F.col("_all") - 1)
        for at, whole in (("low", F.floor(place)), ("high", F.ceil(place))):
            held = (F.col("_upto") > whole) & (F.col("_upto") - F.col(n) <= whole)
            out.append(F.max(F.when(held, F.col(value))).alias(f"_{name}_{at}"))
        out.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
    found = joined.groupBy(group).agg(*out)
    between = {name: F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * F.col(f"_{name}_part") for name in quantiles}
    return found.select(group, *(c.alias(name) for name, c in between.items()))


def duration_stats(df: DataFrame, group: str, duration: str) -> DataFrame:
    """Per group: count, mean, median and 95th percentile (exact, linear), total seconds and hours; missing durations and NaN don't count."""
    d = F.col(duration).cast("double")
    counted = df.select(group, F.when(~F.isnan(d), d).alias("_d")).groupBy(group, "_d").agg(F.count("*").alias("_n"))
    n = F.coalesce(F.sum(F.when(F.col("_d").isNotNull(), F.col("_n"))), F.lit(0))
    total = F.coalesce(F.sum(F.col("_d") * F.col("_n")), F.lit(0.0))
    sums = counted.groupBy(group).agg(n.alias("n"), total.alias("total_seconds"))
    quantiles = exact_quantiles(counted.filter("_d is not null"), group, "_d", "_n", {"median": 0.5, "p95": 0.95})
    out = sums.join(quantiles.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    out = out.withColumn("mean", F.col("total_seconds") / F.nullif("n", F.lit(0)))
    return out.select(group, "n", "mean", "median", "p95", "total_seconds", (F.col("total_seconds") / 3600.0).alias("total_hours"))


def text_stats(df: DataFrame, groups: Sequence[str], text: str, duration: str) -> DataFrame:
    """Per group: rows, durations, and characters and words of the texts."""
    t, d = collapsed(F.coalesce(F.col(text), F.lit(""))), F.col(duration).cast("double")
    measured = df.select(*groups, F.when(~F.isnan(d), d).alias("d"), F.length(t).alias("c"), F.size(word_units(F.col(text))).alias("w"))
    parts = [f(x).alias(f"{name}_{y}") for x, name in (("d", "duration"), ("c", "chars"), ("w", "words")) for f, y in ((F.mean, "mean"), (F.min, "min"), (F.max, "max"))]
    return measured.groupBy(*groups).agg(F.count("*").alias("n_rows"), *parts)


def mixture_hours(df: DataFrame, corpus: str, language: str, split: str, duration: str) -> DataFrame:
    """Hours of the train rows per corpus and language."""
    return df.filter(F.col(split) == "train").groupBy(corpus, language).agg((F.sum(F.col(duration).cast("double")) / 3600.0).alias("hours"))


def independent_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``dimension, value, n``: three or more group-bys in one pass."""
    names = [f"_{c}" for c in columns]
    named = df.select(*(F.col(c).cast("string").alias(f"_{c}") for c in columns))
    sets = [[F.col(n)] for n in names]
    counted = named.groupingSets(sets, *names).agg(F.count("*").alias("n"), *(F.grouping(n).alias(f"g{n}") for n in names))
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, n in zip(columns, names, strict=True):
        dimension = F.when(F.col(f"g{n}") == 0, F.lit(c)).otherwise(dimension)
        value = F.when(F.col(f"g{n}") == 0, F.col(n)).otherwise(value)
    return counted.select(dimension.alias("dimension"), value.alias("value"), "n")


def mixture_weights(hours: DataFrame, corpus: str, language: str, beta_corpus: float, beta_language: float) -> DataFrame:
    """Sampling weights: a language's share of hours to the power of one beta, times a corpus' share within it to the other.

    Rows are a corpus and language each, so the windows are over a handful of rows.
    """
    by_language = Window.partitionBy(language)  # a null language is one of its own
    out = hours.withColumn("_l", F.sum("hours").over(by_language))
    inner = F.pow(F.col("hours") / F.col("_l"), F.lit(beta_corpus))
    out = out.withColumn("_inner", inner / F.sum(inner).over(by_language)).withColumn("_outer", F.pow("_l", F.lit(beta_language)))
    first = F.when(F.row_number().over(by_language.orderBy(corpus)) == 1, F.col("_outer"))
    out = out.withColumn("_first", first).withColumn("_whole", F.sum("_first").over(Window.partitionBy()))
    return out.select(corpus, language, (F.col("_inner") * F.col("_outer") / F.col("_whole")).alias("weight"))


def hours_by(df: DataFrame, group: Column, duration: str) -> DataFrame:
    """Rows and hours of each group; a duration that is missing or NaN adds a row and no time."""
    d = F.col(duration).cast("double")
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), (F.coalesce(F.sum(F.when(~F.isnan(d), d)), F.lit(0.0)) / 3600.0).alias("hours"))


def progress(done: int, total: int, seconds: float) -> dict[str, float]:
    """Percent done, rows a second and seconds left."""
    speed = done / seconds if seconds > 0 else 0.0
    return {"percent": 100.0 * done / total if total else 0.0, "rows_per_second": speed, "seconds_left": (total - done) / speed if speed else 0.0}


def clock(seconds: Column) -> Column:
    """``1h02m03s``, ``2m03s`` or ``3s``."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("m"), two(r), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"), two(r), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))

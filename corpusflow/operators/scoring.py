"""Classifier scores: labels, thresholds, candidates, and the hook that runs a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.sizing import lookup

UNKNOWN_THRESHOLD = 0.55


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, stable for large ones."""
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def ranked_labels(scores: Column, labels: Sequence[str]) -> Column:
    """Label and score structs of a score map, best first; ties keep the order of ``labels``."""
    pairs = F.filter(F.array(*(F.struct((-scores[x]).alias("k"), F.lit(i).alias("i"), F.lit(x).alias("label"), scores[x].alias("score")) for i, x in enumerate(labels))), lambda p: p["score"].isNotNull())
    return F.transform(F.array_sort(pairs), lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score")))


def final_label(label: Column, score: Column, threshold: float = UNKNOWN_THRESHOLD) -> Column:
    """The label, or ``unseen`` where its score stays under the threshold."""
    return F.when(score < threshold, F.lit("unseen")).otherwise(label)


def score_of(scores: Column, key: str, primary: Column | None = None) -> Column:
    """A stated score, else the map's, else 0."""
    return F.coalesce(*([primary] if primary is not None else []), scores[key], F.lit(0.0))


def percent(n: Column, of: Column) -> Column:
    """``100 n / of`` to four places, 0 where nothing is counted."""
    return F.when(of > 0, F.round(100.0 * n / of, 4)).otherwise(0.0)


def label_shares(df: DataFrame, label: str, status: str, labels: Sequence[str]) -> DataFrame:
    """``label, n, percent`` over rows of status ok (null counts as ok), a row for each given label, also for none."""
    ok = df.filter(F.coalesce(F.col(status), F.lit("ok")) == "ok")
    counts = ok.groupBy(F.coalesce(F.col(label), F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    # The whole is summed over the labels that occur, which are few, and reaches the others through the listed ones.
    whole = counts.agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by"))
    listed = whole.select("total", "by", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    n = F.coalesce(F.try_element_at("by", "label"), F.lit(0))
    return listed.select("label", n.alias("n"), percent(n, F.coalesce("total", F.lit(0))).alias("percent"))


def by_percent(shares: DataFrame) -> DataFrame:
    """Label shares with their ``place`` in the report: most percent first, then by label; a row per label."""
    return shares.withColumn("place", F.row_number().over(Window.orderBy(F.desc("percent"), "label")))


def source_route(source: Column, allowed: Sequence[str]) -> Column:
    """``skipped_filtered_source`` for a row of a source that isn't allowed, else null; without allowed sources all are."""
    other = ~F.coalesce(source.isin(*allowed), F.lit(False)) if allowed else F.lit(False)
    return F.when(other, F.lit("skipped_filtered_source"))


def out_of_range(rows: DataFrame, sizes: DataFrame, file: str, index: str, size: str) -> DataFrame:
    """``file, n_rows, n_outside``: row numbers per file, repeats once, and those outside 0 up to the file's ``size``; a file of unknown size has no rows.

    Row numbers are counted per file before they meet the sizes.
    """
    given = rows.select(file, index).distinct().filter(F.col(index).isNotNull())
    joined = lookup(given, sizes.select(file, size), [file], "left")
    outside = (F.col(index) < 0) | (F.col(index) >= F.coalesce(size, F.lit(0)))
    return joined.groupBy(file).agg(F.count("*").alias("n_rows"), F.count_if(outside).alias("n_outside"))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """Rows that are ok (null counts as ok), skipped or failed."""
    s = F.coalesce(F.col(status), F.lit("ok"))
    return df.agg(F.count("*").alias("total"), F.count_if(s == "ok").alias("ok"), F.count_if(s.startswith("skipped")).alias("skipped"), F.count_if(s == "error").alias("error"))


def threshold_sweep(df: DataFrame, score: Column, thresholds: Sequence[float], malformed: Column | None = None) -> DataFrame:
    """``threshold, scanned, qualifying, percent, malformed`` for each threshold in one pass.

    Rows for which ``malformed`` holds are counted apart; they aren't scanned.
    """
    broken = F.coalesce(malformed, F.lit(False)) if malformed is not None else F.lit(False)
    scanned = F.count_if(~broken).alias("scanned")
    counts = df.agg(scanned, F.count_if(broken).alias("malformed"), *(F.count_if(~broken & (score >= t)).alias(f"t{i}") for i, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("qualifying")) for i, t in enumerate(thresholds)))
    return counts.select("scanned", "malformed", F.inline(rows)).select("threshold", "scanned", "qualifying", percent(F.col("qualifying"), F.col("scanned")).alias("percent"), "malformed")


def last_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows with one key the last one in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def enriched(shards: DataFrame, candidates: DataFrame, keys: Sequence[str], prefix: str = "text_") -> DataFrame:
    """Shard rows that are candidates, with the candidates' columns under ``prefix``."""
    renamed = candidates.select(*keys, *(F.col(c).alias(prefix + c) for c in candidates.columns if c not in keys))
    return lookup(shards, renamed, list(keys))


def pending(rows: DataFrame, done: DataFrame, keys: Sequence[str], retry_failed: bool = False, status: str = "status") -> DataFrame:
    """Rows not yet in the log; with ``retry_failed`` only rows logged as ok are done."""
    if retry_failed and status in done.columns:
        done = done.filter(F.coalesce(F.col(status), F.lit("ok")) == "ok")
    return lookup(rows, done.select(*keys).distinct(), list(keys), "left_anti")


def binary_label(status: Column, text_score: Column, audio_score: Column, in_scope: Column, threshold: float) -> Column:
    """Whether a scored row of a source in scope passes both thresholds; null scores don't."""
    ok = F.coalesce(status, F.lit("ok")) == "ok"
    return F.coalesce(ok & in_scope & (text_score >= threshold) & (audio_score >= threshold), F.lit(False))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows; the order should end with a unique column."""
    return df.orderBy(*order).limit(k)


def sampled(df: DataFrame, key: Column, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows chosen by a seeded hash of their key: the same rows for any partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), key)), key).limit(k)


class ScoreModel(Protocol):
    """A classifier of texts or of audio bytes: labels and one list of probabilities for each."""

    labels: Sequence[str]

    def predict(self, items: list) -> list[list[float]]: ...


def scored(df: DataFrame, text: str, load: Callable[[], ScoreModel], batch: int = 256) -> DataFrame:
    """``df`` with ``status``, ``error``, ``label_scores`` and ``predictions`` (best first) of a model loaded once per task.

    The column ``text`` holds texts or audio bytes. A batch that fails is halved down to
    single rows, so one bad item is one error row; null and blank ones are ``skipped_empty``.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", status string, error string, label_scores map<string,double>"
    best_first = F.array_sort(F.transform(F.map_entries("label_scores"), lambda p: F.struct((-p["value"]).alias("k"), p["key"].alias("label"), p["value"].alias("score"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()

        def predict(texts: list[str]) -> list[tuple[str, str | None, list | None]]:
            try:
                return [("ok", None, list(zip(model.labels, map(float, p), strict=True))) for p in model.predict(texts)]
            except Exception as e:
                if len(texts) == 1:
                    return [("error", str(e)[:500], None)]
                half = len(texts) // 2
                return predict(texts[:half]) + predict(texts[half:])

        for rows in batches:
            texts = rows.column(rows.schema.get_field_index(text)).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            out: list = [("skipped_empty", None, None)] * len(texts)
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                for i, got in zip(part, predict([texts[i] for i in part]), strict=True):
                    out[i] = got
            kinds = (pa.string(), pa.string(), pa.map_(pa.string(), pa.float64()))
            added = [pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*rows.schema.names, "status", "error", "label_scores"])

    predictions = F.transform(best_first, lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score")))
    return df.mapInArrow(run, ddl).withColumn("predictions", predictions)

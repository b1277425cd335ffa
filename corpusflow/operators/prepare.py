"""Rows as the model families take them, predictions as the evaluation takes them, and their contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.scoring import last_of_key
from corpusflow.sizing import lookup

# The models that are known, by family.
MODELS = {
    "whisper": ("openai/whisper-medium", "openai/whisper-large-v3"),
    "qwen": ("Qwen/Qwen3-ASR-0.6B", "Qwen/Qwen3-ASR-1.7B"),
    "omni": ("Omni ASR 300M", "Omni ASR 1B"),
}
# Columns of a manifest row.
MANIFEST_COLUMNS = ("uid", "audio_path", "text", "duration", "sample_rate", "source")


def family_of(name: Column, models: Mapping[str, Sequence[str]] = MODELS) -> Column:
    """The family of a model name, spelled exactly; an unknown or null name raises an error when the plan runs."""
    known = sorted(m for names in models.values() for m in names)
    out = F.when(F.lit(False), F.lit(""))
    for family, names in models.items():
        out = out.when(name.isin(*names), F.lit(family))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown model "), F.coalesce(name, F.lit("null")), F.lit("; known: " + ", ".join(known)))).cast("string"))


def for_seq2seq(df: DataFrame, audio: str, text: str, duration: str, max_seconds: float = 30.0) -> DataFrame:
    """Rows up to the longest audio, with input path, labels and task; a row of unknown length stays, NaN counts as too long."""
    return df.filter(F.coalesce(F.col(duration) <= max_seconds, F.lit(True))).withColumns({"architecture": F.lit("seq2seq"), "input_audio_path": F.col(audio), "labels_text": F.col(text), "task": F.lit("transcribe")})


def for_chat(df: DataFrame, audio: str, text: str, system: str, user: str) -> DataFrame:
    """Rows with a chat of system, user (audio and text) and assistant turns; each content is a list of typed parts."""
    part = lambda kind, value, path: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("text"), path.cast("string").alias("audio_path"))
    none = F.lit(None)
    turns = F.array(
        F.struct(F.lit("system").alias("role"), F.array(part("text", F.lit(system), none)).alias("content")),
        F.struct(F.lit("user").alias("role"), F.array(part("audio", none, F.col(audio)), part("text", F.lit(user), none)).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.array(part("text", F.col(text), none)).alias("content")),
    )
    return df.withColumns({"architecture": F.lit("chat"), "prompt_text": F.lit(user), "target_text": F.col(text), "messages": turns})


def for_ctc(df: DataFrame, audio: str, text: str, task: str, language: str) -> DataFrame:
    """Rows with task, language and target."""
    return df.withColumns({"architecture": F.lit("ctc"), "task": F.lit(task), "language": F.lit(language), "input_audio_path": F.col(audio), "target_text": F.col(text)})


def normalized_predictions(raw: DataFrame, source: DataFrame, constants: Mapping[str, str], key: str = "uid") -> DataFrame:
    """Predictions with the source's text where they lack a reference, and the run's constants; of repeated source keys the last counts."""
    known = last_of_key(source.select(key, F.col("text").alias("_text"), "row_index"), [key], [F.desc("row_index")]).select(key, "_text")
    reference = F.coalesce("reference", "_text", F.lit("")) if "reference" in raw.columns else F.coalesce("_text", F.lit(""))
    joined = lookup(raw, known, [key], "left").withColumn("reference", reference).withColumn("prediction", F.coalesce("prediction", F.lit("")))
    return joined.select(key, "reference", "prediction", *(F.lit(v).alias(k) for k, v in constants.items()))


def manifest_faults(df: DataFrame, files: DataFrame, path: str, base: str = "") -> DataFrame:
    """One row with the faults of a split's manifest, all zero where it keeps the contract.

    ``n_rows, is_empty, missing_columns, n_lacking`` (rows without a required value),
    ``n_no_file`` (audio that isn't among ``files``; a relative path lies below ``base``),
    ``n_bad_duration, n_bad_rate`` (neither missing nor above 0).
    """
    have = [c for c in MANIFEST_COLUMNS if c in df.columns]
    rows = df.select(*have, *(F.lit(None).cast("string").alias(c) for c in MANIFEST_COLUMNS if c not in have))
    place = F.when(F.col("audio_path").startswith("/") | (F.lit(base) == ""), F.col("audio_path")).otherwise(F.concat(F.lit(base + "/"), "audio_path"))
    there = files.select(F.col(path).alias("_path")).distinct().withColumn("_there", F.lit(True))
    rows = lookup(rows.withColumn("_path", place), there, ["_path"], "left")
    lacking = F.exists(F.array(*(F.col(c).isNull() for c in MANIFEST_COLUMNS)), lambda x: x)
    bad = lambda c: F.coalesce(~(F.col(c).cast("double") > 0) | F.isnan(F.col(c).cast("double")), F.lit(False))
    return rows.agg(
        F.count("*").alias("n_rows"),
        (F.count("*") == 0).alias("is_empty"),
        F.lit(",".join(c for c in sorted(MANIFEST_COLUMNS) if c not in have)).alias("missing_columns"),
        F.count_if(lacking).alias("n_lacking"),
        F.count_if(F.col("audio_path").isNotNull() & F.col("_there").isNull()).alias("n_no_file"),
        F.count_if(bad("duration")).alias("n_bad_duration"),
        F.count_if(bad("sample_rate")).alias("n_bad_rate"),
    )


def collated(df: DataFrame, batch: Column, order: str, columns: Sequence[str]) -> DataFrame:
    """Batches as parallel lists in row order; a batch is a bounded number of rows."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    packed = df.groupBy(batch.alias("batch_id")).agg(rows.alias("_rows"))

    def values(name: str) -> Column:
        return F.transform("_rows", lambda row: row[name]).alias(f"{name}_list")

    return packed.select("batch_id", *(values(c) for c in columns))


def mock_prediction(reference: Column, prefix: str, tuned: bool, placeholder: bool = False) -> Column:
    """What the smoke models predict: the reference when tuned, else a marker before it or the marker alone."""
    text = F.coalesce(reference, F.lit(""))
    return text if tuned else (F.lit(prefix) if placeholder else F.concat(F.lit(prefix + " "), text))


def mock_loss(epoch: Column, family: str) -> tuple[Column, Column]:
    """Training and validation loss of the smoke trainer."""
    train = F.greatest(F.lit(0.001), 1.0 / (epoch + 1) + F.lit(0.01) * len(family))
    return train, F.greatest(F.lit(0.001), train * 0.9)


def mapped(col: Column, groups: Mapping[str, str], default: str) -> Column:
    """A name's group, or the default."""
    out = F.when(F.lit(False), F.lit(""))
    for name, group in groups.items():
        out = out.when(col == name, F.lit(group))
    return out.otherwise(F.lit(default))

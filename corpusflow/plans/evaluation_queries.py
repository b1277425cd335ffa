"""Queries on error rates, prepared rows, statistics and audio bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.reading import source_name, split_name
from corpusflow.functions.text import word_units
from corpusflow.operators import audio, evaluate, prepare, scoring, stats
from corpusflow.plans import sql
from corpusflow.plans.tables import table
from corpusflow.streaming.resume import windowed_counts

MARKER = "[draft]"
METRICS = ["wer", "cer", "normalized_wer", "normalized_cer", "loose_wer", "loose_cer"]


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions made from the transcripts: the base drops every fourth word after a marker, the tuned is the normalised text."""
    rows = table(spark, folder, "segments").select("uid", "transcript", "normalized_transcript", "source", "duration").dropDuplicates(["uid"])
    kept = F.filter(word_units(F.col("transcript")), lambda w, i: i % 4 != 3)
    return rows.select(
        "uid", source_name(F.col("source")).alias("source"), F.coalesce("transcript", F.lit("")).alias("reference"), F.concat_ws(" ", F.lit(MARKER), F.array_join(kept, " ")).alias("base"),
        F.coalesce("normalized_transcript", F.lit("")).alias("tuned"), "duration",
    )


def wer_cer_per_row(spark: SparkSession, folder: str) -> DataFrame:
    """Edits and units of every record's base prediction."""
    return evaluate.pair_errors(_predictions(spark, folder), "reference", "base", ["uid"]).select("uid", *(f"{m}_{p}" for m in METRICS for p in ("edits", "units")))


def metrics_six(spark: SparkSession, folder: str) -> DataFrame:
    """The six corpus metrics of the tuned predictions."""
    return evaluate.corpus_metrics(evaluate.pair_errors(_predictions(spark, folder), "reference", "tuned"))


def metrics_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """The six metrics per source."""
    return evaluate.corpus_metrics(evaluate.pair_errors(_predictions(spark, folder), "reference", "tuned", ["source"]), ["source"])


def base_vs_tuned(spark: SparkSession, folder: str) -> DataFrame:
    """Improvement of the tuned over the base predictions."""
    return evaluate.compared(evaluate.pair_errors(_predictions(spark, folder), "reference", {"base_": "base", "tuned_": "tuned"}))


def prediction_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of the predictions against their contract: a run that names states by source and lacks some training hashes."""
    state = F.when(F.col("source") == "qasr", "tuned").when(F.col("source") == "layla", "other").otherwise("base")
    given = {"prediction": F.col("base"), "model_name": F.col("source"), "model_family": F.lit("whisper"), "tuned_or_base": state, "run_name": F.lit("r"), "config_hash": F.lit(""), "tuned_adapter_path": F.lit("a")}
    return evaluate.contract_faults(_predictions(spark, folder).withColumns(given))


def prediction_health(spark: SparkSession, folder: str) -> DataFrame:
    """Empty predictions, with the first of them."""
    rows = _predictions(spark, folder)
    out = evaluate.prediction_health(rows, "tuned", "uid", "duration")
    return out.select("n_rows", "n_empty", F.round("hours", 6).alias("hours"), F.array_join("first_empty", ",").alias("first_empty"))


def best_epoch_early_stop(spark: SparkSession, folder: str) -> DataFrame:
    """The best epoch of a training history and where it stops: a day per epoch, its least value the metric."""
    days = table(spark, folder, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("epoch")).agg(F.round(F.min("value"), 4).alias("wer"))
    return evaluate.best_epoch(days, "epoch", "wer", 3)


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segments").dropDuplicates(["uid"])
    return rows.select("uid", F.col("original_audio_path").alias("audio_path"), F.coalesce("transcript", F.lit("")).alias("text"), F.round(F.col("duration").cast("double"), 3).alias("duration"), F.col("sampling_rate").alias("sample_rate"), "source")


def prepare_seq2seq(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of at most five seconds for the first family."""
    return prepare.for_seq2seq(_manifest(spark, folder), "audio_path", "text", "duration", 5.0).select("uid", "architecture", "input_audio_path", "labels_text", "task")


def prepare_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages, told by their parts."""
    rows = prepare.for_chat(_manifest(spark, folder), "audio_path", "text", "Transcribe.", "What is said?")
    m = F.col("messages")
    return rows.select("uid", F.size(m).alias("n_turns"), m[1]["content"][0]["audio_path"].alias("audio_path"), m[1]["content"][1]["text"].alias("asked"), m[2]["content"][0]["text"].alias("answer"))


def prepare_ctc(spark: SparkSession, folder: str) -> DataFrame:
    """Rows for the third family."""
    return prepare.for_ctc(_manifest(spark, folder), "audio_path", "text", "asr", "apc_Arab").select("uid", "architecture", "task", "language", "target_text")


def prediction_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Raw predictions with references from their source rows."""
    source = table(spark, folder, "segments").select("uid", F.col("transcript").alias("text"), F.unix_micros("ingested_at").alias("row_index"))
    raw = table(spark, folder, "row_probabilities").select("uid", F.col("text").alias("prediction")).distinct()
    return prepare.normalized_predictions(raw, source, {"model_name": "m", "tuned_or_base": "base"})


def manifest_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of the manifest rows, the recordings being the files there are."""
    files = table(spark, folder, "recordings").filter(source_name(F.col("source")) != "layla")
    return prepare.manifest_faults(_manifest(spark, folder), files, "original_audio_path")


def model_families(spark: SparkSession, folder: str) -> DataFrame:
    """The family of a model name for each nation."""
    names = sorted(m for names in prepare.MODELS.values() for m in names)
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % len(names) + 1).cast("int"))
    return table(spark, folder, "nation").select("n_nationkey", name.alias("model_name")).withColumn("model_family", prepare.family_of(F.col("model_name")))


def collated_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Items in batches of sixteen as parallel lists."""
    rows = table(spark, folder, "eval_items").select("item_id", "uid", "split")
    out = prepare.collated(rows, F.floor(F.col("item_id") / 16), "item_id", ["uid", "split"])
    return out.select("batch_id", F.array_join("uid_list", ",").alias("uids"), F.array_join("split_list", ",").alias("splits"))


def mock_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """What the smoke models predict for each item."""
    text = F.col("text")
    return table(spark, folder, "eval_items").select(
        "item_id", F.md5(prepare.mock_prediction(text, MARKER, False)).alias("base"), prepare.mock_prediction(text, MARKER, False, True).alias("placeholder"), F.md5(prepare.mock_prediction(text, MARKER, True)).alias("tuned")
    )


def mock_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Losses of the smoke trainer over a region per epoch."""
    train, val = prepare.mock_loss(F.col("r_regionkey"), "chat")
    return table(spark, folder, "region").select(F.col("r_regionkey").alias("epoch"), F.round(train, 9).alias("train_loss"), F.round(val, 9).alias("val_loss"))


def duration_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean, median, 95th percentile and hours per source."""
    out = stats.duration_stats(table(spark, folder, "segments").withColumn("leaf", source_name(F.col("source"))), "leaf", "duration")
    return out.select("leaf", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "total_seconds", "total_hours")))


def text_stats_by_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, durations, characters and words per split."""
    out = stats.text_stats(table(spark, folder, "segments").withColumn("part", split_name(F.col("split"))), ["part"], "transcript", "duration")
    whole = [c for c in out.columns if c.endswith(("_min", "_max")) and not c.startswith("duration")]
    return out.select("part", "n_rows", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("part", "n_rows", *whole)), *whole)


def mixture_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Train hours per source and language."""
    rows = table(spark, folder, "segments").withColumns({"corpus": source_name(F.col("source")), "part": split_name(F.col("split"))})
    return stats.mixture_hours(rows, "corpus", "language", "part", "duration").withColumn("hours", F.round("hours", 6))


def mixture_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Sampling weights of corpora and languages from their train hours."""
    rows = table(spark, folder, "segments").withColumns({"corpus": source_name(F.col("source")), "part": split_name(F.col("split"))})
    hours = stats.mixture_hours(rows, "corpus", "language", "part", "duration")
    return stats.mixture_weights(hours, "corpus", "language", 0.5, 0.25).withColumn("weight", F.round("weight", 6))


def mixture_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by split, by source and by language in one pass."""
    rows = table(spark, folder, "segments").select(split_name(F.col("split")).alias("split"), source_name(F.col("source")).alias("corpus"), "language")
    return stats.independent_counts(rows, ["split", "corpus", "language"])


def clock_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Durations of recordings as clock texts."""
    length = F.nanvl("audio_duration", F.lit(None).cast("double"))
    return table(spark, folder, "recordings").select("recording_id", stats.clock(length * 100).alias("clock"))


def pcm_and_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Length and kind of each record's audio bytes, and where its audio is."""
    data = F.col("audio")
    rows = table(spark, folder, "segments")
    return rows.select(
        "uid", "ingested_at", F.round(audio.pcm_seconds(data, F.lit(16000)), 9).alias("seconds"), audio.encoding_of(data).alias("kind"), audio.located(rows).alias("place")
    )


def pcm_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Energy of each record's audio."""
    return table(spark, folder, "segments").select("uid", "ingested_at", F.round(audio.pcm_energy("audio"), 6).alias("energy"))


class _LengthModel:
    """A deterministic stand-in for a classifier: scores by the text's length."""

    labels = ("short", "long")

    def predict(self, texts: list[str]) -> list[list[float]]:
        return [[1.0 / (1 + len(t)), 1.0 - 1.0 / (1 + len(t))] for t in texts]


def model_map(spark: SparkSession, folder: str) -> DataFrame:
    """Rows scored by a model that each task loads once."""
    rows = table(spark, folder, "segments").select("uid", "ingested_at", "transcript")
    return scoring.scored(rows, "transcript", _LengthModel).select("uid", "ingested_at", "status", F.round(F.col("label_scores")["short"], 9).alias("short"))


class _LevelModel:
    """A deterministic stand-in for an audio classifier: scores by the loudest sample."""

    labels = ("quiet", "loud")

    def predict(self, items: list[bytes]) -> list[list[float]]:
        peaks = [float(np.abs(audio.decoded(data)[0]).max()) for data in items]
        return [[1.0 - p, p] for p in peaks]


def audio_model_map(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose audio bytes a model scores, with the better of two labels."""
    rows = table(spark, folder, "segments").select("uid", "ingested_at", "audio")
    best = F.get("predictions", F.lit(0))
    return scoring.scored(rows, "audio", _LevelModel).select("uid", "ingested_at", "status", best["label"].alias("label"), F.round(best["score"], 6).alias("score"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and kind; the same rule runs on a stream."""
    out = windowed_counts(table(spark, folder, "events"), "ts", "event_type", "value")
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def _words(expr: str) -> str:
    return f"(case when {sql.collapsed(expr)} = '' then []::varchar[] else string_split({sql.collapsed(expr)}, ' ') end)"


_PREDICTIONS = f"""
with once as (
  select uid, any_value({sql.source_name('source')}) as source, coalesce(any_value(transcript), '') as reference, coalesce(any_value(normalized_transcript), '') as tuned, any_value(duration) as duration
  from segments group by uid
), predictions as (
  select *, '{MARKER} ' || array_to_string(list_filter({_words('reference')}, lambda w, i: (i - 1) % 4 != 3), ' ') as base from once
)"""


def _distance(a: str, b: str) -> str:
    """Edit distance of two lists in SQL: distinct units become single letters, for the engine's distance counts bytes."""
    known = f"list_distinct(list_concat({a}, {b}))"
    code = lambda x: f"array_to_string(list_transform({x}, lambda u: chr((32 + list_position({known}, u))::int)), '')"
    return f"levenshtein({code(a)}, {code(b)})"


def _errors(hypothesis: str, keep: str) -> str:
    """One row per record with edits and units of the six metrics, by way of the forms and unit lists."""
    forms = {"": ("reference", hypothesis), "normalized_": (sql.basic("reference"), sql.basic(hypothesis)), "loose_": (sql.loose("reference"), sql.loose(hypothesis))}
    units = ", ".join(
        f"{_words(e)} as {p}w{k}, string_split(replace({e}, ' ', ''), '') as {p}c{k}" for p, pair in forms.items() for k, e in zip("rh", pair, strict=True)
    )
    out = []
    for p in forms:
        for m, u in (("wer", "w"), ("cer", "c")):
            r, h = (f"list_filter({p}{u}{k}, lambda x: x != '')" for k in "rh")
            out.append(f"{_distance(r, h)} as {p}{m}_edits, len({r}) as {p}{m}_units, len({h}) as {p}{m}_other")
    return f", units_{hypothesis} as (select {keep}, {units} from predictions), errors_{hypothesis} as (select {keep}, {', '.join(out)} from units_{hypothesis})"


def _metrics(hypothesis: str, group: str = "") -> str:
    lead = f"{group}, " if group else ""
    rows = [
        f"""select {lead}'{m}' as metric, sum({m}_edits)::bigint as edits, sum({m}_units)::bigint as units,
  case when sum({m}_units) > 0 then sum({m}_edits)::double / sum({m}_units) when sum({m}_other) > 0 then 1.0 else 0.0 end as value from errors_{hypothesis} {'group by ' + group if group else ''}"""
        for m in METRICS
    ]
    return " union all ".join(rows)


_MANIFEST = """
with manifest as (select uid, any_value(original_audio_path) as audio_path, coalesce(any_value(transcript), '') as text, round(any_value(duration)::double, 3) as duration,
  any_value(sampling_rate) as sample_rate, any_value(source) as source from segments group by uid)
"""
_CHARS, _WORDS = f"length({sql.collapsed('t')})", f"len({_words('t')})"

QUERIES = {
    f.__name__: f
    for f in (
        wer_cer_per_row, metrics_six, metrics_by_source, base_vs_tuned, prediction_contract, prediction_health, best_epoch_early_stop, prepare_seq2seq, prepare_chat, prepare_ctc,
        prediction_normalize, manifest_contract, collated_batches, mock_predictions, mock_losses, duration_stats, text_stats_by_split, mixture_hours, mixture_weights, mixture_counts, clock_texts,
        pcm_and_kind, pcm_energy, model_map, event_windows, model_families, audio_model_map,
    )
}
SQL = {
    "wer_cer_per_row": _PREDICTIONS + _errors("base", "uid") + f" select uid, {', '.join(f'{m}_{p}' for m in METRICS for p in ('edits', 'units'))} from errors_base",
    "metrics_six": _PREDICTIONS + _errors("tuned", "uid") + " " + _metrics("tuned"),
    "metrics_by_source": _PREDICTIONS + _errors("tuned", "source") + " " + _metrics("tuned", "source"),
    "base_vs_tuned": _PREDICTIONS
    + _errors("base", "uid")
    + _errors("tuned", "uid")
    + f""" select metric, b.value as base, t.value as tuned, b.value - t.value as absolute, (b.value - t.value) / nullif(b.value, 0) as relative
from ({_metrics('base')}) b join ({_metrics('tuned')}) t using (metric)""",
    "prediction_contract": _PREDICTIONS
    + """ select count(*) as n_rows, count(*) = 0 as is_empty, count_if(source is null or coalesce(source = 'qasr', false)) as n_missing,
  array_to_string(list_filter([case when count_if(source is null) > 0 then 'model_name' end, case when count_if(source = 'qasr') > 0 then 'training_config_hash' end], lambda x: x is not null), ',') as missing_columns,
  count_if(coalesce(source = 'layla', false)) as n_bad_state, 'model_name,tuned_or_base' as varying_columns, 'config_hash' as empty_columns from predictions""",
    "prediction_health": _PREDICTIONS
    + """ select (select count(*) from predictions) as n_rows, (select count(*) from predictions where trim(tuned, ' ') = '') as n_empty,
  (select round(sum(duration::double) / 3600, 6) from predictions) as hours,
  (select coalesce(string_agg(uid, ',' order by uid), '') from (select uid from predictions where trim(tuned, ' ') = '' order by uid limit 20)) as first_empty""",
    "best_epoch_early_stop": """
with recursive days as (select (ts::date - date '1970-01-01')::int as epoch, round(min(value), 4) as wer from events group by all
), ordered as (select *, row_number() over (order by epoch) as i from days
), walk as (
  select i, epoch, epoch as best_epoch, wer as best_value, 0::bigint as waited from ordered where i = 1
  union all
  select o.i, o.epoch, case when o.wer < w.best_value then o.epoch else w.best_epoch end, least(o.wer, w.best_value), case when o.wer < w.best_value then 0 else o.epoch - w.best_epoch end
  from ordered o join walk w on o.i = w.i + 1 where w.waited < 3
) select best_epoch, best_value, epoch as stopped_epoch from walk order by i desc limit 1""",
    "prepare_seq2seq": _MANIFEST
    + "select uid, 'seq2seq' as architecture, audio_path as input_audio_path, text as labels_text, 'transcribe' as task from manifest where coalesce(duration <= 5.0::double, true)",
    "prepare_chat": _MANIFEST + "select uid, 3 as n_turns, audio_path, 'What is said?' as asked, text as answer from manifest",
    "prepare_ctc": _MANIFEST + "select uid, 'ctc' as architecture, 'asr' as task, 'apc_Arab' as language, text as target_text from manifest",
    "prediction_normalize": """select r.uid, coalesce(s.transcript, '') as reference, coalesce(r.text, '') as prediction, 'm' as model_name, 'base' as tuned_or_base
from (select distinct uid, text from row_probabilities) r left join (select uid, transcript from segments qualify row_number() over (partition by uid order by ingested_at desc) = 1) s using (uid)""",
    "manifest_contract": _MANIFEST
    + """select count(*) as n_rows, count(*) = 0 as is_empty, '' as missing_columns,
  count_if(uid is null or audio_path is null or duration is null or sample_rate is null or source is null) as n_lacking,
  count_if(audio_path is not null and audio_path not in (select original_audio_path from recordings where original_audio_path is not null and """
    + sql.source_name("source")
    + """ != 'layla')) as n_no_file,
  count_if(coalesce(duration <= 0 or isnan(duration), false)) as n_bad_duration, count_if(coalesce(sample_rate <= 0, false)) as n_bad_rate from manifest""",
    "model_families": """with n as (select n_nationkey, ['Omni ASR 1B', 'Omni ASR 300M', 'Qwen/Qwen3-ASR-0.6B', 'Qwen/Qwen3-ASR-1.7B', 'openai/whisper-large-v3', 'openai/whisper-medium'][n_nationkey % 6 + 1] as model_name from nation)
select *, case when starts_with(model_name, 'Omni') then 'omni' when starts_with(model_name, 'Qwen') then 'qwen' else 'whisper' end as model_family from n""",
    "collated_batches": """select floor(item_id / 16)::bigint as batch_id, string_agg(uid, ',' order by item_id) as uids, string_agg(split, ',' order by item_id) as splits from eval_items group by all""",
    "mock_predictions": f"select item_id, md5('{MARKER} ' || text) as base, '{MARKER}' as placeholder, md5(text) as tuned from eval_items",
    "mock_losses": """select r_regionkey as epoch, round(greatest(0.001::double, 1.0::double / (r_regionkey + 1) + 0.01::double * 4), 9) as train_loss,
  round(greatest(0.001::double, greatest(0.001::double, 1.0::double / (r_regionkey + 1) + 0.01::double * 4) * 0.9::double), 9) as val_loss from region""",
    "duration_stats": f"""with d as (select {sql.source_name('source')} as leaf, case when not isnan(duration) then duration::double end as d from segments)
select leaf, count(d) as n, round(avg(d), 6) as mean, round(median(d), 6) as median, round(quantile_cont(d, 0.95), 6) as p95, round(coalesce(sum(d), 0), 6) as total_seconds,
  round(coalesce(sum(d), 0) / 3600, 6) as total_hours from d group by leaf""",
    "text_stats_by_split": f"""with d as (select {sql.split_name('split')} as part, case when not isnan(duration) then duration::double end as d, coalesce(transcript, '') as t from segments
), m as (select part, d, {_CHARS} as c, {_WORDS} as w from d)
select part, count(*) as n_rows, round(avg(d), 6) as duration_mean, round(min(d), 6) as duration_min, round(max(d), 6) as duration_max, round(avg(c), 6) as chars_mean, min(c)::int as chars_min,
  max(c)::int as chars_max, round(avg(w), 6) as words_mean, min(w)::int as words_min, max(w)::int as words_max from m group by part""",
    "mixture_hours": f"""select {sql.source_name('source')} as corpus, language, round(sum(duration::double) / 3600, 6) as hours from segments where {sql.split_name('split')} = 'train' group by all""",
    "mixture_weights": f"""with h as (
  select {sql.source_name('source')} as corpus, language, sum(duration::double) / 3600 as hours from segments where {sql.split_name('split')} = 'train' group by all
), l as (select language, sum(hours) as total from h group by language), i as (
  select corpus, h.language, pow(hours / total, 0.5) as w, pow(total, 0.25) as o from h join l on h.language is not distinct from l.language
) select corpus, language, round(w / sum(w) over (partition by language) * o / (select sum(pow(total, 0.25)) from l), 6) as weight from i""",
    "mixture_counts": f"""with r as (select {sql.split_name('split')} as split, {sql.source_name('source')} as corpus, language from segments)
select 'split' as dimension, split as value, count(*) as n from r group by split union all select 'corpus', corpus, count(*) from r group by corpus
union all select 'language', language, count(*) from r group by language""",
    "clock_texts": """with s as (select recording_id, floor(case when not isnan(audio_duration) then audio_duration end * 100)::bigint as s from recordings)
select recording_id, case when s >= 3600 then (s // 3600)::varchar || 'h' || lpad((s // 60 % 60)::varchar, 2, '0') || 'm' || lpad((s % 60)::varchar, 2, '0') || 's'
  when s >= 60 then (s // 60)::varchar || 'm' || lpad((s % 60)::varchar, 2, '0') || 's' else s::varchar || 's' end as clock from s""",
    "pcm_and_kind": """select uid, ingested_at, round(coalesce(octet_length(audio) / 2.0::double / 16000, 0), 9) as seconds,
  case when audio is null then null when starts_with(hex(audio), '52494646') then 'wav' when starts_with(hex(audio), '664C6143') then 'flac' when starts_with(hex(audio), '4F676753') then 'ogg'
    when starts_with(hex(audio), '494433') then 'mp3' else 'pcm' end as kind,
  case when audio is not null then 'audio' when coalesce(trim(original_audio_path, ' '), '') != '' then 'original_audio_path' end as place from segments""",
    "pcm_energy": """with h as (select uid, ingested_at, hex(audio) as h, octet_length(audio) // 2 as n from segments
), s as (select uid, ingested_at, list_transform(range(0, n), lambda i: ('0x' || substring(h, 4 * i + 3, 2) || substring(h, 4 * i + 1, 2))::int) as u from h
) select uid, ingested_at, round(list_avg(list_transform(u, lambda x: pow((case when x >= 32768 then x - 65536 else x end) / 32768.0::double, 2))), 6) as energy from s""",
    "audio_model_map": """with h as (select uid, ingested_at, hex(audio) as h, coalesce(octet_length(audio), 0) // 2 as n from segments
), s as (select uid, ingested_at, list_transform(range(0, n), lambda i: ('0x' || substring(h, 4 * i + 3, 2) || substring(h, 4 * i + 1, 2))::int) as u from h
), p as (select uid, ingested_at, list_max(list_transform(u, lambda x: abs(case when x >= 32768 then x - 65536 else x end) / 32768.0::double)) as p from s
) select uid, ingested_at, case when p is null then 'skipped_empty' else 'ok' end as status, case when p > 0.5 then 'loud' when p is not null and p < 0.5 then 'quiet' when p is not null then 'loud' end as label,
  round(greatest(p, 1 - p), 6) as score from p""",
    "model_map": f"""select uid, ingested_at, case when coalesce({sql.collapsed('transcript')}, '') = '' then 'skipped_empty' else 'ok' end as status,
  case when coalesce({sql.collapsed('transcript')}, '') != '' then round(1.0::double / (1 + length(transcript)), 9) end as short from segments""",
    "event_windows": """select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""",
}

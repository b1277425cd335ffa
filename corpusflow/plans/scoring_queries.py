"""Queries on classifier scores, candidates and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.reading import source_name, speaker_name
from corpusflow.operators import scoring, timing
from corpusflow.operators.stats import hours_by
from corpusflow.plans import sql
from corpusflow.plans.tables import table
from corpusflow.sizing import lookup

AUDIO_LABELS = ["Maghrebi", "MSA", "Egyptian", "Gulf", "Levantine"]
TEXT_LABELS = ["MAGHREB", "LEV", "MSA", "GLF", "EGY"]
IN_SCOPE = ("qasr", "masc_c")
#: Stands in for the stated score where a log has none.
THRESHOLDS = [0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "row_probabilities")


def _text_score() -> Column:
    return scoring.score_of(F.col("text_label_scores"), "LEV")


def _audio_score() -> Column:
    return scoring.score_of(F.col("label_scores"), "Levantine")


def argmax_label(spark: SparkSession, folder: str) -> DataFrame:
    """Best label, its score and the final label of each distinct log row."""
    ranked = scoring.ranked_labels(F.col("label_scores"), AUDIO_LABELS)
    best = _log(spark, folder).select("source_row_key", F.get(ranked, F.lit(0)).alias("best"))
    return best.select("source_row_key", F.col("best.label").alias("label"), F.col("best.score").alias("score"), scoring.final_label(F.col("best.label"), F.col("best.score")).alias("final"))


def unseen_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and percent of each final label over ok rows, labels without rows included."""
    return scoring.label_shares(_log(spark, folder), "final_label", "status", [*AUDIO_LABELS, "unseen"])


def label_table(spark: SparkSession, folder: str) -> DataFrame:
    """The label shares in the order of a report: most percent first."""
    return scoring.by_percent(unseen_distribution(spark, folder))


def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by status."""
    return scoring.status_counts(_log(spark, folder), "status")


def softmax_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The best softmax class of each vector, over all its values."""
    logits = F.transform("embedding", lambda x: x.cast("double") * 20)
    rows = table(spark, folder, "embeddings").select("vec_id", scoring.softmax(logits).alias("p"))
    return rows.select("vec_id", F.array_position("p", F.array_max("p")).cast("int").alias("class"), F.round(F.array_max("p"), 6).alias("probability"))


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Rows at or above each threshold; rows without a status are counted as malformed."""
    return scoring.threshold_sweep(_log(spark, folder), _text_score(), THRESHOLDS, F.col("status").isNull())


def topk_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best-scored distinct rows."""
    rows = _log(spark, folder).select("source_row_key", _text_score().alias("score")).distinct()
    return scoring.top_k(rows, [F.desc("score"), F.col("source_row_key")], 20)


def reservoir_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Ten rows above a threshold by a seeded hash."""
    rows = _log(spark, folder).filter(_text_score() >= 0.8).select("source_row_key").distinct()
    return scoring.sampled(rows, F.col("source_row_key"), 10)


def last_records(spark: SparkSession, folder: str) -> DataFrame:
    """The last five rows of each shard."""
    rows = _log(spark, folder).select("source_file", "row_idx", "status").distinct()
    from pyspark.sql.window import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("row_idx")))).filter("place <= 5").select("source_file", "row_idx", "place")


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    last = scoring.last_of_key(_log(spark, folder).withColumn("score", _text_score()), ["uid"], [F.desc("row_idx"), F.desc("status")])
    return last.filter("score >= 0.8").select("uid", "score", "source_file")


def audio_candidates_join(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that are candidates, with their text score; of repeated log rows the last counts."""
    rows = table(spark, folder, "segments").select("uid", "ingested_at", "duration")
    joined = scoring.enriched(rows, _candidates(spark, folder).select("uid", "score"), ["uid"])
    return joined.select("uid", "ingested_at", "text_score")


def candidate_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of segments that hold a candidate."""
    rows = table(spark, folder, "segments").select("uid", "source_file")
    return lookup(rows, _candidates(spark, folder).select("uid"), ["uid"], "left_semi").select("source_file").distinct()


def candidates_by_row(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the log that are candidates by file and row number, with the score of the last record of that row."""
    rows = _log(spark, folder).select("source_file", "row_idx").distinct()
    last = scoring.last_of_key(_log(spark, folder).withColumn("score", _text_score()), ["source_file", "row_idx"], [F.desc("score"), F.desc("source_row_key")])
    return scoring.enriched(rows, last.filter("score >= 0.8").select("source_file", "row_idx", "score"), ["source_file", "row_idx"])


def existence_by_row(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each file by whether an accepted record has their file and row number."""
    keys = ["source_file", "row_idx"]
    accepted = _labelled(spark, folder).filter("is_lev").select(*keys).distinct().withColumn("hit", F.lit(True))
    rows = lookup(_log(spark, folder).select(*keys).distinct(), accepted, keys, "left")
    return rows.groupBy("source_file").agg(F.count_if("hit").alias("n_lev"), F.count_if(F.col("hit").isNull()).alias("n_non_lev"))


def candidate_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Rows scored, candidates, and the shards they are in."""
    hit = _text_score() >= 0.8
    return _log(spark, folder).agg(F.count("*").alias("n_scored"), F.count_if(hit).alias("n_candidates"), F.count_distinct(F.when(hit, F.col("source_file"))).alias("n_shards"))


def resume_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that the log doesn't have yet."""
    return scoring.pending(table(spark, folder, "segments").select("uid").distinct(), _log(spark, folder), ["uid"])


def resume_retrying(spark: SparkSession, folder: str) -> DataFrame:
    """Segments without an ok row in the log."""
    return scoring.pending(table(spark, folder, "segments").select("uid").distinct(), _log(spark, folder), ["uid"], retry_failed=True)


def missing_side_report(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings by source with and without annotation segments."""
    specs = table(spark, folder, "segment_specs").select("recording_id").distinct().withColumn("known", F.lit(1))
    rows = table(spark, folder, "recordings").select("recording_id", source_name(F.col("source")).alias("source"))
    return rows.join(specs, "recording_id", "left").groupBy("source").agg(F.count("known").alias("n_matched"), F.count_if(F.col("known").isNull()).alias("n_unmatched"))


def speaker_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with the gender that the record of their recording's speaker states; those without a record stay."""
    specs = table(spark, folder, "segment_specs").select("recording_id", speaker_name(F.col("speaker_id")).alias("speaker"), F.get_json_object("speaker_meta", "$.gender").alias("gender"))
    speakers = specs.filter("speaker is not null").groupBy("recording_id", "speaker").agg(F.min("gender").alias("stated_gender"))
    rows = table(spark, folder, "segments").select("uid", "ingested_at", "recording_id", speaker_name(F.col("speaker_id")).alias("speaker"))
    return timing.with_speaker(rows, speakers, ["recording_id", "speaker"], ["stated_gender"]).select("uid", "ingested_at", "speaker", "stated_gender")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    scope = source_name(F.col("source")).isin(*IN_SCOPE)
    return _log(spark, folder).withColumn("is_lev", scoring.binary_label(F.col("status"), _text_score(), _audio_score(), scope, 0.5))


def binary_label(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that pass both thresholds."""
    return _labelled(spark, folder).select("source_row_key", "status", "is_lev")


def binary_source_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and accepted rows by source."""
    return _labelled(spark, folder).groupBy(source_name(F.col("source")).alias("source")).agg(F.count("*").alias("n_rows"), F.count_if("is_lev").alias("n_accepted"), F.count_if(_text_score() >= 0.5).alias("n_text"))


def existence_join(spark: SparkSession, folder: str) -> DataFrame:
    """Segments by whether an accepted row of the log names them."""
    accepted = _labelled(spark, folder).filter("is_lev").select("uid").distinct().withColumn("hit", F.lit(True))
    rows = lookup(table(spark, folder, "segments").select("uid", "source_file"), accepted, ["uid"], "left")
    return rows.groupBy("source_file").agg(F.count_if("hit").alias("n_lev"), F.count_if(F.col("hit").isNull()).alias("n_non_lev"))


def audio_minimum(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that the shortest audio length would skip, by stated status."""
    short = F.coalesce(F.col("duration_sec") < 2.0, F.lit(False))
    return _log(spark, folder).groupBy("status", F.when(short, "skipped_short").otherwise("scored").alias("route")).agg(F.count("*").alias("n_rows"))


def hours_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and hours of each final label."""
    out = hours_by(_log(spark, folder), F.col("final_label"), "duration_sec")
    return out.select("final_label", "n_rows", F.round("hours", 6).alias("hours"))


def out_of_range_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Row numbers of the log that lie outside their file."""
    sizes = table(spark, folder, "segments").groupBy(F.regexp_replace("source_file", r"__data-.*$", "").alias("dataset")).agg(F.count("*").alias("n"))
    rows = _log(spark, folder).select(F.regexp_replace("source_file", r"__clean-.*$", "").alias("dataset"), "row_idx")
    return scoring.out_of_range(rows, sizes, "dataset", "row_idx", "n")


def filtered_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by source and whether a list of sources leaves them out."""
    name = source_name(F.col("source"))
    route = F.coalesce(scoring.source_route(name, IN_SCOPE), F.lit("taken"))
    return _log(spark, folder).groupBy(name.alias("source"), route.alias("route")).agg(F.count("*").alias("n_rows"))


_T, _A = "coalesce(text_label_scores['LEV'], 0.0::double)", "coalesce(label_scores['Levantine'], 0.0::double)"
_LAST = f"""(select * from (select uid, source_file, {_T} as score, row_number() over (partition by uid order by row_idx desc nulls last, status desc nulls last) as n from row_probabilities)
  where n = 1 and score >= 0.8)"""
_IS_LEV = f"coalesce(coalesce(status, 'ok') = 'ok' and {sql.source_name('source')} in ('qasr', 'masc_c') and {_T} >= 0.5 and {_A} >= 0.5, false)"
_SHARES = """with ok as (select * from row_probabilities where coalesce(status, 'ok') = 'ok'), listed(label) as (values ('Maghrebi'), ('MSA'), ('Egyptian'), ('Gulf'), ('Levantine'), ('unseen'))
select label, count(final_label) as n, round(100.0::double * count(final_label) / (select count(*) from ok), 4) as percent from listed left join ok on final_label = label group by label"""
_BEST = " ".join(f"when label_scores['{x}'] = m then '{x}'" for x in AUDIO_LABELS)

QUERIES = {
    f.__name__: f
    for f in (
        argmax_label, unseen_distribution, status_rollup, softmax_embeddings, threshold_sweep, topk_candidates, reservoir_sample, last_records, audio_candidates_join,
        candidate_shards, candidate_stats, resume_anti, resume_retrying, missing_side_report, speaker_lookup, binary_label, binary_source_summary, existence_join, audio_minimum,
        hours_by_label, out_of_range_rows, label_table, candidates_by_row, existence_by_row, filtered_sources,
    )
}
SQL = {
    "argmax_label": f"""with top as (select *, list_max(map_values(label_scores)) as m from row_probabilities)
select source_row_key, case {_BEST} end as label, m as score, case when m < 0.55 then 'unseen' else case {_BEST} end end as final from top""",
    "unseen_distribution": _SHARES,
    "label_table": f"select *, row_number() over (order by percent desc, label)::int as place from ({_SHARES})",
    "candidates_by_row": f"""select source_file, row_idx, max({_T}) as text_score from row_probabilities where source_file is not null and row_idx is not null
group by all having max({_T}) >= 0.8""",
    "existence_by_row": f"""with r as (select source_file, row_idx, bool_or({_IS_LEV}) as hit from row_probabilities group by all)
select source_file, count_if(hit) as n_lev, count_if(not hit) as n_non_lev from r group by all""",
    "filtered_sources": f"""select {sql.source_name('source')} as source, case when coalesce({sql.source_name('source')} in ('qasr', 'masc_c'), false) then 'taken' else 'skipped_filtered_source' end as route,
  count(*) as n_rows from row_probabilities group by all""",
    "status_rollup": """select count(*) as total, count_if(coalesce(status, 'ok') = 'ok') as ok, count_if(coalesce(starts_with(status, 'skipped'), false)) as skipped,
  count_if(coalesce(status = 'error', false)) as error from row_probabilities""",
    "softmax_embeddings": """with x as (select vec_id, list_transform(embedding, lambda v: v::double * 20) as l from embeddings),
e as (select vec_id, list_transform(l, lambda v: exp(v - list_max(l))) as e from x), p as (select vec_id, list_transform(e, lambda v: v / list_sum(e)) as p from e)
select vec_id, list_position(p, list_max(p))::int as class, round(list_max(p), 6) as probability from p""",
    "threshold_sweep": f"""with t(threshold) as (values (0.4::double), (0.5), (0.6), (0.7), (0.8), (0.9)), s as (select {_T} as score from row_probabilities where status is not null)
select threshold, (select count(*) from s) as scanned, (select count(*) from s where score >= threshold) as qualifying,
  round(100.0::double * (select count(*) from s where score >= threshold) / (select count(*) from s), 4) as percent, (select count(*) from row_probabilities where status is null) as malformed from t""",
    "topk_candidates": f"select distinct source_row_key, {_T} as score from row_probabilities order by score desc, source_row_key limit 20",
    "reservoir_sample": f"select source_row_key from (select distinct source_row_key from row_probabilities where {_T} >= 0.8) order by md5('42|' || source_row_key), source_row_key limit 10",
    "last_records": """select source_file, row_idx, row_number() over (partition by source_file order by row_idx desc)::int as place from (select distinct source_file, row_idx, status from row_probabilities)
qualify row_number() over (partition by source_file order by row_idx desc) <= 5""",
    "audio_candidates_join": f"select s.uid, s.ingested_at, c.score as text_score from segments s join {_LAST} c using (uid)",
    "candidate_shards": f"select distinct s.source_file from segments s join {_LAST} c using (uid)",
    "candidate_stats": f"""select count(*) as n_scored, count_if({_T} >= 0.8) as n_candidates, count(distinct case when {_T} >= 0.8 then source_file end) as n_shards from row_probabilities""",
    "resume_anti": "select distinct uid from segments where uid not in (select uid from row_probabilities where uid is not null)",
    "resume_retrying": "select distinct uid from segments where uid not in (select uid from row_probabilities where uid is not null and coalesce(status, 'ok') = 'ok')",
    "missing_side_report": f"""select {sql.source_name('source')} as source, count(s.recording_id) as n_matched, count_if(s.recording_id is null) as n_unmatched
from recordings r left join (select distinct recording_id from segment_specs) s using (recording_id) group by all""",
    "speaker_lookup": """with speakers as (
  select recording_id, nullif(lower(trim(speaker_id)), '') as speaker, min(speaker_meta->>'$.gender') as stated_gender from segment_specs group by all
) select s.uid, s.ingested_at, nullif(lower(trim(s.speaker_id)), '') as speaker, p.stated_gender
from segments s left join speakers p on s.recording_id = p.recording_id and nullif(lower(trim(s.speaker_id)), '') = p.speaker""",
    "binary_label": f"select source_row_key, status, {_IS_LEV} as is_lev from row_probabilities",
    "binary_source_summary": f"""select {sql.source_name('source')} as source, count(*) as n_rows, count_if({_IS_LEV}) as n_accepted, count_if({_T} >= 0.5) as n_text
from row_probabilities group by all""",
    "existence_join": f"""select source_file, count_if(uid in (select uid from row_probabilities where {_IS_LEV} and uid is not null)) as n_lev,
  count_if(uid not in (select uid from row_probabilities where {_IS_LEV} and uid is not null)) as n_non_lev from segments group by all""",
    "audio_minimum": """select status, case when coalesce(duration_sec < 2.0, false) then 'skipped_short' else 'scored' end as route, count(*) as n_rows from row_probabilities group by all""",
    "hours_by_label": "select final_label, count(*) as n_rows, round(coalesce(sum(case when not isnan(duration_sec) then duration_sec end), 0) / 3600.0::double, 6) as hours from row_probabilities group by all",
    "out_of_range_rows": """with sizes as (select regexp_replace(source_file, '__data-.*$', '') as dataset, count(*) as n from segments group by all)
select dataset, count(*) as n_rows, count_if(row_idx < 0 or row_idx >= coalesce(n, 0)) as n_outside
from (select distinct regexp_replace(source_file, '__clean-.*$', '') as dataset, row_idx from row_probabilities where row_idx is not null) left join sizes using (dataset) group by all""",
}

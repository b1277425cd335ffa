"""Queries on column resolution, names, unions and replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.reading import source_name
from corpusflow.operators import audit, columns, prepare
from corpusflow.plans import sql
from corpusflow.plans.tables import table

#: Spellings of sources that mean another one.
ALIASES = {"masc_c": ("masc", "masc_c_only"), "qasr": ("processed_segments",)}
GROUPS = {"casablanca_jordanian": "levant", "casablanca_palestinian": "levant", "omnilingual_apc": "levant", "layla": "levant"}


def source_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per canonical source, aliases resolved."""
    name = columns.canonical_source(F.col("source"), ALIASES)
    return table(spark, folder, "documents").groupBy(name.alias("source")).agg(F.count("*").alias("n_rows"))


def source_from_row(spark: SparkSession, folder: str) -> DataFrame:
    """The source of each row, from its field or its file's name."""
    rows = table(spark, folder, "row_probabilities")
    return rows.select("source_row_key", columns.source_of_row(rows, ALIASES).alias("found"))


def row_uids(spark: SparkSession, folder: str) -> DataFrame:
    """Row names from the first key with a value."""
    rows = table(spark, folder, "segments")
    return rows.select("uid", "ingested_at", columns.row_uid(rows, F.col("source_file"), F.col("source_row_index"), ["segment_key", "original_annotation_path", "segment_id"]).alias("row_name"))


def dataset_from_path(spark: SparkSession, folder: str) -> DataFrame:
    """Dataset names from audio paths."""
    return table(spark, folder, "recordings").select("recording_id", columns.dataset_of_path(F.col("original_audio_path"), "/data").alias("dataset"))


def stable_file_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Stable ids and safe names of audio files."""
    path = F.col("original_audio_path")
    return table(spark, folder, "recordings").select("recording_id", columns.stable_file_id(path).alias("file_id"), columns.safe_name(path).alias("safe"))


def first_text_per_row(spark: SparkSession, folder: str) -> DataFrame:
    """The first text with content of each row, its field, and the raw value."""
    rows = table(spark, folder, "segments")
    wanted = ["raw_text", "metadata_json", "transcript", "normalized_transcript"]
    text, field = columns.first_text(rows, wanted)
    return rows.select("uid", "ingested_at", text.alias("text"), field.alias("text_field"), columns.first_raw(rows, wanted).alias("raw"))


def safe_casts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers read from JSON strings, nothing where there is none."""
    number = columns.safe_double(F.get_json_object("segment_meta", "$.WMER"))
    return table(spark, folder, "segment_specs").groupBy("recording_id").agg(F.count(number).alias("n_numbers"), F.max(number).alias("most"))


def audio_of_records(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript files with the audio file that their name leads to."""
    path = F.col("original_audio_path")
    files = table(spark, folder, "recordings").filter("original_audio_path is not null")
    records = files.select("recording_id", F.concat(F.lit("./"), F.regexp_replace(path, r"\.wav$", ""), F.lit("_Arabic_transcription.txt")).alias("text_path"))
    return columns.with_audio(records, "text_path", files, "original_audio_path")


def paths_and_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Paths made absolute, and those that hold a directory of a name."""
    path = F.col("original_audio_path")
    rows = table(spark, folder, "recordings")
    return rows.select("recording_id", columns.absolute_path(F.replace(path, F.lit("/data/"), F.lit("")), "/mnt").alias("absolute"), columns.holds_part(path, "QASR").alias("excluded"))


def union_aligned(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables under one schema, counted by source and kind."""
    schema = table(spark, folder, "segments").select("uid", "transcript", "source", "duration", "language").schema
    items = table(spark, folder, "eval_items").withColumnRenamed("text", "transcript")
    both = columns.aligned(table(spark, folder, "segments"), schema).withColumn("kind", F.lit("segment")).unionByName(columns.aligned(items, schema).withColumn("kind", F.lit("item")))
    return both.groupBy("kind", source_name(F.col("source")).alias("source")).agg(F.count("*").alias("n"), F.count("duration").alias("n_duration"), F.count("language").alias("n_language"))


def union_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Two roots merged, their rows counted by root and split."""
    roots = {"segments": table(spark, folder, "segments").select("uid", "split", "source_file"), "items": table(spark, folder, "eval_items").select("uid", "split")}
    merged = columns.stacked(*(df.withColumn("root", F.lit(r)) for r, df in roots.items()))
    return merged.groupBy("root", "split").agg(F.count("*").alias("n"), F.count("source_file").alias("n_with_file"))


def merged_without_clash(spark: SparkSession, folder: str) -> DataFrame:
    """Roots that share no file, with the check that they don't."""
    documents = table(spark, folder, "documents").select("source_file", "source")
    broadcast_docs, rest = documents.filter("source_file like 'qasr%'"), documents.filter("source_file not like 'qasr%'")
    merged = audit.merged_roots({"first": broadcast_docs, "second": rest}, "source_file")
    return merged.groupBy("root").agg(F.count("*").alias("n_rows"), F.count_distinct("source_file").alias("n_files"))


def replace_subset_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """One source's rows replaced by others, their number checked."""
    rows = table(spark, folder, "documents").select("doc_id", source_name(F.col("source")).alias("source"), "n_chars")
    new = rows.filter("source = 'subtitles'").withColumn("n_chars", F.lit(0).cast("bigint"))
    replaced = audit.replaced_subset(rows, F.col("source") == "subtitles", new, expected=rows.filter("source = 'subtitles'").count())
    return replaced.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"))


def dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of each record."""
    return audit.keep_first(table(spark, folder, "segments"), ["uid"], [F.col("ingested_at")]).select("uid", "ingested_at", "source_file", "source_row_index")


def grouped_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources mapped to groups, others to the default."""
    group = prepare.mapped(source_name(F.col("source")), GROUPS, "other")
    return table(spark, folder, "recordings").groupBy(group.alias("group")).agg(F.count("*").alias("n_recordings"))


def single_source_log(spark: SparkSession, folder: str) -> DataFrame:
    """One source's rows of the log."""
    return table(spark, folder, "row_probabilities").filter(source_name(F.col("source")) == "qasr").groupBy("status").agg(F.count("*").alias("n_rows"))


def routed_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per leaf of their file name, with the leaf's language."""
    leaf = columns.leaf_of(F.col("source_file"), {"masc_c": "masc_non_lev", "masc_c__bulk": "masc_bulk", "qasr": "qasr", "layla": "layla"}, "rest")
    return table(spark, folder, "documents").groupBy(leaf.alias("leaf"), columns.language_of(leaf).alias("language")).agg(F.count("*").alias("n_rows"))


def corpus_of_path(spark: SparkSession, folder: str) -> DataFrame:
    """Split and corpus read from paths."""
    split, corpus = columns.path_parts(F.col("original_audio_path"), "/data")
    return table(spark, folder, "recordings").select("recording_id", split.alias("first_part"), corpus.alias("corpus"))


def numbered_uids(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered names and short hashes of log rows."""
    rows = table(spark, folder, "row_probabilities").select("source_row_key", "row_idx").distinct()
    name = columns.numbered_uid(F.lit("c"), F.lit("train"), F.col("row_idx") % 7, F.lit(3), F.col("row_idx"))
    return rows.select("source_row_key", name.alias("name"), columns.short_hash(16, F.col("source_row_key"), F.col("row_idx")).alias("short"))


def capped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """At most five documents of each file."""
    return columns.capped(table(spark, folder, "documents").select("doc_id", "source_file"), "source_file", [F.col("doc_id")], 5)


_CANONICAL = f"""(case when {sql.source_name('source')} in ('masc_c', 'masc', 'masc_c_only') then 'masc_c'
  when {sql.source_name('source')} in ('qasr', 'processed_segments') then 'qasr' else nullif({sql.source_name('source')}, '') end)"""

QUERIES = {
    f.__name__: f
    for f in (
        source_canonical, source_from_row, row_uids, dataset_from_path, stable_file_ids, first_text_per_row, safe_casts, paths_and_parts, union_aligned, union_tagged,
        merged_without_clash, replace_subset_guarded, dedup_keep_first, grouped_sources, single_source_log, routed_leaves, corpus_of_path, numbered_uids, capped_rows, audio_of_records,
    )
}
SQL = {
    "source_canonical": f"select {_CANONICAL} as source, count(*) as n_rows from documents group by all",
    "source_from_row": f"""select source_row_key, coalesce({_CANONICAL}, case when contains(lower(source_file), 'masc_c') then 'masc_c' when contains(lower(source_file), 'qasr') then 'qasr' end) as found
from row_probabilities""",
    "row_uids": """select uid, ingested_at, coalesce(source_file || ':original_annotation_path=' || original_annotation_path, source_file || ':segment_id=' || segment_id,
  source_file || ':row=' || source_row_index::varchar) as row_name from segments""",
    "dataset_from_path": """select recording_id, case when starts_with(original_audio_path, '/data/') and len(string_split(substring(original_audio_path, 7), '/')) >= 2
  then string_split(substring(original_audio_path, 7), '/')[1] else coalesce(nullif(string_split(original_audio_path, '/')[-2], ''), 'unknown') end as dataset from recordings""",
    "stable_file_ids": """select recording_id, regexp_replace(replace(original_audio_path, '/', '__'), '[^A-Za-z0-9_.-]+', '_', 'g') || '__' || substring(md5(original_audio_path), 1, 10) as file_id,
  replace(replace(replace(replace(original_audio_path, '/', '__'), ' ', '_'), ':', '_'), chr(92), '__') as safe from recordings""",
    "audio_of_records": """select recording_id, './' || regexp_replace(original_audio_path, '[.]wav$', '') || '_Arabic_transcription.txt' as text_path, original_audio_path as audio_path
from recordings where original_audio_path is not null""",
    "first_text_per_row": f"""select uid, ingested_at, coalesce(nullif({sql.collapsed('metadata_json')}, ''), nullif({sql.collapsed('transcript')}, ''), nullif({sql.collapsed('normalized_transcript')}, '')) as text,
  case when {sql.collapsed('metadata_json')} != '' then 'metadata_json' when {sql.collapsed('transcript')} != '' then 'transcript'
    when {sql.collapsed('normalized_transcript')} != '' then 'normalized_transcript' end as text_field,
  case when {sql.collapsed('metadata_json')} != '' then metadata_json when {sql.collapsed('transcript')} != '' then transcript
    when {sql.collapsed('normalized_transcript')} != '' then normalized_transcript end as raw from segments""",
    "safe_casts": """select recording_id, count(try_cast(segment_meta->>'$.WMER' as double)) as n_numbers, max(try_cast(segment_meta->>'$.WMER' as double)) as most
from segment_specs group by all""",
    "paths_and_parts": """select recording_id, '/mnt/' || replace(original_audio_path, '/data/', '') as absolute,
  list_contains(list_transform(string_split(original_audio_path, '/'), lambda x: lower(x)), 'qasr') as excluded from recordings""",
    "union_aligned": f"""select kind, {sql.source_name('source')} as source, count(*) as n, count(duration) as n_duration, count(language) as n_language from (
  select 'segment' as kind, source, duration, language from segments union all select 'item', source, null, null from eval_items) group by all""",
    "union_tagged": """select root, split, count(*) as n, count(source_file) as n_with_file from (
  select 'segments' as root, split, source_file from segments union all select 'items', split, null from eval_items) group by all""",
    "merged_without_clash": """select case when source_file like 'qasr%' then 'first' else 'second' end as root, count(*) as n_rows, count(distinct source_file) as n_files
from documents where source_file is not null group by all""",
    "replace_subset_guarded": f"""select {sql.source_name('source')} as source, count(*) as n_rows, sum(case when {sql.source_name('source')} = 'subtitles' then 0 else n_chars end)::bigint as n_chars
from documents group by all""",
    "dedup_keep_first": "select uid, ingested_at, source_file, source_row_index from segments qualify row_number() over (partition by uid order by ingested_at) = 1",
    "grouped_sources": f"""select case when {sql.source_name('source')} in ('casablanca_jordanian', 'casablanca_palestinian', 'omnilingual_apc', 'layla') then 'levant' else 'other' end as "group",
  count(*) as n_recordings from recordings group by all""",
    "single_source_log": f"select status, count(*) as n_rows from row_probabilities where {sql.source_name('source')} = 'qasr' group by all",
    "routed_leaves": """with l as (select case when starts_with(source_file, 'masc_c__bulk') then 'masc_bulk' when starts_with(source_file, 'masc_c') then 'masc_non_lev'
  when starts_with(source_file, 'layla') then 'layla' when starts_with(source_file, 'qasr') then 'qasr' else 'rest' end as leaf from documents)
select leaf, case when leaf = 'masc_non_lev' then 'arb_Arab' else 'apc_Arab' end as language, count(*) as n_rows from l group by all""",
    "corpus_of_path": """select recording_id, string_split(original_audio_path, '/')[3] as first_part,
  array_to_string(list_slice(string_split(original_audio_path, '/'), 4, -2), '_') as corpus from recordings""",
    "numbered_uids": """select distinct source_row_key, 'c_train_' || lpad((row_idx % 7)::varchar, 5, '0') || '_0003_' || lpad(row_idx::varchar, greatest(4, length(row_idx::varchar))::int, '0') as name,
  substring(sha256('["' || source_row_key || '","' || row_idx::varchar || '"]'), 1, 16) as short from row_probabilities""",
    "capped_rows": "select doc_id, source_file from documents qualify row_number() over (partition by source_file order by doc_id) <= 5",
}

"""Queries that write a table through a sink and read it back through a reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.reading import source_name
from corpusflow.operators import cleaning
from corpusflow.plans import cleaning_queries, sql
from corpusflow.plans.tables import table
from corpusflow.sizing import scratch_path
from corpusflow.sources import readers, sinks


def routed_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Segments written to a folder per drop reason, and what each folder holds."""
    path = scratch_path(spark)
    rows = cleaning.flagged(table(spark, folder, "segments"), "transcript", "duration").select("uid", "transcript", "source_row_index", "drop_reason")
    sinks.write_routed(rows, path, rows_per_file=1000)
    return spark.read.parquet(path).groupBy("drop_reason").agg(F.count("*").alias("n_rows"), F.count_distinct("uid").alias("n_uids"), F.sum("source_row_index").alias("row_sum"))


def replaced_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written by source; one source is then replaced by its broadcasts and the others stay."""
    path = scratch_path(spark)
    rows = table(spark, folder, "documents").select("doc_id", "n_chars", "doc_type", F.coalesce(source_name(F.col("source")), F.lit("none")).alias("leaf"))
    sinks.write_leaves(rows, path, ["leaf"], rows_per_file=500)
    sinks.write_leaves(rows.filter("leaf = 'qasr' and doc_type = 'broadcast'"), path, ["leaf"])
    return spark.read.parquet(path).groupBy("leaf").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The log appended in two runs with a broken line between them: good rows by status, malformed lines under their own."""
    path = scratch_path(spark)
    rows = table(spark, folder, "row_probabilities").select("uid", "row_idx", "status", "top_score", "text")
    sinks.append_log(rows.filter("row_idx % 2 = 0"), path)
    spark.range(1).select(F.lit('{"uid": "x", "row_idx').alias("value")).write.mode("append").text(path)
    sinks.append_log(rows.filter("row_idx % 2 != 0 or row_idx is null"), path)
    good, bad = readers.read_jsonl(spark, [path], rows.schema)
    counts = good.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n_rows"), F.count_distinct("uid").alias("n_uids"), F.max("row_idx").alias("last_row"))
    return counts.unionByName(bad.agg(F.lit("malformed").alias("status"), F.count("*").alias("n_rows"), F.lit(0).cast("bigint").alias("n_uids"), F.lit(None).cast("bigint").alias("last_row")))


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """A report written as one tab-separated file in order, read with the place of each line."""
    path = scratch_path(spark)
    report = table(spark, folder, "recordings").groupBy(source_name(F.col("source")).alias("source")).agg(F.count("*").alias("n"), F.sum("n_speakers").alias("n_speakers"))
    sinks.write_table(report, path, [F.desc("n"), F.col("source")], sep="\t")
    lines = spark.read.option("header", True).option("sep", "\t").schema(report.schema).csv(path)
    return lines.withColumn("place", F.monotonically_increasing_id() + 1)  # one file, so ids count its lines


def arrow_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Segments written as Arrow files and read back under a drifted schema, against the files' own counts."""
    path = scratch_path(spark)
    rows = table(spark, folder, "segments").select("uid", "transcript", "sampling_rate", "duration", "source_file")
    written = sinks.write_arrow(rows, path)
    wanted = rows.drop("source_file").withColumns({"sampling_rate": F.col("sampling_rate").cast("bigint"), "gender": F.lit(None).cast("string")}).schema
    back = readers.read_arrow(spark, [path], wanted)
    counts = back.agg(F.count("*").alias("n_rows"), F.count_distinct("uid").alias("n_uids"), F.count("transcript").alias("n_texts"), F.sum("sampling_rate").alias("rates"), F.count("gender").alias("n_genders"))
    return counts.withColumn("n_written", written.agg(F.sum("n_rows")).scalar())


def rows_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in files of 300 rows: rows by the footers, by the file manifest and by row numbers, and files where they differ."""
    path = scratch_path(spark)
    table(spark, folder, "documents").select("doc_id", "source").write.option("maxRecordsPerFile", 300).parquet(path)
    footers = readers.count_rows(spark, [path])
    numbered = readers.read_parquet(spark, [path], columns=["doc_id"]).groupBy("file_name").agg(F.count_distinct("row_index").alias("n_numbers"), (F.max("row_index") + 1).alias("last"))
    manifest = sinks.file_manifest(spark.read.parquet(path)).select(F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.col("n_rows").alias("n_listed"))
    joined = footers.join(numbered, "file_name", "full").join(manifest, "file_name", "full")
    same = F.coalesce((F.col("n_rows") == F.col("n_numbers")) & (F.col("n_rows") == F.col("last")) & (F.col("n_rows") == F.col("n_listed")), F.lit(False))
    return joined.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_listed").alias("n_listed"), F.max("n_rows").alias("most"), F.count_if(~same).alias("n_different"))


def record_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The held-out items as the list of one JSON document, and its elements in their order."""
    path = scratch_path(spark)
    items = table(spark, folder, "eval_items").select("item_id", "uid", "split")
    whole = items.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("item_id", "uid", "split"))).alias("records"))).alias("value"))  # a fixed number of items
    whole.coalesce(1).write.text(path)
    return readers.read_records(spark, path).select(F.col("position").cast("bigint").alias("position"), "item_id", "uid", "split")


QUERIES = {f.__name__: f for f in (routed_tables, replaced_leaves, log_lines, report_files, arrow_shards, rows_by_file, record_lists)}
SQL = {
    "routed_tables": cleaning_queries._FLAGGED
    + "select coalesce(drop_reason, 'clean') as drop_reason, count(*) as n_rows, count(distinct uid) as n_uids, sum(source_row_index)::bigint as row_sum from routed group by all",
    "replaced_leaves": f"""with d as (select coalesce({sql.source_name('source')}, 'none') as leaf, n_chars, doc_type from documents)
select leaf, count(*) as n_rows, sum(n_chars)::bigint as n_chars from d where leaf != 'qasr' or doc_type = 'broadcast' group by leaf""",
    "log_lines": """select coalesce(status, 'none') as status, count(*) as n_rows, count(distinct uid) as n_uids, max(row_idx) as last_row from row_probabilities group by all
union all select 'malformed', 1, 0, null""",
    "report_files": f"""select {sql.source_name('source')} as source, count(*) as n, sum(n_speakers)::bigint as n_speakers,
  row_number() over (order by count(*) desc, {sql.source_name('source')} nulls first) as place from recordings group by 1""",
    "arrow_shards": """select count(*) as n_rows, count(distinct uid) as n_uids, count(transcript) as n_texts, sum(sampling_rate)::bigint as rates, 0 as n_genders, count(*) as n_written from segments""",
    "rows_by_file": "select count(*) as n_rows, count(*) as n_listed, least(300, count(*)) as most, 0 as n_different from documents",
    "record_lists": "select row_number() over (order by item_id) - 1 as position, item_id, uid, split from eval_items",
}

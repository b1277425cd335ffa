"""Writers: routed tables, logs, reports and manifests."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusflow.sizing import saved


def write_routed(df: DataFrame, path: str, reason: str = "drop_reason", rows_per_file: int = 0) -> None:
    """One pass to ``drop_reason=.../`` directories, kept rows under ``clean``."""
    routed = df.withColumn(reason, F.coalesce(reason, F.lit("clean")))
    routed.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy(reason).parquet(path)


def write_leaves(df: DataFrame, path: str, keys: Sequence[str], rows_per_file: int = 50_000, row_group_mb: int = 128) -> None:
    """Partitioned parquet; existing partitions not in ``df`` stay, those in it are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    writer.option("parquet.block.size", row_group_mb << 20).partitionBy(*keys).parquet(path)


def write_arrow(df: DataFrame, path: str) -> DataFrame:
    """Arrow files, one a task and each whole or not at all; returns ``file_name, n_rows`` of those written.

    ``path`` is a folder that all executors see. A task that runs again writes its file again under the same name.
    """
    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"data-{context.partitionId():05d}.arrow"
        files, folder = pa_fs.FileSystem.from_uri(path) if "://" in path else (pa_fs.LocalFileSystem(), path.removeprefix("file:"))
        files.create_dir(folder, recursive=True)
        part, n = f"{folder}/{name}.{context.taskAttemptId()}.part", 0
        with files.open_output_stream(part) as out, pa.ipc.new_file(out, schema) as writer:
            for batch in batches:
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema))
                n += batch.num_rows
        files.move(part, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file_name", "n_rows"])

    return saved(df.mapInArrow(run, "file_name string, n_rows bigint"))


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a JSON log; each call's files appear at once or not at all."""
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, order: Sequence[Column], sep: str = ",") -> None:
    """A small report as one delimited file with a header, in order."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def markdown(df: DataFrame, title: str) -> Iterator[str]:
    """The lines of a report as a Markdown table, one by one and all of them; the driver holds one partition at a time."""
    yield from (f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns))
    for row in df.toLocalIterator():
        yield "| " + " | ".join("" if v is None else str(v) for v in row) + " |"


def snapshot(spark: SparkSession, path: str, copy: str) -> bool:
    """A table's files copied to ``copy`` before the table is replaced; False where the copy is there already and stays as it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, copy))
    files = target.getFileSystem(conf)
    if files.exists(target):
        return False
    part = jvm.org.apache.hadoop.fs.Path(f"{copy}.part")
    files.delete(part, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, files, part, False, True, conf)
    return files.rename(part, target)


def file_manifest(df: DataFrame) -> DataFrame:
    """Files of a table with their rows."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count("*").alias("n_rows"))


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def content_key(value: Any, length: int = 16) -> str:
    """The short hash under which the result of these settings is kept."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:length]


def write_json(path: str, value: Mapping[str, Any]) -> None:
    """A small JSON file, whole or not at all."""
    part = Path(f"{path}.part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    os.replace(part, path)


def cached(df: DataFrame, folder: str, settings: Any) -> tuple[DataFrame, bool]:
    """``df`` kept under the hash of its settings, and whether it was there already."""
    path = f"{folder}/{content_key(settings)}"
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    if not there:
        df.write.mode("overwrite").parquet(path)
        noted = spark.createDataFrame([(canonical_json(settings), df.schema.json())], "settings string, fields string")
        noted.coalesce(1).write.mode("overwrite").json(f"{path}.metadata")
    return spark.read.schema(df.schema).parquet(path), there


def clear_cached(spark: SparkSession, folder: str, settings: Any) -> bool:
    """What ``cached`` keeps under these settings, removed; whether there was any."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{folder}/{content_key(settings)}{end}") for end in ("", ".metadata")]
    return [p.getFileSystem(conf).delete(p, True) for p in paths][0]

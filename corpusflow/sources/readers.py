"""Readers for what Spark has no format for, and for drifting or broken inputs."""

from __future__ import annotations

import io
import json
import wave
import zipfile
from collections.abc import Callable, Iterator, Sequence
from glob import glob as glob_files
from pathlib import Path
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusflow.functions.reading import outer_trimmed
from corpusflow.functions.text import joined_tokens

SUFFIXES = (".parquet", ".arrow", ".jsonl")


def discover(roots: Sequence[str], suffixes: Sequence[str] = SUFFIXES, most: int | None = None) -> tuple[list[str], list[str]]:
    """Files under the roots, sorted and without repeats, and the roots that don't exist. ``most`` is a dry-run cap."""
    found: dict[str, None] = {}
    missing = []
    for root in map(Path, roots):
        if root.is_file() and root.suffix.lower() in suffixes:
            found[str(root)] = None
        elif root.is_dir():
            found.update(dict.fromkeys(str(p) for s in suffixes for p in root.rglob(f"*{s}")))
        else:
            missing.append(str(root))
    return sorted(found)[:most], missing


def discover_globs(globs: Sequence[str], suffixes: Sequence[str] = SUFFIXES, most: int | None = None) -> list[str]:
    """Files that patterns name, in the order of the patterns, sorted within one, each once. ``most`` is a dry-run cap.

    Of one pattern parquet files come before Arrow files and those before JSON lines.
    """
    found: dict[str, None] = {}
    for pattern in globs:
        files = [f for f in glob_files(pattern, recursive=True) if f.lower().endswith(tuple(suffixes))]
        rank = {f: next(i for i, s in enumerate(suffixes) if f.lower().endswith(s)) for f in files}
        found.update(dict.fromkeys(sorted(files, key=lambda f: (rank[f], f))))
    return list(found)[:most]


def count_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file_name, n_rows`` of parquet files; only their footers are read."""
    files = spark.read.option("recursiveFileLookup", True).parquet(*paths)
    return files.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count("*").alias("n_rows"))


def read_parquet(spark: SparkSession, paths: Sequence[str], glob: str = "*.parquet", columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet shards with ``file_name`` and ``row_index``, the only row identity that survives a shuffle; schemas are merged."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("mergeSchema", True).parquet(*paths)
    return df.select(*(columns or df.columns), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def _ipc_batches(data: bytes) -> Iterator[pa.RecordBatch]:
    """Batches of an Arrow file, or of an Arrow stream where it is none."""
    try:
        reader = pa.ipc.open_file(io.BytesIO(data))
        yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
    except pa.ArrowInvalid:
        yield from pa.ipc.open_stream(io.BytesIO(data))


def read_arrow(spark: SparkSession, paths: Sequence[str], schema: StructType, glob: str = "*.arrow") -> DataFrame:
    """Arrow IPC shards, file or stream format, aligned to ``schema``; a file is read by one task."""
    wanted = to_arrow_schema(schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(list(paths)).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for part in _ipc_batches(data):
                    have = set(part.schema.names)
                    columns = [part.column(f.name).cast(f.type) if f.name in have else pa.nulls(part.num_rows, f.type) for f in wanted]
                    yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    return files.mapInArrow(run, schema)


def read_saved_dataset(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A saved dataset folder: the Arrow files that its ``state.json`` lists, or all of them where it has none."""
    state = Path(folder) / "state.json"
    if not state.exists():
        return read_arrow(spark, [folder], schema)
    names = [f["filename"] for f in json.loads(state.read_text(encoding="utf-8"))["_data_files"]]
    return read_arrow(spark, [f"{folder}/{n}" for n in names], schema) if names else spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, paths: Sequence[str], schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Good lines, and malformed ones as ``file_name, line``; blank lines are neither."""
    corrupt = "_corrupt_record"
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_name").alias("file_name")).filter(F.trim("value") != "")
    parsed = lines.select("file_name", "value", F.from_json("value", StructType([*schema.fields]).add(corrupt, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r"))
    good = parsed.filter(f"r is not null and r.{corrupt} is null").select("r.*").drop(corrupt)
    bad = parsed.filter(f"r is null or r.{corrupt} is not null").select("file_name", F.coalesce(f"r.{corrupt}", "value").alias("line"))
    return good, bad


def read_records(spark: SparkSession, path: str, field: str = "records") -> DataFrame:
    """Elements of a JSON document's list, with their ``position``."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.posexplode(field).alias("position", "r")).select("position", "r.*")


def read_annotations(spark: SparkSession, paths: Sequence[str], root: str, preferred: str = "transcript_align") -> tuple[DataFrame, DataFrame]:
    """Segments of annotation documents, and the documents themselves.

    Of several segment lists the preferred one is read, else the first. Segments have
    ``recording_id, annotation_id, position, segment_id, who, start_time, end_time, tokens,
    transcript, AWD, PMER, WMER, speaker_name, speaker_normalized_name, speaker_gender``;
    one without an id is named by its file and position, and a speaker that the document
    doesn't describe has nulls. Documents have ``file_name, recording_id, annotation_id,
    recording`` (its attributes) and ``fault``: why a document has no segments, or null.
    """
    segment = "struct<_id:string,_who:string,_starttime:string,_endtime:string,_AWD:string,_PMER:string,_WMER:string,element:array<string>>"
    body = f"struct<segments:array<struct<_annotation_id:string,segment:array<{segment}>>>>"
    speaker = "struct<_id:string,_name:string,_normalizedName:string,_speakerGender:string>"
    head = f"struct<recording:struct<_filename:string,_service_name:string,_date:string,_duration:string>,speakers:struct<speaker:array<{speaker}>>>"
    read = spark.read.format("xml").option("rowTag", root).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    docs = read.schema(f"head {head}, body {body}, _corrupt string").load(list(paths)).select("*", F.col("_metadata.file_name").alias("file_name"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    lists = F.col("body.segments")
    chosen = F.coalesce(F.get(F.filter(lists, lambda s: s["_annotation_id"] == preferred), F.lit(0)), F.get(lists, F.lit(0)))
    fault = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.col("head.recording").isNull(), "no recording").when(chosen.isNull(), "no segments")
    name = F.coalesce(F.nullif("head.recording._filename", F.lit("")), stem)
    docs = docs.select("file_name", stem.alias("stem"), name.alias("recording_id"), "head", chosen.alias("s"), fault.alias("fault"))
    rows = docs.filter("fault is null").select("stem", "recording_id", F.col("s._annotation_id").alias("annotation_id"), F.col("head.speakers.speaker").alias("speakers"), F.posexplode("s.segment").alias("position", "e"))
    number = lambda c: F.col(c).try_cast("double")
    filled = F.filter(F.transform(F.col("e.element"), outer_trimmed), lambda x: x != "")
    # A document's speakers are few; of a repeated id the last counts.
    own = F.element_at(F.filter("speakers", lambda x: F.coalesce(x["_id"], F.lit("")) == F.coalesce(F.col("e._who"), F.lit(""))), -1)
    rows = rows.withColumn("own", F.when(F.size(F.filter("speakers", lambda x: F.coalesce(x["_id"], F.lit("")) == F.coalesce(F.col("e._who"), F.lit("")))) > 0, own))
    segments = rows.select(
        "recording_id", "annotation_id", "position", F.coalesce(F.nullif("e._id", F.lit("")), F.format_string("%s_segment_%06d", "stem", "position")).alias("segment_id"), F.col("e._who").alias("who"),
        number("e._starttime").alias("start_time"), number("e._endtime").alias("end_time"), F.coalesce(filled, F.array().cast("array<string>")).alias("tokens"), joined_tokens(filled).alias("transcript"),
        F.col("e._AWD").alias("AWD"), F.col("e._PMER").alias("PMER"), F.col("e._WMER").alias("WMER"),
        F.col("own._name").alias("speaker_name"), F.col("own._normalizedName").alias("speaker_normalized_name"), F.col("own._speakerGender").alias("speaker_gender"),
    )
    return segments, docs.select("file_name", "recording_id", F.col("s._annotation_id").alias("annotation_id"), F.col("head.recording").alias("recording"), "fault")


def _per_file(spark: SparkSession, paths: Sequence[str], glob: str, ddl: str, read: Callable[[bytes], tuple]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(list(paths)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([dict(zip(names, (path, *read(data)), strict=True))], schema=arrow)

    arrow = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    names = arrow.names
    return files.mapInArrow(run, ddl)


def _wav_header(source: IO[bytes]) -> tuple:
    with wave.open(source) as w:
        return w.getframerate(), w.getnframes(), w.getnchannels(), w.getnframes() / w.getframerate()


def wav_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, rate, frames, channels, seconds`` of WAV files; of a file only the chunks before the samples are read."""
    ddl = "path string, rate int, frames bigint, channels int, seconds double"
    # The listing gives the paths alone, so Spark reads no content; a task opens each file itself.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(list(paths)).select("path")
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                places, name = pa_fs.FileSystem.from_uri(path) if "://" in path else (pa_fs.LocalFileSystem(), path.removeprefix("file:"))
                with places.open_input_file(name) as source:
                    rows.append(dict(zip(schema.names, (path, *_wav_header(source)), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, ddl)


def wav_slice(data: bytes, first: int, after: int) -> bytes:
    """Frames ``first`` up to ``after`` of a WAV file."""
    with wave.open(io.BytesIO(data)) as w:
        w.setpos(max(0, min(first, w.getnframes())))
        return w.readframes(max(0, after - first))


def _docx_text(data: bytes) -> tuple:
    # Fixed value: the namespace of word-processing documents.
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{name}t")) for p in tree.iter(f"{name}p"))
    return ("\n".join(line for line in lines if line.strip()),)


def docx_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, text`` of word-processing documents, a line per filled paragraph."""
    return _per_file(spark, paths, "*.docx", "path string, text string", _docx_text)


def file_hashes(spark: SparkSession, paths: Sequence[str], glob: str = "*") -> DataFrame:
    """``path, sha256, n_bytes`` of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(list(paths))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))

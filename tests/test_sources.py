"""Readers, writers, the model hook and incremental runs on small files."""

import io
import wave
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow import sizing
from corpusflow.operators import audit, scoring
from corpusflow.sources import readers, sinks
from corpusflow.streaming.resume import run_new_files, windowed_counts


def test_discover(tmp_path):
    for name in ("b.parquet", "a.arrow", "x.txt"):
        (tmp_path / name).write_bytes(b"")
    found, missing = readers.discover([str(tmp_path), str(tmp_path / "a.arrow"), "/nowhere"])
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.arrow", "b.parquet"] and missing == ["/nowhere"]


def test_arrow_files_and_streams(spark, tmp_path):
    table = pa.table({"uid": ["a", "b"], "n": pa.array([1, None], pa.int64())})
    with pa.ipc.new_file(tmp_path / "f.arrow", table.schema) as w:
        w.write_table(table)
    with pa.ipc.new_stream(tmp_path / "s.arrow", table.schema) as w:
        w.write_table(table.select(["uid"]).append_column("extra", pa.array([1, 2])) if False else table)
    schema = spark.createDataFrame([], "uid string, n bigint, missing double").schema
    assert sorted(map(tuple, readers.read_arrow(spark, [str(tmp_path)], schema).collect()), key=str) == sorted([("a", 1, None), ("b", None, None)] * 2, key=str)


def test_jsonl_counts_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"uid": "a", "n": 1}\n\n{bad\n{"uid": "b"}\n')
    schema = spark.createDataFrame([], "uid string, n bigint").schema
    good, bad = readers.read_jsonl(spark, [str(tmp_path / "log.jsonl")], schema)
    assert sorted(map(tuple, good.collect())) == [("a", 1), ("b", None)]
    assert [(r["file_name"], r["line"]) for r in bad.collect()] == [("log.jsonl", "{bad")]


def test_annotations(spark, tmp_path):
    (tmp_path / "r1.xml").write_text(
        "<transcript><head><recording filename='rec_1' service_name='MSA'/><speakers><speaker id='p1' name='N' normalizedName='n' speakerGender='male'/></speakers></head>"
        "<body><segments annotation_id='other'><segment id='x' who='s'/></segments>"
        "<segments annotation_id='transcript_align'><segment id='s1' who='p1' starttime='1.5' endtime='2' AWD='0.4' PMER='1' WMER='2'><element>a</element><element> </element><element>.</element></segment>"
        "<segment who='p2' starttime='' endtime='x'><element>c</element></segment></segments></body></transcript>"
    )
    (tmp_path / "r2.xml").write_text("<transcript><head/><body/></transcript>")
    segments, documents = readers.read_annotations(spark, [str(tmp_path)], "transcript")
    rows = [tuple(r) for r in segments.orderBy("position").collect()]
    assert rows == [
        ("rec_1", "transcript_align", 0, "s1", "p1", 1.5, 2.0, ["a", "."], "a.", "0.4", "1", "2", "N", "n", "male"),
        ("rec_1", "transcript_align", 1, "r1_segment_000001", "p2", None, None, ["c"], "c", None, None, None, None, None, None),
    ]
    found = {r["file_name"]: (r["recording_id"], r["fault"]) for r in documents.collect()}
    assert found == {"r1.xml": ("rec_1", None), "r2.xml": ("r2", "no recording")}
    assert documents.filter("file_name = 'r1.xml'").select("recording._service_name").first()[0] == "MSA"


def test_globs_counts_and_saved_datasets(spark, tmp_path):
    for name in ("b/2.jsonl", "b/1.arrow", "b/3.parquet", "a/1.parquet", "a/x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    found = readers.discover_globs([f"{tmp_path}/b/*", f"{tmp_path}/**/*.parquet"])
    assert [f.removeprefix(f"{tmp_path}/") for f in found] == ["b/3.parquet", "b/1.arrow", "b/2.jsonl", "a/1.parquet"]
    assert len(readers.discover_globs([f"{tmp_path}/b/*"], most=2)) == 2
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert [r["n_rows"] for r in readers.count_rows(spark, [str(tmp_path / "t")]).collect()] == [7]
    folder = tmp_path / "saved"
    folder.mkdir()
    for name in ("data-0.arrow", "cache-1.arrow"):
        with pa.ipc.new_stream(folder / name, pa.schema([("n", pa.int64())])) as w:
            w.write_table(pa.table({"n": [1, 2]}))
    schema = spark.createDataFrame([], "n bigint").schema
    assert readers.read_saved_dataset(spark, str(folder), schema).count() == 4
    (folder / "state.json").write_text('{"_data_files": [{"filename": "data-0.arrow"}]}')
    assert readers.read_saved_dataset(spark, str(folder), schema).count() == 2


def test_snapshots_and_cleared_results(spark, tmp_path):
    table, copy = str(tmp_path / "t"), str(tmp_path / "t.bak")
    spark.range(3).write.parquet(table)
    assert sinks.snapshot(spark, table, copy) and not sinks.snapshot(spark, table, copy)
    assert spark.read.parquet(copy).count() == 3
    assert not sinks.cached(spark.range(2), str(tmp_path), {"a": 1})[1] and sinks.cached(spark.range(2), str(tmp_path), {"a": 1})[1]
    assert sinks.clear_cached(spark, str(tmp_path), {"a": 1}) and not sinks.clear_cached(spark, str(tmp_path), {"a": 1})
    assert not sinks.cached(spark.range(2), str(tmp_path), {"a": 1})[1]


def test_wav_and_docx(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(bytes(range(200)) * 80)
    assert tuple(readers.wav_headers(spark, [str(tmp_path)]).first())[1:] == (8000, 8000, 1, 1.0)
    assert len(readers.wav_slice((tmp_path / "a.wav").read_bytes(), 10, 20)) == 20
    body = "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:p><w:t>a</w:t><w:t>b</w:t></w:p><w:p/><w:p><w:t>c</w:t></w:p></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    assert readers.docx_texts(spark, [str(tmp_path)]).first()["text"] == "ab\nc"
    assert readers.file_hashes(spark, [str(tmp_path)], "*.wav").first()["n_bytes"] == 16044


def test_records(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"records": [{"original": "a"}, {"original": "b", "normalized": "c"}]}')
    rows = readers.read_records(spark, str(tmp_path / "d.json")).orderBy("position").collect()
    assert [(r["position"], r["original"], r["normalized"]) for r in rows] == [(0, "a", None), (1, "b", "c")]


def test_routed_and_leaf_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "x")], "id int, drop_reason string")
    sinks.write_routed(df, str(tmp_path / "routed"))
    assert {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "routed")).groupBy("drop_reason").count().collect()} == {"clean": 1, "x": 2}
    leaves = str(tmp_path / "leaves")
    sinks.write_leaves(spark.createDataFrame([("train", "a", 1), ("val", "a", 2)], "split string, leaf string, id int"), leaves, ["split", "leaf"])
    sinks.write_leaves(spark.createDataFrame([("train", "a", 9)], "split string, leaf string, id int"), leaves, ["split", "leaf"])
    assert {(r["split"], r["id"]) for r in spark.read.parquet(leaves).collect()} == {("train", 9), ("val", 2)}
    assert sinks.file_manifest(spark.read.parquet(leaves)).agg(F.sum("n_rows")).first()[0] == 2
    sinks.write_table(df, str(tmp_path / "t"), [F.col("id")], "\t")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == 3
    assert list(sinks.markdown(df.orderBy("id"), "T"))[2:5] == ["| id | drop_reason |", "|---|---|", "| 1 |  |"]


def test_cached_by_content(spark, tmp_path):
    df = spark.range(3).toDF("id")
    assert sinks.cached(df, str(tmp_path), {"b": 1, "a": [2]})[1] is False
    again, there = sinks.cached(df, str(tmp_path), {"a": [2], "b": 1})
    assert there and again.count() == 3
    assert sinks.canonical_json({"b": 1, "a": None}) == '{"a":null,"b":1}'


class Picky:
    labels = ("x", "y")

    def predict(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("bad text")
        return [[0.25, 0.75] for _ in texts]


def test_model_failures_are_single_rows(spark):
    df = spark.createDataFrame([(i, "bad" if i == 7 else None if i == 3 else "ok") for i in range(20)], "i int, t string")
    rows = {r["i"]: r for r in scoring.scored(df, "t", Picky, batch=8).collect()}
    assert rows[7]["status"] == "error" and "bad text" in rows[7]["error"]
    assert rows[3]["status"] == "skipped_empty"
    assert all(rows[i]["label_scores"] == {"x": 0.25, "y": 0.75} for i in range(20) if i not in (3, 7))


def test_new_files_are_read_once(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    df.write.parquet(source)
    run = lambda: run_new_files(spark, source, df.schema, lambda x: x.withColumn("n", F.length("t")), sink, checkpoint)
    run()
    df.withColumn("id", F.lit(2)).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 2]


def test_windows_on_a_stream(spark, tmp_path):
    df = spark.sql("select timestamp'2025-01-01 00:10:00' as ts, 'a' as k, 1.0D as v union all select timestamp'2025-01-01 02:10:00', 'a', 2.0D")
    df.write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "ts", "k", "v")
    query = stream.writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, windowed_counts(df, "ts", "k", "v").collect()))


def test_guards_raise(spark):
    a = spark.createDataFrame([(1, "f1"), (2, "f2")], "id int, file string")
    with pytest.raises(Exception, match="two roots"):
        audit.merged_roots({"a": a, "b": a}, "file").collect()
    with pytest.raises(Exception, match="number of rows"):
        audit.replaced_subset(a, F.col("id") == 1, a, expected=5).collect()
    assert audit.replaced_subset(a, F.col("id") == 1, a.filter("id = 1"), expected=1).count() == 2


def test_wave_bytes():
    data = io.BytesIO()
    assert data.getvalue() == b""


def test_a_report_keeps_every_row(spark):
    lines = list(sinks.markdown(spark.range(1001), "T"))
    assert len(lines) == 4 + 1001 and lines[-1] == "| 1000 |"


def test_no_folder_of_its_own_on_a_cluster(spark):
    from types import SimpleNamespace

    unset = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            sizing.shared_folder(unset(master))
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs:///shared/"}, sparkContext=None)
    assert sizing.shared_folder(named) == "hdfs:///shared"
    assert sizing.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_saved_tables_know_their_figures_and_go(spark):
    table, figures = sizing.saved_with(spark.range(7), n=F.count("*"), most=F.max("id"))
    assert figures == {"n": 7, "most": 6} and table.count() == 7
    before = len(sizing._written)
    sizing.release(table)
    assert len(sizing._written) == before - 1

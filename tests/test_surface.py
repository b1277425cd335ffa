"""Settings, the command line, and small helpers without a table of their own."""

import dataclasses
import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.__main__ import main
from corpusflow.config import load_settings
from corpusflow.operators import audio, columns, evaluate, prepare, scoring, stats, timing


@dataclasses.dataclass(frozen=True)
class Settings:
    name: str
    epochs: int = 2


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"name": "a"}))
    assert load_settings(str(path), Settings) == Settings("a", 2)
    for bad in ({"epochs": 1}, {"name": "a", "x": 1}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            load_settings(str(path), Settings)


def test_command_line(capsys):
    main(["list"])
    assert "clean_report_by_dataset: " in capsys.readouterr().out


def test_pcm_and_families():
    assert audio.mono_pcm(np.array([[1.0, 1.0], [-2.0, -2.0], [0.0, 0.5]])) == np.array([32767, -32767, 8192], "<i2").tobytes()
    first = np.array([[1.0, -2.0, 0.0], [1.0, -2.0, 0.5]])
    assert audio.mono_pcm(first) == audio.mono_pcm(np.array([[1.0, 1.0], [-2.0, -2.0], [0.0, 0.5]]))
    assert audio.mono_pcm(np.array([16384, -32768], np.int16)) == np.array([16384, -32767], "<i2").tobytes() and audio.mono_pcm(np.array([])) == b""
    assert audio.mono_pcm(np.zeros((2, 3, 4))) == bytes(8)
    assert stats.progress(50, 200, 10.0) == {"percent": 25.0, "rows_per_second": 5.0, "seconds_left": 30.0}
    assert stats.progress(0, 0, 0.0) == {"percent": 0.0, "rows_per_second": 0.0, "seconds_left": 0.0}


def test_columns_by_schema_and_by_row(spark):
    df = spark.createDataFrame([(" ", "b  c", 1), (None, None, 2), ("a", "b", 3)], "raw_text string, sentence string, id int")
    assert columns.first_present(df, ["text", "sentence", "raw_text"]) == "sentence"
    assert columns.first_present(df, ["text"]) is None
    text, name = columns.first_text(df, ["missing", "raw_text", "sentence"])
    assert [tuple(r) for r in df.select(text, name).collect()] == [("b c", "sentence"), (None, None), ("a", "raw_text")]
    aligned = columns.aligned(df, spark.createDataFrame([], "id bigint, extra double, sentence string").schema)
    assert aligned.dtypes == [("id", "bigint"), ("extra", "double"), ("sentence", "string")]
    numbers = spark.createDataFrame([("1.5",), ("x",), ("nan",), (None,)], "n string")
    assert [r[0] for r in numbers.select(columns.safe_double(F.col("n"))).collect()] == [1.5, None, None, None]


def test_numbers_longer_than_their_width_stay_whole(spark):
    rows = [(7, 12, 345), (123456, 10000, 15006), (123457, 10001, 15007), (None, 1, 2)]
    numbers = [F.col(c) for c in ("part", "group", "row")]
    names = spark.createDataFrame(rows, "part bigint, group bigint, row bigint").select(columns.numbered_uid(F.lit("c"), F.lit("val"), *numbers))
    assert [r[0] for r in names.collect()] == ["c_val_00007_0012_0345", "c_val_123456_10000_15006", "c_val_123457_10001_15007", "c_val_0001_0002"]


def test_places_of_audio(spark):
    def place(ddl, *row):
        df = spark.createDataFrame([row], ddl)
        return df.select(audio.located(df)).first()[0]

    parts = "audio struct<array:array<double>,bytes:binary,path:string>, wav string"
    assert place(parts, ([0.5], b"x", "p"), "w") == "audio.array" and place(parts, (None, b"x", "p"), "w") == "audio.bytes"
    assert place(parts, (None, None, "p"), "w") == "audio.path" and place(parts, (None, None, ""), "w") == "wav" and place(parts, None, " ") is None
    assert place("audio binary, audio_bytes binary, file string", None, b"", "f") == "audio_bytes"
    assert place("audio string, bytes string, wav_path string, original_audio_path string", "a", "b", " ", "o") == "original_audio_path"
    df = spark.createDataFrame([(b"RIFFxx",), (b"ID3",), (b"OggS",), (b"fLaC1",), (b"RIF",), (None,)], "a binary")
    assert [tuple(r) for r in df.select(audio.encoding_of(F.col("a")), audio.pcm_seconds(F.col("a"), F.lit(1))).collect()] == [("wav", 3.0), ("mp3", 1.5), ("ogg", 2.0), ("flac", 2.5), ("pcm", 1.5), (None, 0.0)]


def test_audio_by_name(spark):
    files = spark.createDataFrame([("a/x.wav",), ("a/x.WAV",), ("b/y.wav",), ("z.WAV",)], "path string")
    records = spark.createDataFrame([("./a/x_Arabic_transcription.txt",), ("./b/y.v2_Arabic_transcription.txt",), ("z",)], "source string")
    found = columns.with_audio(records, "source", files, "path")
    assert {r["source"]: r["audio_path"] for r in found.collect()} == {"./a/x_Arabic_transcription.txt": "a/x.WAV", "./b/y.v2_Arabic_transcription.txt": "b/y.wav", "z": "z.WAV"}
    for name in ("./q_Arabic_transcription.txt", None):
        with pytest.raises(Exception, match="no audio file"):
            columns.with_audio(spark.createDataFrame([(name,)], "source string"), "source", files, "path").collect()


def test_names_and_models(spark):
    df = spark.createDataFrame([("a/b\\c: d",)], "n string")
    assert df.select(columns.safe_name(F.col("n"))).first()[0] == "a__b__c__d"
    known = spark.createDataFrame([(m, f) for f, names in prepare.MODELS.items() for m in names], "m string, f string")
    assert known.filter(prepare.family_of(F.col("m")) == F.col("f")).count() == 6
    for name in ("whisper", None):
        with pytest.raises(Exception, match="unknown model"):
            spark.createDataFrame([(name,)], "m string").select(prepare.family_of(F.col("m"))).collect()


def test_contracts(spark):
    ddl = "uid string, reference string, prediction string, model_name string, model_family string, tuned_or_base string, run_name string, config_hash string"
    good = [("u1", "r", "p", "m", "f", "base", "n", "h"), ("u2", "", "", "m", "f", "base", "n", "h")]
    faults = lambda rows, ddl=ddl: evaluate.contract_faults(spark.createDataFrame(rows, ddl)).first().asDict()
    none = {"n_rows": 2, "is_empty": False, "n_missing": 0, "missing_columns": "", "n_bad_state": 0, "varying_columns": "", "empty_columns": ""}
    assert faults(good) == none
    assert faults([]) == none | {"n_rows": 0, "is_empty": True}
    tuned = [(*r[:5], "tuned", *r[6:]) for r in good]
    assert faults(tuned) == none | {"n_missing": 2, "missing_columns": "training_config_hash,tuned_adapter_path"}
    assert faults([(*r, "a", "t") for r in tuned], ddl + ", tuned_adapter_path string, training_config_hash string") == none
    odd = [("u1", None, "p", "m", "f", "Base", "", "h"), ("u2", "r", "p", "m2", "f", "base", "", "h")]
    assert faults(odd) == none | {"n_missing": 1, "missing_columns": "reference", "n_bad_state": 1, "varying_columns": "model_name,tuned_or_base", "empty_columns": "run_name"}

    files = spark.createDataFrame([("/d/a.wav",), ("/base/b.wav",)], "path string")
    ddl = "uid string, audio_path string, text string, duration double, sample_rate int"
    rows = [("u1", "/d/a.wav", "t", 1.0, 16000), ("u2", "b.wav", "t", 0.0, 0), ("u3", "c.wav", None, None, 1), ("u4", None, "t", float("nan"), None)]
    found = prepare.manifest_faults(spark.createDataFrame(rows, ddl), files, "path", "/base").first().asDict()
    assert found == {"n_rows": 4, "is_empty": False, "missing_columns": "source", "n_lacking": 4, "n_no_file": 1, "n_bad_duration": 2, "n_bad_rate": 1}
    assert prepare.manifest_faults(spark.createDataFrame([], ddl), files, "path").first()["is_empty"]


def test_rows_outside_their_file_and_routes(spark):
    rows = spark.createDataFrame([("a", -1), ("a", 0), ("a", 4), ("a", 5), ("a", 5), ("b", 0), (None, 1), ("a", None)], "f string, i int")
    found = scoring.out_of_range(rows, spark.createDataFrame([("a", 5)], "f string, n int"), "f", "i", "n")
    assert {r["f"]: (r["n_rows"], r["n_outside"]) for r in found.collect()} == {"a": (4, 2), "b": (1, 1), None: (1, 1)}
    df = spark.createDataFrame([("x",), ("y",), (None,)], "s string")
    assert [r[0] for r in df.select(scoring.source_route(F.col("s"), ["x"])).collect()] == [None, "skipped_filtered_source", "skipped_filtered_source"]
    assert df.filter(scoring.source_route(F.col("s"), []).isNull()).count() == 3
    sweep = scoring.threshold_sweep(spark.createDataFrame([(0.5, False), (0.9, False), (None, False), (0.9, True)], "s double, bad boolean"), F.col("s"), [0.6], F.col("bad"))
    assert tuple(sweep.first()) == (0.6, 3, 1, 33.3333, 1)


def test_speakers_and_counters(spark):
    segments = spark.createDataFrame([("r", "s", 1), ("r", "q", 2), ("r", None, 3)], "r string, who string, i int")
    speakers = spark.createDataFrame([("r", "s", "male")], "r string, who string, gender string")
    assert {x["i"]: x["gender"] for x in timing.with_speaker(segments, speakers, ["r", "who"], ["gender"]).collect()} == {1: "male", 2: None, 3: None}
    recordings = spark.createDataFrame([("a", True, False), ("b", True, True), ("c", False, False), ("d", True, False)], "r string, has_annotation boolean, is_malformed boolean")
    parts = spark.createDataFrame([("a", None, 1.5), ("a", "invalid", 9.0), ("a", "too_short", 0.01), ("b", None, 5.0), ("d", "empty_transcript", 2.0)], "r string, fault string, seconds double")
    assert tuple(timing.segmenter_counters(recordings, parts, "r").first()) == (4, 3, 1, 1, 1, 1, 1, 1, 1, 1.5)


def test_decoded_audio():
    pcm = np.array([0, 16384, -32768], "<i2").tobytes()
    samples, rate = audio.decoded(pcm + b"x", 8000)
    assert samples.tolist() == [0.0, 0.5, -1.0] and rate == 8000
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(44100)
            w.writeframes(np.array([[0, 16384], [-32768, -32768]], "<i2").tobytes())
        samples, rate = audio.decoded(out.getvalue())
    assert samples.tolist() == [0.25, -1.0] and rate == 44100
    with pytest.raises(ValueError):
        audio.decoded(b"fLaC....")

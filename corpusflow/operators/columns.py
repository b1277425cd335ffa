"""Finding columns, naming rows and aligning schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from corpusflow.functions.reading import source_name
from corpusflow.functions.text import collapsed
from corpusflow.sizing import lookup

#: Text and duration columns that shards are known to use, in order of preference.
TEXT_CANDIDATES = ("transcript", "normalized_transcript", "raw_text", "transcription", "sentence", "text")
DURATION_CANDIDATES = ("duration", "duration_sec", "duration_seconds", "audio_duration", "length")


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column of ``df``: one choice for the whole shard."""
    return next((c for c in candidates if c in df.columns), None)


def first_text(df: DataFrame, candidates: Sequence[str]) -> tuple[Column, Column]:
    """Per row the first candidate that is not blank, collapsed, and the name of its column; null where all are."""
    present = [c for c in candidates if c in df.columns]
    texts = [F.nullif(collapsed(F.col(c).cast("string")), F.lit("")) for c in present]
    names = [F.when(t.isNotNull(), F.lit(c)) for t, c in zip(texts, present, strict=True)]
    none = F.lit(None).cast("string")
    return F.coalesce(*texts, none), F.coalesce(*names, none)


def first_raw(df: DataFrame, candidates: Sequence[str]) -> Column:
    """Per row the first candidate that is not blank, as it is stored."""
    present = [F.when(collapsed(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in candidates if c in df.columns]
    return F.coalesce(*present, F.lit(None).cast("string"))


def safe_double(col: Column) -> Column:
    """A number, or null where the value is none; NaN counts as missing."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def row_uid(df: DataFrame, file: Column, row_index: Column, keys: Sequence[str] = ("uid", "id", "segment_id", "utt_id", "video_id", "audio_id")) -> Column:
    """``file:key=value`` for the first key with a value, else ``file:row=N``. Not unique: join on file and row index."""
    named = [F.concat(file, F.lit(f":{k}="), F.col(k).cast("string")) for k in keys if k in df.columns]
    return F.coalesce(*named, F.concat(file, F.lit(":row="), row_index.cast("string")))


def canonical_source(col: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """The source's name, aliases resolved; blank gives null."""
    name = F.nullif(source_name(col), F.lit(""))
    out = F.when(F.lit(False), F.lit(""))
    for canonical, spellings in aliases.items():
        out = out.when(name.isin(canonical, *spellings), F.lit(canonical))
    return out.otherwise(name)


def source_of_row(df: DataFrame, aliases: Mapping[str, Sequence[str]], fields: Sequence[str] = ("source", "source_name", "dataset_source", "dataset"), file: str = "source_file") -> Column:
    """The first source field with a name, else the source whose name the file's name holds."""
    named = [canonical_source(F.col(c), aliases) for c in fields if c in df.columns]
    if file in df.columns:
        low = F.lower(F.col(file))
        inferred = F.when(F.lit(False), F.lit(""))
        for canonical in aliases:
            inferred = inferred.when(low.contains(canonical), F.lit(canonical))
        named.append(inferred)
    return F.coalesce(*named, F.lit(None).cast("string"))


def dataset_of_path(path: Column, root: str) -> Column:
    """First directory below the root, else the file's own directory, else ``unknown``."""
    inside = F.when(path.startswith(root + "/"), F.substring(path, F.lit(len(root) + 2), F.length(path)))
    parts, own = F.split(inside, "/"), F.split(path, "/")
    parent = F.when(F.size(own) >= 2, F.nullif(F.element_at(own, -2), F.lit("")))
    return F.coalesce(F.when(F.size(parts) >= 2, parts[0]), parent, F.lit("unknown"))


def stable_file_id(path: Column) -> Column:
    """A readable slug of the path and ten hexadecimal digits of its hash."""
    slug = F.regexp_replace(F.replace(path, F.lit("/"), F.lit("__")), r"[^A-Za-z0-9_.-]+", "_")
    return F.concat(slug, F.lit("__"), F.substring(F.md5(path), 1, 10))


def safe_name(col: Column) -> Column:
    """A name that is safe in a file system: two underscores for a slash of either kind, one for a blank or colon."""
    return F.replace(F.replace(F.translate(col, ": ", "__"), F.lit("/"), F.lit("__")), F.lit("\\"), F.lit("__"))


def absolute_path(path: Column, base: str) -> Column:
    """The path itself where it is absolute, else below ``base``."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))


def preview(text: Column, length: int = 220) -> Column:
    """The first characters of a text, for display only."""
    return F.substring(text, 1, length)


def audio_candidates(text_path: Column, suffix: str = "_Arabic_transcription.txt", extensions: Sequence[str] = (".WAV", ".wav")) -> Column:
    """Where the audio of a transcript may lie, best first: its path without ``./`` and ``suffix``, and with each extension for its own."""
    bare = F.regexp_replace(F.replace(F.replace(text_path, F.lit("./"), F.lit("")), F.lit(suffix), F.lit("")), r"(?<=[^/])\.[^./]+$", "")
    return F.array(*(F.concat(bare, F.lit(x)) for x in extensions))


def with_audio(records: DataFrame, text_path: str, files: DataFrame, path: str) -> DataFrame:
    """``records`` with ``audio_path``, the first candidate among ``files``; a record without one raises an error when the plan runs.

    Null paths have no audio and raise as well. ``files`` are joined by broadcast only where they are few.
    """
    named = files.select(F.col(path).alias("_path")).distinct()
    offers = records.select(text_path).distinct().select(text_path, F.posexplode(audio_candidates(F.col(text_path))).alias("_place", "_path"))
    found = lookup(offers, named, ["_path"]).groupBy(text_path).agg(F.min_by("_path", "_place").alias("audio_path"))
    none = F.raise_error(F.concat(F.lit("no audio file for "), F.coalesce(F.col(text_path), F.lit("a null path")))).cast("string")
    return lookup(records, found, [text_path], "left").withColumn("audio_path", F.coalesce("audio_path", none))


def holds_part(path: Column, part: str) -> Column:
    """Whether a directory or file of the path has that name, in any case."""
    return F.exists(F.split(path, "/"), lambda x: F.lower(x) == part.lower())


def aligned(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def stacked(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under the union of their columns; missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def path_parts(path: Column, root: str) -> tuple[Column, Column]:
    """Split and corpus of ``root/split/corpus[/part]/file``: the corpus is its directories joined by ``_``."""
    parts = F.split(F.substring(path, F.lit(len(root) + 2), F.length(path)), "/")
    return F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def language_of(corpus: Column, whole: str = "arb_Arab", dialect: str = "apc_Arab") -> Column:
    """The language tag of a corpus: the whole language for the one that is not of the dialect."""
    return F.when(corpus.contains("masc") & corpus.contains("non_lev"), whole).otherwise(dialect)


def leaf_of(file_name: Column, prefixes: Mapping[str, str], default: str | None = None) -> Column:
    """The leaf whose file-name prefix fits, the longest first."""
    out = F.when(F.lit(False), F.lit(""))
    for prefix in sorted(prefixes, key=len, reverse=True):
        out = out.when(file_name.startswith(prefix), F.lit(prefixes[prefix]))
    return out.otherwise(F.lit(default))


def numbered_uid(corpus: Column, split: Column, part: Column, group: Column, row: Column) -> Column:
    """``corpus_split_00001_0002_0003``; longer numbers stay whole."""
    pad = lambda c, n: F.lpad(c.cast("string"), F.greatest(F.lit(n), F.length(c.cast("string"))), F.lit("0"))
    return F.concat_ws("_", corpus, split, pad(part, 5), pad(group, 4), pad(row, 4))


def capped(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each group, the first in ``order``: a dry-run knob."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def short_hash(length: int, *values: Column) -> Column:
    """The first digits of the SHA-256 of the values as canonical JSON."""
    body = F.to_json(F.array(*(v.cast("string") for v in values)), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, length)

"""One form for texts that look the same but are stored as different characters.

Width, joining shape, invisible characters and accent order are brought to one form by
rule. Look-alike letters need more care, so they get a script-aware repair: in a token of
mixed script the letters foreign to its dominant script are replaced, but only when the
result is in the corpus vocabulary. A token of one script is never rewritten, nor are
Persian letters in a text with letters that only such alphabets have. Where the twin of
such a token is in the vocabulary the two still look the same on the page, so a comparison
key beside the text reads it as its twin.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.textforms import has_lookalike, is_persian, plain_form, repaired
from corpusflow.sizing import lookup, saved

_TOKEN = re.compile(r"[\w\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed]+")
#: Distinct words a task holds before it passes them on.
VOCABULARY_FLUSH = 300_000

_PARTS = pa.list_(pa.struct([("token", pa.string()), ("fixed", pa.string()), ("mixed", pa.bool_())]))
_READ = pa.schema([("field", pa.string()), ("uid", pa.string()), ("raw", pa.binary()), ("key", pa.binary()), ("plain", pa.string()), ("parts", _PARTS), ("word", pa.string())])
_READ_DDL = "field string, uid string, raw binary, key binary, plain string, parts array<struct<token:string,fixed:string,mixed:boolean>>, word string"


def _reader(keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two kinds: texts with their form and the tokens in doubt, and words seen in one script."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[str] = set()

        def flushed() -> pa.RecordBatch:
            out = pa.array(list(words), pa.string())
            words.clear()
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(out), f.type) for f in list(_READ)[:-1]), out], schema=_READ)

        for batch in batches:
            raws, keys, plains, all_parts = [], [], [], []
            for text in batch.column(2).to_pylist():
                plain, parts = plain_form(text), None
                tokens = _TOKEN.findall(plain)
                if has_lookalike(plain):
                    persian = is_persian(plain)
                    fixed = {t: f for t in tokens if (f := repaired(t, persian)) is not None}
                    words.update(t for t in tokens if t not in fixed)
                    parts = [{"token": t, "fixed": f, "mixed": mixed} for t, (f, mixed) in fixed.items()] or None
                else:
                    words.update(tokens)
                raws.append(xxhash.xxh3_128_digest(text))
                keys.append(None if parts else xxhash.xxh3_128_digest(plain))
                plains.append(plain if parts or keep_text else None)
                all_parts.append(parts)
            columns = [batch.column(1), batch.column(0), pa.array(raws, pa.binary()), pa.array(keys, pa.binary()), pa.array(plains, pa.string()), pa.array(all_parts, _PARTS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(raws), pa.string())], schema=_READ)
            if len(words) > VOCABULARY_FLUSH:
                yield flushed()
        yield flushed()

    return read


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their known repairs put in, and the key of the text in which single-script twins are read alike as well."""
    for batch in batches:
        fields, raws, plains, fixes = (batch.column(i).to_pylist() for i in range(4))
        texts, keys = [], []
        for plain, parts in zip(plains, fixes, strict=True):
            forms = []
            for wanted in ((True,), (True, False)):
                known = {p["token"]: p["fixed"] for p in parts or () if p["mixed"] in wanted}
                forms.append(_TOKEN.sub(lambda m, known=known: known.get(m[0], m[0]), plain) if known else plain)
            texts.append(forms[0])
            keys.append(xxhash.xxh3_128_digest(forms[1]))
        columns = [pa.array(fields, pa.string()), pa.array(raws, pa.binary()), pa.array(keys, pa.binary()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["field", "raw", "key", "unified"])


def unified_texts(rows: DataFrame, key: str, fields: list[str], keep_text: bool = True) -> DataFrame:
    """``field, uid, raw, key`` and with ``keep_text`` also ``unified``: every non-empty text and the form it is brought to.

    ``raw`` stands for the value as stored, ``key`` for what a reader sees; both are 128-bit
    hashes. Rows without ``key`` and null or empty texts are left out; repeated rows stay
    repeated; very long texts are read whole. Other columns are ignored. An empty table
    gives an empty result. Tables are written on the way, so this runs jobs.
    """
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))
    read = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("uid"), F.inline(pairs)).filter("text != ''")
    read = saved(read.mapInArrow(_reader(keep_text), _READ_DDL))
    vocabulary = read.filter("word is not null").select("word").distinct()
    texts = read.filter("word is null")
    # A text in doubt is repaired once, however often it is stored.
    doubtful = texts.filter("key is null").groupBy("field", "raw").agg(F.first("plain").alias("plain"), F.first("parts").alias("parts"))
    doubtful = saved(doubtful)
    tokens = doubtful.select(F.inline("parts")).distinct()
    known = tokens.join(vocabulary.withColumnRenamed("word", "fixed"), "fixed", "left_semi")
    needed = doubtful.select("field", "raw", F.inline("parts")).select("field", "raw", "token", "mixed")
    fixes = lookup(needed, saved(known), ["token", "mixed"]).groupBy("field", "raw").agg(F.collect_list(F.struct("token", "fixed", "mixed")).alias("fixes"))
    mended = doubtful.join(fixes, ["field", "raw"], "left").select("field", "raw", "plain", "fixes")
    mended = saved(mended.mapInArrow(_apply, "field string, raw binary, key binary, unified string"))
    text = ["unified"] if keep_text else []
    plain = texts.filter("key is not null").select("field", "uid", "raw", "key", *(F.col("plain").alias(c) for c in text))
    fixed = lookup(texts.filter("key is null").select("field", "uid", "raw"), mended, ["field", "raw"])
    return plain.unionByName(fixed.select("field", "uid", "raw", "key", *text))


def same_looking_classes(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``field, uid, key, raw``: the records of every class of texts that look the same but are stored in several ways.

    A record is a distinct uid; of rows that differ the one with the least stored value's hash counts.
    """
    texts = saved(unified_texts(rows, key, fields, keep_text=False))
    several = texts.groupBy("field", "key").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).filter("low != high").select("field", "key")
    members = lookup(texts, saved(several), ["field", "key"], "left_semi")
    return saved(members.groupBy("field", "uid").agg(F.min(F.struct("raw", "key")).alias("m")).select("field", "uid", "m.key", "m.raw"))


def class_links(members: DataFrame) -> DataFrame:
    """``field, uid, class_id, n_forms, n_links``: each member's class, the stored forms in it, and the records it is linked to."""
    forms = members.groupBy("field", "key", "raw").agg(F.count("*").alias("n"))
    sizes = forms.groupBy("field", "key").agg(F.sum("n").alias("total"), F.count("*").alias("n_forms")).filter("n_forms > 1")
    others = forms.join(sizes, ["field", "key"]).select("field", "key", "raw", "n_forms", (F.col("total") - F.col("n")).alias("n_links"))
    return lookup(members, saved(others), ["field", "key", "raw"]).select("field", "uid", F.lower(F.hex("key")).alias("class_id"), "n_forms", "n_links")


def same_looking_pairs(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``field, uid_a, uid_b``: records whose values in a field look the same but differ as stored, smaller uid first.

    Records of one stored value form a class; classes of one look are paired and only then
    expanded, with the members of a hot class spread over tasks, so equal copies never
    meet each other.
    """
    members = same_looking_classes(rows, key, fields)
    classes = members.select("field", "key", "raw").distinct()
    pairs = classes.withColumnRenamed("raw", "raw_a").join(classes.withColumnRenamed("raw", "raw_b"), ["field", "key"]).filter("raw_a < raw_b")
    first = members.select("field", "key", F.col("raw").alias("raw_a"), F.col("uid").alias("x"))
    second = members.select("field", "key", F.col("raw").alias("raw_b"), F.col("uid").alias("y"))
    half = lookup(first, saved(pairs), ["field", "key", "raw_a"])
    joined = lookup(second, half.select("field", "key", "raw_b", "x"), ["field", "key", "raw_b"])
    return joined.select("field", F.least("x", "y").alias("uid_a"), F.greatest("x", "y").alias("uid_b"))

"""Same and near-same records across splits: minwise hashing, banded buckets, exact check.

Shingles are pairs of neighbouring words with their occurrence number, not five-word
shingles: a case is a pair within 15 percent of word edits, and one edit in eight words
leaves no five-word shingle in common. ``k`` edits spare all but ``2 k`` of the pairs of
the longer text, so for ``n`` words the Jaccard similarity of a case is at least
``(n - 1 - 2 k) / (n - 1 + 2 k)``, and the bands are chosen for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.distance import sequence_distance
from corpusflow.functions.reading import source_name, split_name
from corpusflow.llm.textforms import words
from corpusflow.sizing import lookup, saved, saved_with

#: Least words of a compared text, and edits allowed per hundred words of the longer one.
MIN_WORDS, EDIT_PERCENT = 8, 15
#: The most of pairs at the limit that all bands may miss.
MISS = 2e-4
#: Chance that two unrelated texts share a minwise value, the texts that a text may meet by chance, and the fewest values in a band.
BY_CHANCE, MEETINGS, LEAST_ROWS = 0.005, 10, 2
#: Held-out texts in a bucket from which on it is parted by further bands of twice the values.
HOT_BUCKET = 200
_MASK = (1 << 64) - 1


def edits_allowed(n: int, percent: int = EDIT_PERCENT) -> int:
    """Most edits for a pair whose longer text has ``n`` words."""
    return n * percent // 100


def least_similarity(n: int, percent: int = EDIT_PERCENT) -> float:
    """Least Jaccard similarity of the word pairs of two texts at the limit, the longer of ``n`` words."""
    k = edits_allowed(n, percent)
    return (n - 1 - 2 * k) / (n - 1 + 2 * k)


def rows_needed(n_texts: int) -> int:
    """Minwise values in a band, so that chance meetings of a text stay few however many texts there are."""
    rows = LEAST_ROWS
    while n_texts * BY_CHANCE**rows > MEETINGS:
        rows += 1
    return rows


def bands_needed(n: int, rows: int, percent: int = EDIT_PERCENT) -> int:
    """Bands of ``rows`` values a text of ``n`` words needs so that a pair at the limit is missed at most with ``MISS``."""
    most = 1
    for longer in range(n, n * 100 // (100 - percent) + 2):
        alike = least_similarity(longer, percent) ** rows
        most = max(most, 1 if alike >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-alike))))
    return most


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers (public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to word hashes; texts of fewer than ``MIN_WORDS`` words end here."""
    hashes: dict[str, bytes] = {}
    for batch in batches:
        keep, keys, packed, sizes = [], [], [], []
        for i, text in enumerate(batch.column(0).to_pylist()):
            found = words(text)
            if len(found) < MIN_WORDS:
                continue
            parts = []
            for w in found:
                if (h := hashes.get(w)) is None:
                    h = hashes[w] = xxhash.xxh3_64_digest(w)
                parts.append(h)
            blob = b"".join(parts)
            keep.append(i)
            keys.append(xxhash.xxh3_128_digest(blob))
            packed.append(blob)
            sizes.append(len(found))
        if len(hashes) > 1_000_000:
            hashes.clear()
        rest = batch.take(pa.array(keep, pa.int64()))
        columns = [pa.array(keys, pa.binary()), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32()), *rest.columns[1:]]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "words", "n", *batch.schema.names[1:]])


def _band_rows(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``bucket, id, n, words`` to the band keys of each text, with a 64-bit sketch of its words for the join to filter on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed: dict[int, int] = {}
        step = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(sizes):
                continue
            word = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=">u8").astype(np.uint64)
            ends = np.cumsum(sizes)
            sketch = np.bitwise_or.reduceat(np.uint64(1) << (_mixed(word) >> np.uint64(58)), ends - sizes)
            inner = np.ones(len(word), bool)
            inner[ends - 1] = False  # the last word of a text has no neighbour
            token = _mixed(word * step + np.append(word[1:], np.uint64(0)))[inner]
            row = np.repeat(np.arange(len(sizes)), sizes - 1)
            order = np.lexsort((token, row))
            token, row = token[order], row[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
            place = np.arange(len(token))
            nth = place - np.maximum.accumulate(np.where(new, place, 0))
            token = _mixed(token + nth.astype(np.uint64) * step)
            bands = np.array([needed.setdefault(n, bands_needed(n, rows)) for n in sizes.tolist()])
            ident = batch.column(1).to_numpy(zero_copy_only=False)
            bucket = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for b in range(int(bands.max())):
                # Texts that need fewer bands are left out of the later ones.
                has = bands > b
                members = np.flatnonzero(has)
                inside = token[has[row]]
                starts = np.concatenate(([0], np.cumsum(sizes[has] - 1)[:-1]))
                key = _mixed(bucket[members] + np.uint64(b + 1) * np.uint64(rows))
                for seed in _seeds((b + 1) * rows)[b * rows :]:
                    key = _mixed(key * step + np.minimum.reduceat(_mixed(inside * seed), starts))
                columns = [pa.array(key.view(np.int64)), pa.array(ident[members]), pa.array(sizes[members].astype(np.int32)), pa.array(sketch[members].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["band", "id", "n", "sketch"])

    return run


def word_distance(a: bytes, b: bytes) -> int:
    """Edit distance of two sequences of 8-byte words."""
    return sequence_distance(*([s[i : i + 8] for i in range(0, len(s), 8)] for s in (a, b)))


def _jaccard(a: bytes, b: bytes) -> float:
    """Jaccard similarity of the word multisets."""
    count: dict[bytes, int] = {}
    for i in range(0, len(a), 8):
        count[a[i : i + 8]] = count.get(a[i : i + 8], 0) + 1
    both = 0
    for i in range(0, len(b), 8):
        if count.get(b[i : i + 8], 0) > 0:
            count[b[i : i + 8]] -= 1
            both += 1
    return both / ((len(a) + len(b)) // 8 - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, wa, wb = (batch.column(i).to_pylist() for i in range(4))
        kept = []
        for i in range(len(a)):
            distance = word_distance(wa[i], wb[i])
            if distance * 100 <= EDIT_PERCENT * (max(len(wa[i]), len(wb[i])) // 8):
                kept.append((a[i], b[i], distance, _jaccard(wa[i], wb[i])))
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate(kinds)], names=["train_key", "eval_key", "distance", "jaccard"])


def _near_pairs(classes: DataFrame, rows: int) -> DataFrame:
    """``t_id, e_id`` of texts that share a bucket, have lengths and sketches within the limit, and stand on both sides.

    A bucket of more than ``HOT_BUCKET`` held-out texts would meet all its train texts with
    all of them. Its texts are banded again inside it, by twice the values and as many more
    bands, so that no more pairs at the limit are missed than before.
    """

    def bands(texts: DataFrame, values: int) -> DataFrame:
        return texts.select("bucket", "id", "n", "words").mapInArrow(_band_rows(values), "band bigint, id bigint, n int, sketch bigint")

    def met(train: DataFrame, held: DataFrame) -> DataFrame:
        t, e = (df.select("band", *(F.col(c).alias(f"{mark}_{c}") for c in ("id", "n", "sketch"))) for df, mark in ((train, "t"), (held, "e")))
        most = F.floor(F.greatest("t_n", "e_n") * EDIT_PERCENT / 100)
        # Exact filters: k edits change at most 2 k bits of the sketch and k words of the length.
        near = (F.abs(F.col("t_n") - F.col("e_n")) <= most) & (F.bit_count(F.col("t_sketch").bitwiseXOR(F.col("e_sketch"))) <= 2 * most)
        return t.join(e, "band").filter(near & (F.col("t_id") != F.col("e_id"))).select("t_id", "e_id")

    sides = [classes.filter(side).withColumn("bucket", F.lit(0)) for side in ("train", "held")]
    train, held = (bands(df, rows) for df in sides)
    hot, figures = saved_with(held.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_BUCKET).select("band"), n=F.count("*"))
    if not figures["n"]:
        return met(train, held)
    again = []
    for df, whole in ((train, sides[0]), (held, sides[1])):
        inside = lookup(df, hot, ["band"], "left_semi").select(F.col("band").alias("bucket"), "id")
        again.append(bands(lookup(inside, whole.select("id", "n", "words"), ["id"]), 2 * rows))
    return met(*(lookup(df, hot, ["band"], "left_anti") for df in (train, held))).unionByName(met(*again))


def cross_split_classes(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of text classes across splits, and the members of the classes.

    Pairs: ``train_key, eval_key, distance, jaccard``, a class being all records of the
    same words; a class on both sides pairs with itself. Members: ``uid, key, split,
    source``. A record is a distinct uid; rows without uid, transcript or a split of
    train, val or test, and texts under ``MIN_WORDS`` words take no part. Other columns
    are ignored. An empty table gives empty results.
    """
    read = segments.select("transcript", F.col("uid").cast("string").alias("uid"), split_name(F.col("split")).alias("split"), source_name(F.col("source")).alias("source"))
    read = read.filter("transcript is not null and uid is not null and split in ('train', 'val', 'test')")
    read = saved(read.mapInArrow(_read_words, "key binary, words binary, n int, uid string, split string, source string"))
    members = read.groupBy("uid").agg(F.min(F.struct("key", "split", "source")).alias("m")).select("uid", "m.*")
    is_train = F.col("split") == "train"
    classes = read.groupBy("key").agg(F.first("words").alias("words"), F.first("n").alias("n"), F.max(is_train).alias("train"), F.max(~is_train).alias("held"))
    # The short id only finds candidates; words and full keys decide.
    classes, figures = saved_with(classes.withColumn("id", F.xxhash64("key")), n=F.count("*"))
    rows = rows_needed(figures["n"])
    pairs = saved(_near_pairs(classes, rows).distinct())
    wanted = pairs.select(F.col("t_id").alias("id")).union(pairs.select("e_id")).distinct()
    texts = saved(lookup(classes.select("id", "key", "words", "train", "held"), wanted, ["id"], "left_semi"))

    def side(name: str, mark: str) -> DataFrame:
        return texts.filter(name).select(F.col("id").alias(f"{mark}_id"), F.col("key").alias(f"{mark}_key"), F.col("words").alias(f"{mark}_words"))

    texted = lookup(lookup(pairs, side("train", "t"), ["t_id"]), side("held", "e"), ["e_id"]).select("t_key", "e_key", "t_words", "e_words")
    near_pairs = texted.mapInArrow(_verified, "train_key binary, eval_key binary, distance int, jaccard double")
    same = classes.filter("train and held").select(F.col("key").alias("train_key"), F.col("key").alias("eval_key"), F.lit(0).alias("distance"), F.lit(1.0).alias("jaccard"))
    return saved(near_pairs.unionByName(same)), members


def cross_split_pairs(segments: DataFrame) -> DataFrame:
    """``train_uid, eval_uid, split, source, distance, jaccard``: every record pair; split and source are the held-out record's.

    Classes are paired first; the members of a hot class are spread over tasks.
    """
    pairs, members = cross_split_classes(segments)
    keys = pairs.select(F.col("train_key").alias("key")).union(pairs.select("eval_key")).distinct()
    members = saved(lookup(members, keys, ["key"], "left_semi"))
    train = members.filter("split = 'train'").select(F.col("key").alias("train_key"), F.col("uid").alias("train_uid"))
    held = members.filter("split != 'train'").select(F.col("key").alias("eval_key"), F.col("uid").alias("eval_uid"), "split", "source")
    half = lookup(held, pairs, ["eval_key"])
    return lookup(train, half, ["train_key"]).select("train_uid", "eval_uid", "split", "source", "distance", "jaccard")


def _links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``key, train, n_links, n_same``: records on the other side that a class' records of a side are linked to."""
    sizes = members.groupBy("key").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") != "train").alias("n_held"))
    sizes = saved(sizes)
    out = []
    for here, there, n, is_train in (("eval_key", "train_key", "n_train", False), ("train_key", "eval_key", "n_held", True)):
        partners = lookup(pairs.select(F.col(here).alias("own"), F.col(there).alias("key"), "distance"), sizes.select("key", F.col(n).alias("n")), ["key"])
        same = F.sum(F.when(F.col("distance") == 0, F.col("n")).otherwise(0))
        out.append(partners.groupBy(F.col("own").alias("key")).agg(F.sum("n").alias("n_links"), same.alias("n_same")).withColumn("train", F.lit(is_train)))
    return out[0].unionByName(out[1]).filter("n_links > 0")


def linked_records(segments: DataFrame) -> DataFrame:
    """``uid, split, source, class_id, n_links, n_same``: records with a partner across splits, their class, and their numbers of partners.

    A class is all records of the same words; ``n_same`` counts the partners of the own class. No record pair is made.
    """
    pairs, members = cross_split_classes(segments)
    members = members.withColumn("train", F.col("split") == "train")
    found = lookup(members, saved(_links(pairs, members)), ["key", "train"])
    return found.select("uid", "split", "source", F.lower(F.hex("key")).alias("class_id"), "n_links", "n_same")


def overlap_report(segments: DataFrame) -> DataFrame:
    """Per held-out split and source: overlapping records, pairs, and pairs of the same words; counted by class sizes."""
    held = linked_records(segments).filter("split != 'train'")
    return held.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.sum("n_links").alias("n_pairs"), F.sum("n_same").alias("n_same"))

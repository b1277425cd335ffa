"""Mixing sources to target weights: weighted fair queueing over shuffled documents.

Every use of a document gets a virtual finish time: the tokens of its source up to and
with it, in a shuffled order, divided by the source's weight. Uses sorted by that time
and cut at the total budget give each source its share.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.reading import source_name
from corpusflow.sizing import lookup, prefix_totals, saved

#: Vocabulary file of a public byte-level tokenizer for many languages.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The pattern that splits text before the merges of that file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Size of a vocabulary file up to which it is sent to the tasks.
MOST_BYTES = 64 << 20
#: Rows aimed at in one bucket of a running total, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 4000, 100_000
#: Distinct pieces whose token count a task remembers.
REMEMBERED = 400_000


def _counter(vocabulary: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pieces = regex.compile(PATTERN).findall
        known: dict[str, int] = {}
        for batch in batches:
            sizes = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                n = 0
                for piece in pieces(text):  # the pieces are encoded apart, so a piece always counts the same
                    if (k := known.get(piece)) is None:
                        k = len(encode(piece))
                        if len(known) < REMEMBERED:
                            known[piece] = k
                    n += k
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return count


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens`` of documents with an id, a source and at least one token; texts are read whole.

    The driver reads the vocabulary file and sends it to the tasks, so executors need not have it.
    """
    read = documents.select("doc_id", source_name(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    read = read.filter("doc_id is not null and source is not null and text is not null")
    kind = documents.schema["doc_id"].dataType.simpleString()
    data = Path(tokenizer).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{tokenizer} is no vocabulary file: over {MOST_BYTES} bytes")
    return read.mapInArrow(_counter(documents.sparkSession.sparkContext.broadcast(data)), f"doc_id {kind}, source string, n_tokens bigint").filter("n_tokens > 0")


def _weights(targets: DataFrame) -> DataFrame:
    """One row per source with a positive share and at least one use; repeated targets add up, a null cap is 1."""
    named = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).cast("double").alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))
    return named.filter("source is not null").groupBy("source").agg(F.sum("w").alias("w"), F.max("cap").cast("int").alias("cap")).filter("w > 0 and cap > 0")


def mix_sources(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The chosen uses (``doc_id, copy, source, n_tokens, finish, running_tokens``) and the report of shares.

    ``copy`` counts a document's uses from 0. Without ``budget`` the total is the largest
    at which every source can give its share under its cap. A source that runs out gives
    no more, and the others go on to the budget. Shares are scaled to one over the sources
    that have tokens; a source without a target isn't used. The report has ``source,
    target_share, max_repeats, available_tokens, n_documents, n_uses, used_tokens,
    actual_share`` for every named source. Ties in time go by source and document. Empty
    tables give empty results. A given seed always gives the same mix.
    """
    sizes = saved(token_sizes(documents, tokenizer))
    per_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n_docs"))
    weights = per_source.join(_weights(targets), "source")
    weights = saved(weights)
    scaled = weights.withColumn("w", F.col("w") / F.lit(weights.agg(F.sum("w")).first()[0] or 1.0))
    # The hair keeps a whole number whole through the division.
    largest, n_docs = scaled.agg(F.min(F.col("cap") * F.col("total") / F.col("w")), F.sum("n_docs")).first()
    end = float(budget) if budget is not None else float(int((largest or 0) + 1e-6))
    buckets = max(1, min(MAX_BUCKETS, (n_docs or 0) // BUCKET_ROWS))
    queued = lookup(sizes, scaled.select("source", "w", "cap", "total"), ["source"])
    shuffled = queued.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * buckets))
    order = [F.col("key"), F.col("doc_id")]
    queued = prefix_totals(saved(shuffled), ["source"], "bucket", order, "n_tokens", "upto").drop("bucket", "key")
    # A use that would start after the end never counts, so copies are made only up to there.
    last_copy = F.least(F.col("cap") - 1, F.floor((F.lit(end) * F.col("w") - F.col("upto") + F.col("n_tokens")) / F.col("total")).cast("int"))
    uses = queued.withColumn("last_copy", last_copy).filter("last_copy >= 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("last_copy"))))
    finish = (F.col("copy") * F.col("total") + F.col("upto")) / F.col("w")
    uses = uses.withColumn("finish", finish).withColumn("bucket", F.least(F.lit(buckets), F.floor(F.col("finish") / max(end, 1.0) * buckets)))
    uses = saved(uses.select("doc_id", "copy", "source", "n_tokens", "finish", "bucket").withColumn("all", F.lit(0)))
    chosen = prefix_totals(uses, ["all"], "bucket", [F.col("finish"), F.col("source"), F.col("doc_id"), F.col("copy")], "n_tokens", "running_tokens")
    chosen = saved(chosen.filter(F.col("running_tokens") <= end).select("doc_id", "copy", "source", "n_tokens", "finish", "running_tokens"))
    used = chosen.groupBy("source").agg(F.count_if(F.col("copy") == 0).alias("n_documents"), F.count("*").alias("n_uses"), F.sum("n_tokens").alias("used_tokens"))
    named = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null")
    report = named.join(per_source, "source", "left").join(used, "source", "left")
    all_tokens = F.lit(chosen.agg(F.sum("n_tokens")).first()[0])
    whole = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_documents", "n_uses", "used_tokens")}
    report = report.select(
        "source", "target_share", "max_repeats", F.coalesce("total", F.lit(0)).alias("available_tokens"), *(v.alias(c) for c, v in whole.items()),
        F.coalesce(F.col("used_tokens") / all_tokens, F.lit(0.0)).alias("actual_share"),
    )
    return chosen, report

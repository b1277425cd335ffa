"""Texts cut off by field limits or broken transfers.

A trie of the corpus vocabulary says whether a text's last token is an unknown proper
prefix of known words. The trie is never held in one place: words are spread by their
first letters, sorted, and each part is walked once in order. Length evidence joins in:
lengths of a source at which texts pile up far beyond their neighbours, and end like cut
ones, are its limits.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.reading import source_name
from corpusflow.llm.textforms import BLANKS, INVISIBLE, words
from corpusflow.sizing import lookup, saved

#: A token is unknown when words it begins are at least this many times as frequent as itself.
RARER = 80
#: Letters that spread the vocabulary, and salts that part the words of one beginning.
HEAD, WORD_SALTS = 3, 8
#: Neighbouring lengths compared with a length; texts it needs; times the neighbours' mean; share that ends like cut ones.
NEIGHBOURS, PILE, PILE_TIMES, PILE_CUT = 50, 3, 8, 0.25
#: Share of a source's closed texts whose last sentence may be as short as a rest, and share of its texts that must be closed for it to tell.
SHORT_SHARE, CLOSED_SHARE = 0.002, 0.5
#: Different texts of the corpus that a last line ends, from which on it is a formula that closes a text, like a signature.
FORMULA = 3
#: Lengths this little under a limit count where the text also ends like a cut one.
SLACK = 3
#: Distinct words a task holds before it passes them on.
VOCABULARY_FLUSH = 300_000
# Brackets and quotes that close again, and what a limit may put in place of the rest.
PAIRS = {"(": ")", "«": "»", "[": "]", "“": "”", "{": "}"}
DOTS = ("...", "…")
SENTENCE_MARKS = ".!?؟…\n"
BROKEN = "�"

_UNSEEN = "".join(map(chr, (*INVISIBLE, *BLANKS))) + " \t\r\n\v\f"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("source", pa.string()), ("text_hash", pa.int64()), ("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("token", pa.string()),
        ("dotted", pa.bool_()), ("broken", pa.bool_()), ("open_pair", pa.bool_()), ("rest", pa.int64()), ("closed", pa.bool_()), ("last_line", pa.int64()), ("word", pa.string()), ("n", pa.int64()),
    ]
)
_DDL = "doc_id bigint, source string, text_hash bigint, n_chars bigint, n_bytes bigint, token string, dotted boolean, broken boolean, open_pair boolean, rest bigint, closed boolean, last_line bigint, word string, n bigint"


def _is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


def _ending(text: str) -> tuple[str, bool, bool]:
    """The text up to its last visible character, whether dots stand for a rest, and whether a letter ends it."""
    seen = text.rstrip(_UNSEEN)
    for dots in DOTS:
        if seen.endswith(dots):
            body = seen[: -len(dots)]
            return body, True, bool(body) and _is_letter(body[-1])
    return seen, False, bool(seen) and _is_letter(seen[-1])


def _rest(seen: str) -> tuple[int, bool]:
    """Words of the last sentence or line, and whether a sentence mark closes it."""
    body = seen.rstrip(SENTENCE_MARKS)
    at = max(body.rfind(mark) for mark in SENTENCE_MARKS)
    return len(words(body[at + 1 :])), len(body) < len(seen)


def _last_line(seen: str) -> int | None:
    """What stands for the last of several lines, whatever follows its last visible character."""
    head, _, line = seen.rpartition("\n")
    return xxhash.xxh3_64_intdigest(line.strip(_UNSEEN)) >> 1 if head else None


def _stopped(body: str) -> bool:
    """Whether a sentence mark, closing sign or symbol ends the text, so an open pair before it shows no cut."""
    return not body or body[-1] in SENTENCE_MARKS + '"' or unicodedata.category(body[-1]) in ("Pe", "Pf", "So")


def _left_open(text: str) -> bool:
    """Whether the last bracket or quote of the text was opened and not closed."""
    return any((at := text.rfind(a)) >= 0 and text.find(b, at) < 0 for a, b in PAIRS.items())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: documents with the evidence of their end, and counts of the words inside texts."""
    counts: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        known, n = pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())
        counts.clear()
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(n), f.type) for f in list(_SCHEMA)[:-2]), known, n], schema=_SCHEMA)

    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(2).to_pylist():
            body, dotted, lettered = _ending(text)
            found = words(text)
            token = found.pop() if lettered and found else None
            counts.update(found)
            rows.append(
                (
                    *(xxhash.xxh3_64_intdigest(text) >> 1, len(text), len(text.rstrip(BROKEN).encode()), token, dotted, body.endswith(BROKEN)),
                    *(not dotted and not _stopped(body) and _left_open(body), *_rest(text.rstrip(_UNSEEN)), _last_line(text.rstrip(_UNSEEN))),
                )
            )
        columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(_SCHEMA)[2:-2])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *(pa.nulls(len(rows), f.type) for f in list(_SCHEMA)[-2:])], schema=_SCHEMA)
        if len(counts) > VOCABULARY_FLUSH:
            yield flushed()
    yield flushed()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth-first walk of a part of the trie: rows come sorted, a token before its equal word."""
    out: list[tuple[str, int, int]] = []
    path: list[list] = []  # tokens on the way from the root: token, its own count, count below it

    def leave() -> None:
        token, own, below = path.pop()
        out.append((token, own, below))
        if path:
            path[-1][2] += own + below

    def batch_out() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["token", "own", "below"])
        out.clear()
        return done

    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            while path and not word.startswith(path[-1][0]):
                leave()
            if n is None:
                if not path or path[-1][0] != word:
                    path.append([word, 0, 0])
            elif path:
                path[-1][1 if path[-1][0] == word else 2] += n
        yield batch_out()
    while path:
        leave()
    yield batch_out()


def prefix_counts(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token, own, below``: how often a token is a word of the vocabulary, and how often a proper prefix of one.

    ``tokens`` has ``token``, ``vocabulary`` has ``word, n`` with one row per word. Tokens
    without both are missing from the result.
    """
    long_words = vocabulary.filter(F.length("word") >= HEAD).withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(WORD_SALTS)).cast("int"))
    long_tokens = tokens.filter(F.length("token") >= HEAD).select(F.col("token").alias("word"), F.lit(None).cast("bigint").alias("n"))
    long_tokens = long_tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(WORD_SALTS - 1))))
    spread = long_words.select("word", "n", "salt").unionByName(long_tokens).withColumn("head", F.substring("word", 1, HEAD))
    parts = spread.repartition("head", "salt").sortWithinPartitions("salt", "word", F.col("n").asc_nulls_first()).select("word", "n")
    walked = parts.mapInArrow(_walk, "token string, own bigint, below bigint").groupBy("token").agg(F.sum("own").alias("own"), F.sum("below").alias("below"))
    # The top of the trie: beginnings of fewer letters are few, whatever the vocabulary.
    tops = F.array(*(F.struct(F.lit(k).alias("k"), F.substring("word", 1, k).alias("token"), (F.length("word") > k).alias("longer")) for k in range(1, HEAD)))
    reached = F.filter(tops, lambda t: t["k"] <= F.length("word"))
    top = vocabulary.select("n", F.inline(reached)).groupBy("token").agg(F.sum(F.when(~F.col("longer"), F.col("n"))).alias("own"), F.sum(F.when(F.col("longer"), F.col("n"))).alias("below"))
    short = tokens.filter(F.length("token") < HEAD).join(top, "token").select("token", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("below", F.lit(0)).alias("below"))
    return walked.unionByName(short)


def find_limits(lengths: DataFrame) -> DataFrame:
    """``source, measure, limit``: lengths at which texts of a source pile up and end like cut ones.

    ``lengths`` has ``source, measure, length, n, n_cut``, a row per length.
    """
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    around = (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * NEIGHBOURS)
    piled = (F.col("n") >= PILE + PILE_TIMES * around) & (F.col("n_cut") >= PILE_CUT * F.col("n"))
    return lengths.withColumn("piled", piled).filter("piled").select("source", "measure", F.col("length").alias("limit"))


def closing_formulas(ends: DataFrame) -> DataFrame:
    """``last_line`` of lines that end ``FORMULA`` or more different texts, such as tags and signatures: those texts came to their end."""
    several = ends.filter("last_line is not null").groupBy("last_line", "text_hash").agg(F.lit(1).alias("one"))
    return several.groupBy("last_line").agg(F.count("*").alias("n")).filter(F.col("n") >= FORMULA).select("last_line")


def short_rests(ends: DataFrame) -> DataFrame:
    """``source, longest_rest``: so few words almost no closed text of the source ends its last sentence with.

    Lengths that no closed text has count as well. Dots may stand for a rest, so they close
    no text here. A source that leaves most of its texts without a mark has no such length,
    for there an open end tells nothing; shares decide, not numbers of texts.
    """
    is_closed = F.col("closed") & ~F.col("dotted")
    counted = ends.groupBy("source", "rest").agg(F.count("*").alias("n_texts"), F.count_if(is_closed).alias("n"))
    of_source = Window.partitionBy("source")
    sizes = counted.withColumn("closes", F.sum("n").over(of_source) >= F.lit(CLOSED_SHARE) * F.sum("n_texts").over(of_source)).filter("closes and n > 0")
    upward = Window.partitionBy("source").orderBy("rest")
    share = F.sum("n").over(upward) / F.sum("n").over(Window.partitionBy("source"))
    return sizes.withColumn("share", share).filter(F.col("share") > SHORT_SHARE).groupBy("source").agg((F.min("rest") - 1).alias("longest_rest"))


def truncated_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut documents with their evidence, and the report per source.

    The first has ``doc_id, source, last_token, cut_word, at_limit, open_pair, broken, short_rest``, a
    row per cut document; the second ``source, n_documents, n_cut, cut_share``. Rows
    without id or text and empty texts can't be cut; a null source is a source of its
    own; repeated texts are judged alike, and count once where lengths pile up. Texts are
    read whole and other columns are ignored. Empty tables give empty results.
    """
    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"), "text")
    read = saved(read.filter("doc_id is not null and text is not null and text != ''").mapInArrow(_read, _DDL))
    ends = read.filter("word is null").drop("word", "n")
    vocabulary = saved(read.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    tokens = ends.filter("token is not null").select("token").distinct()
    cut_tokens = prefix_counts(tokens, vocabulary).filter(F.col("below") > 0).filter(F.col("own") * RARER <= F.col("below")).select("token")
    looked = saved(lookup(ends.filter("token is not null"), saved(cut_tokens.withColumn("prefix", F.lit(True))), ["token"], "left").unionByName(ends.filter("token is null").withColumn("prefix", F.lit(None).cast("boolean"))))
    looked = looked.withColumn("prefix", F.coalesce("prefix", F.lit(False)))
    cut_like = F.col("prefix") | F.col("broken")
    measures = F.array(F.struct(F.lit("chars").alias("measure"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("n_bytes").alias("length")))
    once = looked.groupBy("source", "text_hash", "n_chars", "n_bytes").agg(F.max(cut_like).alias("cut_like"))
    lengths = once.select("source", "cut_like", F.inline(measures)).groupBy("source", "measure", "length").agg(F.count("*").alias("n"), F.count_if("cut_like").alias("n_cut"))
    limits = saved(find_limits(lengths))
    under = limits.select("source", "measure", "limit", F.explode(F.sequence(F.lit(0), F.lit(SLACK))).alias("short"))
    under = under.groupBy("source", "measure", (F.col("limit") - F.col("short")).alias("length")).agg((F.min("short") == 0).alias("exact"))
    by = {m: saved(under.filter(F.col("measure") == m).select("source", F.col("length").alias(f"n_{m}"), F.col("exact").alias(f"{m}_exact"))) for m in ("chars", "bytes")}
    judged = lookup(lookup(looked, by["chars"], ["source", "n_chars"], "left"), by["bytes"], ["source", "n_bytes"], "left")
    near = F.col("chars_exact").isNotNull() | F.col("bytes_exact").isNotNull()
    exact = F.coalesce("chars_exact", F.lit(False)) | F.coalesce("bytes_exact", F.lit(False))
    judged = judged.withColumn("at_limit", exact | (near & (F.col("dotted") | F.col("prefix"))))
    judged = lookup(judged, saved(short_rests(ends)), ["source"], "left")
    judged = lookup(judged, saved(closing_formulas(ends)).withColumn("formula", F.lit(True)), ["last_line"], "left").withColumn("formula", F.coalesce("formula", F.lit(False)))
    short = F.col("token").isNotNull() & ~F.col("dotted") & ~F.col("closed") & ~F.col("formula") & (F.col("rest") <= F.col("longest_rest"))
    judged = judged.withColumns({"short_rest": F.coalesce(short, F.lit(False)), "open_pair": F.col("open_pair") & ~F.col("formula")})
    judged = judged.withColumn("cut_word", F.col("prefix") & ~F.col("dotted"))
    judged = judged.withColumn("cut", F.col("cut_word") | F.col("at_limit") | F.col("open_pair") | F.col("broken") | F.col("short_rest"))
    cut = judged.filter("cut").select("doc_id", F.nullif("source", F.lit("")).alias("source"), F.col("token").alias("last_token"), "cut_word", "at_limit", "open_pair", "broken", "short_rest")
    report = judged.groupBy(F.nullif("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_documents"), F.count_if("cut").alias("n_cut"))
    return cut, report.withColumn("cut_share", F.col("n_cut") / F.col("n_documents"))

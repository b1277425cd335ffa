"""Held-out passages inside training text: suffix arrays over shards of the corpus.

A task reads its documents into shards of word numbers, sorts the suffixes of each shard,
and looks every test suffix up by binary search. Matches are extended to their full
length. Words that no test item has can't be part of a match, so they only part the runs
that are sorted; that is exact, and it keeps the arrays small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.textforms import words

#: Least consecutive words of a leak; a power of two, for the suffixes are ranked by doubling.
MIN_WORDS = 8
#: Words of the test items that one pass over the corpus looks for; more items take more passes.
BLOCK_WORDS = 300_000
#: Words of the corpus in one suffix array.
SHARD_WORDS = 1_000_000


@dataclass(frozen=True)
class _Items:
    """A block of test items: word numbers from 1, all items in one array parted by zeros."""

    vocabulary: dict[str, int]
    tokens: np.ndarray
    item: np.ndarray
    place: np.ndarray


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[_Items, list]]:
    ids: list = []
    vocabulary: dict[str, int] = {}
    tokens: list[int] = []
    item: list[int] = []
    place: list[int] = []

    def block() -> tuple[_Items, list]:
        return _Items(vocabulary, np.array(tokens, np.int64), np.array(item, np.int64), np.array(place, np.int64)), ids

    for row in items.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text).toLocalIterator():
        found = words(row[1])
        if len(found) < MIN_WORDS:
            continue
        tokens += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found] + [0]
        item += [len(ids)] * (len(found) + 1)
        place += range(len(found) + 1)
        ids.append(row[0])
        if len(tokens) > BLOCK_WORDS:
            yield block()
            ids, vocabulary, tokens, item, place = [], {}, [], [], []
    if ids:
        yield block()


def _ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` words; equal beginnings have equal ranks."""
    rank, reach = tokens, 1
    while reach < depth:
        after = np.zeros_like(rank)
        after[:-reach] = rank[reach:]
        pair = rank * (int(rank.max()) + 1) + after
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        rank[tokens == 0] = 0  # a suffix starting at a break
        reach *= 2
    return rank


def _full(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places whose next ``depth`` words hold no break."""
    breaks = np.concatenate(([0], np.cumsum(tokens == 0)))
    at = np.arange(len(tokens))
    return at[(at + depth <= len(tokens)) & (breaks[np.minimum(at + depth, len(tokens))] == breaks[at])]


def shard_matches(corpus: np.ndarray, test: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest common runs of at least ``depth`` words: place in the corpus, place in the test, length.

    Zeros are breaks in both. Each run comes once, from its first word to its last.
    """
    none = np.array([], np.int64)
    suffixes, wanted = _full(corpus, depth), _full(test, depth)
    if not len(suffixes) or not len(wanted):
        return none, none, none
    rank = _ranks(np.concatenate((corpus, [0], test)), depth)
    array = suffixes[np.argsort(rank[suffixes], kind="stable")]  # the suffix array, as deep as a match needs
    sorted_rank, asked = rank[array], rank[len(corpus) + 1 + wanted]
    low, high = np.searchsorted(sorted_rank, asked, "left"), np.searchsorted(sorted_rank, asked, "right")
    n = high - low
    t = np.repeat(wanted, n)
    if not len(t):
        return none, none, none
    c = array[np.repeat(low, n) + np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)]
    before_c, before_t = np.where(c > 0, corpus[c - 1], 0), np.where(t > 0, test[t - 1], 0)
    first = (before_c != before_t) | (before_c == 0)
    c, t = c[first], t[first]
    length = np.full(len(c), depth)
    ended_c, ended_t = np.append(corpus, 0), np.append(test, 0)
    growing = np.arange(len(c))
    while len(growing):
        x, y = ended_c[c[growing] + length[growing]], ended_t[t[growing] + length[growing]]
        growing = growing[(x == y) & (x != 0)]
        length[growing] += 1
    return c, t, length


def _finder(items, ids, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Items = items.value
        number = block.vocabulary.get
        tokens: list[np.ndarray] = []
        owners: list = []
        owner_at: list[tuple[int, int, int]] = []  # document, place in it, words in the run
        held = 0

        def matches() -> pa.RecordBatch:
            corpus = np.concatenate(tokens) if tokens else np.array([], np.int64)
            doc = np.array(owner_at, np.int64).reshape(-1, 3)
            starts = np.cumsum(doc[:, 2] + 1) - doc[:, 2] - 1
            c, t, length = shard_matches(corpus, block.tokens, MIN_WORDS)
            run = np.searchsorted(starts, c, "right") - 1
            columns = (
                [owners[i] for i in doc[run, 0]],
                [ids[i] for i in block.item[t]],
                doc[run, 1] + c - starts[run],
                block.place[t],
                length,
            )
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.array([number(w, 0) for w in words(text)], np.int64)
                breaks = np.flatnonzero(np.concatenate(([0], found, [0])) == 0)
                long = np.flatnonzero(np.diff(breaks) > MIN_WORDS)
                if not len(long):
                    continue
                for k in long:
                    run = found[breaks[k] : breaks[k + 1] - 1]
                    tokens.append(np.append(run, 0))
                    owner_at.append((len(owners), int(breaks[k]), len(run)))
                    held += len(run) + 1
                owners.append(owner)
                if held >= SHARD_WORDS:
                    yield matches()
                    tokens.clear(), owners.clear(), owner_at.clear()
                    held = 0
        if held:
            yield matches()

    return find


def verbatim_matches(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, doc_word, item_word, n_words``: every longest run of at least ``MIN_WORDS`` words in both.

    ``doc_word`` and ``item_word`` count words from 0. Rows without id or text and items of
    fewer words take no part; repeated rows repeat their matches; documents are read whole
    and other columns are ignored. Without documents or items the result is empty.
    """
    spark = documents.sparkSession
    types = (documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString())
    ddl = f"doc_id {types[0]}, item_id {types[1]}, doc_word bigint, item_word bigint, n_words bigint"
    empty = spark.createDataFrame([], ddl)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(empty.schema)
    read = documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text)
    result = empty
    for block, ids in _blocks(items, item_id, text):
        found = read.mapInArrow(_finder(spark.sparkContext.broadcast(block), ids, schema), ddl)  # bounded by BLOCK_WORDS
        result = found if result is empty else result.unionByName(found)
    return result


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_matches, n_words``: leaked pairs with the length of their longest run."""
    return verbatim_matches(documents, items).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_matches"), F.max("n_words").alias("n_words"))


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no passage of an item; those without id or text stay."""
    affected = verbatim_matches(documents, items).select("doc_id").distinct()
    return documents.join(affected, "doc_id", "left_anti")

"""Weighted mixing: shares, caps, order and edge cases."""

import pytest

from corpusflow.llm import mixture

DOCS = "doc_id bigint, text string, source string, n_tokens int, copy int, w double"
TARGETS = "source string, target_share double, max_repeats int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1.0) for r in rows], DOCS)


def test_token_counts_are_the_tokenizers(spark):
    import base64

    import tiktoken

    with open(mixture.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=mixture.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["I don't  know\n\n ok 123", "قال «نعم» ﻟﻴﺶ؟ 🙂", " ", "a" * 5000, "<|endoftext|> x"]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    assert {r["doc_id"]: r["n_tokens"] for r in mixture.token_sizes(df).collect()} == {i: len(encoding.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_shares_caps_and_order(spark):
    rows = [(i, "word " * (5 + i % 7), "Big" if i % 4 else "small one") for i in range(800)]
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("small-one", 0.4, 3), ("absent", 0.1, 1)], TARGETS)
    chosen, report = mixture.mix_sources(documents(spark, rows), targets)
    got = chosen.collect()
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    by = {r["source"]: r for r in report.collect()}
    assert by["absent"]["n_uses"] == 0 and by["absent"]["actual_share"] == 0.0
    assert by["big"]["actual_share"] == pytest.approx(5 / 9, abs=0.01)
    assert by["small_one"]["actual_share"] == pytest.approx(4 / 9, abs=0.01)
    assert max(r["copy"] for r in got if r["source"] == "small_one") <= 2 and max(r["copy"] for r in got if r["source"] == "big") == 0
    in_order = sorted(got, key=lambda r: (r["finish"], r["source"], r["doc_id"], r["copy"]))
    running = 0
    for r in in_order:
        running += r["n_tokens"]
        assert r["running_tokens"] == running
    assert sorted(map(tuple, mixture.mix_sources(documents(spark, rows).repartition(7), targets)[0].collect())) == sorted(map(tuple, got))


def test_budget(spark):
    rows = [(i, "a b c d", "x" if i % 2 else "y") for i in range(100)]
    targets = spark.createDataFrame([("x", 0.75, 1), ("y", 0.25, 1)], TARGETS)
    chosen, report = mixture.mix_sources(documents(spark, rows), targets, budget=80)
    each = chosen.first()["n_tokens"]
    assert chosen.count() == 80 // each
    shares = {r["source"]: r["actual_share"] for r in report.collect()}
    assert shares["x"] == pytest.approx(0.75, abs=0.06)
    # Beyond what the caps allow every document is used as often as it may be.
    assert mixture.mix_sources(documents(spark, rows), targets, budget=10**6)[0].count() == 100


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a", "x"), (3, "a b", None), (4, "a b", "x"), (5, "a b", "unlisted")]
    targets = spark.createDataFrame([("x", 1.0, None), ("x", None, 1), (None, 1.0, 1), ("y", 0.0, 1), ("z", 0.5, 0)], TARGETS)
    chosen, report = mixture.mix_sources(documents(spark, rows), targets)
    assert [(r["doc_id"], r["copy"]) for r in chosen.collect()] == [(4, 0)]
    assert {r["source"] for r in report.collect()} == {"x", "y", "z"}
    assert mixture.mix_sources(documents(spark, []), targets)[0].count() == 0
    assert mixture.mix_sources(documents(spark, rows), targets.limit(0))[0].count() == 0

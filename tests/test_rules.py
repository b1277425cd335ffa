"""Sequential rules, splits, budgets and error rates against plain versions."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import distance
from corpusflow.operators import evaluate, splits, timing
from corpusflow.sizing import is_small, lookup, prefix_totals


def resolved(segments, duration):
    out, previous = [], 0.0
    for i, (a, b) in enumerate(segments):
        later = next((x for x, _ in segments[i + 1 :] if x is not None), None)
        start = previous if a is None else a
        if b is None:
            b = later if later is not None and later >= start else duration if i == len(segments) - 1 else start
        start = max(0.0, start)
        end = max(start, min(duration, b))
        out.append((start, end))
        previous = end
    return out


def test_resolved_times(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for r in range(40):
        duration = float(rng.randint(5, 60))
        pick = lambda: rng.choice([None, float(rng.randint(-2, 70))])
        segments = [(pick(), pick()) for _ in range(rng.randint(1, 9))]
        rows += [(f"r{r}", i, a, b, duration) for i, (a, b) in enumerate(segments)]
        expected |= {(f"r{r}", i): x for i, x in enumerate(resolved(segments, duration))}
    df = spark.createDataFrame(rows, "r string, i int, a double, b double, d double")
    found = timing.resolved_times(df, "r", ["i"], "a", "b", "d").collect()
    assert {(x["r"], x["i"]): (x["resolved_start"], x["resolved_end"]) for x in found} == expected


def test_byte_budget(spark):
    sizes = [random.Random(i).randint(0, 900) for i in range(200)]
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)], "g string, i int, n int").repartition(4)
    held = shard = 0
    expected = {}
    for i, n in enumerate(sizes):
        expected[i] = shard
        held += n
        if held >= 1000:
            held, shard = 0, shard + 1
    assert {r["i"]: r["shard_id"] for r in timing.byte_budget_shards(df, "g", [F.col("i")], "n", 1000).collect()} == expected


@pytest.mark.parametrize("n", [1, 7, 90, 170])
def test_exact_split(spark, n):
    df = spark.createDataFrame([("leaf" if i % 3 else None, i) for i in range(n)], "leaf string, id int")
    out = splits.exact_split(df, "leaf", "id").groupBy("leaf", "new_split").count().collect()
    counts = {(r[0], r[1]): r[2] for r in out}
    for leaf in {None, "leaf"}:
        size = sum(c for (x, _), c in counts.items() if x == leaf)
        assert counts.get((leaf, "train"), 0) == math.floor(size * 0.7)
        assert counts.get((leaf, "val"), 0) == math.floor(size * 0.15)
    assert sum(counts.values()) == n


def test_ratios():
    with pytest.raises(ValueError):
        splits.check_ratios(0.5, 0.6)


@pytest.mark.parametrize("ratios", [(0.7, 0.2, 0.2), (0.8, 0.3, -0.1), (0.5, 0.2, 0.2), (float("nan"), 0.5, 0.5)])
def test_exact_split_checks_its_ratios(spark, ratios):
    with pytest.raises(ValueError, match="split ratios"):
        splits.exact_split(spark.createDataFrame([("a", 1)], "leaf string, id int"), "leaf", "id", 42, *ratios)


def test_greedy_budget(spark):
    rng = random.Random(3)
    rows = [(f"u{i}", rng.choice([0.0, -1.0, None, float("nan"), *map(float, range(1, 40))])) for i in range(120)]
    rows[0] = ("u0", 500.0)
    expected, total = set(), 0.0
    for u, d in sorted(rows, key=lambda r: (hashlib.md5(f"s|{r[0]}".encode()).hexdigest(), r[0])):
        if d is None or not d > 0 or (expected and total + d > 200):
            continue
        expected.add(u)
        total += d
        if total >= 200:
            break
    df = spark.createDataFrame(rows, "uid string, d double")
    assert {r["uid"] for r in splits.greedy_budget(df, "d", "uid", 200.0, "s").collect()} == expected


def test_three_phase_budget(spark):
    rng = random.Random(5)
    rows = [(f"u{i}", float(rng.randint(1, 60)), i % 4 == 0) for i in range(150)]
    md5 = lambda s, u: hashlib.md5(f"{s}|{u}".encode()).hexdigest()
    chosen, total = {}, 0.0
    phases = [
        (1, sorted((r for r in rows if r[2]), key=lambda r: (md5("seed", r[0]), r[0]))[:6]),
        (2, sorted(rows, key=lambda r: (-r[1], md5("longest", r[0]), r[0]))),
        (3, sorted(rows, key=lambda r: (r[1], md5("topoff", r[0]), r[0]))),
    ]
    for phase, offers in phases:
        for u, d, _ in offers:
            if u not in chosen and total + d <= 500:
                chosen[u] = phase
                total += d
    df = spark.createDataFrame(rows, "uid string, d double, seed boolean")
    found = splits.three_phase_budget(df, "d", "uid", 500.0, F.col("seed"), 6).collect()
    assert {r["uid"]: r["phase"] for r in found} == chosen


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_sequence_distance():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert distance.sequence_distance(a, b) == edit(a, b) == distance.sequence_distance(list(a), list(b))
    many = [str(i) for i in range(40_000)]
    assert distance.sequence_distance(many, many[::-1][:20]) == 39_999
    assert distance.sequence_distance(many, [*many[1:], "x"]) == 2


def test_word_distance(spark):
    pairs = [("a b c", "a c", 1), ("", "a b", 2), (None, "a", 1), (None, None, 0), (" a  b ", "a b", 0), (" ".join(map(str, range(50_000))), "7 x", 49_999)]
    df = spark.createDataFrame(pairs, "r string, h string, d int")
    assert df.select((distance.word_distance("r", "h") == F.col("d")).alias("same")).filter("same").count() == len(pairs)


def test_two_hypotheses_in_one_pass(spark):
    df = spark.createDataFrame([("a b c d", "a b c", "a b c d"), ("x y", "x z", "x"), (None, "q", None)], "r string, base string, tuned string")
    both = {r["metric"]: r for r in evaluate.compared(evaluate.pair_errors(df, "r", {"base_": "base", "tuned_": "tuned"})).collect()}
    for side in ("base", "tuned"):
        alone = {r["metric"]: r["value"] for r in evaluate.corpus_metrics(evaluate.pair_errors(df, "r", side)).collect()}
        assert {m: r[side] for m, r in both.items()} == alone
    assert both["wer"]["absolute"] == pytest.approx(3 / 6 - 1 / 6) and both["wer"]["relative"] == pytest.approx(2 / 3)


def test_error_rates(spark):
    reference = "مرحبا هذا مثال اختبار صغير"
    golden = {"[smoke whisper prediction] " + reference: (0.6, 1.0909090909090908), "[smoke qwen prediction] " + reference: (0.6, 0.9545454545454546), "[smoke omni prediction]": (1.0, 1.0)}
    for hypothesis, (wer, cer) in golden.items():
        df = spark.createDataFrame([(reference, hypothesis)], "r string, h string")
        m = {r["metric"]: r["value"] for r in evaluate.corpus_metrics(evaluate.pair_errors(df, "r", "h")).collect()}
        assert (m["wer"], m["cer"]) == pytest.approx((wer, cer))
    for r, h, value in (("", "", 0.0), ("", "x", 1.0), (None, None, 0.0)):
        df = spark.createDataFrame([(r, h)], "r string, h string")
        assert evaluate.corpus_metrics(evaluate.pair_errors(df, "r", "h")).filter("metric = 'wer'").first()["value"] == value


def test_best_epoch(spark):
    history = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.4), (4, 0.6), (5, 0.1)], "epoch int, wer double")
    assert tuple(evaluate.best_epoch(history, "epoch", "wer", 2).first()) == (2, 0.4, 4)
    assert tuple(evaluate.best_epoch(history, "epoch", "wer", 9).first()) == (5, 0.1, 5)


@pytest.mark.parametrize("rows", [0, 50_000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_is_the_same_on_both_ways(spark, rows, how):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, i int")
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("zz", 3)], "k string, v int")
    expected = sorted(map(str, big.join(table, ["k"], how).collect()))
    assert sorted(map(str, lookup(big, table, ["k"], how, rows).collect())) == expected


def test_prefix_totals(spark):
    rows = [("a" if i % 2 else "b", i // 10, i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, bucket int, i int, v int")
    found = {r["i"]: r["t"] for r in prefix_totals(df, ["g"], "bucket", [F.col("i")], "v", "t").collect()}
    assert found == {i: sum(x for x in range(i + 1) if x % 2 == i % 2) for i in range(100)}


def test_ordinals_follow_files_and_keep_nulls(spark):
    rows = [(leaf, f, i) for leaf in ("a", None) for f in ("f2", "f1", None) for i in range(5)]
    df = spark.createDataFrame(rows, "leaf string, file string, i int").repartition(3)
    found = {(r["leaf"], r["file"], r["i"]): (r["ordinal"], r["shard_id"]) for r in timing.row_shards(df, "leaf", "file", "i", 4).collect()}
    place = {None: 0, "f1": 5, "f2": 10}
    assert found == {(leaf, f, i): (place[f] + i, (place[f] + i) // 4) for leaf, f, i in rows}


def test_small_means_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2], None)] * 10, "t string, a array<int>, b binary")
    assert is_small(df) and is_small(df, 10) and not is_small(df, 9)
    assert not is_small(df, 100, 5_000) and is_small(df.limit(0), 0, 0)

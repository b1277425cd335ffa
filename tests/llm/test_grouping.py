"""Grouped splits and score cutoffs against plain versions."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.llm.components import connected_components
from corpusflow.llm.cutoff import find_cutoffs, kept_records, score_fields, scored_records, wanted_rank
from corpusflow.llm.grouped_split import assign_splits, class_shares, place, split_shares, torn_groups

SEGMENTS = "uid string, recording_id string, speaker_id string, split string, source string, dialect string, label string, `group` string"
TARGETS = "split_name string, target_share double"


def parts(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(4)
    links = {
        "random": [(f"{rng.randint(0, 150):04d}", f"{rng.randint(0, 150):04d}") for _ in range(120)],
        "chain": [(f"{i:04d}", f"{i + 1:04d}") for i in range(400)],
        "star": [("hub", f"{i:04d}") for i in range(1500)] + [("hub2", "0007")],
        "empty": [],
    }[shape]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, "x"), ("y", None), ("z", "z")], "a string, b string").repartition(6)
    found = connected_components(df, "a", "b").collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == parts([p for p in links if p[0] != p[1]])


def segments(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SEGMENTS)


def test_torn_groups_and_edges(spark):
    rows = [
        ("u1", "r1", " Spk_A ", "train", "s", None), ("u2", "r2", "spk_a", "dev", "s", None), ("u3", "r2", "spk_b", "VALIDATION", "s", None), ("u4", "r3", "SPK_B", None, "s", None),
        ("u5", "r4", None, "train", "s", None), ("u6", "r4", " ", "test", "s", None), ("u7", "r5", "spk_c", "train", "s", None), ("u8", "r6", "spk_c", "other", "s", None),
        (None, "r6", "spk_c", "test", "s", None), ("u9", None, "spk_c", "train", "s", None), ("u1", "r1", " Spk_A ", "train", "s", None),
    ]
    found = torn_groups(segments(spark, rows)).collect()
    assert {(r["group_id"], r["recording_id"]) for r in found} == {("spk_a", "r1"), ("spk_a", "r2"), ("spk_a", "r3")}
    assert torn_groups(segments(spark, [])).count() == 0


def plainly_placed(groups, shares):
    """The placement one group after the other; a class is dealt out at its end."""
    names = sorted((s for s, x in shares.items() if x > 0), key=lambda s: (-shares[s], s))
    labels = {x for _, v in groups.values() for x in v} | {""}
    total = {x: sum((v.get(x, 0) if x else n) for n, v in groups.values()) for x in labels}
    held = {x: [0] * len(names) for x in total}
    open_groups, out = dict(groups), {}
    while open_groups:
        left = {x: sum((v.get(x, 0) if x else n) for n, v in open_groups.values()) for x in labels}
        rare = min((x for x, n in left.items() if n > 0 and x), key=lambda x: (left[x], x), default="")
        classes = {}
        for g, (n, v) in open_groups.items():
            if size := v.get(rare, 0) if rare else n:
                classes.setdefault((size, n), []).append(g)
        now, now_all = list(held[rare]), list(held[""])
        for (size, n), members in sorted(classes.items(), reverse=True):
            counts = [0] * len(names)
            for _ in members:
                fits = [i for i, a in enumerate(now_all) if shares[names[i]] * total[""] - a >= n] or range(len(names))
                i = min(fits, key=lambda i: (now[i] / shares[names[i]], i))
                counts[i] += 1
                now[i] += size
                now_all[i] += n
            md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
            vector = lambda g: md5(json.dumps([{"key": k, "value": x} for k, x in sorted(groups[g][1].items())], separators=(",", ":")))
            members.sort(key=lambda g: (vector(g)[:2], md5(g)[:2], vector(g), md5(g)))
            rest = members
            for name, k in zip(names, counts, strict=True):
                takes = [(i + 1) * k // len(rest) > i * k // len(rest) for i in range(len(rest))]
                out |= {g: name for g, t in zip(rest, takes, strict=True) if t}
                rest = [g for g, t in zip(rest, takes, strict=True) if not t]
        for g in [g for members in classes.values() for g in members]:
            n, v = open_groups.pop(g)
            for x, k in {**v, "": n}.items():
                held[x][names.index(out[g])] += k
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_group_is_placed_in_turn(spark, seed):
    rng = random.Random(seed)
    groups = {}
    for i in range(400):
        n = rng.choice([1, 1, 1, 2, 3, 8, 40])
        v = {x: k for x in ("source=a", "source=b", "dialect=X", "dialect=Y", "dialect=Z") if (k := rng.choice([0, 0, n, max(1, n // 2)]))}
        groups[f"g{i:03d}"] = (n, v if i % 50 else {})
    df = spark.createDataFrame([(g, n, v) for g, (n, v) in groups.items()], "group string, records bigint, counts map<string,bigint>").repartition(3)
    shares = {"train": 0.75, "val": 0.125, "test": 0.125, "none": 0.0}  # exact in binary, so ties are ties
    found = place(df, shares).collect()
    assert len(found) == len(groups)
    assert {r["group"]: r["new_split"] for r in found} == plainly_placed(groups, shares)


def test_classes_of_any_number():
    rng = random.Random(3)
    for _ in range(400):
        m = rng.randint(1, 4)
        held, held_all, shares = [rng.randint(0, 90) for _ in range(m)], [rng.randint(0, 200) for _ in range(m)], [rng.randint(1, 9) / 16 for _ in range(m)]
        size, total = rng.randint(1, 5), rng.randint(1, 900)
        records, n = size + rng.randint(0, 4), rng.randint(1, 120)
        now, now_all, counts = list(held), list(held_all), [0] * m
        for _ in range(n):
            fits = [i for i in range(m) if shares[i] * total - now_all[i] >= records] or range(m)
            i = min(fits, key=lambda i: (now[i] / shares[i], i))
            counts[i] += 1
            now[i] += size
            now_all[i] += records
        assert class_shares(size, records, n, held, held_all, shares, total) == counts and (held, held_all) == (now, now_all)
    assert class_shares(1, 1, 3 * 10**12, [0, 0], [0, 0], [0.75, 0.25], 3 * 10**12) == [2250 * 10**9, 750 * 10**9]


def test_assignment_keeps_groups_and_shares(spark):
    rng = random.Random(8)
    rows = [(f"u{i}", f"r{rng.randint(0, 250)}", rng.choice([None, f"s{rng.randint(0, 400)}"]), rng.choice(["train", "val", None]), rng.choice("abc"), rng.choice(["X", "Y", None])) for i in range(1500)]
    targets = spark.createDataFrame([("train", 0.7), ("val", 0.15), ("test", 0.15)], TARGETS)
    df = segments(spark, rows + rows[:50])
    out = assign_splits(df, targets)
    got = {r["uid"]: r for r in out.collect()}
    assert len(got) == out.count() == 1500
    group = parts([(f"1{r[1]}", f"0{r[2]}" if r[2] else f"1{r[1]}") for r in rows])
    by = {}
    for r in rows:
        by.setdefault(group[f"1{r[1]}"], set()).add(got[r[0]]["new_split"])
    assert all(len(s) == 1 for s in by.values())
    largest = max(sum(1 for r in rows if group[f"1{r[1]}"] == g) for g in by) / 1500
    for r in split_shares(out, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) <= max(0.01, largest)


def test_more_labels_than_any_limit(spark):
    rows = [(f"u{i}", None, None, None, "s", None) for i in range(300)]
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], TARGETS)
    df = segments(spark, rows).withColumn("dialect", F.concat(F.lit("d"), F.pmod(F.xxhash64("uid"), F.lit(12))))
    counts = {r["new_split"]: r["count"] for r in assign_splits(df, targets).groupBy("new_split").count().collect()}
    assert counts == {"train": 150, "test": 150}


def test_assignment_of_lone_records(spark):
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], TARGETS)
    out = assign_splits(segments(spark, [(f"u{i}", None, None, None, None, None) for i in range(10)]), targets)
    assert {r["new_split"]: r["count"] for r in out.groupBy("new_split").count().collect()} == {"train": 5, "test": 5}
    assert assign_splits(segments(spark, []), targets).count() == 0
    with pytest.raises(ValueError):
        assign_splits(segments(spark, []), spark.createDataFrame([("train", None)], TARGETS))


ROWS = "uid string, source string, a double, b double, score string, cutoff string, bin int"
CUTS = "source string, score_field string, target_fraction double"


def plain_cutoff(scores, fraction):
    if not scores or fraction <= 0:
        return None
    return sorted(scores, reverse=True)[math.ceil(fraction * len(scores) - 1e-9 * len(scores)) - 1]


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_cutoffs_are_exact(spark, bins):
    rng = random.Random(bins)
    scores = {"qasr": [round(rng.random(), 2) for _ in range(300)], "m c": [rng.random() ** 9 for _ in range(101)], "one": [0.5], "same": [0.25] * 9, "near": [0.1, 0.1 + 2e-17, math.nextafter(0.1, 1)]}
    rows = [(f"{s}{i}", s, x, None, "", "", 0) for s, xs in scores.items() for i, x in enumerate(xs)]
    targets = [(s.upper(), "a", f) for s in scores for f in [rng.choice([0.0625, 0.375, 0.5, 0.75, 1.0])]] + [("none", "a", 0.5), ("one", "b", 0.5), ("qasr", "b", 0.0)]
    df, cuts = spark.createDataFrame(rows, ROWS), spark.createDataFrame(targets, CUTS)
    found = {(r["source"], r["score_field"]): r["cutoff"] for r in find_cutoffs(scored_records(df, ["a", "b"]), cuts, bins).collect()}
    for source, field, fraction in targets:
        key = source.lower().replace(" ", "_")
        values = scores.get(source.lower(), []) if field == "a" else []
        assert found[(key, field)] == plain_cutoff(values, fraction)


def test_scored_rows_and_report(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("u1", " QASR ", 0.9, nan), ("u1", " QASR ", 0.9, nan), ("u2", "qasr", 0.9, 1.5), ("u3", "Qasr", 0.1, -0.1), ("u4", "qasr", None, inf), (None, "qasr", 0.99, 0.5), ("u5", None, 0.99, 0.5), ("u6", "qasr", 1.0, 0.0), ("u7", "qasr", 0.0, 1.0)]
    df = spark.createDataFrame([(*r, "", "", 0) for r in rows], ROWS)
    cuts = spark.createDataFrame([("q-a s r", "a", 0.5), ("qasr", "a", 0.4), ("qasr", "b", 0.5), ("zzz", "a", 0.5)], CUTS)
    kept, report = kept_records(df, cuts)
    assert {(r["score_field"], r["uid"]) for r in kept.collect()} == {("a", "u6"), ("a", "u1"), ("a", "u2"), ("b", "u7")}
    assert {(r["source"], r["score_field"]): (r["n_scored"], r["n_kept"]) for r in report.collect()} == {("qasr", "a"): (5, 3), ("qasr", "b"): (2, 1), ("zzz", "a"): (0, 0), ("q_a_s_r", "a"): (0, 0)}
    empty_kept, empty_report = kept_records(df.limit(0), cuts)
    assert empty_kept.count() == 0 and empty_report.filter("cutoff is not null").count() == 0
    assert kept_records(df, cuts.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        kept_records(df, spark.createDataFrame([("qasr", "zzz", 0.5)], CUTS))


def test_more_score_fields_than_a_thousand(spark):
    fields = [f"f{i:04d}" for i in range(1500)]
    assert score_fields(["uid", *fields], spark.createDataFrame([("s", f, 0.5) for f in fields], CUTS)) == fields


def test_hot_source(spark):
    df = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("uid"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"), ((F.col("id") * 7919) % 5000 / 5000.0).alias("a"))
    kept, _ = kept_records(df, spark.createDataFrame([("hot", "a", 0.25)], CUTS))
    assert kept.count() == math.ceil(0.25 * df.filter("source = 'hot'").count())


def test_wanted_rank_of_many_records(spark):
    known = [(0.001, 2_000_001, 2001), (0.001, 2_000_000, 2000), (0.1, 30, 3), (0.1, 3, 1), (5 / 6, 6, 5), (2 / 3, 3, 2), (0.07, 100, 7), (0.375, 10**9, 375 * 10**6), (0.123, 10**9 + 1, 123 * 10**6 + 1), (1.0, 7, 7), (0.0, 7, 0), (0.5, 0, 0), (1e-20, 5, 1), (0.1, 2 * 10**9, 2 * 10**8), (0.7, 2 * 10**9 + 1, 1_400_000_001), (0.375, 10**11, 375 * 10**8), (0.001, 10**11 + 1, 10**8 + 1)]
    rng = random.Random(2)
    drawn = [(f"0.{rng.randint(1, 9999):04d}", rng.randint(1, 10**9)) for _ in range(300)]
    known += [(float(f), n, -(-int(f[2:]) * n // 10**4)) for f, n in drawn]
    df = spark.createDataFrame([(i, f, n) for i, (f, n, _) in enumerate(known)], "i int, f double, n bigint")
    found = {r[0]: r[1] for r in df.select("i", wanted_rank(F.col("f"), F.col("n"))).collect()}
    assert found == {i: w for i, (_, _, w) in enumerate(known)}


def test_cutoff_of_many_records(spark):
    scored = spark.range(2_000_001).select(F.lit("s").alias("source"), F.lit("a").alias("score_field"), (F.col("id") / 2_000_001.0).alias("score"))
    cut = find_cutoffs(scored, spark.createDataFrame([("s", "a", 0.001)], CUTS)).first()
    assert cut["n_wanted"] == 2001 and scored.filter(F.col("score") >= cut["cutoff"]).count() == 2001

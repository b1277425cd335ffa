"""Overlaps, look-alikes, leaks and cut texts against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import leakage, lookalike, overlap, truncation
from corpusflow.llm.textforms import words

SEGMENTS = "uid string, transcript string, normalized_transcript string, split string, source string, key string, words string, n int, id int"


def segments(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1, 1) for r in rows], SEGMENTS)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def changed(rng, text, edits):
    out = text.split()
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.choice("arc")
        if kind == "a":
            out.insert(at, f"w{rng.randint(0, 99)}")
        elif kind == "r" and len(out) > 1:
            del out[at]
        else:
            out[at] = f"w{rng.randint(0, 99)}"
    return " ".join(out)


def test_word_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(2))
        pack = lambda ws: b"".join(w.encode() * 8 for w in ws)
        assert overlap.word_distance(pack(a), pack(b)) == edit(a, b)


def test_overlap_pairs(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 40))) for _ in range(60)]
    texts += [changed(rng, rng.choice(texts), rng.randint(0, 6)) for _ in range(140)]
    rows = [(f"u{i:03d}", t, None, rng.choice(["train", "TRAIN ", "val", "dev", "test", None, "other"]), rng.choice(["a", "A ", "b", None])) for i, t in enumerate(texts)]
    rows += [rows[0], ("z1", None, None, "train", "a"), ("z2", "", None, "test", "a"), (None, texts[1], None, "test", "a"), ("z3", "w1 " * 3000, None, "train", "a"), ("z4", "w1 " * 2900, None, "test", "b")]
    expected = {}
    side = {"train": "train", "TRAIN ": "train", "val": "val", "dev": "val", "test": "test"}
    known = {r[0]: (words(r[1]), side.get(r[3])) for r in rows if r[0] and r[1] and side.get(r[3]) and len(words(r[1])) >= 8}
    for a, (x, s) in known.items():
        for b, (y, t) in known.items():
            if s == "train" and t != "train" and abs(len(x) - len(y)) * 100 <= 15 * max(len(x), len(y)) and (d := edit(x, y) if len(x) < 999 else 100) * 100 <= 15 * max(len(x), len(y)):
                expected[(a, b)] = d
    found = overlap.cross_split_pairs(segments(spark, rows)).collect()
    assert len(found) == len({(r["train_uid"], r["eval_uid"]) for r in found})
    assert {(r["train_uid"], r["eval_uid"]): r["distance"] for r in found} == expected
    report = overlap.overlap_report(segments(spark, rows)).agg(F.sum("n_pairs"), F.sum("n_same"), F.sum("n_records")).first()
    assert tuple(report) == (len(expected), sum(d == 0 for d in expected.values()), len({b for _, b in expected}))
    links = {r["uid"]: r["n_links"] for r in overlap.linked_records(segments(spark, rows)).collect()}
    assert links == Counter(u for pair in expected for u in pair)
    assert overlap.cross_split_pairs(segments(spark, [])).count() == 0


def test_bands_cover_the_limit():
    for n in (8, 13, 14, 20, 27, 40, 200):
        k = overlap.edits_allowed(n)
        for rows in (2, 3, 4):
            for other in (n, n - k):
                bands = min(overlap.bands_needed(n, rows), overlap.bands_needed(other, rows))
                assert (1 - overlap.least_similarity(n) ** rows) ** bands <= overlap.MISS


def test_edits_spare_as_many_word_pairs_as_promised():
    rng = random.Random(12)
    for _ in range(400):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(8, 40))]
        b = changed(rng, " ".join(a), rng.randint(0, overlap.edits_allowed(len(a)))).split()
        n = max(len(a), len(b))
        if edit(a, b) <= overlap.edits_allowed(n) and len(b) > 1:
            x, y = (Counter(zip(t, t[1:], strict=False)) for t in (a, b))
            assert sum((x & y).values()) >= overlap.least_similarity(n) * sum((x | y).values()) - 1e-9


def test_values_in_a_band_grow_with_the_texts():
    assert [overlap.rows_needed(n) for n in (0, 30_000, 400_000, 3_000_000, 10**8, 10**10)] == [2, 2, 2, 3, 4, 4]


def test_hot_buckets_are_parted(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_BUCKET", 3)
    rng = random.Random(17)
    frame = " ".join(f"h{i}" for i in range(9))
    rows = [(f"u{i:03d}", f"{frame} " + " ".join(f"w{rng.randint(0, 5)}" for _ in range(rng.randint(1, 5))), None, rng.choice(["train", "train", "test"]), "a") for i in range(150)]
    known = {r[0]: (words(r[1]), r[3]) for r in rows}
    expected = {(a, b) for a, (x, s) in known.items() for b, (y, t) in known.items() if s == "train" and t == "test" and edit(x, y) * 100 <= 15 * max(len(x), len(y))}
    found = [(r["train_uid"], r["eval_uid"]) for r in overlap.cross_split_pairs(segments(spark, rows)).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 300


def test_one_text_held_by_a_third(spark):
    hot = " ".join(f"h{i}" for i in range(12))
    rows = [(f"t{i}", hot, None, "train", "a") for i in range(300)] + [(f"e{i}", hot + " x", None, "test", "a") for i in range(3)]
    rows += [(f"r{i}", " ".join(f"{i}q{j}" for j in range(9)), None, "train", "a") for i in range(300)]
    assert overlap.cross_split_pairs(segments(spark, rows)).count() == 900


def test_same_looking_pairs(spark):
    base = ["coffee نعم", "وليك هذا", "plain", "حتى", "٢٠ كتاب", "أكل", "ab", "A"]
    variants = ["соffее نعم", "cоffeе نعم", "coffee نعم", "ولیک ھذا", "وليك‏ هذا", "ｐlain", "حتی", "۲۰ كتاب", "أكل", "a​b", "a", "اكل", "cоffее نعم"]
    rows = [(f"u{i:02d}", t, t if i % 2 else None, "train", "a") for i, t in enumerate(base + variants + base)]
    rows += [rows[0], ("x1", None, "", "train", "a"), (None, "plain", "plain", "train", "a")]
    looks = {}
    classes = [{0, 8, 9, 10, 20, 21}, {1, 11, 12, 22}, {2, 13, 23}, {3, 14, 24}, {4, 15, 25}, {5, 16, 26}, {6, 17, 27}, {7, 28}, {18}, {19}]
    for k, members in enumerate(classes):
        looks |= dict.fromkeys(members, k)
    values = base + variants + base
    expected = set()
    for field, of in (("transcript", lambda i: True), ("normalized_transcript", lambda i: i % 2 == 1)):
        at = [i for i in range(len(values)) if of(i)]
        expected |= {(field, f"u{i:02d}", f"u{j:02d}") for i in at for j in at if i < j and looks[i] == looks[j] and values[i] != values[j]}
    found = [tuple(r) for r in lookalike.same_looking_pairs(segments(spark, rows), "uid", ["transcript", "normalized_transcript"]).collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected
    unified = lookalike.unified_texts(segments(spark, rows), "uid", ["transcript"]).filter("uid = 'u08'").first()["unified"]
    assert unified == "coffee نعم"
    assert lookalike.same_looking_pairs(segments(spark, []), "uid", ["transcript"]).count() == 0


def test_unknown_result_is_left_alone(spark):
    rows = [("u1", "zzоzz", None, None, None), ("u2", "zzоzz", None, None, None), ("u3", "zzoоz", None, None, None)]
    assert {r["unified"] for r in lookalike.unified_texts(segments(spark, rows), "uid", ["transcript"]).collect()} == {"zzоzz", "zzoоz"}


def test_words_of_one_script_stay(spark):
    texts = ["cop", "TOP", "كى", "сор", "ТОР", "کی", "СОР", "cор", "چای کی", "چای كى"]
    rows = [(f"u{i}", t, None, None, None) for i, t in enumerate(texts)]
    out = {r["uid"]: r for r in lookalike.unified_texts(segments(spark, rows), "uid", ["transcript"]).collect()}
    assert [out[f"u{i}"]["unified"] for i in range(len(texts))] == [*texts[:7], "cop", *texts[8:]]
    # On the page they are the same: only the key says so, and only where the twin is known.
    looks = [out[f"u{i}"]["key"] for i in range(len(texts))]
    assert looks[0] == looks[3] == looks[7] and looks[1] == looks[4] and looks[2] == looks[5] and looks[8] == looks[9] and len(set(looks)) == 5
    members = lookalike.same_looking_classes(segments(spark, rows), "uid", ["transcript"])
    links = {r["uid"]: (r["n_forms"], r["n_links"]) for r in lookalike.class_links(members).collect()}
    assert links == {"u0": (3, 2), "u3": (3, 2), "u7": (3, 2), "u1": (2, 1), "u4": (2, 1), "u2": (2, 1), "u5": (2, 1), "u8": (2, 1), "u9": (2, 1)}


DOCS = "doc_id bigint, text string, source string, item_id string, n_words int, token string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x") for r in rows], DOCS)


@pytest.mark.parametrize("shard", [50, 1_000_000])
def test_leaks(spark, monkeypatch, shard):
    monkeypatch.setattr(leakage, "SHARD_WORDS", shard)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 40 if shard == 50 else 300_000)
    rng = random.Random(11)
    item_texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 40))) for _ in range(12)]
    docs = []
    for i in range(80):
        text = [rng.choice("abcdefghxyz") for _ in range(rng.randint(0, 60))]
        if i % 4 == 0:
            piece = rng.choice(item_texts).split()
            a = rng.randrange(max(1, len(piece) - 6))
            text[5:5] = piece[a : a + rng.randint(6, 12)]
        docs.append((i, " ".join(text), "s"))
    docs += [(100, None, "s"), (101, "", "s"), (None, item_texts[0], "s"), (3, docs[3][1], "s"), (102, "a b c d e f g h " * 4000, "s")]
    items = spark.createDataFrame([*enumerate(item_texts), (None, "a b c d e f g h"), (99, None), (98, "a b c d e f g h a")], "item_id int, text string")
    grams = {}
    for i, t in [*enumerate(item_texts), (98, "a b c d e f g h a")]:
        w = t.split()
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(i)
    expected = {(d, i) for d, t, _ in docs if d is not None and t for w in [t.split()] for k in range(len(w) - 7) for i in grams.get(tuple(w[k : k + 8]), ())}
    df = documents(spark, docs)
    found = leakage.verbatim_matches(df, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    text = dict((d, t) for d, t, _ in docs if d is not None)
    item = dict([*enumerate(item_texts), (98, "a b c d e f g h a")])
    for r in found:
        a, b = text[r["doc_id"]].split(), item[r["item_id"]].split()
        x, y, n = r["doc_word"], r["item_word"], r["n_words"]
        assert a[x : x + n] == b[y : y + n] and n >= 8
        assert x + n == len(a) or y + n == len(b) or a[x + n] != b[y + n]
        assert x == 0 or y == 0 or a[x - 1] != b[y - 1]
    kept = {r["doc_id"] for r in leakage.without_leaks(df, items).collect()}
    assert kept == {d for d, *_ in docs} - {d for d, _ in expected}
    assert leakage.leaked(df.limit(0), items).count() == 0 and leakage.leaked(df, items.limit(0)).count() == 0


def test_prefix_counts(spark):
    rng = random.Random(3)
    vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))): rng.randint(1, 9) for _ in range(150)}
    tokens = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(80)} | {"a", "ab", "abc"}
    found = truncation.prefix_counts(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(list(vocabulary.items()), "word string, n bigint"))
    got = {r["token"]: (r["own"] or 0, r["below"]) for r in found.collect() if (r["own"] or 0) + r["below"] > 0}
    exact = {t: (vocabulary.get(t, 0), sum(n for w, n in vocabulary.items() if w.startswith(t) and w != t)) for t in tokens}
    assert got == {t: v for t, v in exact.items() if sum(v)}


def test_cut_texts(spark):
    rng = random.Random(21)
    lexicon = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(120)]
    long = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    rows = [(i, long(rng.randint(10, 40)) + ".", "S ") for i in range(200)]
    whole = [(1000 + i, long(rng.randint(10, 40)), "s") for i in range(5)]
    limited = [(2000 + i, long(80)[:300], "S") for i in range(25)]
    cut = []
    for i in range(6):
        word = next(w for w in lexicon if len(w) > 5 and w[:5] not in lexicon)
        cut.append((3000 + i, f"{long(12)} {word[:5]}", "other"))
    opened = [(4000, long(12) + " (" + long(3), "s"), (4001, long(12) + " (" + long(3) + ").", "s"), (4002, long(9) + " �", "s"), *((4003 + i, long(9) + ".\n#tag", "s") for i in range(3))]
    odd = [(5000, None, "s"), (5001, "", "s"), (None, "x", "s"), (5002, " ", None), (5003, ("word " * 200_000) + "end.", None)]
    df = documents(spark, rows + whole + limited + cut + opened + odd)
    found, report = truncation.truncated_documents(df)
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == {d for d, *_ in limited + cut} | {4000, 4002}
    assert all(got[d]["at_limit"] for d, *_ in limited) and all(got[d]["cut_word"] for d, *_ in cut)
    counts = {r["source"]: (r["n_documents"], r["n_cut"]) for r in report.collect()}
    assert counts["other"] == (6, 6) and counts[None] == (2, 0) and counts["s"] == (236, 27)
    assert truncation.truncated_documents(df.limit(0))[0].count() == 0


def test_rests_shorter_than_any_closed(spark):
    words = ["baker", "citadel", "fathom", "gondola", "lantern", "meadow", "pilgrim", "saddle"]
    some = lambda i, n: " ".join(words[(i + k) % len(words)] for k in range(n))
    closed = [(i, f"{some(i, 9)}. {some(i + 3, 3 + i % 5)}.", "s") for i in range(120)]
    dotted = [(1000 + i, f"{some(i, 9)}. {some(i, 1)}...", "s") for i in range(9)]
    few = [(2000 + i, f"{some(i, 9)}. {some(i, 5)}.", "few") for i in range(9)]
    cut = [(3000, f"{some(0, 9)}. {some(1, 1)}", "S"), (3001, f"{some(1, 12)}. {some(2, 2)}", "s")]
    cut += [(3002, f"{some(3, 9)}. {some(4, 2)}", "few"), (3003, f"{some(5, 9)}.\n{some(2, 1)}", "s")]
    signed = [(5000 + i, f"{some(i, 9)}.\nbaker desk", "s") for i in range(4)] + [(5004, f"{some(6, 9)}. (pilgrim.\n baker desk ", "s")]
    # Most texts of this source stay open, so an open end tells nothing there.
    never = [(6000 + i, f"{some(i, 9)}\n{some(i, 1 + i % 5)}", "open") for i in range(40)] + [(6100 + i, f"{some(i, 9)}. {some(i, 6)}.", "open") for i in range(9)]
    whole = never + [(4000, f"{some(2, 15)}. {some(3, 3)}", "s"), (4001, f"{some(3, 9)}. {some(4, 4)}", "none"), (4002, f"{some(4, 18)}. {some(5, 2)}...", "s")]
    found, _ = truncation.truncated_documents(documents(spark, closed + dotted + few + cut + whole + signed))
    got = {r["doc_id"]: r["short_rest"] for r in found.collect()}
    assert {d for d, short in got.items() if short} == {3000, 3001, 3002, 3003}
    assert not set(got) & {d for d, *_ in closed + few + whole + signed}


def test_planted_cuts_are_found(spark):
    """Cuts at a limit and inside words among texts of several habits: nearly all are found, and hardly any whole text."""
    rng = random.Random(33)
    lexicon = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choice(lexicon) for _ in range(rng.randint(4, 14)))
    rows, cut = [], set()
    for i in range(1500):
        source = rng.choice(["closes", "never closes", "limited"])
        mark = "" if source == "never closes" else "."
        text = (mark + " ").join(sentence() for _ in range(rng.randint(3, 12))) + mark
        if source == "limited" and len(text) > 420:
            text = text[:420]
            cut.add(i)
        elif rng.random() < 0.06:
            at = rng.randrange(len(text) // 2, len(text) - 2)
            while text[at - 1] in " ." or text[at] in " .":
                at -= 1  # inside a word
            text = text[:at]
            cut.add(i)
        elif rng.random() < 0.03:
            text = text.rstrip(".")
        rows.append((i, text, source))
    found = {r["doc_id"] for r in truncation.truncated_documents(documents(spark, rows))[0].collect()}
    assert len(found & cut) >= 0.95 * len(cut) and len(found & cut) >= 0.97 * len(found)


def test_open_pairs_need_no_letter_at_the_end(spark):
    start = "pilgrim saddle lantern meadow."
    cut = [f"{start} See {end}" for end in ("(12", "(baker, ", "(", "«", "[baker: 7", "(baker")]
    whole = [f"{start} See {end}" for end in ("(12)", "«baker»", "(baker, saddle.", "(baker?", "(baker\n♪", "baker, 12", "(1) [baker]", "(baker\n[end]", "(12...")]
    found, _ = truncation.truncated_documents(documents(spark, [(i, t, "s") for i, t in enumerate(cut + whole)]))
    assert {r["doc_id"] for r in found.filter("open_pair").collect()} == set(range(len(cut)))
    assert found.count() == len(cut)

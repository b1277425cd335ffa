"""Golden vectors of the text rules."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import chars, text


def apply(spark, form, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in rows.select("i", form(F.col("t"))).orderBy("i").collect()]


def test_full_form(spark):
    given = ["أكلتُ التفاحةَ، وقال: آهـــ!", "مرحبا [laugh] كيفك؟", "عندي ٣ كتب", "ﷺ ﻻ", "<noise> نعم $5 + 3", "a b‏c", None, ""]
    assert apply(spark, text.normalized_full, given) == ["اكلت التفاحة وقال اه", "مرحبا laugh كيفك", "عندي ٣ كتب", "صلى الله عليه وسلم لا", "<noise> نعم $5 + 3", "a b‏c", "", ""]


def test_other_forms(spark):
    assert apply(spark, text.normalized_segmenter, ["﻿أؤئةى‏ـب", None]) == ["اويهي ب", ""]
    assert apply(spark, text.normalized_basic, ["a.b، «c» `d`", None]) == ["a b «c» d", ""]
    assert apply(spark, text.normalized_loose, ["مرحـباً، `x` <y>", "a؝b"]) == ["مرحبا ` x ` <y>" if False else "مرحبا `x` <y>", "a b"]


def test_stripping(spark):
    assert apply(spark, text.stripped_v2, ["a <noise> b", "noises", "[x] y", None]) == ["a b", "s", "x y", ""]
    assert apply(spark, text.stripped_v3, ["a (b) [c] <d> e hesitation", ""]) == ["a e", ""]
    assert apply(spark, text.changed_v2, ["a noise", "[x]", None]) == [True, False, False]
    assert apply(spark, text.english_tokens, ["don't well-known x1", "عربي", None]) == [["don't", "well-known", "x"], [], []]


def test_flags(spark):
    values = ["abc", "٣", "[x]", "[]", None, ""]
    assert apply(spark, text.has_latin, values) == [True, False, True, False, False, False]
    assert apply(spark, text.has_digit, values) == [False, True, False, False, False, False]
    assert apply(spark, text.has_bracket_token, values) == [False, False, True, False, False, False]


def test_joined_tokens(spark):
    rows = spark.createDataFrame([(["قال", ":", "(", "نعم", ")", "", None, "."],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in rows.select(text.joined_tokens(F.col("t"))).collect()] == ["قال: (نعم).", "", ""]


def test_units(spark):
    assert apply(spark, text.word_units, ["a b  c", "", None]) == [["a", "b", "c"], [], []]
    assert apply(spark, text.char_units, ["a b\tc", None]) == ["ab\tc", ""]


@pytest.mark.parametrize(("pattern", "rule"), [(chars.WS, lambda c: c.isspace()), (chars.PUNCT, lambda c: unicodedata.category(c)[0] == "P")])
def test_character_classes_match_python(spark, pattern, rule):
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string")
    found = {r[0] for r in rows.filter(F.col("t").rlike(f"^{pattern}$")).select("c").collect()}
    assert found == {c for c in points if rule(chr(c))} - ({0} if 0 in found else set())

"""The forms of a text that the operators compare."""

import pytest

from corpusflow.llm import sql, textforms
from corpusflow.llm.textforms import has_lookalike, is_persian, plain_form, repaired, words


@pytest.mark.parametrize(
    ("a", "b"),
    [("ｆｉｌｅ", "file"), ("ﻟﻴﺶ", "ليش"), ("ﻻ", "لا"), ("a b", "a b"), ("a​b﻿", "ab"), ("é", "é"), ("أ", "أ"), ("بَّ", "بَّ"), ("", "")],
)
def test_same_look(a, b):
    assert plain_form(a) == plain_form(b)


@pytest.mark.parametrize(("a", "b"), [("أ", "ا"), ("ة", "ه"), ("a b", "a  b"), ("٤", "۴"), ("A", "a"), ("مـا", "ما"), ("²", "2"), ("a.", "a")])
def test_visible_differences(a, b):
    assert plain_form(a) != plain_form(b)


def test_repair():
    assert repaired("соffее") == ("coffee", True) and repaired("fіlе") == ("file", True)
    assert repaired("coffee") is None and repaired("пишу") is None and repaired("пор") is None
    assert repaired("ولیک") == ("وليك", True) and repaired("حتی") == ("حتى", True) and repaired("وليك") is None
    assert repaired("مدرسە") == ("مدرسه", True) and repaired("۲٤") == ("٢٤", True)
    assert repaired("ولیک", persian=True) == ("وليك", False) and is_persian("چ") and not is_persian("ولیک")
    assert has_lookalike("соffее") and not has_lookalike("coffee وليك")


def test_words_of_one_script_are_no_repair():
    assert repaired("сор") == ("cop", False) and repaired("ТОР") == ("TOP", False)
    assert repaired("کی") == ("كى", False) and repaired("۲۰") == ("٢٠", False)


def test_tables_agree_with_the_twins_tables():
    assert {c: to for c, to in textforms._SAME_LOOK.items() if textforms.unicodedata.category(c) != "Cn"} == sql._shapes()
    assert textforms.LATIN_LOOKALIKES | textforms.ARABIC_LOOKALIKES == sql._twins()
    for c in map(chr, [*range(1, 0xD800), *range(0xF900, 0xFFFE)]):
        if c not in textforms._SAME_LOOK and textforms.unicodedata.category(c) not in ("Cn", "Co"):
            assert textforms._FOLD[ord(c)] == (" " if c == " " else sql._among_words(c)), hex(ord(c))


def test_words():
    assert words("[laugh] قال: «مدرسةٌ» ﻟﻴﺶ؟ <noise x> ＯＫ-fine أولئك") == ["قال", "مدرسه", "ليش", "ok", "fine", "اوليك"]
    assert words("") == [] and words("[a] <b> …") == []
    assert words("مـ‏ا") == words("ما")
    assert words("ولیک ھذا") == words("وليك هذا")
    assert words("[open word") == ["open", "word"]

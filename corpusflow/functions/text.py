"""Text rules as Column functions; all but the compatibility normalisation stay in the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusflow.functions.chars import (
    ALEF_FORMS,
    ANGLE_SPAN,
    BASIC_PUNCT,
    BRACKET_TOKEN,
    DIACRITICS,
    DIGITS,
    ENGLISH_TOKEN,
    LATIN,
    LONE_BRACKETS,
    PLACEHOLDER,
    PUNCT,
    ROUND_SPAN,
    SQUARE_SPAN,
    TATWEEL,
    WS,
)

# Letters that the segmenter's form folds, marks it reads as blanks, and the tatweel it drops.
SEGMENTER_FROM, SEGMENTER_TO = "أإآٱىؤئة", "اااايويه"
MARKS_AS_BLANKS = "﻿‏‎"
# Tokens that take no blank before or after them.
NO_SPACE_BEFORE, NO_SPACE_AFTER = "،؛:,.!?؟)]}»", "([{'\"«"


def collapsed(col: Column) -> Column:
    """White space of any kind collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(col, WS + "+", " "))


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility normalisation, for which the JVM side has no function."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normalized_full(col: Column) -> Column:
    """The training form: compatibility form, one alef, no tatweel and marks, punctuation as blanks; null gives ''."""
    folded = F.translate(nfkc(F.coalesce(col, F.lit(""))), ALEF_FORMS + TATWEEL, "ا" * len(ALEF_FORMS))
    return collapsed(F.regexp_replace(F.regexp_replace(folded, DIACRITICS, ""), PUNCT, " "))


def normalized_segmenter(col: Column) -> Column:
    """The segmenter's form: letters folded, direction marks as blanks; vowel marks and punctuation stay."""
    read = F.translate(F.coalesce(col, F.lit("")), MARKS_AS_BLANKS, " " * len(MARKS_AS_BLANKS))
    return collapsed(F.translate(read, SEGMENTER_FROM + TATWEEL, SEGMENTER_TO))


def normalized_basic(col: Column) -> Column:
    """The evaluation's basic form: a fixed set of punctuation as blanks."""
    return collapsed(F.translate(collapsed(F.coalesce(col, F.lit(""))), BASIC_PUNCT, " " * len(BASIC_PUNCT)))


def normalized_loose(col: Column, tatweel: bool = True, diacritics: bool = True) -> Column:
    """The evaluation's loose form: all punctuation as blanks, and by choice no tatweel and no marks."""
    out = F.regexp_replace(collapsed(F.coalesce(col, F.lit(""))), PUNCT, " ")
    if tatweel:
        out = F.translate(out, TATWEEL, "")
    return collapsed(F.regexp_replace(out, DIACRITICS, "") if diacritics else out)


def has_latin(col: Column, letters: str = LATIN) -> Column:
    """Whether the raw text has a letter of the class; null has none."""
    return F.coalesce(col.rlike(letters), F.lit(False))


def has_digit(col: Column) -> Column:
    """Whether the raw text has a digit of the three shapes."""
    return F.coalesce(col.rlike(DIGITS), F.lit(False))


def has_bracket_token(col: Column) -> Column:
    """Whether the text has a filled bracket marker; it is reported and never drops a row."""
    return F.coalesce(col.rlike(BRACKET_TOKEN), F.lit(False))


def without_placeholders(col: Column) -> Column:
    """Placeholder words, with or without their brackets, as blanks."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), PLACEHOLDER, " ")


def without_spans(col: Column) -> Column:
    """Angle, square and round spans, in that order, as blanks."""
    out = F.coalesce(col, F.lit(""))
    for span in (ANGLE_SPAN, SQUARE_SPAN, ROUND_SPAN):
        out = F.regexp_replace(out, span, " ")
    return out


def stripped_v2(col: Column) -> Column:
    """Placeholders and then lone brackets removed."""
    return collapsed(F.regexp_replace(without_placeholders(col), LONE_BRACKETS, " "))


def stripped_v3(col: Column) -> Column:
    """Spans, placeholders and lone brackets removed."""
    return stripped_v2(without_spans(col))


def changed_v2(col: Column) -> Column:
    """Whether a placeholder was found."""
    return without_placeholders(col) != F.coalesce(col, F.lit(""))


def changed_v3(col: Column) -> Column:
    """Whether a span or placeholder was found."""
    return without_placeholders(without_spans(col)) != F.coalesce(col, F.lit(""))


def english_tokens(col: Column) -> Column:
    """Latin-letter tokens with inner hyphens and apostrophes."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(ENGLISH_TOKEN), F.lit(0))


def joined_tokens(tokens: Column) -> Column:
    """Tokens put together with blanks except before closing and after opening marks."""

    def step(text: Column, raw: Column) -> Column:
        token = F.regexp_replace(F.coalesce(raw, F.lit("")), f"^{WS}+|{WS}+$", "")
        closing = (F.length(token) == 1) & F.lit(NO_SPACE_BEFORE).contains(token)
        opened = F.lit(NO_SPACE_AFTER).contains(F.right(text, F.lit(1)))
        return F.when(token == "", text).when(text == "", token).when(closing | opened, F.concat(text, token)).otherwise(F.concat_ws(" ", text, token))

    return F.aggregate(F.coalesce(tokens, F.array().cast("array<string>")), F.lit(""), step)


def word_units(col: Column) -> Column:
    """The words of a text; an empty text has none."""
    text = collapsed(F.coalesce(col, F.lit("")))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def char_units(col: Column) -> Column:
    """The text without its plain blanks, compared character by character."""
    return F.replace(F.coalesce(col, F.lit("")), F.lit(" "), F.lit(""))

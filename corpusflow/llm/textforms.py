"""Forms of a text that the operators compare: what a reader sees, and the words in it.

These kernels run inside Arrow batches. Most texts hold no unusual character and
take the short path of one regular-expression search.
"""

from __future__ import annotations

import re
import unicodedata

# Characters that leave no mark on the page.
INVISIBLE = (0xAD, 0x61C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF)
# Blanks of another width.
BLANKS = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
# Letters of other scripts that print as these Latin letters.
LATIN_LOOKALIKES = dict(
    zip(
        "аеорсухѕіјԁһԛԝАВЕКМНОРСТХУЅІЈ" "οανικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxsijdhqwABEKMHOPCTXYSIJ" "oavikABEZHIKMNOPTYX",
        strict=True,
    )
)
# Letters of other Arabic-script alphabets and digits that print as these.
ARABIC_LOOKALIKES = dict(zip("کھہە۰۱۲۳۷۸۹", "كههه٠١٢٣٧٨٩", strict=True))
FARSI_YEH, YEH, ALEF_MAKSURA = "ی", "ي", "ى"
# Letters of the Persian and Urdu alphabets that look like no letter of Arabic.
PERSIAN_ONLY = "پچژگٹڈڑںے"
# Kinds of compatibility characters that differ from their plain form only in width or joining shape.
SAME_LOOK_KINDS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
# Letters folded together where words are compared.
LETTER_FOLD = dict(zip("أإآٱىئؤة", "ااااييوه", strict=True))


def _same_look() -> dict[str, str]:
    """Characters that look like another string, from the Unicode data: invisible ones, blanks, widths and joining shapes."""
    table = {chr(c): "" for c in INVISIBLE} | {chr(c): " " for c in BLANKS}
    for c in (*range(0xFB50, 0xFDF0), *range(0xFE70, 0xFEFD), *range(0xFF01, 0xFFEF)):
        parts = unicodedata.decomposition(chr(c)).split()
        if parts and parts[0] in SAME_LOOK_KINDS:
            plain = unicodedata.normalize("NFKC", chr(c))
            table[chr(c)] = plain[1:] if plain[0] == " " and len(plain) > 1 else plain
    return table


_SAME_LOOK = _same_look()
_UNUSUAL = re.compile("[" + "".join(f"\\U{ord(c):08x}" for c in _SAME_LOOK) + "]")
_LOOKALIKE = re.compile("[" + "".join((*LATIN_LOOKALIKES, *ARABIC_LOOKALIKES, FARSI_YEH)) + "]")
_PERSIAN_ONLY = re.compile(f"[{PERSIAN_ONLY}]")
_MARKER = re.compile(r"\[[^\]]*\]|<[^>]*>")
_YEH_INSIDE = re.compile(FARSI_YEH + r"(?=[\u064b-\u065f\u0670]*[\u0620-\u064a\u066e-\u06d3])")


def plain_form(text: str) -> str:
    """``text`` with width, joining shape, invisible characters and accent order brought to one form.

    No letter is replaced by a look-alike here; that needs the vocabulary (see ``lookalike``).
    """
    if text.isascii():
        return text
    if _UNUSUAL.search(text):
        text = _UNUSUAL.sub(lambda m: _SAME_LOOK[m[0]], text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def has_lookalike(text: str) -> bool:
    """Whether ``text`` holds a letter or digit that prints as one of another alphabet."""
    return _LOOKALIKE.search(text) is not None


def _arabic_fixed(token: str) -> str:
    if FARSI_YEH in token:  # dotted only where a letter follows
        token = _YEH_INSIDE.sub(YEH, token).replace(FARSI_YEH, ALEF_MAKSURA)
    return "".join(ARABIC_LOOKALIKES.get(c, c) for c in token)


def is_persian(text: str) -> bool:
    """Whether ``text`` has a letter of the Persian or Urdu alphabet that Arabic has no twin for, so their other letters are at home in it."""
    return _PERSIAN_ONLY.search(text) is not None


def repaired(token: str, persian: bool = False) -> tuple[str, bool] | None:
    """A token's form in its dominant script, and whether it is of mixed script; None where nothing is foreign.

    The dominant script is the one with most letters among those that print in no other
    script. Persian letters and digits in an Arabic token count as foreign, for the corpus
    spells them with the Arabic ones; in a ``persian`` text they are at home. A token that
    consists of look-alikes alone is a word of one script: its twin is given, marked as not mixed.
    """
    latin = arabic = other = western = eastern = 0
    for c in token:
        if c in LATIN_LOOKALIKES:
            western += 1
        elif c in ARABIC_LOOKALIKES or c == FARSI_YEH:
            eastern += 1
        elif c.isascii():
            latin += c.isalpha()
        elif 0x600 <= ord(c) < 0x700:
            arabic += c.isalnum()
        else:
            other += c.isalpha()
    if western and not eastern and not arabic and (latin > other or not latin + other):
        return "".join(LATIN_LOOKALIKES.get(c, c) for c in token), latin > 0
    if eastern and not western and not latin and not other:
        return _arabic_fixed(token), arabic > 0 and not persian
    return None


class _WordFold(dict):
    """Character to what it stands for among words: itself, a folded letter, nothing or a blank."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if c in LETTER_FOLD or c == FARSI_YEH:
            to = LETTER_FOLD.get(c, YEH)
        elif c in LATIN_LOOKALIKES or c in ARABIC_LOOKALIKES:
            to = (LATIN_LOOKALIKES.get(c) or ARABIC_LOOKALIKES[c]).lower()
        elif kind[0] in "LN":
            to = "" if c == "ـ" else c.lower()
        elif kind == "Mn" and unicodedata.bidirectional(c) == "NSM" and (0x0600 <= code < 0x0780 or 0x08A0 <= code < 0x0900):
            to = ""
        elif kind[0] == "M":
            to = c
        else:
            to = "" if kind == "Cf" else " "
        self[code] = to
        return to


_FOLD = _WordFold()


def words(text: str) -> list[str]:
    """The words of ``text`` under the project's reading rules.

    Markers in square or angle brackets are dropped; vowel marks, tatweel, letter case
    and invisible characters don't count; punctuation and symbols separate; look-alikes
    and the alef, yeh, waw and teh forms are folded.
    """
    text = plain_form(text)
    if "[" in text or "<" in text:
        text = _MARKER.sub(" ", text)
    return text.translate(_FOLD).split()

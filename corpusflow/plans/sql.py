"""Pieces of DuckDB SQL that say what the Column functions say."""

from __future__ import annotations

import unicodedata

from corpusflow.functions import chars


def quoted(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def swapped(expr: str, pattern: str, by: str = " ") -> str:
    """All matches of a pattern replaced."""
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(by)}, 'g')"


def collapsed(expr: str) -> str:
    """White space collapsed, none at the ends."""
    return f"trim({swapped(expr, chars.WS + '+')}, ' ')"


def has(expr: str, pattern: str) -> str:
    """Whether a pattern occurs; null counts as no."""
    return f"coalesce(regexp_matches({expr}, {quoted(pattern)}), false)"


def source_name(expr: str) -> str:
    """The canonical name of a source."""
    return f"translate(lower(trim({expr})), '- ', '__')"


def split_name(expr: str) -> str:
    """The canonical name of a split."""
    return f"(case when lower(trim({expr})) in ('dev', 'validation', 'val') then 'val' else lower(trim({expr})) end)"


def basic(expr: str) -> str:
    """The evaluation's basic form."""
    return collapsed(f"translate({collapsed(f'coalesce({expr}, {chr(39)*2})')}, {quoted(chars.BASIC_PUNCT)}, {quoted(' ' * len(chars.BASIC_PUNCT))})")


def loose(expr: str) -> str:
    """The evaluation's loose form."""
    return collapsed(swapped(swapped(swapped(collapsed(f"coalesce({expr}, '')"), chars.PUNCT), chars.TATWEEL, ""), chars.DIACRITICS, ""))


def compatibility_rows() -> str:
    """Rows ``(character, plain)`` of every compatibility character of the basic plane, from the Unicode data."""
    pairs = ((chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xA0, 0xFFFE) if not 0xAC00 <= c <= 0xDFFF)
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs if unicodedata.normalize("NFKC", a) != a)

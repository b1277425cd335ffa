"""Character classes as regular expressions that mean the same to Java and to the SQL oracle."""

from __future__ import annotations

# White space as Python's str.split sees it (Java's \s and RE2's \s are ASCII only).
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Unicode category P of version 15.1; the listed points are missing from Java 17's \p{P}.
PUNCT = (
    r"[\p{P}\x{061D}\x{1B7D}-\x{1B7E}\x{2E53}-\x{2E5D}\x{10F86}-\x{10F89}\x{116B9}\x{11B00}-\x{11B09}"
    r"\x{11F43}-\x{11F4F}\x{12FF1}-\x{12FF2}]"
)
# Arabic vowel and recitation marks; the letter folds of the two normalisations.
DIACRITICS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
TATWEEL = "ـ"
ALEF_FORMS = "أإآٱ"
LATIN = "[A-Za-z]"
DIGITS = "[0-9٠-٩۰-۹]"
# A filled bracket marker, and a Latin token with inner hyphens and apostrophes.
BRACKET_TOKEN = r"(\[[^\]]+\]|<[^>]+>)"
ENGLISH_TOKEN = r"[A-Za-z]+(?:[-'][A-Za-z]+)*"
# Placeholder words of the annotators, in their spellings.
PLACEHOLDER_WORDS = "hesitation|noise|unintelligible|unintelligable|unitlegable"
PLACEHOLDER = rf"(?i)(?:<|\[)?\s*(?:{PLACEHOLDER_WORDS})\s*(?:>|\])?"
LONE_BRACKETS = r"[\[\]<>]"
ANGLE_SPAN, SQUARE_SPAN, ROUND_SPAN = r"<[^>]*>", r"\[[^\]]*\]", r"\([^)]*\)"
# The punctuation the basic evaluation form replaces by a blank.
BASIC_PUNCT = ".,!?;:،؛؟\"'`“”‘’()[]{}<>/\\|*_+=~^%@#$&…-–—"

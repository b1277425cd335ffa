"""SQL twins of the training-data queries, for DuckDB.

They follow the statement of each problem by another way than the operators: closures
instead of components, all pairs instead of buckets, sets of word runs instead of suffix
arrays. They are meant for the small tables. Their character tables are made here from
the names in the Unicode data, so a mistake in the operators' tables shows.
"""

from __future__ import annotations

import unicodedata

_SOURCE = "translate(lower(trim(source)), '- ', '__')"
_SPLIT = "case when lower(trim(split)) in ('dev', 'validation', 'val') then 'val' else lower(trim(split)) end"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(pairs) -> str:
    return ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in pairs)


def _mapped(source: str, result: str, table: str, expr: str = "{}") -> str:
    """A table of texts with every character put through a map; ``expr`` wraps the result."""
    agg = expr.format("string_agg(coalesce(b, a), '' order by i)")
    return f"""{result}_cells as (select t, unnest(string_split(p, '')) as a, generate_subscripts(string_split(p, ''), 1) as i from {source}
), {result} as (select t, {agg} as p from {result}_cells left join {table} using (a) group by t)"""


# Names of letters that print as these.
_CYRILLIC = {
    "SMALL": "A a, IE e, O o, ER p, ES c, U y, HA x, DZE s, BYELORUSSIAN-UKRAINIAN I i, JE j, KOMI DE d, SHHA h, QA q, WE w",
    "CAPITAL": "A A, VE B, IE E, KA K, EM M, EN H, O O, ER P, ES C, TE T, HA X, U Y, DZE S, BYELORUSSIAN-UKRAINIAN I I, JE J",
}
_GREEK = {
    "SMALL": "OMICRON o, ALPHA a, NU v, IOTA i, KAPPA k",
    "CAPITAL": "ALPHA A, BETA B, EPSILON E, ZETA Z, ETA H, IOTA I, KAPPA K, MU M, NU N, OMICRON O, RHO P, TAU T, UPSILON Y, CHI X",
}
_ARABIC = {"KEHEH": "KAF", "HEH DOACHASHMEE": "HEH", "HEH GOAL": "HEH", "AE": "HEH"}
_SAME_DIGITS = ("ZERO", "ONE", "TWO", "THREE", "SEVEN", "EIGHT", "NINE")
# Names of letters that count as one among words.
_ONE_AMONG_WORDS = {
    "ALEF WITH HAMZA ABOVE": "ALEF", "ALEF WITH HAMZA BELOW": "ALEF", "ALEF WITH MADDA ABOVE": "ALEF", "ALEF WASLA": "ALEF", "ALEF MAKSURA": "YEH",
    "YEH WITH HAMZA ABOVE": "YEH", "FARSI YEH": "YEH", "WAW WITH HAMZA ABOVE": "WAW", "TEH MARBUTA": "HEH",
}
_VISIBLE_FORMATS = ("ARABIC NUMBER", "ARABIC SIGN", "ARABIC FOOTNOTE", "ARABIC END", "ARABIC POUND", "ARABIC PIASTRE", "ARABIC DISPUTED", "SYRIAC", "INTERLINEAR")
_FORMS = (" ISOLATED FORM", " FINAL FORM", " MEDIAL FORM", " INITIAL FORM")


def _arabic(name: str) -> str:
    return unicodedata.lookup(f"ARABIC LETTER {name}")


def _twins() -> dict[str, str]:
    """Letters and digits that print as others, the dotless or dotted yeh apart."""
    out = {}
    for script, sizes in (("CYRILLIC", _CYRILLIC), ("GREEK", _GREEK)):
        for size, pairs in sizes.items():
            for name, latin in (pair.rsplit(" ", 1) for pair in pairs.split(", ")):
                out[unicodedata.lookup(f"{script} {size} LETTER {name}")] = latin
    digits = {unicodedata.lookup(f"EXTENDED ARABIC-INDIC DIGIT {n}"): unicodedata.lookup(f"ARABIC-INDIC DIGIT {n}") for n in _SAME_DIGITS}
    return out | {_arabic(a): _arabic(b) for a, b in _ARABIC.items()} | digits


def _shapes() -> dict[str, str]:
    """Characters that differ from others in width or joining shape only, or leave nothing on the page."""
    out = {}
    for c in map(chr, range(0x80, 0xFFFE)):
        kind, name = unicodedata.category(c), unicodedata.name(c, "")
        if kind == "Zs":
            out[c] = " "
        elif kind == "Cf" and not name.startswith(_VISIBLE_FORMATS):
            out[c] = ""
        elif name.startswith(("FULLWIDTH", "HALFWIDTH", "ARABIC TATWEEL WITH")) or (name.startswith("ARABIC") and name.endswith(_FORMS)):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and not 0xFDF0 <= ord(c) < 0xFE00:  # ligatures of whole words have a shape of their own
                out[c] = plain.removeprefix(" ") if len(plain) > 1 else plain
    return out


def _among_words(c: str) -> str:
    """What a character stands for among words."""
    kind = unicodedata.category(c)
    one = {_arabic(a): _arabic(b) for a, b in _ONE_AMONG_WORDS.items()}
    if c in one or c in _twins():
        return one.get(c) or _twins()[c].lower()
    if unicodedata.name(c, "") == "ARABIC TATWEEL" or kind == "Cf":
        return ""
    if kind[0] in "LN":
        return c.lower()
    if kind == "Mn" and (0x600 <= ord(c) < 0x780 or 0x8A0 <= ord(c) < 0x900):
        return ""
    return c if kind[0] == "M" else " "


def _look() -> str:
    return f"look(a, b) as (values {_values(_shapes().items())})"


def _fold() -> str:
    """What each assigned character stands for among words, where that isn't itself."""
    codes = [*range(1, 0xD800), *range(0xF900, 0xFFFE), *range(0x1F000, 0x1FB00)]
    twins, one = _twins(), {_arabic(a) for a in _ONE_AMONG_WORDS}
    letters = (c for c in map(chr, codes) if unicodedata.category(c) not in ("Cn", "Co", "Lo", "Ll") or c in twins or c in one)
    pairs = ((c, _among_words(c)) for c in letters if c != " ")
    return f"fold(a, b) as (values {_values((a, b) for a, b in pairs if a != b)})"


def _words(texts: str) -> str:
    """The words of every text of a query giving ``t``, as table ``worded(t, ws)``."""
    return f"""{_look()}, {_fold()}, given as (select distinct t, t as p from ({texts}) where t is not null and t != ''
), {_mapped('given', 'plain', 'look', 'nfc_normalize({})')}, unmarked as (select t, regexp_replace(p, '\\[[^\\]]*\\]|<[^>]*>', ' ', 'g') as p from plain
), {_mapped('unmarked', 'folded', 'fold')}, worded as (select t, list_filter(string_split(p, ' '), lambda x: x != '') as ws from folded)"""


_SCORED = f"""
with names as (
  select uid, min({_SOURCE}) as source,
    max(case when text_target_label_score between 0 and 1 and not isnan(text_target_label_score) then text_target_label_score end) as text_target_label_score,
    max(case when top_score between 0 and 1 and not isnan(top_score) then top_score end) as top_score
  from row_probabilities where uid is not null and source is not null group by uid
), scored as (
  select uid, source, 'text_target_label_score' as score_field, text_target_label_score as score from names where text_target_label_score is not null
  union all select uid, source, 'top_score', top_score from names where top_score is not null
), targets as (
  select {_SOURCE} as source, score_field, target_fraction from cutoff_targets
), ranked as (
  select s.*, t.target_fraction, row_number() over (partition by s.source, s.score_field order by score desc) as place,
    count(*) over (partition by s.source, s.score_field) as n_scored
  from scored s join targets t using (source, score_field)
), cutoffs as (
  select source, score_field, target_fraction, n_scored, max(score) as cutoff
  from ranked where place >= target_fraction * n_scored - 1e-9 group by all
)
"""

_TORN = f"""
with recursive rows as (select recording_id, nullif(lower(trim(speaker_id)), '') as spk, {_SPLIT} as part from segments where uid is not null
), links as (select distinct recording_id, spk from rows where recording_id is not null and spk is not null
), reach as (
  select recording_id, spk from links
  union
  select r.recording_id, far.spk from reach r join links near on r.spk = near.spk join links far on near.recording_id = far.recording_id
), named as (select recording_id, min(spk) as group_id from reach group by recording_id
), torn as (
  select group_id from named join rows using (recording_id) where part in ('train', 'val', 'test') group by group_id having count(distinct part) >= 2
)
select group_id, recording_id from named join torn using (group_id)"""


def _overlaps() -> str:
    # Distinct words of a pair become single letters, for the engine's distance counts bytes; a pair holds fewer than 95 here.
    code = "array_to_string(list_transform({}, lambda w: chr((32 + list_position(known, w))::int)), '')"
    return f"""
with {_words('select transcript as t from segments')}, records as (
  select uid, any_value({_SPLIT}) as part, any_value(ws) as ws from segments join worded on transcript = t where uid is not null group by uid
), long as (select *, len(ws) as n from records where len(ws) >= 8 and part in ('train', 'val', 'test')
), pairs as (
  select a.uid as x, b.uid as y, a.ws as xs, b.ws as ys, greatest(a.n, b.n) * 15 as most, list_distinct(list_concat(a.ws, b.ws)) as known
  from long a join long b on a.part = 'train' and b.part != 'train' and abs(a.n - b.n) * 100 <= 15 * greatest(a.n, b.n)
  where len(list_intersect(a.ws, b.ws)) * 2 >= least(len(list_distinct(a.ws)), len(list_distinct(b.ws)))
)
select least(x, y) as uid_a, greatest(x, y) as uid_b from pairs where levenshtein({code.format('xs')}, {code.format('ys')}) * 100 <= most"""


def _same_look() -> str:
    farsi, yeh, bare = _arabic("FARSI YEH"), _arabic("YEH"), _arabic("ALEF MAKSURA")
    inside = "regexp_replace(@, '" + farsi + r"([\x{064b}-\x{065f}\x{0670}]*[\x{0620}-\x{064a}\x{066e}-\x{06d3}])', '" + yeh + r"\1', 'g')"
    twins = _twins() | {farsi: bare}
    skeleton = f"translate({inside.replace('@', inside.replace('@', 'p'))}, {_quoted(''.join(twins))}, {_quoted(''.join(twins.values()))})"
    return f"""
with {_look()}, cells as (
  select distinct 'transcript' as field, uid, transcript as t from segments where uid is not null and transcript != ''
  union select 'normalized_transcript', uid, normalized_transcript from segments where uid is not null and normalized_transcript != ''
), given as (select distinct t, t as p from cells), {_mapped('given', 'plain', 'look', 'nfc_normalize({})')}, seen as (select field, uid, t, {skeleton} as k from cells join plain using (t))
select a.field, a.uid as uid_a, b.uid as uid_b from seen a join seen b on a.field = b.field and a.k = b.k and a.t != b.t and a.uid < b.uid"""


def _leaks() -> str:
    runs = "unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) as run"
    return f"""
with {_words('select text as t from documents union all select text from eval_items')}, of_documents as (
  select distinct doc_id, {runs} from documents join worded on text = t where doc_id is not null and len(ws) >= 8
), of_items as (select distinct item_id, {runs} from eval_items join worded on text = t where item_id is not null and len(ws) >= 8)
select distinct doc_id, item_id from of_documents join of_items using (run)"""


def _matches() -> str:
    """Longest runs: matching runs of eight words that follow each other on one diagonal are one."""
    places = "unnest(range(1, len(ws) - 6)) as place"
    run = "array_to_string(ws[place:place + 7], ' ') as run"
    return f"""
with {_words('select text as t from documents union all select text from eval_items')}, of_documents as (
  select doc_id, place as d, {run} from (select doc_id, ws, {places} from documents join worded on text = t where doc_id is not null and len(ws) >= 8)
), of_items as (select item_id, place as i, {run} from (select item_id, ws, {places} from eval_items join worded on text = t where item_id is not null and len(ws) >= 8)
), met as (select doc_id, item_id, d, i, d - row_number() over (partition by doc_id, item_id, d - i order by d) as island from of_documents join of_items using (run))
select doc_id, item_id, min(d) - 1 as doc_word, min(i) - 1 as item_word, count(*) + 7 as n_words from met group by doc_id, item_id, d - i, island"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {
        "p1_found": _TORN,
        "p3_found": _SCORED + "select score_field, uid from scored join cutoffs using (source, score_field) where score >= cutoff",
        "p3_report": _SCORED
        + """select source, score_field, c.target_fraction, n_scored, cutoff, count(*) as n_kept, count(*) / n_scored as kept_fraction
from scored join cutoffs c using (source, score_field) where score >= cutoff group by 1, 2, 3, 4, 5""",
        "p4_found": _overlaps(),
        "p4_report": f"""
with found as ({_overlaps()}), parts as (
  select uid, any_value({_SPLIT}) as split, any_value({_SOURCE}) as source, any_value(transcript) as t from segments where uid is not null group by uid
), sided as (
  select h.uid, h.split, h.source, h.t, o.t as o from found join parts h on h.uid in (uid_a, uid_b) and h.split != 'train'
  join parts o on o.uid = case when h.uid = uid_a then uid_b else uid_a end
), {_words('select transcript as t from segments').replace('worded as', 'worded2 as')}
select split, source, count(distinct uid) as n_records, count(*) as n_pairs, count_if(a.ws = b.ws)::bigint as n_same
from sided join worded2 a on sided.t = a.t join worded2 b on sided.o = b.t group by all""",
        "p5_found": _same_look(),
        "p6_found": _leaks(),
        "p6_matches": _matches(),
        "p6_clean": f"select doc_id, source, n_chars from documents where doc_id not in (select doc_id from ({_leaks()}))",
    }

"""Queries on text forms, tokens and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import chars, text
from corpusflow.operators import audit
from corpusflow.plans import sql
from corpusflow.plans.tables import table


def _form(spark: SparkSession, folder: str, form, column: str = "transcript") -> DataFrame:
    return table(spark, folder, "segments").select("uid", "ingested_at", form(F.col(column)).alias("form"))


def normalize_full(spark: SparkSession, folder: str) -> DataFrame:
    """The training form of every transcript."""
    return _form(spark, folder, text.normalized_full)


def normalize_segmenter(spark: SparkSession, folder: str) -> DataFrame:
    """The segmenter's form of every transcript."""
    return _form(spark, folder, text.normalized_segmenter)


def normalize_basic(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation's basic form."""
    return _form(spark, folder, text.normalized_basic)


def normalize_loose(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation's loose form."""
    return _form(spark, folder, text.normalized_loose)


def collapse_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with white space collapsed, by the hash of the text."""
    return table(spark, folder, "documents").select("doc_id", F.md5(text.collapsed(F.col("text"))).alias("text_md5"))


def _documents(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", *(c.alias(n) for n, c in columns.items()))


def strip_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without placeholder words and lone brackets."""
    return _documents(spark, folder, text_md5=F.md5(text.stripped_v2(F.col("text"))), changed=text.changed_v2(F.col("text")))


def strip_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without spans, placeholders and lone brackets."""
    return _documents(spark, folder, text_md5=F.md5(text.stripped_v3(F.col("text"))), changed=text.changed_v3(F.col("text")))


def recover_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows dropped for Latin letters that come back once their spans are gone."""
    dropped = table(spark, folder, "segments").filter(text.has_latin(F.col("transcript")))
    return audit.recovered(dropped, "transcript").select("uid", "ingested_at", "stripped", "flag_number")


def english_tokens_by_field_shard(spark: SparkSession, folder: str) -> DataFrame:
    """Latin tokens over all, by field, by shard, and by both."""
    return audit.token_audit(table(spark, folder, "segments"), ["transcript", "normalized_transcript", "prompt"], "source_file")


def english_tokens_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Latin tokens over all with their place in the order of their letters."""
    return audit.tokens_in_order(english_tokens_by_field_shard(spark, folder))


def top_examples_per_shard(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten documents of each shard that hold a Latin letter."""
    rows = table(spark, folder, "documents").filter(text.has_latin(F.col("text")))
    return audit.first_examples(rows, "source_file", [F.col("doc_id")], 10).select("source_file", "doc_id", "place", F.substring("text", 1, 160).alias("preview"))


def join_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of transcripts, marks apart, put together again."""
    # Marks become tokens of their own, as annotation files have them.
    parts = F.split(text.collapsed(F.regexp_replace("transcript", r"([،؛؟.,!?:()«»\[\]])", " $1 ")), " ")
    return table(spark, folder, "segments").select("uid", "ingested_at", text.joined_tokens(parts).alias("joined"))


def unit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words and characters as the error rates count them."""
    return table(spark, folder, "segments").select("uid", "ingested_at", F.size(text.word_units(F.col("transcript"))).alias("n_words"), F.length(text.char_units(F.col("transcript"))).alias("n_chars"))


def _placeholders(expr: str) -> str:
    return sql.swapped(expr, chars.PLACEHOLDER)


def _spans(expr: str) -> str:
    return sql.swapped(sql.swapped(sql.swapped(expr, chars.ANGLE_SPAN), chars.SQUARE_SPAN), chars.ROUND_SPAN)


_SEGMENTER = f"translate(translate(coalesce(transcript, ''), {sql.quoted(text.MARKS_AS_BLANKS)}, '   '), {sql.quoted(text.SEGMENTER_FROM + chars.TATWEEL)}, {sql.quoted(text.SEGMENTER_TO)})"
_FULL_FOLDED = f"translate(nfc_normalize(plain), {sql.quoted(chars.ALEF_FORMS + chars.TATWEEL)}, {sql.quoted('ا' * len(chars.ALEF_FORMS))})"
_AUDIT_TOKENS = f"""
with cells as (
  select source_file as shard, 'transcript' as field, transcript as t from segments
  union all select source_file, 'normalized_transcript', normalized_transcript from segments
), tokens as (select shard, field, unnest(regexp_extract_all(coalesce(t, ''), {sql.quoted(chars.ENGLISH_TOKEN)})) as token from cells)
"""

QUERIES = {
    f.__name__: f
    for f in (
        normalize_full, normalize_segmenter, normalize_basic, normalize_loose, collapse_whitespace, strip_placeholders, strip_spans, recover_rows,
        english_tokens_by_field_shard, english_tokens_in_order, top_examples_per_shard, join_tokens, unit_counts,
    )
}


def _sql() -> dict[str, str]:
    full = sql.collapsed(sql.swapped(sql.swapped(_FULL_FOLDED, chars.DIACRITICS, ""), chars.PUNCT))
    return {
        "normalize_full": f"""
with plain_of(a, b) as (values {sql.compatibility_rows()}), texts as (
  select distinct transcript as t from segments where transcript is not null and transcript != ''
), cells as (select t, unnest(string_split(t, '')) as a, generate_subscripts(string_split(t, ''), 1) as i from texts
), mapped as (select t, string_agg(coalesce(b, a), '' order by i) as plain from cells left join plain_of using (a) group by t)
select uid, ingested_at, case when plain is null then '' else {full} end as form from segments left join mapped on transcript = t""",
        "normalize_segmenter": f"select uid, ingested_at, {sql.collapsed(_SEGMENTER)} as form from segments",
        "normalize_basic": f"select uid, ingested_at, {sql.basic('transcript')} as form from segments",
        "normalize_loose": f"select uid, ingested_at, {sql.loose('transcript')} as form from segments",
        "collapse_whitespace": f"select doc_id, md5({sql.collapsed('text')}) as text_md5 from documents",
        "strip_placeholders": f"""select doc_id, md5({sql.collapsed(sql.swapped(_placeholders("text"), chars.LONE_BRACKETS))}) as text_md5, {_placeholders("text")} != text as changed from documents""",
        "strip_spans": f"""select doc_id, md5({sql.collapsed(sql.swapped(_placeholders(_spans("text")), chars.LONE_BRACKETS))}) as text_md5,
  {_placeholders(_spans("text"))} != text as changed from documents""",
        "recover_rows": f"""with bare as (select uid, ingested_at, {sql.collapsed(_spans("transcript"))} as stripped from segments where {sql.has('transcript', chars.LATIN)})
select uid, ingested_at, stripped, {sql.has('stripped', chars.DIGITS)} as flag_number from bare where not {sql.has('stripped', chars.LATIN)}""",
        "english_tokens_by_field_shard": _AUDIT_TOKENS
        + """select case grouping(shard) * 2 + grouping(field) when 3 then 'all' when 2 then 'field' when 1 then 'shard' else 'shard_field' end as level,
  field, shard, token, count(*) as n from tokens group by grouping sets ((token), (field, token), (shard, token), (shard, field, token))""",
        "english_tokens_in_order": _AUDIT_TOKENS + "select token, count(*) as n, row_number() over (order by token) as place from tokens group by token",
        "top_examples_per_shard": f"""select source_file, doc_id, row_number() over (partition by source_file order by doc_id)::int as place, substring(text, 1, 160) as preview
from documents where {sql.has('text', chars.LATIN)} qualify row_number() over (partition by source_file order by doc_id) <= 10""",
        "unit_counts": f"""select uid, ingested_at, (case when {sql.collapsed("coalesce(transcript, '')")} = '' then 0
  else len(string_split({sql.collapsed("coalesce(transcript, '')")}, ' ')) end)::int as n_words, length(replace(coalesce(transcript, ''), ' ', ''))::int as n_chars from segments""",
        "join_tokens": f"""
with recursive parts as (
  select uid, ingested_at, list_filter(string_split({sql.collapsed("regexp_replace(coalesce(transcript, ''), '([،؛؟.,!?:()«»\\[\\]])', ' \\1 ', 'g')")}, ' '), lambda x: x != '') as p
  from segments
), walk as (
  select uid, ingested_at, p, 1 as i, coalesce(p[1], '') as joined from parts
  union all
  select uid, ingested_at, p, i + 1, case
    when (length(p[i + 1]) = 1 and contains({sql.quoted(text.NO_SPACE_BEFORE)}, p[i + 1])) or contains({sql.quoted(text.NO_SPACE_AFTER)}, right(joined, 1)) then joined || p[i + 1]
    else joined || ' ' || p[i + 1] end
  from walk where i < len(p)
)
select uid, ingested_at, joined from walk where i >= len(p)""",
    }


SQL = _sql()

"""Queries on the training-data operators; their SQL twins are in ``sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import cutoff, grouped_split, leakage, lookalike, mixture, overlap, sql, truncation


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings of groups whose rows stand in two or more splits."""
    return grouped_split.torn_groups(_table(spark, folder, "segments")).select("group_id", "recording_id")


def p1_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """One split for every record, the same for a whole group."""
    return grouped_split.assign_splits(_table(spark, folder, "segments"), _table(spark, folder, "split_targets"))


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each split."""
    return grouped_split.split_shares(p1_assigned(spark, folder), _table(spark, folder, "split_targets"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that the cutoff of their source keeps, per score field."""
    kept, _ = cutoff.kept_records(_table(spark, folder, "row_probabilities"), _table(spark, folder, "cutoff_targets"))
    return kept.select("score_field", "uid")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Cutoff and kept size of each source and score field."""
    return cutoff.kept_records(_table(spark, folder, "row_probabilities"), _table(spark, folder, "cutoff_targets"))[1]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a train record and a val or test record of nearly the same words, smaller uid first."""
    pairs = overlap.cross_split_pairs(_table(spark, folder, "segments"))
    return pairs.select(F.least("train_uid", "eval_uid").alias("uid_a"), F.greatest("train_uid", "eval_uid").alias("uid_b"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per held-out split and source."""
    return overlap.overlap_report(_table(spark, folder, "segments"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a partner across splits: their class and their number of links."""
    return overlap.linked_records(_table(spark, folder, "segments"))


_TEXT_FIELDS = ["transcript", "normalized_transcript"]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records whose texts look the same but are stored differently."""
    return lookalike.same_looking_pairs(_table(spark, folder, "segments"), "uid", _TEXT_FIELDS)


def p5_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the two fields in its one form, and the key of what a reader sees."""
    texts = lookalike.unified_texts(_table(spark, folder, "segments"), "uid", _TEXT_FIELDS)
    return texts.select("field", "uid", "unified", F.lower(F.hex("key")).alias("look_key"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a same-looking twin: their class and their number of links."""
    return lookalike.class_links(lookalike.same_looking_classes(_table(spark, folder, "segments"), "uid", _TEXT_FIELDS))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the held-out items of which they hold a passage."""
    return leakage.leaked(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p6_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every longest verbatim run with its places."""
    return leakage.verbatim_matches(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are left without the affected ones."""
    return leakage.without_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("doc_id", "source", "n_chars")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen uses of documents in the order of their virtual finish times."""
    return mixture.mix_sources(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[0]


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    """How often each chosen document is used."""
    return p7_mix(spark, folder).groupBy("doc_id", "source").agg(F.count("*").alias("n_uses"), F.sum("n_tokens").alias("used_tokens"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture.mix_sources(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.truncated_documents(_table(spark, folder, "documents"))[0].select("doc_id")


def p8_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Cut documents with what shows it."""
    return truncation.truncated_documents(_table(spark, folder, "documents"))[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut documents per source."""
    return truncation.truncated_documents(_table(spark, folder, "documents"))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this module by name."""
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return sql.oracle_sql()

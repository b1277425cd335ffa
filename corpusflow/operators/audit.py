"""Token audits, merges of roots, recovery and guarded replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.text import changed_v3, collapsed, english_tokens, has_digit, has_latin, without_spans
from corpusflow.sizing import prefix_totals


def token_audit(df: DataFrame, fields: Sequence[str], shard: str) -> DataFrame:
    """``level, field, shard, token, n``: Latin tokens counted over all, by field, by shard and by both.

    Fields a table lacks are left out. Counts are combined before the shuffle.
    """
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields if f in df.columns))
    tokens = df.select(F.col(shard).alias("shard"), F.inline(cells)).select("shard", "field", F.explode(english_tokens(F.col("text"))).alias("token"))
    counted = tokens.groupBy("shard", "field", "token").agg(F.count("*").alias("n"))
    sets = [(), ("field",), ("shard",), ("shard", "field")]
    sets = [[*(F.col(c) for c in s), F.col("token")] for s in sets]
    out = counted.groupingSets(sets, "shard", "field", "token").agg(F.sum("n").alias("n"), F.grouping_id("shard", "field", "token").alias("gid"))
    level = F.element_at(F.create_map(*(F.lit(x) for k, v in {6: "all", 4: "field", 2: "shard", 0: "shard_field"}.items() for x in (k, v))), F.col("gid").cast("int"))
    return out.select(level.alias("level"), "field", "shard", "token", "n")


def tokens_in_order(audit: DataFrame) -> DataFrame:
    """``token, n, place``: the tokens counted over all, in the order of their code points, without one sort task for all."""
    overall = audit.filter("level = 'all'").select("token", "n", F.substring("token", 1, 2).alias("_head"), F.lit(1).alias("_one"))
    return prefix_totals(overall, [], "_head", [F.col("token")], "_one", "place").select("token", "n", "place")


def first_examples(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their ``place`` from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def merged_roots(roots: dict[str, DataFrame], file: str) -> DataFrame:
    """All roots' rows with ``root``; a file named in two roots raises when the plan runs."""
    tagged = [df.withColumn("root", F.lit(name)) for name, df in roots.items()]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    clash = out.groupBy(file).agg(F.count_distinct("root").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    # The assertion stands in a filter, for an unused column would be pruned with it.
    return out.filter(F.assert_true(clash.scalar() <= 1, F.lit("a file is in two roots")).isNull())


def recovered(dropped: DataFrame, text: str) -> DataFrame:
    """Dropped rows whose text has no Latin letter once its spans are gone; digits are flagged and do not gate."""
    raw = F.col(text)
    bare = collapsed(without_spans(raw))
    out = dropped.withColumns({"stripped": bare, "flag_number": has_digit(bare), "flag_span": changed_v3(raw)})
    return out.filter(~has_latin(F.col("stripped")))


def replaced_subset(table: DataFrame, subset: Column, *parts: DataFrame, expected: int | None = None) -> DataFrame:
    """``table`` without the rows of ``subset``, plus ``parts``; a count other than ``expected`` raises when the plan runs."""
    new = parts[0]
    for p in parts[1:]:
        new = new.unionByName(p, allowMissingColumns=True)
    kept = table.filter(~F.coalesce(subset, F.lit(False)))
    if expected is not None:
        right = F.assert_true(new.agg(F.count("*").alias("n")).scalar() == expected, F.lit("the parts have another number of rows"))
        kept, new = kept.filter(right.isNull()), new.filter(right.isNull())
    return kept.unionByName(new, allowMissingColumns=True)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")

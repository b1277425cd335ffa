"""Reading rules shared by all tables: names of sources, splits and speakers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.chars import WS


def outer_trimmed(col: Column) -> Column:
    """``col`` without leading and trailing white space of any width."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def source_name(col: Column) -> Column:
    """Lower case, outer blanks dropped, ``-`` and blank read as ``_``; null stays null."""
    return F.translate(F.lower(outer_trimmed(col)), "- ", "__")


def split_name(col: Column) -> Column:
    """train, val or test for any spelling (dev and validation mean val); null and other names give null or the name itself."""
    low = F.lower(outer_trimmed(col))
    return F.when(low.isin("dev", "validation", "val"), F.lit("val")).otherwise(low)


def speaker_name(col: Column) -> Column:
    """Lower case without outer blanks; null and blank name nobody and give null."""
    return F.nullif(F.lower(outer_trimmed(col)), F.lit(""))

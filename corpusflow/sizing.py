"""Helpers that keep plans safe when the data grows.

* ``saved`` cuts lineage through a parquet table in the shared checkpoint folder.
* ``lookup`` joins a small table by broadcast only after its size was checked, and
  otherwise spreads hot keys over salts.
* ``prefix_totals`` gives running totals without one global sort task.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes up to which a lookup table may be broadcast; beyond either the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20
#: Copies of a lookup row over which the rows of a hot key are spread.
SALTS = 8

_written: list[tuple[SparkSession, str]] = []


def in_one_process(master: str) -> bool:
    """Whether driver and executor are one process and share its disk."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a session in one process gets a fresh local folder. On a cluster that is an error, for
    every executor would write to a disk of its own and the table read back would lack the others' rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not in_one_process(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corpusflow-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there goes with ``release``."""
    path = f"{shared_folder(spark)}/corpusflow/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: no lineage, survives lost executors."""
    return saved_with(df)[0]


def saved_with(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``saved``, and aggregates of ``df`` taken while it is written, so they cost no pass of their own."""
    spark = df.sparkSession
    path = scratch_path(spark)
    seen = Observation() if figures else None
    watched = df.observe(seen, *(c.alias(name) for name, c in figures.items())) if seen else df
    watched.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if seen else {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


def release(*tables: DataFrame) -> None:
    """Delete the files behind tables made by ``saved``; with none given, all of this process."""
    names = {f.rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:") for t in tables for f in t.inputFiles()}
    for item in list(_written):
        if not tables or item[1].removeprefix("file://").removeprefix("file:") in names:
            _remove(*item)
            _written.remove(item)


atexit.register(release)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``size`` bytes; reads no more rows than it must to know."""
    held = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            held = held + F.coalesce(F.octet_length(f"`{name}`"), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            held = held + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{name}`"))), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    return n <= rows and total <= size


def lookup(big: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``table`` (one row per key) to ``big`` without letting a hot key fall into one task.

    A table of at most ``rows`` rows and ``BROADCAST_BYTES`` is broadcast. A larger one is copied ``SALTS``
    times and joined on key and salt, so the differing rows of a key spread over ``SALTS`` tasks.
    ``how`` is one of inner, left, left_semi, left_anti. Null keys never match.
    """
    if is_small(table, rows):
        return big.join(F.broadcast(table), keys, how)
    # The salt comes from the row's own values, so a task that runs again deals its rows the same way.
    others = [c for c, kind in big.dtypes if c not in keys and "map<" not in kind] or keys
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def prefix_totals(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: str, total: str) -> DataFrame:
    """Running total of ``value`` per group in the order (``bucket``, ``order``), the row itself included.

    Buckets must be ordered ranges of the sort key. Only one sum per bucket passes
    through the window over a whole group; rows are sorted inside their bucket. Null
    groups and buckets are values like any other.
    """
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*groups, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ran = df.withColumn("_inside", F.sum(value).over(inside))
    keys = [*groups, bucket]
    offsets = offsets.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "_offset")
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    joined = ran.join(offsets, same).withColumn(total, F.col("_offset") + F.col("_inside"))
    return joined.drop("_offset", "_inside", *(f"_{i}" for i in range(len(keys))))

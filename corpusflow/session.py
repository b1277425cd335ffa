"""Session builder with the settings the queries are written for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from corpusflow.sizing import in_one_process


def build_session(app: str = "corpusflow", cores: str | None = None, partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's settings win.

    ``cores`` is the text inside ``local[...]``; ``partitions`` sets the shuffle partitions; ``shared`` is the
    folder of intermediate tables, which a cluster names in ``spark.checkpoint.dir``.
    """
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    master = os.environ.get("SPARK_MASTER", f"local[{cores}]")
    if shared is None and in_one_process(master):
        shared = tempfile.mkdtemp(prefix="corpusflow-")
        atexit.register(shutil.rmtree, shared, True)
    builder = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

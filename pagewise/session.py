"""Session construction and the shared state folder.

On a cluster the session comes from the platform and ``spark.checkpoint.dir``
names a shared folder; we only read it.  Tests and the bench build a local
session with ``build_session`` and, only there, the folder is a fresh scratch dir.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    shuffle_partitions: int = 8,
    app_name: str = "pagewise",
    extra: dict | None = None,
) -> SparkSession:
    """Local session for tests and benchmarks (UI off, AQE on, UTC)."""
    master = master or os.environ.get("PAGEWISE_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAGEWISE_DRIVER_MEMORY", "8g"))
    )
    extra = dict(extra or {})
    if "spark.checkpoint.dir" not in extra:  # this session is for one machine: a scratch folder
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="pagewise-state-")
    for k, v in extra.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def state_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written table versions: ``spark.checkpoint.dir``, as it is set.

    Spark keeps its own checkpoints in a folder per application below it;
    tables, state and stream checkpoints stand beside those, so the next
    application finds them.  There is no default: tests and the bench set a
    folder through ``build_session``."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that every executor can reach")
    return root.rstrip("/")

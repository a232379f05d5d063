"""Native reading-log tables on parquet, and versioned writes.

Parquet has no UPDATE/DELETE, so every change operator returns the new table
state and ``write_version`` stores it as a new immutable version directory
under the shared state root (``spark.checkpoint.dir``).  A reader of the old
version is never disturbed, a failed job leaves no half-written version
(the file committer only publishes complete task outputs), and the written
version also cuts the lineage of long change chains.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewise.schema import READER, RECORD, SHELF, text_keyed
from pagewise.session import state_root
from pagewise.sources.binding import ReadingLog

SCHEMAS = {"reader": READER, "shelf": SHELF, "record": RECORD}


def table_path(spark: SparkSession, name: str, version: str | None = None) -> str:
    base = f"{state_root(spark)}/tables/{name}"
    return base if version is None else f"{base}/v={version}"


def write_version(
    spark: SparkSession, df: DataFrame, name: str, version: str | None = None, cluster_by: str | None = "user_id"
) -> DataFrame:
    """Write ``df`` as a new version of table ``name``; return it read back.

    Rows are sorted by ``cluster_by`` inside each file so parquet row-group
    statistics let single-reader queries skip most of the data.
    """
    version = version or uuid.uuid4().hex
    path = table_path(spark, name, version)
    out = df.sortWithinPartitions(cluster_by) if cluster_by and cluster_by in df.columns else df
    out.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_rows(spark: SparkSession, df: DataFrame, name: str, version: str, cluster_by: str | None = "user_id") -> DataFrame:
    """INSERT: add the files of ``df`` to a stored version; the files that are there stay as they are."""
    path = table_path(spark, name, version)
    (df.sortWithinPartitions(cluster_by) if cluster_by else df).write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_native(spark: SparkSession, root: str, text_keys: bool = False) -> ReadingLog:
    """Load reader/shelf/record parquet directories with their fixed schemas; ``text_keys``: keys as text."""
    schemas = {t: text_keyed(x) if text_keys else x for t, x in SCHEMAS.items()}
    r, s, c = (spark.read.schema(schemas[t]).parquet(f"{root.rstrip('/')}/{t}") for t in ("reader", "shelf", "record"))
    return ReadingLog(r, s, c)


def write_native(spark: SparkSession, log: ReadingLog, root: str, mode: str = "errorifexists") -> None:
    for name, df in (("reader", log.reader), ("shelf", log.shelf), ("record", log.record)):
        df.sortWithinPartitions("user_id").write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def sql(spark: SparkSession, text: str, args=None, **frames: DataFrame) -> DataFrame:
    """Run a statement with bound parameters (``:name`` with a dict, ``?`` with a
    list) and DataFrames referenced as ``{name}``."""
    return spark.sql(text, args=args, **frames)

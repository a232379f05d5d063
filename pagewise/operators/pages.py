"""The record log stored page by page, so that a request reads one page.

``store`` writes ``paged_log`` once, sorted by reader and row number in files
that Spark sizes by sampled ranges of both, with small row groups.  Their least
and largest values are the directory: the scan of one page of one reader skips
every row group but those that hold it.  ``refresh`` replaces the readers of a
change: it writes their new pages as a further part, and the newest part that
names a reader holds its pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.operators.lists import paged_log
from pagewise.session import state_root
from pagewise.sources.binding import ReadingLog

ROW_GROUP = 1 << 20  # bytes


def _root(spark: SparkSession, name: str) -> str:
    return f"{state_root(spark)}/pages/{name}"


def _write(pages: DataFrame, users: DataFrame, root: str, part: int) -> None:
    spark, work = pages.sparkSession, f"{root}/work/part={part}"
    pages.write.mode("overwrite").parquet(work)  # the ranges are sampled first: the pages would be made twice
    out = spark.read.schema(pages.schema).parquet(work).repartitionByRange("user_id", "rn").sortWithinPartitions("user_id", "rn")
    out.write.option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(f"{root}/pages/part={part}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    users.select("user_id").distinct().sort("user_id").write.mode("overwrite").parquet(f"{root}/readers/part={part}")


def store(spark: SparkSession, log: ReadingLog, name: str) -> None:
    """Write the pages of all readers as part 0."""
    _write(paged_log(log), log.reader, _root(spark, name), 0)


def refresh(spark: SparkSession, log: ReadingLog, users: DataFrame, name: str, part: int) -> None:
    """Write the pages of ``users`` (column user_id) after a change as part number ``part``, above all before."""
    only = users.select("user_id").distinct()
    own = ReadingLog(log.reader, *(t.join(only, "user_id", "left_semi") for t in (log.shelf, log.record)))
    _write(paged_log(own), only, _root(spark, name), part)


def page(spark: SparkSession, name: str, user, number: int) -> DataFrame:
    """Rows of page ``number`` of a reader, in order."""
    root, mine = _root(spark, name), F.col("user_id") == F.lit(user)
    newest = spark.read.parquet(f"{root}/readers").filter(mine).agg(F.max("part")).first()[0]
    rows = spark.read.parquet(f"{root}/pages").filter((F.col("part") == F.lit(newest)) & mine & (F.col("page_no") == F.lit(number)))
    return rows.drop("part").orderBy("rn")

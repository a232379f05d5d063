"""Reading-log tables bucketed by (user_id, b_isbn) in the session's catalog.

Shelf and records are written once into the same number of buckets by the key
that most queries group and join on, one sorted file a bucket.  A scan then
already has the distribution that progress, book detail and running totals
need: they run without an exchange of the records.

A bucket must not hold a key without a bound.  Books with more than
``hot_rows`` records, and records whose reader or book is unknown, are written
beside it without buckets.  ``bounded`` are the bucketed rows, of which a key
has at most ``hot_rows``; ``record`` has all, and where there are hot ones a
query over it aggregates them before its exchange, as over plain files.

The number of buckets and the schemas stand in a small file beside the tables,
so ``read`` finds them in a new application, whose catalog is empty.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewise.schema import SHELF_KEY
from pagewise.session import state_root
from pagewise.sources.binding import ReadingLog

HOT_ROWS = 1 << 20
COUNTED = 1 << 16  # hashes of a key under which records are counted first


@dataclass(frozen=True)
class BucketedLog(ReadingLog):
    """The three tables; of the records also those in buckets and, if there are any, the hot ones."""

    bounded: DataFrame
    hot: DataFrame | None


def _root(spark: SparkSession, name: str) -> str:
    return f"{state_root(spark)}/bucketed/{name}"


def _write(df: DataFrame, path: str, table: str, buckets: int, order: list[str]) -> None:
    one = df.repartition(buckets, *SHELF_KEY).sortWithinPartitions(*order)  # a task writes one bucket, as one file
    one.write.bucketBy(buckets, *SHELF_KEY).sortBy(*order).mode("overwrite").option("path", path).saveAsTable(table)


def _hot_keys(record: DataFrame, hot_rows: int) -> DataFrame | None:
    """Books with more than ``hot_rows`` records; None if there are none.  Only books whose hash has as many are counted
    one by one, so the first count exchanges a row per hash."""
    record = record.filter(F.col("user_id").isNotNull() & F.col("b_isbn").isNotNull()).select(*SHELF_KEY, F.pmod(F.xxhash64(*SHELF_KEY), F.lit(COUNTED)).alias("_h"))
    many = [r[0] for r in record.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select("_h").collect()]  # at most COUNTED
    if not many:
        return None
    hashes = record.sparkSession.createDataFrame([(h,) for h in many], "_h long")
    books = record.join(F.broadcast(hashes), "_h", "left_semi").groupBy(*SHELF_KEY).agg(F.count(F.lit(1)).alias("_n"))
    return books.filter(F.col("_n") > hot_rows).select(*SHELF_KEY)


def write(spark: SparkSession, log: ReadingLog, name: str, buckets: int | None = None, hot_rows: int = HOT_ROWS) -> BucketedLog:
    """Store ``log`` under ``name`` and read it back.  ``buckets``: as many as shuffle partitions if not given."""
    root, buckets = _root(spark, name), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    log.reader.write.mode("overwrite").parquet(f"{root}/reader")
    _write(log.shelf, f"{root}/shelf", f"{name}_shelf", buckets, SHELF_KEY)
    unknown = F.col("user_id").isNull() | F.col("b_isbn").isNull()
    bounded, hot = log.record.filter(~unknown), log.record.filter(unknown)
    if (hot_keys := _hot_keys(log.record, hot_rows)) is not None:
        hot_keys.write.mode("overwrite").parquet(f"{root}/hot_keys")
        hot_keys = spark.read.schema(hot_keys.schema).parquet(f"{root}/hot_keys")
        bounded, hot = bounded.join(hot_keys, SHELF_KEY, "left_anti"), hot.unionByName(log.record.join(hot_keys, SHELF_KEY, "left_semi"))
    _write(bounded, f"{root}/record", f"{name}_record", buckets, [*SHELF_KEY, "r_date", "r_page"])
    hot.write.mode("overwrite").parquet(f"{root}/hot")
    about = {"buckets": buckets, "shelf": log.shelf.schema.json(), "record": log.record.schema.json(), "reader": log.reader.schema.json()}
    about["hot"] = bool(spark.read.schema(log.record.schema).parquet(f"{root}/hot").take(1))
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/about")
    return read(spark, name)


def read(spark: SparkSession, name: str) -> BucketedLog:
    """The tables stored under ``name``; a catalog that doesn't know them is told where they lie."""
    root = _root(spark, name)
    about = json.loads(spark.read.text(f"{root}/about").first()[0])
    schema = {t: T.StructType.fromJson(json.loads(about[t])) for t in ("reader", "shelf", "record")}
    for table, order in (("shelf", SHELF_KEY), ("record", [*SHELF_KEY, "r_date", "r_page"])):
        if not spark.catalog.tableExists(f"{name}_{table}"):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema[table].fields)
            spark.sql(
                f"CREATE TABLE `{name}_{table}` ({columns}) USING parquet CLUSTERED BY ({', '.join(SHELF_KEY)}) "
                f"SORTED BY ({', '.join(order)}) INTO {about['buckets']} BUCKETS LOCATION '{root}/{table}'"
            )
    shelf, bounded = spark.table(f"{name}_shelf"), spark.table(f"{name}_record")
    hot = spark.read.schema(schema["record"]).parquet(f"{root}/hot") if about["hot"] else None
    record = bounded if hot is None else bounded.unionByName(hot)
    return BucketedLog(spark.read.schema(schema["reader"]).parquet(f"{root}/reader"), shelf, record, bounded, hot)

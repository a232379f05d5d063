"""Catalog search payloads: JSON text with an ``items`` array.

Payloads returned by a book-search service are landed as text (one JSON
document per line) and flattened with ``from_json`` + ``explode``: no Python
parsing, the JSON reader runs inside the scan's codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.schema import CATALOG_ITEM, CATALOG_PAYLOAD


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files (JSON lines) as a single ``payload`` text column."""
    return spark.read.text(path).withColumnRenamed("value", "payload")


def flatten_items(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payload -> one row per item: title, image, author, discount, isbn."""
    parsed = payloads.select(F.from_json(F.col(column), CATALOG_PAYLOAD).alias("p"))
    return parsed.select(F.explode("p.items").alias("item")).select(
        *[F.col(f"item.{f.name}").alias(f.name) for f in CATALOG_ITEM.fields]
    )


#: Why a payload or an item is rejected.
NOT_JSON, NO_ITEMS, NO_ITEM = "not json", "no items", "no item"


def variant_items(spark: SparkSession, payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Items of payloads of unknown or broken shape, and a table of what is rejected: (payload, place, reason).

    The text is parsed once to a VARIANT.  Text that is no JSON, and a document without an array of items, are
    rejected whole (place NULL); an item that is no object or has no isbn is rejected by its place in the array.
    Fields of another type than text are read as text, and those an item lacks are NULL."""
    # the shape is asked of the JSON path, so a scalar or an object in place of the array is no error
    parsed = payloads.select(F.col(column).alias("payload"), F.try_parse_json(column).alias("v"))
    parsed = parsed.withColumn("items", F.expr("try_variant_get(v, '$.items', 'array<variant>')"))
    whole = F.when(F.col("v").isNull(), NOT_JSON).when(F.col("items").isNull(), NO_ITEMS)
    found = spark.sql("SELECT p.payload, t.pos AS place, t.col AS item FROM {p} p, LATERAL posexplode(p.items) AS t", p=parsed)
    fields = [f.name for f in CATALOG_ITEM.fields]
    found = found.select("payload", "place", *[F.expr(f"try_variant_get(item, '$.{c}', 'string')").alias(c) for c in fields])
    lost = parsed.select("payload", F.lit(None).cast("int").alias("place"), whole.alias("reason")).filter("reason is not null")
    bad = found.filter("isbn is null").select("payload", "place", F.lit(NO_ITEM).alias("reason"))
    return found.filter("isbn is not null").select(*fields), lost.unionByName(bad)


def part_items(part: DataFrame) -> DataFrame:
    """Catalog items built from the ``part`` table (all fields as text)."""
    return part.select(
        F.col("p_partkey").alias("_key"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("cover/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image"),
        F.col("p_brand").alias("author"),
        F.round(F.col("p_retailprice") * 100).cast("long").cast("string").alias("discount"),
        F.col("p_partkey").cast("string").alias("isbn"),
    )


def pack_payloads(items: DataFrame, per_payload: int = 10) -> DataFrame:
    """Pack items into payload documents of at most ``per_payload`` items
    (consecutive keys), the shape a paged search response has."""
    fields = [f.name for f in CATALOG_ITEM.fields]
    g = items.groupBy(F.floor(F.col("_key") / per_payload).alias("page_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_key"), *[F.col(c) for c in fields]))).alias("s")
    )
    arr = F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    return g.select("page_id", F.to_json(F.struct(arr.alias("items"))).alias("payload"))

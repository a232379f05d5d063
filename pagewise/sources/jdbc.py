"""Load the reading-log tables from a relational database over JDBC.

The keys are text (login names, isbns), which ``partitionColumn`` can't split:
each table is read as ``partitions`` queries, one for each value of a hash of
the reader modulo that number, and cast to the text-keyed schema.  Choose the
number by the table's size (rows / partitions ~ a few million).

No database may be started here: the tests look at the predicates only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.schema import READER, RECORD, SHELF, text_keyed
from pagewise.sources.binding import ReadingLog

# --- fixed values: table names of the original schema ---
SOURCE_TABLES = {"reader": "tb_user", "shelf": "tb_book", "record": "tb_bookrecord"}
SCHEMAS = {"reader": READER, "shelf": SHELF, "record": RECORD}
HASH = "ora_hash({column}, {top})"  # the source's own hash function: 0 to top


def predicates(partitions: int = 64, column: str = "user_id", hash_of: str = HASH) -> list[str]:
    """One condition per partition; together they hold for every row once (a NULL key hashes like a value)."""
    return [f"{hash_of.format(column=column, top=partitions - 1)} = {i}" for i in range(partitions)]


def read_table(spark: SparkSession, url: str, table: str, properties: dict, partitions: int = 64, hash_of: str = HASH) -> DataFrame:
    return spark.read.jdbc(url, table, predicates=predicates(partitions, hash_of=hash_of), properties=properties)


def load_log(spark: SparkSession, url: str, properties: dict, **split) -> ReadingLog:
    """reader / shelf / record from the source tables, with the
    text-keyed schema (only the columns the library uses; the password column is never read)."""
    out = {}
    for name, src in SOURCE_TABLES.items():
        df = read_table(spark, url, src, properties, **split)
        cols = {c.lower(): c for c in df.columns}
        out[name] = df.select(
            *[
                (F.col(cols[f.name]) if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in text_keyed(SCHEMAS[name]).fields
            ]
        )
    return ReadingLog(out["reader"], out["shelf"], out["record"])

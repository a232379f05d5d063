"""Dashboard tiles from a state that batches of records are merged into.

Sums and counts of two batches add up; counts of distinct days don't, so the
days stand as exact bitmaps, 64 days to a number, which are joined by OR.  A
batch of appended records is reduced to a part: per (reader, book) the pages
and records, and per reader the bitmaps of the days with a record of a book on
the shelf: numbers, which Spark aggregates by hash, where a bitmap of Spark's
own has 4 KB for the few days of a reader and is sorted.  Tiles
merge the parts, whose rows grow with books and readers and not with the
records; ``compact`` writes the merged parts as one (``parts``).

The state takes appends, as the original's tiles do between deletes; after a
delete, a new one is begun.  Unknown readers and books are values of their own
and stand on no shelf; a record without a date counts, but has no day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.operators.parts import Parts
from pagewise.schema import SHELF_KEY


def reduced(records: DataFrame, shelf: DataFrame) -> dict[str, DataFrame]:
    """The part of a batch: books (reader, book, pages, n), days (reader, bucket, bits)."""
    books = records.groupBy(*SHELF_KEY).agg(F.sum("r_page").alias("pages"), F.count(F.lit(1)).alias("n"))
    on_shelf = records.filter(F.col("r_date").isNotNull()).join(shelf.select(*SHELF_KEY), SHELF_KEY, "left_semi")
    day = F.unix_date("r_date")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(64)))
    days = on_shelf.groupBy("user_id", F.floor(day / 64).cast("int").alias("bucket")).agg(F.bit_or(bit).alias("bits"))
    return {"books": books, "days": days}


def merged(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One row per key of parts that were put below one another."""
    books = parts["books"].groupBy(*SHELF_KEY).agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"))
    return {"books": books, "days": parts["days"].groupBy("user_id", "bucket").agg(F.bit_or("bits").alias("bits"))}


class TileState(Parts):
    """The parts of one name under the shared state root."""

    kind, tables = "tiles", ("books", "days")

    def merged(self, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return merged(parts)

    def append(self, batch: int, records: DataFrame, shelf: DataFrame) -> None:
        """Add the records of batch number ``batch``."""
        self.put(batch, reduced(records, shelf))

    def tiles(self, reader: DataFrame, shelf: DataFrame) -> DataFrame:
        """user_id, yrpage, yrbook, yrdt, totalrow: as ``reading_totals`` and ``record_count`` have them."""
        state = self.read()
        n = state["books"].groupBy("user_id").agg(F.sum("n").alias("totalrow"))
        own = state["books"].join(shelf.select(*SHELF_KEY), SHELF_KEY, "left_semi")
        own = own.groupBy("user_id").agg(F.sum("pages").alias("yrpage"), F.count("b_isbn").alias("yrbook"))
        days = state["days"].groupBy("user_id").agg(F.sum(F.bit_count("bits").cast("long")).alias("yrdt"))
        out = reader.select("user_id")
        for t in (own, days, n):
            out = out.join(t, "user_id", "left")
        return out.select("user_id", "yrpage", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("yrbook", "yrdt", "totalrow")])

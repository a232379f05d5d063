"""Per-book progress: the one aggregate most queries share.

The original statements compute ``SUM(r_page) OVER (PARTITION BY isbn)`` on
the shelf x record join and then DISTINCT the result.  Here records are
aggregated first (partial aggregation before the shuffle, so a hot reader or
book only ships one partial row per map task) and joined second: no fan-out,
no DISTINCT, no window over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.schema import SHELF_KEY
from pagewise.sources.binding import ReadingLog


def progress(record: DataFrame) -> DataFrame:
    """(user_id, b_isbn) -> pages read, record counts, first/last reading date.

    Unused columns are pruned by Catalyst, so callers take what they need.
    """
    return record.groupBy(*SHELF_KEY).agg(
        F.sum("r_page").alias("cur_sum"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("r_page").alias("n_pages"),
        F.count("r_date").alias("n_dates"),
        F.min("r_date").alias("first_dt"),
        F.max("r_date").alias("last_dt"),
    )


def with_pages_read(shelf: DataFrame, record: DataFrame) -> DataFrame:
    """shelf LEFT JOIN progress: cur_page = NVL(sum, 0) for every shelf row."""
    prog = progress(record).select(*SHELF_KEY, "cur_sum")
    return shelf.join(prog, SHELF_KEY, "left").withColumn(
        "cur_page", F.coalesce(F.col("cur_sum"), F.lit(0).cast("long"))
    )


def reading_progress(log: ReadingLog, user=None) -> DataFrame:
    """Books in progress (b_end_yn = 'N'): pages read and pages left.

    to_page may be negative (over-read books are not 'finished': the flag
    needs exact equality).  With ``user`` the rows come in the original
    order: first reading date ascending, never-read books last.
    """
    log = log.for_user(user)
    shelf = log.shelf.filter(F.col("b_end_yn") == "N")
    out = with_pages_read(shelf, log.record).select(
        "user_id",
        "b_title",
        "b_author",
        "b_isbn",
        "cur_page",
        "b_page",
        (F.col("b_page") - F.col("cur_page")).alias("to_page"),
        "b_create_dt",
    )
    if user is not None:
        out = out.orderBy(F.col("b_create_dt").asc_nulls_last(), "b_isbn")
    return out

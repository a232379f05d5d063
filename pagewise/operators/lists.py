"""Shelf lists, book detail, the record log with running totals, paging.

Plans are aggregate-before-join throughout: ``record`` is reduced per key
(partial aggregation, so hot keys collapse map-side) before it meets the
shelf, and existence tests are semi joins against distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewise.functions.category import category_label
from pagewise.functions.numeric import ratio_round_half_up
from pagewise.functions.text import date_text, nvl_text
from pagewise.operators import scan
from pagewise.operators.progress import with_pages_read
from pagewise.schema import PAGE_SIZE, SHELF_KEY
from pagewise.sources.binding import ReadingLog
from pagewise.sources.bucketed import BucketedLog

# Identical rows of a tie group that one input row is expanded into (see running_pages).
EXPAND_CHUNK = 1 << 20


def wish_list(log: ReadingLog, user=None) -> DataFrame:
    """Unfinished books with pages read, started flag and formatted dates."""
    log = log.for_user(user)
    shelf = log.shelf.filter(F.col("b_end_yn") == "N")
    out = with_pages_read(shelf, log.record).select(
        "user_id",
        F.when(F.col("b_create_dt").isNull(), "N").otherwise("Y").alias("read_yn"),
        "b_title",
        "b_author",
        category_label("b_category").alias("b_category"),
        nvl_text("b_memo").alias("b_memo"),
        "b_page",
        "cur_page",
        F.coalesce(date_text("b_create_dt"), F.lit(" ")).alias("b_create_dt"),
        F.coalesce(date_text("b_update_dt"), F.lit(" ")).alias("b_update_dt"),
        "b_isbn",
    )
    if user is not None:
        # ORDER BY the text alias: ' ' (never started) sorts last under DESC.
        out = out.orderBy(F.col("b_create_dt").desc(), "b_isbn")
    return out


def finished_list(log: ReadingLog, user=None) -> DataFrame:
    """Finished books that have at least one record and an existing reader.

    The original three-way join + DISTINCT projects shelf columns only, so it
    is two semi joins; the record side is reduced to distinct keys first.
    """
    log = log.for_user(user)
    keys = log.record.select(*SHELF_KEY).distinct()
    out = (
        log.shelf.filter(F.col("b_end_yn") == "Y")
        .join(keys, SHELF_KEY, "left_semi")
        .join(log.reader.select("user_id"), "user_id", "left_semi")
        .select(
            "user_id",
            "b_title",
            "b_author",
            "b_page",
            date_text("b_create_dt").alias("b_create_dt"),
            date_text("b_update_dt").alias("b_update_dt"),
            category_label("b_category").alias("b_category"),
            nvl_text("b_memo").alias("b_memo"),
            "b_isbn",
        )
    )
    if user is not None:
        out = out.orderBy(F.col("b_create_dt").desc_nulls_first(), "b_isbn")
    return out


def book_detail(log: ReadingLog, user=None, isbn=None) -> DataFrame:
    """Detail card per book with records: counts and mean pages per session."""
    log = log.for_user(user)
    shelf, record = log.shelf, log.record
    if isbn is not None:
        shelf = shelf.filter(F.col("b_isbn") == F.lit(isbn))
        record = record.filter(F.col("b_isbn") == F.lit(isbn))
    stats = record.groupBy(*SHELF_KEY).agg(
        F.count("r_date").alias("rlday"),
        F.sum("r_page").alias("_s"),
        F.count("r_page").alias("_n"),
    )
    return shelf.join(stats, SHELF_KEY, "inner").select(
        "user_id",
        "b_isbn",
        "b_title",
        "b_author",
        "b_dicount",
        category_label("b_category").alias("b_category"),
        nvl_text("b_memo").alias("b_memo"),
        nvl_text("b_mlday").alias("b_mlday"),
        nvl_text("b_mlpage").alias("b_mlpage"),
        "b_image",
        date_text("b_create_dt").alias("b_create_dt"),
        date_text("b_update_dt").alias("b_update_dt"),
        "rlday",
        ratio_round_half_up("_s", "_n", 2).alias("rlpage"),
    )


def detail_json(detail: DataFrame) -> DataFrame:
    """The detail card as the JSON array the page receives (positional)."""
    cols = [c for c in detail.columns if c not in ("user_id", "b_isbn")]
    return detail.select(
        "user_id", "b_isbn", F.to_json(F.array(*[F.col(c).cast("string") for c in cols])).alias("detail")
    )


def running_pages(record: DataFrame, shelf: DataFrame) -> DataFrame:
    """Record rows with the running page total inside their book.

    ``SUM(r_page) OVER (PARTITION BY book ORDER BY r_date ROWS UNBOUNDED
    PRECEDING)`` evaluated without a window over raw rows:

    1. identical rows (same user, book, date, pages) are interchangeable, so
       they are counted, not carried: a partial aggregate;
    2. the running total runs over these tie groups, month by month of a book;
       a book that stands on a shelf several times meets its rows only after;
    3. the k-th row of a group has total ``upto - (n - k) * r_page``; groups
       are cut into chunks of ``EXPAND_CHUNK`` rows, dealt out and expanded, so
       one hot book never lands on one task.

    Inside a day the order is r_page ascending (the original leaves it open);
    the output multiset is the window's exactly.
    """
    g = record.groupBy(*SHELF_KEY, "r_date", "r_page").agg(F.count(F.lit(1)).alias("_n"))
    g = scan.running(
        g,
        SHELF_KEY,
        [F.col("r_date").asc_nulls_last(), F.col("r_page").asc_nulls_last()],
        [("_upto", "sum", F.col("r_page") * F.col("_n"), True)],
        [(F.trunc("r_date", "month"), "asc_nulls_last")],
    )
    return expanded(g, shelf)


def expanded(g: DataFrame, shelf: DataFrame) -> DataFrame:
    """The rows of tie groups (``_n`` rows, of which the last one's total is ``_upto``) with their books."""
    books = shelf.select(*SHELF_KEY, "b_title", "b_author", "b_page", "b_update_dt")
    g = g.join(books, SHELF_KEY, "inner")
    last_chunk = F.expr(f"(_n - 1) div {EXPAND_CHUNK}")
    g = g.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
    g = g.repartition(*SHELF_KEY, "r_date", "r_page", "_chunk")
    lo, hi = F.col("_chunk") * EXPAND_CHUNK + 1, F.least(F.col("_n"), (F.col("_chunk") + 1) * EXPAND_CHUNK)
    rows = g.withColumn("_k", F.explode(F.sequence(lo, hi)))
    sum_page = F.when(
        F.col("r_page").isNull(), F.col("_upto")
    ).otherwise(F.col("_upto") - (F.col("_n") - F.col("_k")) * F.col("r_page"))
    return rows.withColumn("sum_page", sum_page).drop("_n", "_upto", "_k", "_chunk")


def bounded_pages(record: DataFrame, shelf: DataFrame) -> DataFrame:
    """``running_pages`` of records of which a book has a bounded number: one window per book, no exchange in buckets."""
    g = record.groupBy(*SHELF_KEY, "r_date", "r_page").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*SHELF_KEY).orderBy(F.col("r_date").asc_nulls_last(), F.col("r_page").asc_nulls_last())
    g = g.withColumn("_upto", F.sum(F.col("r_page") * F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = g.join(shelf.select(*SHELF_KEY, "b_title", "b_author", "b_page", "b_update_dt"), SHELF_KEY, "inner")
    rows = g.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    before = F.coalesce((F.col("_n") - F.col("_k")) * F.col("r_page"), F.lit(0))
    return rows.withColumn("sum_page", F.col("_upto") - before).drop("_n", "_upto", "_k")


def record_log(log: ReadingLog, user=None) -> DataFrame:
    """Every record with its book and the running pages total of that book."""
    if isinstance(log, BucketedLog) and user is None:
        r = bounded_pages(log.bounded, log.shelf)
        if log.hot is not None:  # a book's records are all here or all there
            r = r.unionByName(running_pages(log.hot, log.shelf))
    else:
        log = log.for_user(user)
        r = running_pages(log.record, log.shelf)
    if user is not None:
        r = r.orderBy(*log_order())
    return r.select(
        "user_id",
        "b_title",
        "b_author",
        date_text("r_date").alias("r_date"),
        "r_page",
        "sum_page",
        "b_page",
        "b_isbn",
    )


# Display order of the record log: the book read last first, newest record
# first; the remaining keys only make ties deterministic.
def log_order() -> list[Column]:
    return [
        F.col("b_update_dt").desc_nulls_first(),
        F.col("r_date").desc_nulls_first(),
        F.col("b_isbn").asc(),
        F.col("r_page").asc_nulls_last(),
        F.col("sum_page").asc_nulls_last(),
    ]


def _numbered(record: DataFrame, shelf: DataFrame) -> DataFrame:
    """Records of readers that one task can hold, with their books, running totals and numbers.

    Records and books are exchanged once, by reader, as one table: a join of both would deal them again, by book."""
    known = F.col("user_id").isNotNull() & F.col("b_isbn").isNotNull()
    book = F.struct("b_title", "b_update_dt").alias("_book")
    rows = record.filter(known).select(*SHELF_KEY, "r_date", "r_page", F.lit(None).cast(shelf.select(book).schema["_book"].dataType).alias("_book"))
    none = [F.lit(None).cast(record.schema[c].dataType).alias(c) for c in ("r_date", "r_page")]
    rows = rows.unionByName(shelf.filter(known).select(*SHELF_KEY, *none, book)).repartition("user_id")
    days = [F.col("r_date").asc_nulls_last(), F.col("r_page").asc_nulls_last()]
    w = Window.partitionBy(*SHELF_KEY).orderBy(*days)
    books = F.collect_list("_book").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"sum_page": F.sum("r_page").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_books": books})
    rows = rows.filter(F.col("_book").isNull()).select(*SHELF_KEY, "r_date", "r_page", "sum_page", F.inline("_books"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(*log_order())))


def paged_log(log: ReadingLog, user=None, page_size: int = PAGE_SIZE) -> DataFrame:
    """Record log with its row number and page number (pages of ``page_size``).

    A reader's whole log is one ordering.  Where one task can hold it, it is numbered whole (``_numbered``); the log of a
    crowded reader is dealt to buckets."""
    log = log.for_user(user)
    many = scan.crowded(scan.crowded_slots([log.record, log.shelf]).scalar())
    record, shelf = log.record, log.shelf
    # the buckets of a crowded reader are the books last read on one day and, inside, the days
    days = [("b_update_dt", "desc_nulls_first"), ("r_date", "desc_nulls_first")]
    dealt = scan.row_number(running_pages(record.filter(many), shelf.filter(many)), ["user_id"], log_order()[len(days) :], days)
    columns = ["user_id", "rn", "b_title", "r_date", "r_page", "sum_page", "b_isbn"]
    r = _numbered(record.filter(~many), shelf.filter(~many)).select(*columns).unionByName(dealt.select(*columns))
    return r.select(
        "user_id",
        F.col("rn").cast("long").alias("rn"),
        F.ceil(F.col("rn") / page_size).cast("long").alias("page_no"),
        "b_title",
        date_text("r_date").alias("r_date"),
        "r_page",
        "sum_page",
        "b_isbn",
    )


def page_count(log: ReadingLog, page_size: int = PAGE_SIZE) -> DataFrame:
    """ceil(records / page_size) per reader."""
    n = log.record.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", F.ceil(F.col("n") / page_size).cast("long").alias("pages"))


def shelf_listing(log: ReadingLog, user=None, scheme: str = "alt") -> DataFrame:
    """Whole shelf, labelled with the alternative category scheme."""
    log = log.for_user(user)
    return log.shelf.select(
        "user_id",
        "b_isbn",
        "b_end_yn",
        "b_title",
        "b_author",
        category_label("b_category", scheme).alias("b_category"),
        "b_page",
        "b_dicount",
        date_text("b_create_dt").alias("b_create_dt"),
        date_text("b_update_dt").alias("b_update_dt"),
    )


def reader_scan(spark: SparkSession, reader: DataFrame) -> DataFrame:
    """SELECT * over the reader table (no password column exists here)."""
    return spark.sql("SELECT user_id, user_nm, user_email FROM {reader}", reader=reader)


def reader_profile(spark: SparkSession, reader: DataFrame, ids: DataFrame) -> DataFrame:
    """Profiles for a batch of requested ids (point lookups as one semi join)."""
    return spark.sql(
        "SELECT r.user_id, r.user_nm, r.user_email FROM {reader} r LEFT SEMI JOIN {ids} i ON r.user_id = i.user_id",
        reader=reader,
        ids=ids,
    )


def profile_of(spark: SparkSession, reader: DataFrame, user) -> DataFrame:
    """One reader's profile, with the id passed as a bound parameter."""
    return spark.sql(
        "SELECT user_nm, user_email FROM {reader} WHERE user_id = :id LIMIT 1",
        args={"id": user},
        reader=reader,
    )

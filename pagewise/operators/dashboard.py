"""Dashboard tiles and chart series, for every reader at once.

Each tile of the original page is a per-user aggregate (one SQL round trip
each).  Here every tile is a ``groupBy("user_id")`` with partial aggregation,
and the dashboard left-joins them all to ``reader`` so readers without books
or records keep their row (the original returned NULL sums / 0 counts).
All tile aggregates come out hash-partitioned on user_id, so the final joins
reuse that distribution instead of shuffling again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewise.functions.category import category_label
from pagewise.functions.text import authors_text, js_text, korean_date, month_label, thousands
from pagewise.operators.progress import reading_progress
from pagewise.schema import BOOKS_UNIT, CAPTION_PARTS, DAYS_UNIT, NO_BOOK, NO_DATE, PAGES_UNIT, SHELF_KEY, WON
from pagewise.sources.binding import ReadingLog


def _all_readers(log: ReadingLog, per_user: DataFrame) -> DataFrame:
    return log.reader.select("user_id").join(per_user, "user_id", "left")


def total_spend(log: ReadingLog, user=None) -> DataFrame:
    """SUM(b_dicount) per reader; NULL for a reader with an empty shelf."""
    log = log.for_user(user)
    spend = log.shelf.groupBy("user_id").agg(F.sum("b_dicount").alias("yrmoney"))
    return _all_readers(log, spend)


def _totals(log: ReadingLog) -> DataFrame:
    """Per reader with records on the shelf: pages, distinct books, distinct days.

    The two DISTINCT counts plan as one Expand + two-level aggregate, both
    levels partially aggregated (a hot reader is pre-reduced map-side)."""
    rec = log.record.join(log.shelf.select(*SHELF_KEY), SHELF_KEY, "left_semi")
    return rec.groupBy("user_id").agg(
        F.sum("r_page").alias("yrpage"),
        F.count_distinct("b_isbn").alias("yrbook"),
        F.count_distinct("r_date").alias("yrdt"),
    )


def reading_totals(log: ReadingLog, user=None, year=None) -> DataFrame:
    """Pages read, books touched, distinct reading days (records with a shelf row);
    all time by default, one calendar year with ``year``."""
    log = log.for_user(user).for_year(year)
    return _all_readers(log, _totals(log)).select(
        "user_id",
        "yrpage",
        F.coalesce("yrbook", F.lit(0).cast("long")).alias("yrbook"),
        F.coalesce("yrdt", F.lit(0).cast("long")).alias("yrdt"),
    )


def last_read(log: ReadingLog, user=None) -> DataFrame:
    """Book(s) with the reader's latest b_update_dt — every tie is returned.

    The correlated ``= (SELECT MAX ...)`` becomes a per-user max joined back
    on (user_id, date): two equi-keys, so a reader with a huge shelf is still
    spread over many join partitions.
    """
    log = log.for_user(user)
    dated = log.shelf.filter(F.col("b_update_dt").isNotNull())
    mx = dated.groupBy("user_id").agg(F.max("b_update_dt").alias("b_update_dt"))
    return dated.join(mx, ["user_id", "b_update_dt"], "inner").select(
        "user_id",
        "b_isbn",
        F.date_format("b_update_dt", "yyyyMMdd").alias("lastday"),
        F.col("b_title").alias("lastbook"),
    )


def monthly_pages(log: ReadingLog) -> DataFrame:
    return log.record.groupBy("user_id", F.date_format("r_date", "yyyyMM").alias("dt")).agg(
        F.sum("r_page").alias("month_page")
    )


def monthly_cumulative(log: ReadingLog, user=None, year=None) -> DataFrame:
    """Cumulative pages by month (line chart).

    Months are aggregated first; the running window then sees one row per
    (reader, month) — bounded by the calendar, whatever the reader's volume —
    and is partitioned by reader instead of the original single global frame.
    """
    log = log.for_user(user).for_year(year)
    w = (
        Window.partitionBy("user_id")
        .orderBy(F.col("dt").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = monthly_pages(log).select(
        "user_id",
        "dt",
        month_label("dt").alias("mon"),
        F.sum("month_page").over(w).alias("page"),
    )
    if user is not None:
        out = out.orderBy(F.col("dt").asc_nulls_last())
    return out


def monthly_series(log: ReadingLog, user=None, as_text: bool = True) -> DataFrame:
    """Parallel arrays month-label[] / cumulative-page[] per reader.

    ``collect_list`` is bounded here: one element per month of activity.
    ``as_text`` joins the arrays with ',' for display and comparison.
    """
    cum = monthly_cumulative(log, user)
    agg = cum.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("dt").isNull().alias("nul"), "dt", "mon", "page"))).alias("s")
    )
    mday = F.transform("s", lambda x: x["mon"])
    mpage = F.transform("s", lambda x: x["page"])
    if as_text:
        mday = F.array_join(mday, ",")
        mpage = F.array_join(F.transform(mpage, lambda p: p.cast("string")), ",")
    return agg.select("user_id", mday.alias("mday"), mpage.alias("mpage"))


def genre_counts(log: ReadingLog, user=None) -> DataFrame:
    """Finished books per category (pie chart).

    Grouped by the raw code, labelled after: unknown codes each keep their own
    '기타' row, and a NULL code counts 0 (COUNT of a NULL column).
    """
    log = log.for_user(user)
    g = (
        log.shelf.filter(F.col("b_end_yn") == "Y")
        .groupBy("user_id", "b_category")
        .agg(F.count("b_category").alias("cnt"))
    )
    return g.select(
        "user_id",
        F.col("b_category").alias("b_code"),
        category_label("b_category").alias("b_category"),
        "cnt",
    )


def genre_series(log: ReadingLog, user=None) -> DataFrame:
    """Pie series as JSON text: [{"name": label, "y": count}, ...] ordered by code."""
    g = genre_counts(log, user)
    agg = g.groupBy("user_id").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("b_code").isNull().alias("nul"), "b_code", "b_category", "cnt"))
        ).alias("s")
    )
    items = F.transform("s", lambda x: F.struct(x["b_category"].alias("name"), x["cnt"].alias("y")))
    return agg.select("user_id", F.to_json(items).alias("piedata"))


def record_count(log: ReadingLog, user=None) -> DataFrame:
    """Number of records per reader (0 when none)."""
    log = log.for_user(user)
    n = log.record.groupBy("user_id").agg(F.count(F.lit(1)).alias("totalrow"))
    return _all_readers(log, n).select("user_id", F.coalesce("totalrow", F.lit(0).cast("long")).alias("totalrow"))


def last_book(log: ReadingLog) -> DataFrame:
    """One latest book per reader; ties broken by the larger b_isbn (documented)."""
    dated = log.shelf.filter(F.col("b_update_dt").isNotNull())
    m = dated.groupBy("user_id").agg(F.max(F.struct("b_update_dt", "b_isbn", "b_title")).alias("m"))
    return m.select(
        "user_id",
        F.date_format("m.b_update_dt", "yyyyMMdd").alias("lastday"),
        F.col("m.b_title").alias("lastbook"),
    )


def dashboard(log: ReadingLog, user=None, year=None) -> DataFrame:
    """All tiles of the main page, one row per reader, raw and formatted.

    ``year`` limits the reading tiles to that year's records (the captions
    say "this year"; the original SQL had no year filter, so the default is
    all time).  Spending has no purchase date and stays all time."""
    log = log.for_user(user).for_year(year)
    spend = log.shelf.groupBy("user_id").agg(F.sum("b_dicount").alias("yrmoney"))
    totals = _totals(log)
    last = last_book(log)
    base = log.reader.select("user_id", "user_nm")
    d = (
        base.join(spend, "user_id", "left")
        .join(totals, "user_id", "left")
        .join(last, "user_id", "left")
    )
    lastday = F.coalesce("lastday", F.lit(NO_DATE))
    zero = F.lit(0).cast("long")
    d = d.withColumn("yrbook", F.coalesce("yrbook", zero)).withColumn("yrdt", F.coalesce("yrdt", zero))
    return d.select(
        "user_id",
        "user_nm",
        "yrmoney",
        "yrpage",
        "yrbook",
        "yrdt",
        "lastday",
        "lastbook",
        F.concat(F.coalesce(thousands("yrmoney"), F.lit("0")), F.lit(WON)).alias("yrmoney_text"),
        F.concat(F.coalesce(thousands("yrpage"), F.lit("0")), F.lit(PAGES_UNIT)).alias("yrpage_text"),
        F.concat(F.col("yrbook").cast("string"), F.lit(BOOKS_UNIT)).alias("yrbook_text"),
        F.concat(F.col("yrdt").cast("string"), F.lit(DAYS_UNIT)).alias("yrdt_text"),
        korean_date(lastday).alias("lastday_text"),
        F.coalesce("lastbook", F.lit(NO_BOOK)).alias("lastbook_text"),
    )


def progress_caption(log: ReadingLog, user=None) -> DataFrame:
    """'title (a, b) [cur p/total p], 남은 페이지 : n p' per book in progress."""
    p = reading_progress(log, user)
    values = ("b_title", authors_text("b_author"), "cur_page", "b_page", "to_page")
    cap = F.concat(*[x for v, part in zip(values, CAPTION_PARTS) for x in (js_text(v), F.lit(part))])
    return p.select("user_id", "b_isbn", cap.alias("caption"))

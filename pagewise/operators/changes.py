"""Change application: inserts, profile update, derived-state refresh, deletes.

Each function is DataFrame -> DataFrame and returns the new table state.
Derived shelf state (first/last reading date, finished flag) is recomputed
from a per-book aggregate of ``record`` joined on the shelf key: one
partial aggregation and one join, no correlated subquery per row.

``users`` restricts a refresh to the readers a request touched (the original
statements re-check *all books of that reader*): only their records are
aggregated and only their shelf rows joined; ``None`` means everyone.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewise.functions.text import blank_to_null
from pagewise.schema import READER, RECORD, SHELF, SHELF_KEY


def reader_set(users: DataFrame) -> DataFrame:
    """Distinct reader ids; Spark broadcasts them where their measured size allows."""
    return users.select("user_id").distinct()


def _for_readers(shelf: DataFrame, record: DataFrame, users: DataFrame | None, derive) -> DataFrame:
    """Apply ``derive(shelf, record)`` to the touched readers only; the other
    shelf rows are copied through unchanged (no aggregation of their records)."""
    if users is None:
        return derive(shelf, record)
    ids = reader_set(users.select(F.col("user_id").cast(shelf.schema["user_id"].dataType).alias("user_id")))
    touched = derive(shelf.join(ids, "user_id", "left_semi"), record.join(ids, "user_id", "left_semi"))
    return shelf.join(ids, "user_id", "left_anti").unionByName(touched.select(*shelf.columns))


# -- inserts -----------------------------------------------------------------


def add_reader(reader: DataFrame, new: DataFrame) -> DataFrame:
    """INSERT INTO reader: append profiles (user_id, user_nm, user_email)."""
    return reader.unionByName(new.select(*[F.col(f.name).cast(reader.schema[f.name].dataType) for f in READER.fields]))


def parse_books(form: DataFrame, schema: T.StructType = SHELF) -> DataFrame:
    """Form rows (all text) -> shelf rows, as the insert statement stores them.

    Blank fields become NULL (the database treats '' as NULL), the finished
    flag starts at 'N' and the reading dates start empty.  A row with a field
    that doesn't parse is left out here and found by ``rejected_books``.  The
    keys have the types of ``schema``.
    """
    form = form.filter(~_bad_book(schema))
    t = {f.name: f.dataType for f in schema.fields}

    def val(c: str) -> Column:
        return blank_to_null(F.col(c).cast("string")).try_cast(t[c]).alias(c)

    return form.select(
        *[val(c) for c in ("user_id", "b_isbn", "b_title", "b_author", "b_dicount", "b_page", "b_category",
                           "b_memo", "b_image", "b_mlday", "b_mlpage")],
        F.lit(None).cast("date").alias("b_create_dt"),
        F.lit(None).cast("date").alias("b_update_dt"),
        F.lit("N").alias("b_end_yn"),
    )


def _unparsed(c: str, kind: T.DataType) -> Column:
    """A field that is neither blank nor of the kind."""
    text = blank_to_null(F.col(c).cast("string"))
    return text.isNotNull() & text.try_cast(kind).isNull()


def _bad_book(schema: T.StructType) -> Column:
    return reduce(or_, [_unparsed(c, schema[c].dataType) for c in ("user_id", "b_isbn", "b_dicount", "b_page")])


def _bad_record(schema: T.StructType) -> Column:
    day = blank_to_null(F.col("readDate"))
    bad = [_unparsed("user_id", schema["user_id"].dataType), _unparsed("b_isbn", schema["b_isbn"].dataType), _unparsed("page", schema["r_page"].dataType)]
    return reduce(or_, bad, day.isNotNull() & F.try_to_date(day, "yyyy-MM-dd").isNull())


def rejected_books(form: DataFrame, schema: T.StructType = SHELF) -> DataFrame:
    """Form rows that ``parse_books`` leaves out: one bad field loses one request, not the batch."""
    return form.filter(_bad_book(schema))


def rejected_records(form: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """Form rows that ``parse_records`` leaves out."""
    return form.filter(_bad_record(schema))


def add_books(shelf: DataFrame, form: DataFrame) -> DataFrame:
    return shelf.unionByName(parse_books(form, shelf.schema))


def parse_records(form: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """Form rows (user_id, b_isbn, readDate 'YYYY-MM-DD', page) -> record rows, without ``rejected_records``."""
    return form.filter(~_bad_record(schema)).select(
        F.col("user_id").try_cast(schema["user_id"].dataType).alias("user_id"),
        F.col("b_isbn").try_cast(schema["b_isbn"].dataType).alias("b_isbn"),
        F.try_to_date(blank_to_null("readDate"), "yyyy-MM-dd").alias("r_date"),
        blank_to_null(F.col("page").cast("string")).try_cast(schema["r_page"].dataType).alias("r_page"),
    )


def add_records(record: DataFrame, form: DataFrame) -> DataFrame:
    return record.unionByName(parse_records(form, record.schema))


# -- updates -----------------------------------------------------------------


def update_profile(reader: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """UPDATE reader SET user_nm, user_email WHERE user_id = ... (NULL is a legal new value).

    With ``order`` (e.g. a request sequence column), several changes of one
    reader resolve to the latest; without it, one change per reader is assumed."""
    if order is not None:
        latest = F.max_by(F.struct("user_nm", "user_email"), order)
        changes = changes.groupBy("user_id").agg(latest.alias("_c")).select("user_id", "_c.*")
    ch = changes.select(
        "user_id",
        F.col("user_nm").alias("_nm"),
        F.col("user_email").alias("_em"),
        F.lit(True).alias("_hit"),
    )
    j = reader.join(ch, "user_id", "left")
    hit = F.col("_hit").isNotNull()
    return j.select(
        "user_id",
        F.when(hit, F.col("_nm")).otherwise(F.col("user_nm")).alias("user_nm"),
        F.when(hit, F.col("_em")).otherwise(F.col("user_email")).alias("user_email"),
    )


def book_totals(record: DataFrame) -> DataFrame:
    """Per book: pages read (NULL if all pages are NULL), dated range, row count."""
    return record.groupBy(*SHELF_KEY).agg(
        F.sum("r_page").alias("_sum"),
        F.min("r_date").alias("_first"),
        F.max("r_date").alias("_last"),
        F.count(F.lit(1)).alias("_rows"),
    )


def refresh_dates(shelf: DataFrame, record: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """First/last reading date of every book of the touched readers (NULL when no dated record)."""

    def derive(sh: DataFrame, rec: DataFrame) -> DataFrame:
        j = sh.join(book_totals(rec).select(*SHELF_KEY, "_first", "_last"), SHELF_KEY, "left")
        return j.withColumn("b_create_dt", F.col("_first")).withColumn("b_update_dt", F.col("_last")).select(
            *sh.columns
        )

    return _for_readers(shelf, record, users, derive)


def mark_finished(shelf: DataFrame, record: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """b_end_yn = 'Y' where pages read equal b_page exactly; other rows unchanged.

    (isbn, page) IN (isbn, SUM(pages)): NULL on either side is UNKNOWN, and a
    book without records is not IN — both leave the flag as it was.
    """

    def derive(sh: DataFrame, rec: DataFrame) -> DataFrame:
        j = sh.join(book_totals(rec).select(*SHELF_KEY, "_sum"), SHELF_KEY, "left")
        return j.withColumn("b_end_yn", _finished_flag()).select(*sh.columns)

    return _for_readers(shelf, record, users, derive)


def unmark_finished(shelf: DataFrame, record: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """b_end_yn = 'N' where (isbn, page) NOT IN (isbn, SUM(pages)) is TRUE.

    TRUE for a book without records (empty set) or a known, different sum;
    UNKNOWN (flag unchanged) when the sum or b_page is NULL.
    """

    def derive(sh: DataFrame, rec: DataFrame) -> DataFrame:
        j = sh.join(book_totals(rec).select(*SHELF_KEY, "_rows", "_sum"), SHELF_KEY, "left")
        return j.withColumn("b_end_yn", _unfinished_flag()).select(*sh.columns)

    return _for_readers(shelf, record, users, derive)


# -- deletes -----------------------------------------------------------------


def remove_books(
    shelf: DataFrame, keys: DataFrame, record: DataFrame | None = None, cascade: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """DELETE shelf rows by (user_id, b_isbn); with ``cascade`` their records too."""
    k = keys.select(*SHELF_KEY).distinct()
    new_shelf = shelf.join(k, SHELF_KEY, "left_anti")
    new_record = record.join(k, SHELF_KEY, "left_anti") if (record is not None and cascade) else record
    return new_shelf, new_record


def remove_records(record: DataFrame, keys: DataFrame) -> DataFrame:
    """DELETE every record of (user_id, b_isbn, day); the day arrives as 'YYYY-MM-DD' text."""
    k = keys.select(
        F.col("user_id").cast(record.schema["user_id"].dataType).alias("user_id"),
        F.col("b_isbn").cast(record.schema["b_isbn"].dataType).alias("b_isbn"),
        F.try_to_date(F.col("rday").cast("string"), "yyyy-MM-dd").alias("r_date"),
    ).distinct()
    return record.join(k, [*SHELF_KEY, "r_date"], "left_anti").select(*[f.name for f in RECORD.fields])


# -- one request = one plan -----------------------------------------------------


def _refreshed(shelf: DataFrame, record: DataFrame, users: DataFrame, flag) -> DataFrame:
    """Dates and flag of the touched readers' books from one per-book aggregate."""

    def derive(sh: DataFrame, rec: DataFrame) -> DataFrame:
        j = sh.join(book_totals(rec), SHELF_KEY, "left").withColumn("b_end_yn", flag())
        return j.withColumn("b_create_dt", F.col("_first")).withColumn("b_update_dt", F.col("_last")).select(*sh.columns)

    return _for_readers(shelf, record, users, derive)


def _finished_flag() -> Column:
    hit = F.coalesce(F.col("_sum") == F.col("b_page"), F.lit(False))
    return F.when(hit, F.lit("Y")).otherwise(F.col("b_end_yn"))


def _unfinished_flag() -> Column:
    hit = F.col("_rows").isNull() | F.coalesce(F.col("_sum") != F.col("b_page"), F.lit(False))
    return F.when(hit, F.lit("N")).otherwise(F.col("b_end_yn"))


def apply_add_request(shelf: DataFrame, record: DataFrame, form: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One "log pages" request (or a batch of requests from *different*
    readers): insert, refresh the dates of the readers' books, set 'Y' where
    the pages now match.  Several requests of one reader must go through the
    replay (the flag depends on their order)."""
    new = parse_records(form, record.schema)
    new_record = record.unionByName(new)
    return _refreshed(shelf, new_record, new, _finished_flag), new_record


def apply_delete_request(shelf: DataFrame, record: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One "delete a day" request: delete, refresh dates, set 'N' where NOT IN holds."""
    new_record = remove_records(record, keys)
    return _refreshed(shelf, new_record, keys, _unfinished_flag), new_record

"""Operators against statements written from their rules, both on Spark, over all readers.

Each statement totals a book's records once and spells out the cases that
three-valued logic leaves open; the operators reach the same rows their own way."""

import pytest

from pagewise.operators import changes, dashboard, lists, progress
from pagewise.sources.binding import driver_log
from tests.conftest import SF001

TOTALS = """
WITH totals AS (
  SELECT user_id AS reader, b_isbn AS book, sum(r_page) AS pages, count(*) AS entries
  FROM record GROUP BY ALL
)
"""


@pytest.fixture(scope="module")
def views(spark):
    log = driver_log(spark, SF001)
    for name in ("reader", "shelf", "record"):
        getattr(log, name).createOrReplaceTempView(name)
    return log


def _same(got, statement):
    cols = sorted(got.columns)
    want = got.sparkSession.sql(statement)
    assert sorted(want.columns) == cols
    left, right = (sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) for df in (got, want))
    assert left == right


def test_pages_read_and_left(views):
    _same(
        progress.reading_progress(views),
        TOTALS
        + """
SELECT s.user_id, s.b_isbn, s.b_title, s.b_author, s.b_page, s.b_create_dt,
       ifnull(t.pages, 0) AS cur_page, s.b_page - ifnull(t.pages, 0) AS to_page
FROM shelf s LEFT JOIN totals t ON t.reader = s.user_id AND t.book = s.b_isbn
WHERE s.b_end_yn = 'N'
""",
    )


def test_last_book_read(views):
    _same(
        dashboard.last_read(views),
        """
SELECT user_id, b_isbn, date_format(b_update_dt, 'yyyyMMdd') AS lastday, b_title AS lastbook
FROM (SELECT s.*, rank() OVER (PARTITION BY user_id ORDER BY b_update_dt DESC NULLS LAST) AS place FROM shelf s)
WHERE place = 1 AND b_update_dt IS NOT NULL
""",
    )


def test_finished_where_pages_agree(views):
    got = changes.mark_finished(views.shelf, views.record).select("user_id", "b_isbn", "b_end_yn")
    _same(
        got,
        TOTALS
        + """
SELECT s.user_id, s.b_isbn,
       if(EXISTS (SELECT 1 FROM totals t WHERE t.reader = s.user_id AND t.book = s.b_isbn AND t.pages = s.b_page),
          'Y', s.b_end_yn) AS b_end_yn
FROM shelf s
""",
    )


def test_unfinished_where_pages_are_known_to_differ(views):
    got = changes.unmark_finished(views.shelf, views.record).select("user_id", "b_isbn", "b_end_yn")
    _same(
        got,
        TOTALS
        + """
SELECT s.user_id, s.b_isbn,
       CASE WHEN t.entries IS NULL THEN 'N'
            WHEN t.pages IS NULL OR s.b_page IS NULL THEN s.b_end_yn
            WHEN t.pages <> s.b_page THEN 'N'
            ELSE s.b_end_yn END AS b_end_yn
FROM shelf s LEFT JOIN totals t ON t.reader = s.user_id AND t.book = s.b_isbn
""",
    )


def test_finished_books_with_records(views):
    got = lists.finished_list(views).select("user_id", "b_isbn", "b_title", "b_page")
    _same(
        got,
        TOTALS
        + """
SELECT s.user_id, s.b_isbn, s.b_title, s.b_page
FROM shelf s
INNER JOIN totals t ON t.reader = s.user_id AND t.book = s.b_isbn
WHERE s.b_end_yn = 'Y' AND EXISTS (SELECT 1 FROM reader r WHERE r.user_id = s.user_id)
""",
    )

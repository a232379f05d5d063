"""Invariants over the sf0.001 driver data."""

from pyspark.sql import functions as F

from pagewise.operators import dashboard, lists, progress
from pagewise.sources.binding import driver_log
from tests.conftest import SF001


def test_last_running_sum_equals_total(spark):
    log = driver_log(spark, SF001)
    r = lists.running_pages(log.record, log.shelf)
    last = r.groupBy("user_id", "b_isbn").agg(F.max("sum_page").alias("last"))
    tot = progress.progress(log.record).select("user_id", "b_isbn", "cur_sum")
    bad = last.join(tot, ["user_id", "b_isbn"]).filter(~F.col("last").eqNullSafe(F.col("cur_sum")))
    assert bad.count() == 0
    assert r.count() == log.record.join(log.shelf.select("user_id", "b_isbn"), ["user_id", "b_isbn"], "left_semi").count()


def test_to_page_plus_cur_page_is_b_page(spark):
    p = progress.reading_progress(driver_log(spark, SF001))
    assert p.filter(F.col("to_page") + F.col("cur_page") != F.col("b_page")).count() == 0


def test_months_sum_to_total_pages(spark):
    log = driver_log(spark, SF001)
    m = dashboard.monthly_cumulative(log).groupBy("user_id").agg(F.max("page").alias("m"))
    t = log.record.groupBy("user_id").agg(F.sum("r_page").alias("t"))
    assert m.join(t, "user_id").filter(F.col("m") != F.col("t")).count() == 0


def test_page_numbers(spark):
    p = lists.paged_log(driver_log(spark, SF001))
    per = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("rn").alias("mx"), F.max("page_no").alias("pg"))
    assert per.filter((F.col("n") != F.col("mx")) | (F.col("pg") != F.ceil(F.col("n") / 10))).count() == 0


def test_single_user_view_is_sorted(spark):
    log = driver_log(spark, SF001)
    u = log.shelf.select("user_id").first()[0]
    rows = progress.reading_progress(log, user=u).collect()
    dates = [r.b_create_dt for r in rows]
    known = [d for d in dates if d is not None]
    assert known == sorted(known) and dates[: len(known)] == known


def test_running_pages_chunked_expansion(spark, monkeypatch):
    """Force the chunked expansion (tiny chunk) and compare with the default path."""
    from pagewise.operators import lists

    log = driver_log(spark, SF001)
    cols = ["user_id", "b_isbn", "r_date", "r_page", "sum_page"]
    a = sorted(map(tuple, lists.running_pages(log.record, log.shelf).select(*cols).collect()), key=repr)
    monkeypatch.setattr(lists, "EXPAND_CHUNK", 1)
    b = sorted(map(tuple, lists.running_pages(log.record, log.shelf).select(*cols).collect()), key=repr)
    assert a == b

"""Bucketed tables: no exchange of the records, hot and unknown keys apart, found again by a new catalog."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewise.operators import lists, progress
from pagewise.sources import bucketed
from pagewise.sources.binding import ReadingLog, driver_log
from tests.conftest import SF001


def name():
    return f"log_{uuid.uuid4().hex[:8]}"


def rows(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def logs(spark):
    log = driver_log(spark, SF001)
    return log, bucketed.write(spark, log, name(), 4)


QUERIES = [progress.reading_progress, lists.record_log, lists.book_detail, lists.wish_list]


@pytest.mark.parametrize("query", QUERIES)
def test_no_exchange_of_records(spark, logs, query):
    plain, stored = logs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if both sides were large
    try:
        df = query(stored)
        assert "Exchange" not in plan(df) and "Exchange" in plan(query(plain))
        assert rows(df) == rows(query(plain))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_file_a_bucket(spark, logs):
    stored = logs[1]
    files = stored.bounded.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 4 and stored.hot is None


def made(spark):
    rng = random.Random(4)
    shelf = spark.createDataFrame([(u, b, f"t{b}", "a", 1, 50, "000", "", "", None, None, None, None, "N") for u in range(3) for b in range(4)], driver_schema(spark, "shelf"))
    base = [(0, 0, i % 28) for i in range(400)] + [(rng.randint(0, 2), rng.randint(1, 3), rng.randint(0, 27)) for _ in range(300)] + [(None, 1, 3)] * 50 + [(1, None, 3)] * 50 + [(9, 9, 1)]
    record = spark.createDataFrame([(u, b, None if d == 5 else f"2024-02-{d + 1:02d}", rng.choice([None, 1, 2, 30])) for u, b, d in base], "user_id long, b_isbn long, d string, r_page long")
    return ReadingLog(spark.createDataFrame([(u, "n", "e") for u in range(4)], driver_schema(spark, "reader")), shelf, record.select("user_id", "b_isbn", F.col("d").cast("date").alias("r_date"), "r_page"))


def driver_schema(spark, table):
    return getattr(driver_log(spark, SF001), table).schema


def test_hot_books_and_unknown_keys_are_no_bucket(spark):
    log = made(spark)
    stored = bucketed.write(spark, log, name(), 3, hot_rows=200)
    assert stored.hot.count() == 500 and stored.bounded.groupBy("user_id", "b_isbn").count().agg(F.max("count")).first()[0] <= 200
    assert rows(stored.record) == rows(log.record)
    for query in QUERIES:
        assert rows(query(stored)) == rows(query(log)), query


def test_a_new_catalog_finds_the_tables(spark):
    log, n = made(spark), name()
    bucketed.write(spark, log, n, 3)
    for t in ("shelf", "record"):
        spark.sql(f"DROP TABLE {n}_{t}")  # the files stay: the table is external
    again = bucketed.read(spark, n)
    assert rows(again.record) == rows(log.record) and rows(lists.record_log(again)) == rows(lists.record_log(log))
    assert "Exchange" not in plan(again.bounded.groupBy("user_id", "b_isbn").count())


def test_empty_tables(spark):
    log = made(spark)
    none = ReadingLog(log.reader.limit(0), log.shelf.limit(0), log.record.limit(0))
    stored = bucketed.write(spark, none, name(), 2)
    assert all(query(stored).count() == 0 for query in QUERIES)


def test_hot_books_are_those_counted_one_by_one(spark, monkeypatch):
    record = made(spark).record
    assert bucketed._hot_keys(record, 1000) is None
    for hashes in (1, 1 << 16):  # all books share a hash
        monkeypatch.setattr(bucketed, "COUNTED", hashes)
        assert rows(bucketed._hot_keys(record, 200)) == {(0, 0): 1}
    assert rows(bucketed._hot_keys(record, 0)) == {(b, u): 1 for u, b in {(r.user_id, r.b_isbn) for r in record.collect()} if None not in (u, b)}

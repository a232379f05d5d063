"""Running totals from the tree of sums, after random adds and deletes."""

import datetime as dt
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewise.operators import dashboard, lists
from pagewise.operators.prefix import LEVELS, UNDATED, PageTree, month_number, removed
from pagewise.sources.binding import ReadingLog
from tests.test_tiles import made, rows

COLUMNS = "user_id long, b_isbn long, r_date date, r_page long"


def both(spark):
    name = uuid.uuid4().hex
    return PageTree(spark, f"{name}-book"), PageTree(spark, f"{name}-reader", ["user_id"])


def drawn(rng, n):
    days = [None, dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2024, 2, 29), dt.date(2024, 2, 1), dt.date(2024, 3, 1), dt.date(9999, 12, 31)]
    days += [dt.date(2023, 1, 1) + dt.timedelta(rng.randrange(700)) for _ in range(6)]
    return [(rng.choice([0, 1, 2, 9, None]), rng.choice([0, 1, 7, None]), rng.choice(days), rng.choice([None, 0, 5, 30])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_full_log_after_random_changes(spark, seed):
    rng, log = random.Random(seed), made(spark)
    book, reader = both(spark)
    held: list[tuple] = []
    for batch in range(4):
        added = drawn(rng, 60)
        # a delete takes every record of (reader, book, day); a NULL key or day equals nothing
        days = {r[:3] for r in held if rng.random() < 0.3 and None not in r[:3]}
        keys = spark.createDataFrame([(*k, 0) for k in days], COLUMNS)
        gone = removed(spark.createDataFrame(held, COLUMNS), keys)
        held = [r for r in held if r[:3] not in days] + added
        for tree in (book, reader):
            tree.apply(batch, spark.createDataFrame(added, COLUMNS), gone)
        if batch == 2:
            book.compact()
            reader.compact()
            book.apply(1, spark.createDataFrame(added, COLUMNS))  # a batch the compacted part holds comes again
    book.apply(3, spark.createDataFrame(added, COLUMNS), gone)  # the last one comes again
    now = ReadingLog(log.reader, log.shelf, spark.createDataFrame(held, COLUMNS))
    assert rows(book.record_log(now)) == rows(lists.record_log(now))
    assert rows(reader.monthly_cumulative()) == rows(dashboard.monthly_cumulative(now))
    for since in ("2024-02-29", "1969-12-05", "9999-12-01"):
        part = F.col("r_date").isNull() | (F.col("r_date") >= f"{since[:7]}-01")
        assert rows(book.record_log(now, since=since)) == rows(lists.record_log(now).filter(part))
    assert rows(book.record_log(now, user=1)) == rows(lists.record_log(now, user=1))


def test_a_change_rewrites_one_node_per_level(spark):
    book, _ = both(spark)
    long = [(1, 1, dt.date(y, m, 1), 3) for y in range(1990, 2020) for m in range(1, 13)]
    book.apply(0, spark.createDataFrame(long, COLUMNS))
    book.apply(1, spark.createDataFrame([(1, 1, dt.date(2004, 5, 9), 4)] * 50, COLUMNS))
    assert spark.read.parquet(f"{book.root}/nodes/part=1").count() == LEVELS
    asked = spark.createDataFrame([(1, 1, 2010 * 12)], "user_id long, b_isbn long, _m int")
    assert [(r._pages, r._n) for r in book.before(asked).collect()] == [(20 * 12 * 3 + 200, 20 * 12 + 50)]


def test_what_was_added_and_deleted_leaves_no_node(spark):
    book, reader = both(spark)
    some = spark.createDataFrame(drawn(random.Random(5), 40), COLUMNS)
    for tree in (book, reader):
        with pytest.raises(FileNotFoundError):
            tree.nodes()
        with pytest.raises(ValueError):
            tree.apply(0)
        tree.apply(0, some)
        tree.apply(1, gone=some)
        assert tree.nodes().count() == 0
        tree.compact()
        assert tree.nodes().count() == 0
        tree.apply(2, some.limit(0))
        assert tree.nodes().count() == 0
    assert reader.monthly_cumulative().count() == 0


def test_months_before_since_are_not_read(spark):
    log = made(spark)
    book, _ = both(spark)
    book.apply(0, log.record)
    path = f"{book.root}-records"
    log.record.write.parquet(path)
    stored = ReadingLog(log.reader, log.shelf, spark.read.parquet(path))
    plan = book.record_log(stored, user=1, since="2024-02-29")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(r_date,2024-02-01)" in plan
    assert plan.count("EqualTo(user_id,1)") >= 2  # records and nodes


def test_month_numbers(spark):
    days = [None, dt.date(1, 1, 1), dt.date(9999, 12, 31)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select(month_number("d").alias("m")).collect()
    assert Counter(r.m for r in got) == Counter([UNDATED, 12, 9999 * 12 + 11]) and 9999 * 12 + 11 < UNDATED < 1 << LEVELS


def test_keys_of_few_records_have_no_more_nodes_than_records(spark):
    """A path of LEVELS nodes for each month of a book with few records filled the disk."""
    book, _ = both(spark)
    few = [(u, u, dt.date(2020 + u % 3, m, 1), 3) for u in range(20) for m in (1, 4, 7, 10)]
    book.apply(0, spark.createDataFrame(few, COLUMNS))
    assert spark.read.parquet(f"{book.root}/nodes/part=0").count() == len(few)
    for batch in (1, 2, 3):  # a key whose loose months grow many goes up the tree when they are compacted
        more = [(1, 1, dt.date(1990 + batch, m, 1), 1) for m in range(1, 13)]
        book.apply(batch, spark.createDataFrame(more, COLUMNS))
    book.compact()
    assert {r.level for r in book.nodes({"user_id": 1}).collect()} == set(range(LEVELS))
    assert {r.level for r in book.nodes({"user_id": 2}).collect()} == {-1}
    asked = spark.createDataFrame([(1, 1, 2021 * 12 + 1), (2, 2, 2022 * 12 + 5)], "user_id long, b_isbn long, _m int")
    assert sorted((r.user_id, r._pages, r._n) for r in book.before(asked).collect()) == [(1, 36 + 3, 37), (2, 6, 2)]
    late = {(r.user_id, r._m): (r._pages, r._n) for r in book.totals(2021 * 12 + 1).collect()}
    assert late[(1, 2021 * 12 + 3)] == (39, 37) and late[(2, 2022 * 12 + 6)] == (6, 2)


def test_a_delete_beside_the_tree_of_a_record_inside_it(spark):
    _, reader = both(spark)
    held = [(1, 1, dt.date(2020, m, d), 30) for m in range(1, 13) for d in (1, 2, 3)]
    reader.apply(0, spark.createDataFrame(held, COLUMNS))  # many: up the tree
    reader.apply(1, spark.createDataFrame([(1, 1, dt.date(2020, 5, 9), 10)], COLUMNS))
    reader.apply(2, gone=spark.createDataFrame([(1, 1, dt.date(2020, 5, 1), 30)], COLUMNS))
    want = {m: 90 * m - (20 if m >= 5 else 0) for m in range(1, 13)}
    assert {int(r.dt[4:]): r.page for r in reader.monthly_cumulative().collect()} == want
    reader.compact()
    assert {int(r.dt[4:]): r.page for r in reader.monthly_cumulative().collect()} == want
    asked = spark.createDataFrame([(1, 2020 * 12 + 6)], "user_id long, _m int")
    assert [(r._pages, r._n) for r in reader.before(asked).collect()] == [(6 * 90 - 20, 18)]

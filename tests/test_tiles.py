"""Tiles from merged batches, SQL functions, payloads of broken shape, stream batches."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewise.operators import dashboard, lists, progress
from pagewise.operators.tiles import TileState, merged, reduced
from pagewise.sources import catalog, sql_functions
from pagewise.sources.binding import ReadingLog, driver_log
from tests.conftest import SF001


def rows(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def made(spark, seed=3):
    rng = random.Random(seed)
    like = driver_log(spark, SF001)
    reader = spark.createDataFrame([(u, "n", "e") for u in range(6)], like.reader.schema)
    shelf = spark.createDataFrame([(u, b, f"t{b}", "a", 1, 50, "000", "", "", None, None, None, None, "N") for u in range(5) for b in range(4)], like.shelf.schema)
    days = [None, "1931-01-01", "1969-12-31", "1970-01-01", "2024-02-29", "2059-09-18", "2059-09-19", "2100-01-01"]  # both sides of a bitmap's end
    data = [(rng.choice([0, 1, 2, 3, 9, None]), rng.choice([0, 1, 2, 7, None]), rng.choice(days), rng.choice([None, 0, 5])) for _ in range(300)]
    record = spark.createDataFrame(data, "user_id long, b_isbn long, d string, r_page long")
    return ReadingLog(reader, shelf, record.select("user_id", "b_isbn", F.col("d").cast("date").alias("r_date"), "r_page"))


def full(log):
    return dashboard.reading_totals(log).join(dashboard.record_count(log), "user_id")


def test_tiles_equal_the_full_recompute_after_every_batch(spark):
    log, state, seen = made(spark), TileState(spark, uuid.uuid4().hex), None
    for i in range(5):
        batch = log.record.filter(F.pmod(F.hash("user_id", "b_isbn", "r_date", "r_page"), F.lit(5)) == i)
        seen = batch if seen is None else seen.unionByName(batch)
        state.append(i, batch, log.shelf)
        if i == 2:
            state.compact()
            assert state.parts() == ["base=2"]
            state.compact()  # nothing came since
            assert state.parts() == ["base=2"]
            state.append(1, batch, log.shelf)  # a batch that the compacted part holds comes again
        assert rows(state.tiles(log.reader, log.shelf)) == rows(full(ReadingLog(log.reader, log.shelf, seen)))
    state.append(4, batch, log.shelf)  # the last batch comes again
    assert state.parts() == ["base=2", "part=3", "part=4"]
    assert rows(state.tiles(log.reader, log.shelf)) == rows(full(log))
    again = TileState(spark, state.root.rsplit("/", 1)[1])
    assert rows(again.tiles(log.reader, log.shelf)) == rows(full(log))


def test_a_batch_without_its_marker_does_not_count(spark):
    log, state = made(spark), TileState(spark, uuid.uuid4().hex)
    with pytest.raises(FileNotFoundError):
        state.tiles(log.reader, log.shelf)
    state.append(0, log.record, log.shelf)
    want = rows(state.tiles(log.reader, log.shelf))
    log.record.groupBy("user_id", "b_isbn").agg(F.sum("r_page").alias("pages"), F.count(F.lit(1)).alias("n")).write.parquet(f"{state.root}/books/part=1")
    assert rows(state.tiles(log.reader, log.shelf)) == want
    state.append(1, log.record.limit(0), log.shelf)
    assert rows(state.tiles(log.reader, log.shelf)) == want


def test_sql_functions(spark):
    log, p = driver_log(spark, SF001), f"t{uuid.uuid4().hex[:6]}"
    sql_functions.register(spark, log, p)
    user = log.shelf.filter("b_end_yn = 'N'").agg(F.min("user_id")).first()[0]
    for scheme in ("kdc", "alt"):
        got = spark.sql(f"SELECT * FROM {p}_shelf(:u, :s)", args={"u": user, "s": scheme})
        assert rows(got) == rows(lists.shelf_listing(log, user, scheme).drop("user_id"))
        want = lists.shelf_listing(log, scheme=scheme).select("b_isbn", "b_category")
        assert rows(log.shelf.select("b_isbn", F.expr(f"{p}_label(b_category, '{scheme}')").alias("b_category"))) == rows(want)
    got = spark.sql(f"SELECT * FROM {p}_progress({user})")
    assert rows(got) == rows(progress.reading_progress(log, user).drop("user_id"))
    assert f"EqualTo(user_id,{user})" in got._jdf.queryExecution().executedPlan().toString()
    one = spark.sql(f"SELECT * FROM {p}_profile({user})").collect()
    assert one == log.reader.filter(F.col("user_id") == user).select("user_nm", "user_email").collect()
    assert spark.sql(f"SELECT * FROM {p}_shelf(NULL, 'alt')").count() == 0


def test_payloads_of_broken_shape(spark):
    item = '{"title":"t","image":null,"author":"a^b","discount":12,"isbn":"9"}'
    texts = [f'{{"items":[{item}]}}', f'{{"items":[{item}', "", "null", "[1]", "7", '{"items":{}}', '{"items":[]}', '{"item":[]}', f'{{"items":[1,{item},null,{{"title":"x"}},"s"]}}', None]
    good, bad = catalog.variant_items(spark, spark.createDataFrame([(t,) for t in texts], "payload string"))
    assert [tuple(r) for r in good.collect()] == [("t", None, "a^b", "12", "9")] * 2
    got = Counter((r.payload, r.place, r.reason) for r in bad.collect())
    last = texts[9]
    assert got == Counter([(texts[1], None, "not json"), ("", None, "not json"), (None, None, "not json"), *((t, None, "no items") for t in texts[3:7] + texts[8:9]), *((last, i, "no item") for i in (0, 2, 3, 4))])


def test_days_are_aggregated_by_hash(spark):
    log = made(spark)
    rest = [f"{d}" for d in (-65, -64, -1, 0, 62, 63, 64, 127, 128, 20000)]  # both ends of a number's bits
    record = spark.createDataFrame([(u, 1, int(d), 1) for u in range(3) for d in rest[u:]] * 2, "user_id long, b_isbn long, d int, r_page long")
    record = record.select("user_id", "b_isbn", F.date_from_unix_date("d").alias("r_date"), "r_page")
    part = reduced(record, log.shelf)
    for days in (part["days"], merged(part)["days"]):
        plan = days._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
        assert rows(days.groupBy("user_id").agg(F.sum(F.bit_count("bits")).alias("n"))) == Counter([(10, 0), (9, 1), (8, 2)])

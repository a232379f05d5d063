"""The bucketed running aggregates equal the plain window, on a skewed key and on NULL keys."""

import random
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewise.operators import scan


def _data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        k = 0 if i < 4000 else rng.randint(1, 50)  # key 0 holds two thirds of the rows
        rows.append((k, i * 3 + rng.randint(0, 2), rng.choice([None, 1, 2, 5]), rng.randint(-9, 9)))
    rows += [(None, i, 1, 1) for i in range(40)] + [(1, None, 2, 2)]
    return spark.createDataFrame(rows, "k long, seq long, v long, w long")


def _plain(df, keys, order, specs):
    agg = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    w = Window.partitionBy(*keys).orderBy(*order)
    for name, kind, value, inclusive in specs:
        df = df.withColumn(name, agg[kind](value).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
    return df


def _rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_running_equals_window(spark):
    df = _data(spark)
    specs = [
        ("s_inc", "sum", F.coalesce(F.col("v"), F.lit(0)), True),
        ("s_exc", "sum", F.col("w"), False),
        ("m_inc", "min", F.col("w"), True),
        ("x_exc", "max", F.col("v"), False),
        ("c_inc", "count", F.col("v"), True),
    ]
    cols = ["k", "seq", "s_inc", "s_exc", "m_inc", "x_exc", "c_inc"]
    for how in ("asc_nulls_last", "desc_nulls_first"):
        order = [getattr(F.col("seq"), how)()]
        got = scan.running(df, ["k"], order, specs, [(F.expr("seq div 500"), how)])
        assert _rows(got, cols) == _rows(_plain(df, ["k"], order, specs), cols)


def test_row_number(spark):
    df = _data(spark)
    out = scan.row_number(df, ["k"], [F.col("seq").desc_nulls_last()], [(F.expr("seq div 100"), "desc_nulls_last")])
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("seq").desc_nulls_last())).cast("long"))
    assert _rows(out, ["k", "seq", "rn"]) == _rows(want, ["k", "seq", "rn"])


def test_building_a_frame_runs_no_job(spark):
    from tests.fixture import micro_log

    from pagewise.operators import changes, lists

    log = micro_log(spark)
    tracker, group = spark.sparkContext.statusTracker(), "lazy"
    spark.sparkContext.setJobGroup(group, group)
    lists.paged_log(log)
    lists.record_log(log)
    changes.refresh_dates(log.shelf, log.record, log.reader.select("user_id"))
    assert not tracker.getJobIdsForGroup(group)


def test_running_rows_are_exchanged_once(spark):
    """The rows stand by key and bucket for the window; the join of the totals must not deal them again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
        out = scan.running(df, ["k"], [F.col("id").asc()], [("s", "sum", F.col("id"), True)], [(F.expr("id div 10"), "asc")])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 4  # the rows; the totals by place, by key, and for the join


def test_keys_and_named_buckets_are_carried_once(spark):
    """The exchanged rows have the key and its bucket in the place, not as columns beside it; NULLs are values."""
    rows = [(k, b, i) for i, (k, b) in enumerate([(1, 1), (1, None), (None, 2), (None, None), (1, 1), (2, 2), (None, 2)])]
    df = spark.createDataFrame(rows, "k long, b long, id long")
    out = scan.row_number(df, ["k"], [F.col("id").asc()], [("b", "asc_nulls_last")])
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("b").asc_nulls_last(), "id")).cast("long"))
    assert out.columns == want.columns and _rows(out, want.columns) == _rows(want, want.columns)
    plan = out._jdf.queryExecution().executedPlan()
    window = plan.toString().split("Window [count(1)")[1]
    rows_of = window.split("Project [")[1].split("\n")[0]  # what is exchanged below the window of the rows
    assert " AS _place" in rows_of and rows_of.split("struct(")[0].count("#") == 1  # id alone


def test_a_log_that_fits_is_exchanged_once(spark, monkeypatch):
    """Pages of readers that one task can hold come from one exchange of records and books; those of dealt readers are the same."""
    from pagewise.operators import lists
    from tests.fixture import micro_log

    base = micro_log(spark)
    path = tempfile.mkdtemp(prefix="pagewise-log-")
    twice = base.record.unionByName(base.record.filter("b_isbn = 3")).unionByName(spark.createDataFrame([(None, 1, None, 3), (1, None, None, 4)], base.record.schema))
    for name, df in (("shelf", base.shelf.unionByName(base.shelf.filter("b_isbn = 4"))), ("record", twice)):
        df.write.parquet(f"{path}/{name}")
    log = type(base)(base.reader, *(spark.read.parquet(f"{path}/{t}") for t in ("shelf", "record")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = lists.paged_log(log)
        got = sorted(map(tuple, whole.collect()), key=repr)
        final = whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        dealt = [x for x in final.split("\n") if "Exchange hashpartitioning(" in x and "(slot" not in x]  # slots: the count of rows by reader
        assert len(dealt) == 1 and "hashpartitioning(user_id" in dealt[0] and ", b_isbn" not in dealt[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for rows in (0, 3):  # all readers dealt to buckets, or some
        monkeypatch.setattr(scan, "CROWDED", rows)
        assert _rows(lists.paged_log(log), whole.columns) == got

"""Randomised: the bucketed scan equals the plain window."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewise.operators import scan
from tests.test_scan import _plain

ROWS = st.lists(
    st.tuples(
        st.sampled_from([0, 0, 0, 1, 2]),  # key 0 is hot
        st.integers(0, 30),  # order value, with ties
        st.one_of(st.none(), st.integers(-5, 5)),
    ),
    min_size=1,
    max_size=120,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ROWS)
def test_bucketed_scan_property(spark, rows):
    df = spark.createDataFrame([(k, o, v, i) for i, (k, o, v) in enumerate(rows)], "k long, o long, v long, i long")
    order = [F.col("o").asc(), F.col("i").asc()]  # total order: ties broken by row id
    specs = [
        ("s", "sum", F.col("v"), True),
        ("se", "sum", F.col("v"), False),
        ("mn", "min", F.col("v"), True),
        ("mx", "max", F.col("v"), False),
        ("c", "count", F.col("v"), True),
    ]
    cols = ["i", "s", "se", "mn", "mx", "c"]
    a = _plain(df, ["k"], order, specs).select(*cols)
    b = scan.running(df, ["k"], order, specs, [(F.expr("o div 7"), "asc")]).select(*cols)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))

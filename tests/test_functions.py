"""Scalar helpers vs exact Python arithmetic."""

from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from pagewise.functions import numeric, text
from pagewise.functions.category import category_label


def test_ratio_rounding_exact(spark):
    pairs = [(n, d) for d in (1, 2, 3, 7, 8, 40, 200, 1000) for n in range(0, 420, 7)] + [(201, 200), (1, 40), (5, 8), (9 * 10**16 + 1, 200)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select(
        "n", "d",
        numeric.ratio_round_half_up("n", "d").alias("up"),
        F.bround(F.col("n") / F.col("d"), 2).alias("br"),
    ).collect()
    for r in got:
        n, d = r.n, r.d
        assert r.up == float((Decimal(n) / Decimal(d)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)), (n, d)
        assert r.br == float((Decimal(n) / Decimal(d)).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN)), (n, d)


def test_text_helpers(spark):
    df = spark.createDataFrame([("", "A^B^C", "20241105", 1234567)], "m string, a string, d string, x long")
    r = df.select(
        text.nvl_text("m").alias("m"),
        text.authors_text("a").alias("a"),
        text.korean_date("d").alias("d"),
        text.thousands("x").alias("x"),
        text.month_label(F.lit("202411")).alias("mon"),
        F.size(text.authors_array("a")).alias("n"),
    ).collect()[0]
    assert (r.m, r.a, r.d, r.x, r.mon, r.n) == (" ", "A, B, C", "2024년 11월 05일", "1,234,567", "11월", 3)


def test_category_schemes(spark):
    df = spark.createDataFrame([("400",), ("ZZZ",), (None,)], "c string")
    kdc = [r[0] for r in df.select(category_label("c")).collect()]
    alt = [r[0] for r in df.select(category_label("c", "alt")).collect()]
    assert kdc == ["자연과학", "기타", "기타"] and alt == ["어학", "기타", "기타"]

"""Model layer: encoder order, split, metric formulae, persistence, invalid input."""

import math

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from pagewise.operators import ml
from pagewise.sources.binding import pooled_log
from tests.conftest import SF001


@pytest.fixture(scope="module")
def fitted(spark):
    log = pooled_log(spark, SF001)
    model, metrics = ml.fit_and_evaluate(log, ml.booster(max_iter=5))
    return log, model, metrics


def test_encoder_is_sorted(spark):
    ts = ml.training_set(pooled_log(spark, SF001))
    pairs = sorted({(r.b_category, r.b_category_encoded) for r in ts.select("b_category", "b_category_encoded").collect()})
    assert [p[1] for p in pairs] == [float(i) for i in range(len(pairs))]


def test_split_is_deterministic_and_about_half(spark):
    rows = ml.split(ml.training_rows(pooled_log(spark, SF001)))
    a = {(r.b_isbn, r.split) for r in rows.collect()}
    b = {(r.b_isbn, r.split) for r in rows.collect()}
    assert a == b
    share = sum(1 for _, s in a if s == "train") / len(a)
    assert 0.35 < share < 0.65


def test_metrics_match_evaluator(spark, fitted):
    log, model, metrics = fitted
    test = ml.split(ml.training_rows(log)).filter("split = 'test'")
    pred = model.transform(test)
    m = metrics.collect()[0]
    for name in ("mae", "rmse", "r2"):
        ev = RegressionEvaluator(labelCol="total_days", predictionCol="prediction", metricName=name).evaluate(pred)
        assert math.isfinite(m[name]) and abs(m[name] - ev) < 1e-6 * max(1.0, abs(ev)), name


def test_save_load_same_predictions(spark, fitted):
    log, model, _ = fitted
    path = ml.save_model(spark, model)
    again = ml.load_model(path)
    a = ml.predict_shelf(model, log.shelf).orderBy("user_id", "b_isbn").collect()
    b = ml.predict_shelf(again, log.shelf).orderBy("user_id", "b_isbn").collect()
    assert a == b and len(a) == log.shelf.count()


def test_plan_rounding(spark):
    df = spark.createDataFrame([(250, 7.0), (250, 0.0), (21, 8.0)], "p int, d double")
    rows = df.select(*ml.reading_plan(F.col("d"), F.col("p"))).collect()
    assert rows[0].average_pages_per_session == 35.71 and rows[1].average_pages_per_session == 0.0
    assert rows[2].average_pages_per_session == 2.62  # 2.625 -> half to even


def test_unseen_category_raises(spark, fitted):
    _, model, _ = fitted
    bad = spark.createDataFrame([(1, 1, 100, "NEVER-SEEN")], "user_id long, b_isbn long, b_page int, b_category string")
    with pytest.raises(Exception):
        ml.predict_shelf(model, bad).collect()


def test_random_split_and_ordered_rows(spark):
    rows = ml.training_rows(pooled_log(spark, SF001), ordered=True)
    starts = [r.start_dt for r in rows.collect()]
    assert starts == sorted(starts)
    sp = ml.split(rows, method="random")
    assert sp.count() == rows.count() and {r.split for r in sp.select("split").distinct().collect()} == {"train", "test"}


def test_metrics_constant_label(spark):
    df = spark.createDataFrame([(3, 2.0), (3, 4.0)], "total_days int, prediction double")
    m = ml.regression_metrics(df).first()
    assert (m.n, m.mae, m.rmse, m.r2) == (2, 1.0, 1.0, None)


def _shelf(spark, rows):
    return spark.createDataFrame(rows, "user_id long, b_isbn long, b_page int, b_category string")


def test_null_rows_get_a_null_plan(spark, fitted):
    log, model, _ = fitted
    cat = log.shelf.select("b_category").first()[0]
    rows = [(1, 1, 100, cat), (1, 1, 100, cat), (1, 2, None, cat), (1, 3, 50, None)]
    planned = ml.with_plan(model, _shelf(spark, rows))
    got = {(r.b_isbn, r.predicted_total_days is None) for r in planned.collect()}
    assert got == {(1, False), (2, True), (3, True)}
    back = ml.write_back(planned)
    assert back.count() == 4 and back.filter("b_mlday is null").count() == 2  # rows that repeat stay as many


def test_many_categories_fit(spark):
    rows = [(i, 50 + i % 7, f"c{i % 40:02d}", i % 13, "train" if i // 40 % 2 else "test") for i in range(400)]
    df = spark.createDataFrame(rows + [(900, None, "c01", 3, "train"), (901, 10, None, 3, "test")], "b_isbn long, b_page int, b_category string, total_days int, split string")
    model, metrics = ml.fit_rows(df, ml.booster(max_iter=3))
    assert metrics.first().n == 200
    unseen = _shelf(spark, [(1, 1, 10, "zz")])
    kept, _ = ml.fit_rows(df, ml.booster(max_iter=1), handle_invalid="keep")
    assert ml.with_plan(kept, unseen).first().predicted_total_days is not None


def test_half_split_is_exact(spark):
    rows = ml.training_rows(pooled_log(spark, SF001))
    got = {r.split: r["count"] for r in ml.split(rows, method="half").groupBy("split").count().collect()}
    assert got["train"] - got["test"] in (0, 1)

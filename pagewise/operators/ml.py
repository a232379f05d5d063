"""Reading-time model: training rows, encoder, split, fit, metrics, persistence,
bulk prediction and the derived reading plan — all Spark ML / DataFrame.

Training rows pool every reader's records of a book (the original joined on
the isbn alone).  Joining shelf x record on isbn multiplies rows by the
number of shelves holding the book; instead both sides are aggregated first
(eager aggregation): records per isbn, shelf rows per (isbn, pages,
category) with their multiplicity m.  AVG/MIN/MAX are unchanged by the
multiplication and COUNT is cnt * m, so the result equals the literal join
without materialising it (a popular book would otherwise fan out
quadratically).
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.functions.numeric import half_up_js, ratio_round_half_up
from pagewise.operators import scan
from pagewise.operators.boosting import Boosted, CellModel, Forest
from pagewise.session import state_root
from pagewise.sources.binding import ReadingLog

FEATURES = ["category_number", "b_page"]
LABEL = "total_days"
SPLIT_SEED = 42


def training_rows(log: ReadingLog, ordered: bool = False) -> DataFrame:
    """b_isbn, b_page, b_category, read_speed, start_dt, end_dt,
    days_since_last_read (a record count, as named originally), total_days.

    ``ordered`` sorts by start_dt as the original listing did (display only:
    a global sort, so off by default)."""
    rec = log.record.groupBy("b_isbn").agg(
        F.sum("r_page").alias("_s"),
        F.count("r_page").alias("_n"),
        F.min("r_date").alias("start_dt"),
        F.max("r_date").alias("end_dt"),
        F.count("r_date").alias("_dates"),
    )
    books = log.shelf.groupBy("b_isbn", "b_page", "b_category").agg(F.count(F.lit(1)).alias("_m"))
    j = books.join(rec, "b_isbn", "inner")
    out = j.select(
        "b_isbn",
        "b_page",
        "b_category",
        ratio_round_half_up("_s", "_n", 2).alias("read_speed"),
        "start_dt",
        "end_dt",
        (F.col("_dates") * F.col("_m")).alias("days_since_last_read"),
        F.datediff("end_dt", "start_dt").alias("total_days"),
    )
    return out.orderBy(F.col("start_dt").asc_nulls_last(), "b_isbn") if ordered else out


def category_indexer(handle_invalid: str = "error") -> StringIndexer:
    """Label encoding with classes in sorted order (index 0 = smallest label)."""
    return StringIndexer(
        inputCol="b_category",
        outputCol="b_category_encoded",
        stringOrderType="alphabetAsc",
        handleInvalid=handle_invalid,
    )


def training_set(log: ReadingLog) -> DataFrame:
    rows = training_rows(log)
    return category_indexer().fit(rows).transform(rows)


def split(df: DataFrame, seed: int = SPLIT_SEED, method: str = "hash") -> DataFrame:
    """50/50 train/test split as a ``split`` column.

    ``hash`` (default): by a hash of the isbn — reproducible across runs and
    partitionings, and checkable against SQL.  ``half``: exactly half of the
    rows, those first by that hash.  ``random``: Spark's sampled
    ``randomSplit([0.5, 0.5], seed)`` (stable only for a fixed partitioning)."""
    if method == "random":
        train, test = df.randomSplit([0.5, 0.5], seed)
        return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("b_isbn").cast("string")))
    if method == "half":
        first, last = F.substring("_h", 1, 3), [F.col("_h"), F.col("b_isbn")]  # 4,096 buckets of the hash, totalled one row each
        out = scan.row_number(df.withColumn("_h", h), [], last, [(first, "asc")], "_up")
        out = scan.row_number(out, [], [c.desc() for c in last], [(first, "desc")], "_down")
        return out.withColumn("split", F.when(F.col("_up") <= F.col("_down"), "train").otherwise("test")).drop("_h", "_up", "_down")
    return df.withColumn("split", F.when(F.substring(h, 1, 1) < "8", "train").otherwise("test"))


def booster(max_iter: int = 100, max_depth: int = 6, step: float = 0.3, lam: float = 1.0) -> Boosted:
    """Second-order boosted trees with the original booster's public defaults (100 trees, depth 6, step 0.3, lambda 1).
    It draws nothing at random, so it takes no seed."""
    return Boosted(rounds=max_iter, depth=max_depth, eta=step, lam=lam)


def model_pipeline(regressor, handle_invalid: str = "error") -> Pipeline:
    """Encode, assemble, regress with a Spark ML regressor.  The code enters as a plain number, as in the original.
    ``handle_invalid`` ("error", "skip", "keep") is for unseen categories."""
    return Pipeline(
        stages=[
            category_indexer(handle_invalid),
            SQLTransformer(statement="SELECT *, b_category_encoded + 0.0D AS category_number FROM __THIS__"),
            VectorAssembler(inputCols=FEATURES, outputCol="features"),
            regressor,
        ]
    )


def usable() -> Column:
    """Rows that a model can be asked about: category and pages are known."""
    return F.col("b_category").isNotNull() & F.col("b_page").isNotNull()


def regression_metrics(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE, R^2 in one distributed aggregate (no driver round trip).

    ss_tot = sum(y^2) - sum(y)^2 / n, so whole-number inputs give the same
    result in any engine."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    a = pred.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(e)).alias("sae"),
        F.sum(e * e).alias("sse"),
        F.sum(y).alias("sy"),
        F.sum(y * y).alias("sy2"),
    )
    ss_tot = F.col("sy2") - F.col("sy") * F.col("sy") / F.col("n")
    return a.select(
        "n",
        (F.col("sae") / F.col("n")).alias("mae"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        # R^2 is undefined for a constant label: NULL instead of a division error
        F.when(ss_tot != 0, F.lit(1.0) - F.col("sse") / ss_tot).alias("r2"),
    )


def fit_rows(rows: DataFrame, regressor=None, name: str = "gbt", handle_invalid: str = "error") -> tuple[PipelineModel | CellModel, DataFrame]:
    """Fit on the train half of split ``rows`` and evaluate on the test half; rows with a NULL feature or label stay out.
    ``regressor``: trees on cells (the booster by default) or a Spark ML regressor."""
    rows = rows.filter(usable() & F.col(LABEL).isNotNull())
    train, regressor = rows.filter(F.col("split") == "train"), regressor if regressor is not None else booster()
    if isinstance(regressor, (Boosted, Forest)):
        model = regressor.fit(train, LABEL, handle_invalid)
    else:
        model = model_pipeline(regressor, handle_invalid).fit(train)
    m = regression_metrics(model.transform(rows.filter(F.col("split") == "test")))
    return model, m.select(F.lit(name).alias("model"), "*")


def fit_and_evaluate(log: ReadingLog, regressor=None, name: str = "gbt") -> tuple[PipelineModel | CellModel, DataFrame]:
    return fit_rows(split(training_rows(log)), regressor, name)


def compare_models(rows: DataFrame) -> DataFrame:
    """The alternatives the original tried, over one (stored) split: linear, random forest, plain gradient boosting
    (500, 0.01, depth 6) and the shipped booster (100 trees)."""
    candidates = [
        ("linear", LinearRegression(featuresCol="features", labelCol=LABEL, solver="normal")),
        ("random_forest", Forest()),
        ("gbt_500", booster(max_iter=500, step=0.01, lam=0.0)),
        ("gbt_100", booster()),
    ]
    out = None
    for name, reg in candidates:
        _, m = fit_rows(rows, reg, name)
        out = m if out is None else out.unionByName(m)
    return out


def save_model(spark: SparkSession, model: PipelineModel | CellModel, name: str | None = None) -> str:
    path = f"{state_root(spark)}/models/{name or uuid.uuid4().hex}"
    if isinstance(model, CellModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel | CellModel:
    spark = SparkSession.getActiveSession()
    grid = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/grid")
    if grid.getFileSystem(spark._jsc.hadoopConfiguration()).exists(grid):
        return CellModel.load(spark, path)
    return PipelineModel.load(path)


def reading_plan(days: Column, pages: Column) -> list[Column]:
    """Derived plan from predicted days: sessions = days; pages per session =
    pages / days when days > 0 else 0; Python-style rounding (half to even)."""
    d = days.cast("double")
    per = F.when(d > 0, pages.cast("int").cast("double") / d).otherwise(F.lit(0.0))
    return [
        F.bround(d, 2).alias("predicted_total_days"),
        F.bround(d, 2).alias("average_reading_sessions"),
        F.bround(per, 2).alias("average_pages_per_session"),
    ]


PLAN = ("predicted_total_days", "average_reading_sessions", "average_pages_per_session")


def with_plan(model: PipelineModel | CellModel, shelf: DataFrame) -> DataFrame:
    """Shelf rows with the derived plan, in one pass: no join, so rows that repeat stay as many.  A row with a NULL
    category or page count has a NULL plan."""
    cols = shelf.columns
    known = model.transform(shelf.filter(usable())).select(*cols, *reading_plan(F.col("prediction"), F.col("b_page")))
    unknown = shelf.filter(~usable()).select(*cols, *[F.lit(None).cast("double").alias(c) for c in PLAN])
    return known.unionByName(unknown)


def predict_shelf(model: PipelineModel | CellModel, shelf: DataFrame) -> DataFrame:
    """Bulk prediction for every shelf row (category, pages) + the derived plan."""
    return with_plan(model, shelf.select("user_id", "b_isbn", "b_page", "b_category")).drop("b_category")


def write_back(planned: DataFrame) -> DataFrame:
    """Store the rounded plan of ``with_plan`` rows on the shelf as text (b_mlday, b_mlpage), rounded
    the way the page did (half up) before the insert."""
    keep = [c for c in planned.columns if c not in PLAN and c not in ("b_mlday", "b_mlpage")]
    return planned.select(
        *keep,
        half_up_js(F.col(PLAN[0])).cast("string").alias("b_mlday"),
        half_up_js(F.col(PLAN[2])).cast("string").alias("b_mlpage"),
    )

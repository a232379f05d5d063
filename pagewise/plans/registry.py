"""Driver-facing query registry: name -> callable(spark, sf_dir) -> DataFrame.

Every callable reads the driver tables at ``sf_dir`` through the binding in
``pagewise.sources.binding`` and returns a lazy DataFrame over all readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.functions.numeric import half_up_js
from pagewise.operators import catalog as cat
from pagewise.operators import changes as chg
from pagewise.operators import dashboard as dash
from pagewise.operators import lists as lst
from pagewise.operators import ml, pages, relevance
from pagewise.operators import progress as prog
from pagewise.operators import replay as rp
from pagewise.operators import scan
from pagewise.operators.prefix import PageTree, removed
from pagewise.operators.tiles import TileState
from pagewise.session import state_root
from pagewise.sources import bucketed, sql_functions
from pagewise.sources import catalog as catsrc
from pagewise.sources.binding import (
    ReadingLog,
    change_log_from_lines,
    driver_log,
    line_base,
    pooled_log,
    shelf_from,
    store_once,
    table,
)
from pagewise.sources.tables import append_rows, write_version
from pagewise.streaming.progress_stream import ProgressStream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


@register("reading_progress")
def q_reading_progress(spark, sf_dir):
    return prog.reading_progress(driver_log(spark, sf_dir))


def _on_driver_log(module, name):
    """Register ``module.name(log)`` over binding A under the same name."""
    fn = getattr(module, name)
    QUERIES[name] = lambda spark, sf_dir: fn(driver_log(spark, sf_dir))


for _n in (
    "total_spend",
    "reading_totals",
    "last_read",
    "monthly_cumulative",
    "monthly_series",
    "genre_counts",
    "genre_series",
    "record_count",
    "dashboard",
    "progress_caption",
):
    _on_driver_log(dash, _n)


for _n in ("wish_list", "finished_list", "book_detail", "record_log", "paged_log"):
    _on_driver_log(lst, _n)


@register("shelf_listing_alt")
def q_shelf_listing_alt(spark, sf_dir):
    return lst.shelf_listing(driver_log(spark, sf_dir), scheme="alt")


@register("reader_scan")
def q_reader_scan(spark, sf_dir):
    return lst.reader_scan(spark, driver_log(spark, sf_dir).reader)


@register("reader_profile")
def q_reader_profile(spark, sf_dir):
    log = driver_log(spark, sf_dir)
    return lst.reader_profile(spark, log.reader, log.shelf.select("user_id"))


# -- one reader's pages: the id is bound, and pushed into the scans ---------------------

USER = 5
YEAR = 1997


@register("reading_progress_user")
def q_reading_progress_user(spark, sf_dir):
    return prog.reading_progress(driver_log(spark, sf_dir), user=USER)


for _n in ("wish_list", "finished_list", "record_log"):
    QUERIES[f"{_n}_user"] = lambda spark, sf_dir, fn=getattr(lst, _n): fn(driver_log(spark, sf_dir), user=USER)


@register("book_detail_one")
def q_book_detail_one(spark, sf_dir):
    """The detail card of the reader's first book, as the positional JSON array of the page."""
    log = driver_log(spark, sf_dir)
    first = log.for_user(USER).shelf.agg(F.min("b_isbn").alias("b_isbn"))
    return lst.detail_json(lst.book_detail(log, user=USER).join(first, "b_isbn", "left_semi"))


@register("profile_bound")
def q_profile_bound(spark, sf_dir):
    return lst.profile_of(spark, driver_log(spark, sf_dir).reader, USER)


@register("page_count")
def q_page_count(spark, sf_dir):
    return lst.page_count(driver_log(spark, sf_dir))


@register("reading_totals_year")
def q_reading_totals_year(spark, sf_dir):
    return dash.reading_totals(driver_log(spark, sf_dir), year=YEAR)


@register("add_request")
def q_add_request(spark, sf_dir):
    """Every second reader logs the pages that are missing of the first book."""
    log = driver_log(spark, sf_dir)
    first = log.shelf.groupBy("user_id").agg(F.min("b_isbn").alias("b_isbn"))
    form = prog.with_pages_read(log.shelf.join(first, ["user_id", "b_isbn"], "left_semi"), log.record).filter("user_id % 2 = 0")
    form = form.select(
        F.col("user_id").cast("string").alias("user_id"), F.col("b_isbn").cast("string").alias("b_isbn"),
        F.lit("1999-01-01").alias("readDate"), (F.col("b_page") - F.col("cur_page")).cast("string").alias("page"),
    )
    return chg.apply_add_request(log.shelf, log.record, form)[0]


@register("delete_request")
def q_delete_request(spark, sf_dir):
    """Every second reader deletes the first day of each book."""
    log = driver_log(spark, sf_dir)
    keys = log.shelf.filter("b_create_dt is not null and user_id % 2 = 1").select(
        "user_id", "b_isbn", F.date_format("b_create_dt", "yyyy-MM-dd").alias("rday")
    )
    return chg.apply_delete_request(log.shelf, log.record, keys)[0]


# -- change application ------------------------------------------------------
# Inputs of the write-side operators are derived from the driver tables: rows
# dated before CUTOFF form the stored state, later rows arrive as form posts
# (all text), so the appended state must equal the full binding.


CUTOFF = "1998-01-01"


def _append(spark, base, new, name):
    """The stored state as a version of its own; only the new rows are written to it."""
    version = uuid.uuid4().hex
    write_version(spark, base, name, version)
    return append_rows(spark, new.select(*base.columns), name, version)


def _cut():
    return F.to_date(F.lit(CUTOFF))


@register("append_records")
def q_append_records(spark, sf_dir):
    rec = driver_log(spark, sf_dir).record
    before = F.col("r_date") < _cut()
    base = rec.filter(before)
    form = rec.filter(~before | F.col("r_date").isNull()).select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("b_isbn").cast("string").alias("b_isbn"),
        F.date_format("r_date", "yyyy-MM-dd").alias("readDate"),
        F.col("r_page").cast("string").alias("page"),
    )
    return _append(spark, base, chg.parse_records(form), "record")


@register("append_books")
def q_append_books(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), line_base(spark, sf_dir)
    before = F.col("o_orderdate") < _cut()
    base = shelf_from(orders.filter(before), lines)
    new = shelf_from(orders.filter(~before | F.col("o_orderdate").isNull()), lines, with_dates=False)
    form = new.select(
        *[F.col(c).cast("string").alias(c) for c in (
            "user_id", "b_isbn", "b_title", "b_author", "b_dicount", "b_page", "b_category", "b_memo", "b_image")],
        F.lit("").alias("b_mlday"),
        F.lit("").alias("b_mlpage"),
    )
    return _append(spark, base, chg.parse_books(form), "shelf")


@register("append_reader")
def q_append_reader(spark, sf_dir):
    log = driver_log(spark, sf_dir)
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.min("o_orderdate").alias("_first")
    )
    r = log.reader.join(first, "user_id", "left")
    before = F.col("_first") < _cut()
    base = r.filter(before).drop("_first")
    form = r.filter(~before | F.col("_first").isNull()).select(
        F.col("user_id").cast("string").alias("user_id"), "user_nm", "user_email"
    )
    return _append(spark, base, chg.add_reader(base.limit(0), form), "reader")


@register("update_profile")
def q_update_profile(spark, sf_dir):
    reader = driver_log(spark, sf_dir).reader
    changes = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").alias("user_id"),
        F.upper("c_name").alias("user_nm"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None).cast("string"))
        .otherwise(F.lower("c_mktsegment"))
        .alias("user_email"),
    )
    return chg.update_profile(reader, changes)


@register("refresh_dates")
def q_refresh_dates(spark, sf_dir):
    log = driver_log(spark, sf_dir)
    stale = shelf_from(table(spark, sf_dir, "orders"), line_base(spark, sf_dir), with_dates=False)
    return chg.refresh_dates(stale, log.record)


@register("mark_finished")
def q_mark_finished(spark, sf_dir):
    log = driver_log(spark, sf_dir)
    return chg.mark_finished(log.shelf, log.record)


@register("unmark_finished")
def q_unmark_finished(spark, sf_dir):
    log = driver_log(spark, sf_dir)
    return chg.unmark_finished(log.shelf, log.record)


def _wish_keys(log):
    return log.shelf.filter(F.col("b_end_yn") == "N").select("user_id", "b_isbn")


@register("remove_books")
def q_remove_books(spark, sf_dir):
    log = driver_log(spark, sf_dir)
    return chg.remove_books(log.shelf, _wish_keys(log), log.record, cascade=True)[0]


@register("remove_books_records")
def q_remove_books_records(spark, sf_dir):
    log = driver_log(spark, sf_dir)
    return chg.remove_books(log.shelf, _wish_keys(log), log.record, cascade=True)[1]


def _returned_days(spark, sf_dir):
    """The days of returned lines, as the keys of a delete (the day as text)."""
    return (
        line_base(spark, sf_dir)
        .filter(F.col("l_returnflag") == "R")
        .select(
            "user_id",
            F.col("l_orderkey").alias("b_isbn"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("rday"),
        )
    )


@register("remove_records")
def q_remove_records(spark, sf_dir):
    return chg.remove_records(driver_log(spark, sf_dir).record, _returned_days(spark, sf_dir))


# -- replay of a change log ----------------------------------------------------


def _landed_changes(spark, sf_dir):
    stored, log = change_log_from_lines(line_base(spark, sf_dir), CUTOFF)
    return {"stored": stored, "log": log}


def _replay_inputs(spark, sf_dir):
    """Stored records and the change log, landed once as tables."""
    t = store_once(spark, sf_dir, "changes", _landed_changes, cluster=("user_id", "seq"))
    return driver_log(spark, sf_dir).shelf, t["stored"], t["log"]


@register("replay_changes")
def q_replay_changes(spark, sf_dir):
    shelf, stored, log = _replay_inputs(spark, sf_dir)
    return rp.replay_shelf(shelf, stored, log, keep=rp.kept)


@register("replay_records")
def q_replay_records(spark, sf_dir):
    _, stored, log = _replay_inputs(spark, sf_dir)
    return rp.replay_records(stored, log)


@register("replay_duplicates")
def q_replay_duplicates(spark, sf_dir):
    """The replay over a shelf that holds every tenth book twice, with other numbers of pages."""
    shelf, stored, log = _replay_inputs(spark, sf_dir)
    second = shelf.filter("b_isbn % 10 = 0").withColumn("b_page", (F.col("b_page") + 25).cast("int"))
    return rp.replay_shelf(shelf.unionByName(second), stored, log, keep=rp.kept)


# -- streaming form of the replay ----------------------------------------------


STREAM_FILES, STREAM_ROWS = 3, 1 << 23  # files at least; entries of a file


@register("stream_progress")
def q_stream_progress(spark, sf_dir):
    """Land the change log as files (each reader's entries in one file, so the
    arrival order is the log order) and run the stream to completion."""
    shelf, stored, log = _replay_inputs(spark, sf_dir)
    run = uuid.uuid4().hex
    src = f"{state_root(spark)}/landing/changes-{run}"
    files = max(STREAM_FILES, log.count() // STREAM_ROWS)  # a batch is a file: bounded, and several of them at every size
    log.repartition(files, "user_id").sortWithinPartitions("user_id", "seq").write.parquet(src)
    ps = ProgressStream(spark, f"progress-{run}", shelf, stored)
    ps.run_available(src, max_files_per_trigger=1)
    return ps.current()[0]


# -- bucketed tables, tiles by batches, SQL functions -------------------------------


_BUCKETED: dict[tuple[str, str], str] = {}


def _bucketed(spark, sf_dir):
    """The reading log in buckets, written once per application and data set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUCKETED:
        name = f"log_{uuid.uuid4().hex[:12]}"
        bucketed.write(spark, driver_log(spark, sf_dir), name)
        _BUCKETED[key] = name
    return bucketed.read(spark, _BUCKETED[key])


@register("progress_bucketed")
def q_progress_bucketed(spark, sf_dir):
    return prog.reading_progress(_bucketed(spark, sf_dir))


@register("record_log_bucketed")
def q_record_log_bucketed(spark, sf_dir):
    return lst.record_log(_bucketed(spark, sf_dir))


@register("book_detail_bucketed")
def q_book_detail_bucketed(spark, sf_dir):
    return lst.book_detail(_bucketed(spark, sf_dir))


@register("tiles_by_batches")
def q_tiles_by_batches(spark, sf_dir):
    """The records arrive in four batches; the state is compacted half way, and one batch comes twice."""
    log = driver_log(spark, sf_dir)
    state = TileState(spark, f"tiles-{uuid.uuid4().hex}")
    batch = F.pmod(F.xxhash64("user_id", "b_isbn", "r_date"), F.lit(4))
    for i in range(4):
        state.append(i, log.record.filter(batch == i), log.shelf)
        if i == 1:
            state.compact()
    state.append(3, log.record.filter(batch == 3), log.shelf)
    return state.tiles(log.reader, log.shelf)


def _tree_after_changes(spark, sf_dir, keys):
    """The records arrive in three batches, the first two are compacted; a fourth deletes the days of returned lines."""
    log, days = driver_log(spark, sf_dir), _returned_days(spark, sf_dir)
    tree = PageTree(spark, f"tree-{uuid.uuid4().hex}", keys)
    batch = F.pmod(F.xxhash64("user_id", "b_isbn", "r_date"), F.lit(3))
    for i in range(3):
        tree.apply(i, log.record.filter(batch == i))
        if i == 1:
            tree.compact()
    tree.apply(3, gone=removed(log.record, days.withColumn("r_date", F.to_date("rday"))))
    return tree, ReadingLog(log.reader, log.shelf, chg.remove_records(log.record, days))


@register("record_log_tree")
def q_record_log_tree(spark, sf_dir):
    """The log after adds and deletes, its totals from the stored tree."""
    tree, now = _tree_after_changes(spark, sf_dir, ["user_id", "b_isbn"])
    return tree.record_log(now)


@register("record_log_since")
def q_record_log_since(spark, sf_dir):
    """The log from a month on: earlier records are not read."""
    tree, now = _tree_after_changes(spark, sf_dir, ["user_id", "b_isbn"])
    return tree.record_log(now, since=f"{YEAR}-01-01")


@register("monthly_tree")
def q_monthly_tree(spark, sf_dir):
    """Cumulative pages by month after adds and deletes, from the tree alone."""
    return _tree_after_changes(spark, sf_dir, ["user_id"])[0].monthly_cumulative()


@register("sql_shelf_listing")
def q_sql_shelf_listing(spark, sf_dir):
    """Every reader's shelf through the table function."""
    prefix = f"f{uuid.uuid4().hex[:8]}"
    sql_functions.register(spark, driver_log(spark, sf_dir), prefix)
    return spark.sql(f"SELECT r.user_id, s.* FROM {prefix}_t_reader r, LATERAL {prefix}_shelf(r.user_id, 'alt') s")


@register("sql_progress")
def q_sql_progress(spark, sf_dir):
    """Every reader's unfinished books through the table function, columns as in ``reading_progress``."""
    prefix = f"f{uuid.uuid4().hex[:8]}"
    sql_functions.register(spark, driver_log(spark, sf_dir), prefix)
    return spark.sql(f"SELECT r.user_id, p.* FROM {prefix}_t_reader r, LATERAL {prefix}_progress(r.user_id) p")


# -- catalog ---------------------------------------------------------------------

SEARCH_TERM = "the"


@register("catalog_flatten")
def q_catalog_flatten(spark, sf_dir):
    """Pack ``part`` into search payloads, land them as JSON text, flatten back."""
    payloads = catsrc.pack_payloads(catsrc.part_items(table(spark, sf_dir, "part")))
    path = f"{state_root(spark)}/landing/catalog-{uuid.uuid4().hex}"
    payloads.select("payload").write.text(path)
    return catsrc.flatten_items(catsrc.read_payloads(spark, path))


def _broken_payloads(spark, sf_dir):
    """Search payloads of which every fifth is cut off, every seventh has no array, and in every third one item has no isbn."""
    payloads = catsrc.pack_payloads(catsrc.part_items(table(spark, sf_dir, "part")))
    cut = F.expr("substring(payload, 1, length(payload) - 1)")
    text = F.when(F.col("page_id") % 5 == 0, cut).when(F.col("page_id") % 7 == 0, F.lit('{"items": "none"}'))
    text = text.when(F.col("page_id") % 3 == 0, F.regexp_replace("payload", '"isbn":"([0-9]*)3"', '"code":$1'))
    return payloads.select(F.coalesce(text, "payload").alias("payload"))


@register("catalog_variant")
def q_catalog_variant(spark, sf_dir):
    return catsrc.variant_items(spark, _broken_payloads(spark, sf_dir))[0]


@register("catalog_rejects")
def q_catalog_rejects(spark, sf_dir):
    """How many payloads and items were rejected, by reason and place."""
    return catsrc.variant_items(spark, _broken_payloads(spark, sf_dir))[1].groupBy("reason", "place").agg(F.count(F.lit(1)).alias("n"))


@register("catalog_search")
def q_catalog_search(spark, sf_dir):
    return cat.search(table(spark, sf_dir, "documents"), SEARCH_TERM, k=10)


@register("catalog_lookup")
def q_catalog_lookup(spark, sf_dir):
    items = catsrc.part_items(table(spark, sf_dir, "part")).drop("_key")
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("isbn"))
    return cat.lookup(items, keys)


RANKED_QUERY = "the of that nation license"
_INDEXED: dict[tuple[str, str], str] = {}


@register("ranked_search")
def q_ranked_search(spark, sf_dir):
    """The ten best documents by BM25, from an index built once per application and data set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXED:
        name = f"documents-{uuid.uuid4().hex}"
        relevance.build(spark, table(spark, sf_dir, "documents"), name)
        _INDEXED[key] = name
    found = relevance.search(relevance.read(spark, _INDEXED[key]), RANKED_QUERY)
    return found.select("doc_id", F.round("score", 6).alias("score"))


_PAGED: dict[tuple[str, str], str] = {}


@register("page_of_reader")
def q_page_of_reader(spark, sf_dir):
    """The second page of the reader that the single-reader queries ask for, from stored pages."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PAGED:
        name = f"pages-{uuid.uuid4().hex}"
        pages.store(spark, driver_log(spark, sf_dir), name)
        _PAGED[key] = name
    return pages.page(spark, _PAGED[key], USER, 2)


# -- reading-time model ------------------------------------------------------------


@register("training_set")
def q_training_set(spark, sf_dir):
    return ml.training_set(pooled_log(spark, sf_dir))


@register("train_test_split")
def q_train_test_split(spark, sf_dir):
    return ml.split(ml.training_set(pooled_log(spark, sf_dir)))


@register("metric_formulae")
def q_metric_formulae(spark, sf_dir):
    """MAE/RMSE/R^2 formulae on a fixed column pair (exactly checkable)."""
    rows = ml.training_rows(pooled_log(spark, sf_dir))
    return ml.regression_metrics(rows, label="total_days", prediction="days_since_last_read")


@register("train_test_half")
def q_train_test_half(spark, sf_dir):
    return ml.split(ml.training_rows(pooled_log(spark, sf_dir)), method="half").select("b_isbn", "split")


@register("training_set_ordered")
def q_training_set_ordered(spark, sf_dir):
    """The training rows with their place in the original listing's order."""
    rows = ml.training_rows(pooled_log(spark, sf_dir))
    days = [(F.col("start_dt"), "asc_nulls_last")]  # at most one total for each day
    return scan.row_number(rows, [], [F.col("b_isbn").asc()], days, "position")


def _training(spark, sf_dir):
    """Split training rows, stored once for all fits."""
    build = lambda s, d: {"training": ml.split(ml.training_rows(pooled_log(s, d)))}
    return store_once(spark, sf_dir, "training", build, cluster=("b_isbn",))["training"]


_MODEL_PATHS: dict[tuple[str, str, str], str] = {}


def _fitted(spark, sf_dir, name="gbt"):
    """Fit once per application and data set, store, then load the stored
    model (the original trained offline and loaded the saved files)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MODEL_PATHS:
        linear = LinearRegression(featuresCol="features", labelCol=ml.LABEL, solver="normal")
        model, _ = ml.fit_rows(_training(spark, sf_dir), {"linear": linear, "small": ml.booster(max_iter=2, max_depth=2)}.get(name), name)
        _MODEL_PATHS[key] = ml.save_model(spark, model)
    return ml.load_model(_MODEL_PATHS[key])


def _held_out(spark, sf_dir):
    return _training(spark, sf_dir).filter(ml.usable() & F.col(ml.LABEL).isNotNull() & (F.col("split") == "test"))


def _scores():
    return [F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")]


@register("model_metrics")
def q_model_metrics(spark, sf_dir):
    """Held-out MAE / RMSE / R^2 of the stored booster."""
    m = ml.regression_metrics(_fitted(spark, sf_dir).transform(_held_out(spark, sf_dir)))
    return m.select(F.lit("gbt").alias("model"), "n", *_scores())


@register("booster_two_rounds")
def q_booster_two_rounds(spark, sf_dir):
    """What the booster predicts after two rounds of depth 2 for each category and page count of the training rows."""
    cells = _training(spark, sf_dir).filter(ml.usable() & F.col(ml.LABEL).isNotNull()).select("b_category", "b_page").distinct()
    return _fitted(spark, sf_dir, "small").transform(cells)


@register("model_compare")
def q_model_compare(spark, sf_dir):
    return ml.compare_models(_training(spark, sf_dir)).select("model", "n", *_scores())


@register("booster_checks")
def q_booster_checks(spark, sf_dir):
    """Counts that hold for any fitted booster: rows of each half, finite predictions, and that reloading changes none."""
    shelf, model = pooled_log(spark, sf_dir).shelf, _fitted(spark, sf_dir)
    again = ml.load_model(ml.save_model(spark, model))
    known = shelf.filter(ml.usable())
    pred = model.transform(known).select("user_id", "b_isbn", F.col("prediction").alias("p"))
    other = again.transform(known).select("user_id", "b_isbn", F.col("prediction").alias("q"))
    finite = F.col("p").isNotNull() & ~F.isnan("p") & (F.abs("p") < float("inf"))
    both = pred.join(other, ["user_id", "b_isbn"]).agg(
        F.count(F.lit(1)).alias("n_predicted"), F.count_if(finite).alias("n_finite"), F.count_if(F.col("p") != F.col("q")).alias("n_changed_by_reload")
    )
    rows = _training(spark, sf_dir).filter(ml.usable() & F.col(ml.LABEL).isNotNull())
    halves = rows.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    one = F.lit(1).alias("_one")
    return halves.select(one, "*").join(both.select(one, "*"), "_one").drop("_one")


@register("linear_metrics")
def q_linear_metrics(spark, sf_dir):
    m = ml.regression_metrics(_fitted(spark, sf_dir, "linear").transform(_held_out(spark, sf_dir)))
    return m.select("n", *[F.round(c, 2).alias(c) for c in ("mae", "rmse", "r2")])


@register("linear_plan")
def q_linear_plan(spark, sf_dir):
    return ml.predict_shelf(_fitted(spark, sf_dir, "linear"), pooled_log(spark, sf_dir).shelf)


@register("linear_write_back")
def q_linear_write_back(spark, sf_dir):
    return ml.write_back(ml.with_plan(_fitted(spark, sf_dir, "linear"), pooled_log(spark, sf_dir).shelf.drop("b_title")))


@register("predict_plan")
def q_predict_plan(spark, sf_dir):
    return ml.predict_shelf(_fitted(spark, sf_dir), pooled_log(spark, sf_dir).shelf)


@register("write_back_predictions")
def q_write_back_predictions(spark, sf_dir):
    return ml.write_back(ml.with_plan(_fitted(spark, sf_dir), pooled_log(spark, sf_dir).shelf))


@register("plan_from_days")
def q_plan_from_days(spark, sf_dir):
    """The derived plan with the observed days standing in for the prediction."""
    rows = ml.training_rows(pooled_log(spark, sf_dir))
    pages_text = F.col("b_page").cast("string")  # the request carries text
    plan = rows.select(
        "b_isbn", *ml.reading_plan(F.col("total_days").cast("float"), pages_text.cast("int"))
    )
    return plan.select(
        "*",
        half_up_js("predicted_total_days").alias("ml_days"),
        half_up_js("average_pages_per_session").alias("ml_page"),
    )

"""Expected values of the golden micro-fixture."""

from pyspark.sql import functions as F

from pagewise.operators import changes, dashboard, lists, progress
from tests.fixture import micro_log


def test_reading_totals_u1(spark):
    r = dashboard.reading_totals(micro_log(spark)).filter("user_id = 1").collect()[0]
    assert (r.yrpage, r.yrbook, r.yrdt) == (160, 3, 4)


def test_reader_without_rows_keeps_a_row(spark):
    r = dashboard.reading_totals(micro_log(spark)).filter("user_id = 3").collect()[0]
    assert (r.yrpage, r.yrbook, r.yrdt) == (None, 0, 0)
    d = dashboard.dashboard(micro_log(spark)).filter("user_id = 3").collect()[0]
    assert d.lastday_text == "0000년 00월 00일" and d.lastbook_text == "없음" and d.yrmoney_text == "0원"


def test_last_read_returns_ties(spark):
    rows = dashboard.last_read(micro_log(spark), user=1).collect()
    assert sorted(r.lastbook for r in rows) == ["T1", "T3"]
    assert {r.lastday for r in rows} == {"20241105"}


def test_genre_counts_group_raw_codes(spark):
    rows = dashboard.genre_counts(micro_log(spark)).collect()
    got = {(r.user_id, r.b_code): (r.b_category, r.cnt) for r in rows}
    assert got == {(1, "000"): ("총류, 컴퓨터과학", 1), (1, "XXX"): ("기타", 1), (1, None): ("기타", 0)}


def test_pages_read_order_text_date_desc(spark):
    log = micro_log(spark)
    w = progress.with_pages_read(log.shelf.filter("user_id = 1"), log.record)
    w = w.select("b_isbn", "cur_page", F.coalesce(F.date_format("b_create_dt", "yyyy-MM-dd"), F.lit(" ")).alias("t"))
    rows = w.orderBy(F.col("t").desc(), "b_isbn").collect()
    assert [(r.b_isbn, r.cur_page) for r in rows] == [(3, 60), (4, 0), (1, 100), (2, 0)]


def test_wish_list_blank_memo_and_unread(spark):
    r = lists.wish_list(micro_log(spark), user=1).collect()
    assert [(x.b_isbn, x.read_yn, x.b_memo, x.b_create_dt, x.b_category) for x in r] == [(2, "N", " ", " ", "기타")]


def test_mark_finished_in_semantics(spark):
    log = micro_log(spark)
    all_n = log.shelf.withColumn("b_end_yn", F.lit("N"))
    out = changes.mark_finished(all_n, log.record).filter("b_end_yn = 'Y'").collect()
    assert [(r.user_id, r.b_isbn) for r in out] == [(1, 1)]


def test_unmark_finished_not_in_semantics(spark):
    log = micro_log(spark)
    all_y = log.shelf.withColumn("b_end_yn", F.lit("Y"))
    out = changes.unmark_finished(all_y, log.record).collect()
    got = {(r.user_id, r.b_isbn): r.b_end_yn for r in out}
    # u1/i4 has only NULL pages: NOT IN is UNKNOWN, the flag stays
    assert got == {(1, 1): "Y", (1, 2): "N", (1, 3): "N", (1, 4): "Y", (2, 1): "N"}


def test_flags_idempotent(spark):
    log = micro_log(spark)
    once = changes.mark_finished(log.shelf, log.record)
    twice = changes.mark_finished(once, log.record)
    assert sorted(once.collect()) == sorted(twice.collect())
    once = changes.unmark_finished(log.shelf, log.record)
    twice = changes.unmark_finished(once, log.record)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_refresh_dates_touched_users_only(spark):
    log = micro_log(spark)
    users = spark.createDataFrame([(1,)], "user_id long")
    out = {(r.user_id, r.b_isbn): (r.b_create_dt, r.b_update_dt) for r in changes.refresh_dates(log.shelf, log.record, users).collect()}
    import datetime as dt

    assert out[(1, 4)] == (dt.date(2024, 11, 3), dt.date(2024, 11, 3))  # stale date fixed
    assert out[(1, 2)] == (None, None)
    assert out[(2, 1)] == (dt.date(2024, 11, 9), dt.date(2024, 11, 9))  # untouched


def test_remove_records_by_text_day(spark):
    log = micro_log(spark)
    keys = spark.createDataFrame([(1, 1, "2024-11-05")], "user_id long, b_isbn long, rday string")
    out = changes.remove_records(log.record, keys).collect()
    assert len(out) == 5 and all(not (r.user_id == 1 and r.b_isbn == 1 and str(r.r_date) == "2024-11-05") for r in out)


def test_parse_forms(spark):
    form = spark.createDataFrame([("1", "7", "2024-12-01", "")], "user_id string, b_isbn string, readDate string, page string")
    r = changes.parse_records(form).collect()[0]
    assert (r.user_id, r.b_isbn, str(r.r_date), r.r_page) == (1, 7, "2024-12-01", None)


def test_request_compositions_match_fold(spark):
    import datetime as dt

    from tests.fold import fold_reference

    log = micro_log(spark)
    s_rows = [r.asDict() for r in log.shelf.collect()]
    r_rows = [r.asDict() for r in log.record.collect()]
    form = spark.createDataFrame([("1", "2", "2024-12-01", "200")], "user_id string, b_isbn string, readDate string, page string")
    shelf, record = changes.apply_add_request(log.shelf, log.record, form)
    exp_s, exp_r = fold_reference(s_rows, r_rows, [dict(user_id=1, b_isbn=2, seq=1, op="add", r_date=dt.date(2024, 12, 1), r_page=200)])
    key = lambda r: (r["user_id"], r["b_isbn"], r["b_end_yn"], r["b_create_dt"], r["b_update_dt"])
    assert sorted(key(r.asDict()) for r in shelf.collect()) == sorted(key(r) for r in exp_s)
    keys = spark.createDataFrame([(1, 1, "2024-11-05")], "user_id long, b_isbn long, rday string")
    shelf2, _ = changes.apply_delete_request(log.shelf, log.record, keys)
    exp_s2, _ = fold_reference(s_rows, r_rows, [dict(user_id=1, b_isbn=1, seq=1, op="del", r_date=dt.date(2024, 11, 5), r_page=None)])
    assert sorted(key(r.asDict()) for r in shelf2.collect()) == sorted(key(r) for r in exp_s2)


def test_dashboard_year(spark):
    d = dashboard.dashboard(micro_log(spark), year=2023).filter("user_id = 1").first()
    assert (d.yrpage, d.yrbook, d.yrdt) == (None, 0, 0)
    d = dashboard.dashboard(micro_log(spark), year=2024).filter("user_id = 1").first()
    assert (d.yrpage, d.yrbook, d.yrdt) == (160, 3, 4)


def test_update_profile_latest_change_wins(spark):
    log = micro_log(spark)
    ch = spark.createDataFrame(
        [(1, "old", "o@x", 1), (1, "new", None, 2), (2, "n2b", "e2b", 1)],
        "user_id long, user_nm string, user_email string, seq long",
    )
    got = {r.user_id: (r.user_nm, r.user_email) for r in changes.update_profile(log.reader, ch, order="seq").collect()}
    assert got == {1: ("new", None), 2: ("n2b", "e2b"), 3: ("n3", None)}

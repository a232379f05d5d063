"""Library entry points that the driver queries do not exercise directly."""

import json
import tempfile

from pagewise.operators import dashboard, lists
from pagewise.sources import tables
from pagewise.sources.binding import ReadingLog
from tests.fixture import micro_log


def test_profile_bound_parameter(spark):
    log = micro_log(spark)
    rows = lists.profile_of(spark, log.reader, 2).collect()
    assert [(r.user_nm, r.user_email) for r in rows] == [("n2", "e2")]
    df = tables.sql(spark, "SELECT count(*) AS n FROM {r} WHERE user_id > ?", args=[1], r=log.reader)
    assert df.first().n == 2


def test_book_detail_single_and_json(spark):
    log = micro_log(spark)
    d = lists.book_detail(log, user=1, isbn=3)
    r = d.collect()
    assert len(r) == 1 and (r[0].rlday, r[0].rlpage, r[0].b_category) == (2, 30.0, "기타")
    j = json.loads(lists.detail_json(d).first().detail)
    assert j[0] == "T3" and j[-1] == "30.0"


def test_page_count_and_series(spark):
    log = micro_log(spark)
    pc = {r.user_id: r.pages for r in lists.page_count(log).collect()}
    assert pc == {1: 1, 2: 1}
    s = {r.user_id: (r.mday, r.mpage) for r in dashboard.monthly_series(log).collect()}
    assert s[1] == ("11월", "160")
    arr = dashboard.monthly_series(log, as_text=False).filter("user_id = 1").first()
    assert list(arr.mday) == ["11월"] and list(arr.mpage) == [160]
    g = json.loads(dashboard.genre_series(log).filter("user_id = 1").first().piedata)
    assert g == [{"name": "총류, 컴퓨터과학", "y": 1}, {"name": "기타", "y": 1}, {"name": "기타", "y": 0}]


def test_native_round_trip_and_versions(spark):
    log = micro_log(spark)
    root = tempfile.mkdtemp(prefix="pagewise-native-")
    tables.write_native(spark, log, root, mode="overwrite")
    back = tables.read_native(spark, root)
    assert isinstance(back, ReadingLog)
    for name in ("reader", "shelf", "record"):
        assert sorted(getattr(back, name).collect()) == sorted(getattr(log, name).collect())
    v = tables.write_version(spark, log.record, "record")
    assert sorted(v.collect()) == sorted(log.record.collect())


def test_single_user_views(spark):
    log = micro_log(spark)
    rl = lists.record_log(log, user=1).collect()
    assert [r.r_date for r in rl][:2] == ["2024-11-05", "2024-11-05"]  # latest book first, newest first
    assert {r.b_isbn for r in lists.finished_list(log, user=1).collect()} == {1, 3, 4}


def test_one_bad_field_loses_one_request(spark):
    from pagewise.operators import changes

    form = spark.createDataFrame(
        [("1", "2", "2024-01-01", "5"), ("1", "2", "01.02.2024", "5"), ("1", "x", "2024-01-01", "5"), ("1", "2", "", "")],
        "user_id string, b_isbn string, readDate string, page string",
    )
    assert changes.parse_records(form).count() == 2 and changes.rejected_records(form).count() == 2


def test_append_keeps_the_files_that_are_there(spark):
    import os

    log = micro_log(spark)
    tables.write_version(spark, log.record, "record", "appended")
    path = tables.table_path(spark, "record", "appended").removeprefix("file:")
    before = set(os.listdir(path))
    back = tables.append_rows(spark, log.record.limit(1), "record", "appended")
    assert before <= set(os.listdir(path)) and back.count() == log.record.count() + 1

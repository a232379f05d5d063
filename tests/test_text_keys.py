"""Login names and isbns as text, from the form to the stream."""

import datetime as dt
import tempfile

from pagewise.operators import changes, lists
from pagewise.operators.replay import replay
from pagewise.schema import READER, RECORD, SHELF, text_keyed
from pagewise.sources import jdbc, tables
from pagewise.sources.binding import ReadingLog
from pagewise.streaming.progress_stream import ProgressStream, log_schema
from tests.fixture import shelf_row
from tests.fold import fold_reference

D = dt.date
X = "080442957X"


def text_log(spark) -> ReadingLog:
    reader = spark.createDataFrame([("alice", "A", None), ("bob", "B", "b@x")], text_keyed(READER))
    shelf = [shelf_row("alice", X, "T1", 30, "000", "N", None, None), shelf_row("alice", "9", "T2", 10, None, "Y", None, None),
             shelf_row("alice", X, "T1", 20, "000", "N", None, None), shelf_row("bob", X, "T1", 30, "ETC", "N", None, None)]
    record = [("alice", "9", D(2024, 1, 1), 10), ("bob", X, D(2024, 1, 2), 5)]
    return ReadingLog(reader, spark.createDataFrame(shelf, text_keyed(SHELF)), spark.createDataFrame(record, text_keyed(RECORD)))


LOG = [("alice", X, 1, "add", D(2024, 2, 1), 20), ("alice", X, 2, "add", D(2024, 2, 2), 10), ("alice", "9", 3, "del", D(2024, 1, 1), None),
       ("bob", X, 1, "add", D(2024, 2, 1), 25)]
STATE = ("user_id", "b_isbn", "b_page", "b_end_yn", "b_create_dt", "b_update_dt")


def _state(rows):
    return sorted((tuple(r[c] for c in STATE) for r in rows), key=repr)


def test_requests(spark):
    log = text_log(spark)
    form = spark.createDataFrame([("alice", X, "2024-02-01", "30"), ("alice", X, "yesterday", "1")], "user_id string, b_isbn string, readDate string, page string")
    shelf, record = changes.apply_add_request(log.shelf, log.record, form)
    assert record.count() == 3 and changes.rejected_records(form, log.record.schema).count() == 1
    flags = {(r.user_id, r.b_isbn, r.b_page): r.b_end_yn for r in shelf.collect()}
    assert flags == {("alice", X, 30): "Y", ("alice", "9", 10): "Y", ("alice", X, 20): "N", ("bob", X, 30): "N"}
    keys = spark.createDataFrame([("alice", X, "2024-02-01")], "user_id string, b_isbn string, rday string")
    shelf, record = changes.apply_delete_request(shelf, record, keys)
    assert record.count() == 2 and shelf.filter("b_end_yn = 'Y'").count() == 1
    book = spark.createDataFrame([("carol", X, "T", "A", "x1", "5", "", "", "", "", "")], "user_id string, b_isbn string, b_title string, b_author string, b_dicount string, b_page string, b_category string, b_memo string, b_image string, b_mlday string, b_mlpage string")
    assert changes.add_books(log.shelf, book).count() == 4 and changes.rejected_books(book, log.shelf.schema).count() == 1
    assert {r.b_isbn for r in lists.record_log(ReadingLog(log.reader, shelf, record), user="bob").collect()} == {X}


def test_replay_and_stream(spark):
    log = text_log(spark)
    changelog = spark.createDataFrame(LOG, log_schema(log.record.schema))
    want, left = fold_reference([r.asDict() for r in log.shelf.collect()], [r.asDict() for r in log.record.collect()], [dict(zip(changelog.columns, r)) for r in LOG])
    shelf, record = replay(log.shelf, log.record, changelog)
    assert _state(r.asDict() for r in shelf.collect()) == _state(want) and record.count() == len(left)
    ps = ProgressStream(spark, "text", log.shelf, log.record, root=tempfile.mkdtemp(prefix="pagewise-stream-"))
    ps.apply_batch(changelog, 0)
    assert _state(r.asDict() for r in ps.current()[0].collect()) == _state(want)


def test_stored_tables(spark):
    log, root = text_log(spark), tempfile.mkdtemp(prefix="pagewise-native-")
    tables.write_native(spark, log, root, mode="overwrite")
    assert {r.user_id for r in tables.read_native(spark, root, text_keys=True).reader.collect()} == {"alice", "bob"}


def test_jdbc_predicates_cover_each_row_once():
    got = jdbc.predicates(4)
    assert got == [f"ora_hash(user_id, 3) = {i}" for i in range(4)]

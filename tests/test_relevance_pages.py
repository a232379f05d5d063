"""BM25 over the inverted index against every document's score; stored pages against the whole log."""

import math
import random
import re
import uuid
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewise.operators import lists, pages, relevance
from pagewise.sources.binding import ReadingLog, driver_log
from tests.conftest import SF001


def brute(rows, query, k):
    texts = {}
    for i, t in rows:
        if i is not None and (w := re.findall(r"[^\W\d_]+", (t or "").lower())):
            texts.setdefault(i, []).extend(w)
    n = len(texts)
    mean = sum(map(len, texts.values())) / n if n else 0
    scores = Counter()
    for term in set(re.findall(r"[^\W\d_]+", query.lower())):
        df = sum(term in w for w in texts.values())
        for i, w in texts.items():
            if tf := w.count(term):
                scores[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def made(seed, n=500):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"] + ["Été", "ß"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 60)))) for i in range(n)]
    return rows + [(1, "ax ax"), (None, "ax"), (9000, None), (9001, "12 _"), (9002, "hz " * 3000)]


@pytest.fixture(scope="module")
def index(spark):
    rows = made(4)
    return rows, relevance.build(spark, spark.createDataFrame(rows, "doc_id long, text string"), uuid.uuid4().hex, block_docs=8)


@pytest.mark.parametrize("query, k", [("ax", 10), ("hz gy", 5), ("AX ay, az ax été", 10), ("hz unknown", 3), ("ß", 400), ("unknown", 5), ("", 5)])
def test_search_is_that_of_all_documents(spark, index, query, k):
    rows, found = index
    got = [(r.doc_id, r.score) for r in relevance.search(found, query, k).collect()]
    want = brute(rows, query, k)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want))


def test_fewer_postings_are_read(spark, index):
    _, found = index
    idf = {"hz": 3.0, "gy": 2.0}
    blocks = relevance.promising(found, idf, 3)
    every = found["postings"].filter(F.col("term").isin(list(idf)))
    assert 0 < every.join(blocks, "block", "left_semi").count() < every.count() / 2
    own = found["postings"].filter("term = 'hz' and doc_id = 9002").first()
    assert own.tf == 3000 and list(own.positions) == list(range(3000))


def test_many_promising_blocks_are_joined(spark, index, monkeypatch):
    rows, found = index
    monkeypatch.setattr(relevance, "FEW_BLOCKS", 0)
    got = [r.doc_id for r in relevance.search(found, "ax ay", 10).collect()]
    assert got == [i for i, _ in brute(rows, "ax ay", 10)]


def test_empty_index(spark):
    found = relevance.build(spark, spark.createDataFrame([], "doc_id long, text string"), uuid.uuid4().hex)
    assert relevance.search(found, "ax").count() == 0


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_pages_equal_the_log_and_are_found_by_their_keys(spark):
    log, name = driver_log(spark, SF001), uuid.uuid4().hex
    pages.store(spark, log, name)
    whole = lists.paged_log(log)
    user = log.record.groupBy("user_id").count().orderBy(F.col("count").desc(), "user_id").first().user_id
    for number in (1, 2, 999):
        got = pages.page(spark, name, user, number)
        assert rows(got) == rows(whole.filter((F.col("user_id") == user) & (F.col("page_no") == number)))
        assert [r.rn for r in got.collect()] == sorted(r.rn for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(user_id,{user})" in plan and "EqualTo(page_no,999)" in plan and "PartitionFilters: [isnotnull(part" in plan
    assert pages.page(spark, name, -1, 1).count() == 0


def test_pages_of_changed_readers(spark):
    log, name = driver_log(spark, SF001), uuid.uuid4().hex
    pages.store(spark, log, name)
    users = [r.user_id for r in log.record.groupBy("user_id").count().orderBy(F.col("count").desc(), "user_id").limit(3).collect()]
    changed = ReadingLog(log.reader, log.shelf, log.record.filter(~((F.col("user_id") == users[0]) & (F.dayofmonth("r_date") < 15)) & (F.col("user_id") != users[1])))
    pages.refresh(spark, changed, spark.createDataFrame([(u,) for u in users[:2]], "user_id long"), name, 1)
    want = lists.paged_log(changed)
    for u in users:
        assert rows(pages.page(spark, name, u, 1)) == rows(want.filter((F.col("user_id") == u) & (F.col("page_no") == 1)))


def test_postings_are_made_where_texts_are_read(spark):
    data = [r for r in made(5, 60) if r != (1, "ax ax")]
    once = relevance._found(spark.createDataFrame(data, "doc_id long, text string"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    for docs in (data, data + [(1, "ax ax"), (3, None), (5, "by ax by"), (5, "")]):
        texts, want = {}, Counter()
        for i, t in docs:
            if i is not None and t is not None:
                texts.setdefault(i, []).append(re.findall(r"[^\W\d_]+", t.lower()))
        for i, rows_of in texts.items():
            for term in {w for r in rows_of for w in r}:
                at = sorted(p for r in rows_of for p, w in enumerate(r) if w == term)
                want[(term, i, len(at), tuple(at), sum(map(len, rows_of)))] += 1
        got = relevance._found(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert Counter((r.term, r.doc_id, r.tf, tuple(r.positions), r.length) for r in got) == want
        assert Counter(r.doc_id for r in got if r["first"]) == Counter({i for _, i, *_ in want})


def test_postings_of_pieces_of_a_batch(monkeypatch):
    texts = [["a", "b", "a"], [], ["b"], ["c"] * 50, ["a", "c"]]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "terms": pa.array(texts, pa.list_(pa.string()))})
    for words in (1, 4, 1 << 20):
        monkeypatch.setattr(relevance, "BATCH_WORDS", words)
        got = [r for b in relevance._postings([batch.slice(0, 0), batch]) for r in b.to_pylist()]
        assert {(r["doc_id"], r["term"]): r["positions"] for r in got} == {(i, t): [p for p, w in enumerate(x) if w == t] for i, x in enumerate(texts) for t in x}
        assert all(r["tf"] == len(r["positions"]) and r["length"] == len(texts[r["doc_id"]]) and r["first"] == (r["positions"][0] == 0) for r in got)
        assert len(got) == 6


def test_a_block_has_its_largest_weight_once(spark, index):
    _, found = index
    want = found["postings"].groupBy("term", "block").agg(F.max("weight").alias("most"))
    assert rows(found["blocks"]) == rows(want)

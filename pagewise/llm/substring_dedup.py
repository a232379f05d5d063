"""Substring dedup by suffix automata of reference shards.

A word goes when it lies in a window (``window`` words on end) that also
starts in a document with a smaller id.  Streaming every document through the
automaton of every other would take time in the square of the corpus, so the
reference is first reduced to what repeats, and each automaton is sent only to
texts that can match it:

1. Every document is read once: its number of words, the digest of its words,
   and its anchors, the word k-grams that are the least by hash in some window.
   Documents with equal digests but the first are removed whole.
2. A window that two texts share has its anchor in both.  Around anchors held
   by several texts the windows are hashed and counted: a window hash held by
   several has a first holder.
3. The first holders' stretches of such windows are the reference passages;
   other texts' stretches, cut by first holder, are the queries (equal ones
   once).  References are dealt to shards by their document; a shard's passages
   go to each of its blocks of queries, where a suffix automaton over words is
   built from them.
4. Queries are streamed through the automaton.  Its matching statistics, and
   the least document at the matched state, decide which windows go: the
   hashes before only choose what to look at.

Memory is bounded by the shard's and block's words and by the longest text;
the k-th copy of a text or passage adds counts, not pairs.

Defined results: null and blank texts have no words; a null doc_id is larger
than any other and never smaller than another null; rows that repeat, and rows
that share a doc_id, don't remove from each other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import buffers, stored

WINDOW = 50
SHARD_WORDS = 50_000  # reference words in a shard, on average
BLOCK_WORDS = 200_000  # query words in a block, on average
CACHE_WORDS = 1 << 20
LAST = (1 << 63) - 1  # stands for a null id
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        out = out * _STEP + h[j : j + n]
    return (out ^ (out >> np.uint64(29))) * _MIX


def anchor_width(window: int) -> int:
    return max(1, 3 * window // 10)


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the k-grams that are least in some window, and every k-gram equal to one of them."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = anchor_width(window)
    g = grams(h, k)
    seen = window - k + 1
    least = np.lib.stride_tricks.sliding_window_view(g, seen)
    n = len(g) - seen + 1
    at = np.unique(np.concatenate([least[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, n)) for i in range(0, n, 65536)]))
    return g[at], at


def _key(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big", signed=True)


def _rows(batch, *more):
    ids = [LAST if x is None else x for x in batch.column("doc_id").to_pylist()]
    return zip(ids, buffers(batch.column("text")), *(batch.column(c).to_pylist() for c in more))


def measured(docs: DataFrame, window: int) -> DataFrame:
    """id, raw (hash of the text as it is), n_words, sha, key, anchors (distinct hashes) of each row."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc, text, raw in _rows(batch, "raw"):
                words = (text or b"").split()
                sha = hashlib.sha256(b" ".join(words)).digest()
                a = np.unique(anchors(hashes(words), window)[0]).view(np.int64) if len(words) >= window else []
                out.append((doc, raw, len(words), sha.hex(), _key(sha), a))
            cols = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "raw", "n_words", "sha", "key", "anchors"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("raw")).mapInArrow(run, "id long, raw long, n_words long, sha string, key long, anchors array<long>")


def _hashed_windows(near: DataFrame, window: int) -> DataFrame:
    """(h, id, raw): hashes of the windows around shared anchors, once for each text."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            hs, ids, raws = [], [], []
            for doc, text, shared, raw in _rows(batch, "shared", "raw"):
                h = hashes(text.split())
                found = np.unique(grams(h, window)[_near_anchors(h, shared, window)])
                hs.append(found.view(np.int64))
                ids.append(np.full(len(found), doc, np.int64))
                raws.append(np.full(len(found), raw, np.int64))
            for i in range(0, len(hs), 256):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x[i : i + 256])) for x in (hs, ids, raws)], names=["h", "id", "raw"])

    return near.mapInArrow(run, "h long, id long, raw long")


def _near_anchors(h: np.ndarray, shared: list[int], window: int) -> np.ndarray:
    """Which windows hold a shared anchor."""
    n, k = len(h) - window + 1, anchor_width(window)
    edge = np.zeros(max(n, 0) + 1, np.int64)
    if n > 0:
        g, at = anchors(h, window)
        at = at[np.isin(g.view(np.int64), np.array(shared, np.int64))]
        np.add.at(edge, np.maximum(at + k - window, 0), 1)
        np.add.at(edge, np.minimum(at + 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _stretches(first: np.ndarray):
    """(start, end, first holder) of maximal runs of windows with one first holder; -1: none."""
    edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]])) if len(first) else []
    for a, b in zip(edges[:-1], edges[1:]):
        if first[a] != -1:
            yield int(a), int(b), int(first[a])


def _passages(near: DataFrame, window: int) -> DataFrame:
    """Reference passages (id = first) and queries (id > first): first, id, key, start, n, body, digest."""

    def run(batches):
        hashes = WordHashes()
        names = ["first", "id", "key", "start", "n", "body", "digest"]
        types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for doc, text, repeated, holders in _rows(batch, "repeated", "holders"):
                words = text.split()
                g = grams(hashes(words), window).view(np.int64)
                known, order = np.unique(np.array(repeated, np.int64), return_index=True)
                owner = np.array(holders, np.int64)[order]
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                first = np.where(known[at] == g, owner[at], -1)
                key = _key(hashlib.sha256(b" ".join(words)).digest())
                for a, b, f in _stretches(first):
                    body = b" ".join(words[a : b + window - 1])
                    out.append((f, doc, key, a, b - a, body, hashlib.md5(body).digest()))
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return near.mapInArrow(run, "first long, id long, key long, start int, n int, body binary, digest binary")


class Automaton:
    """Suffix automaton of several word sequences; every state knows the least document that holds its words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [LAST]

    def _state(self, nxt: dict, link: int, length: int, least: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def _split(self, p: int, w, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, LAST)
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, doc: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
            else:
                cur, p = self._state({}, 0, length[last] + 1, LAST), last
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = cur
            least[last] = min(least[last], doc)

    def close(self) -> None:
        """Hand the least documents on to all suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.least[s] < self.least[p]:
                self.least[p] = self.least[s]

    def matches(self, words: list, window: int):
        """(start, least document) of each window of ``words`` that the automaton holds."""
        s = n = 0
        for i, w in enumerate(words):
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            if n >= window:
                while self.length[self.link[s]] >= window:
                    s = self.link[s]
                    n = self.length[s]
                yield i + 1 - window, self.least[s]


def _matched(refs: DataFrame, queries: DataFrame, window: int, shard_words: int, block_words: int) -> DataFrame:
    """first, digest, starts, owners of each query: the windows that its shard's automaton holds, and their least document."""
    total = refs.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    shard = F.pmod(F.xxhash64("first"), F.lit(shards))
    refs = refs.select(shard.alias("shard"), "first", "body").distinct()
    asked = queries.select(shard.alias("shard"), "first", "digest", "body", "n").dropDuplicates(["first", "digest"])
    blocks = asked.groupBy("shard").agg(F.ceil(F.sum(F.col("n") + window - 1) / block_words).alias("blocks"))
    asked = asked.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("digest"), "blocks").alias("block"), "first", "digest", "body")
    refs = refs.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "first", "body")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        auto = Automaton()
        refs, asked = rows[rows["digest"].isna()], rows[rows["digest"].notna()]
        for doc, body in sorted(zip(refs["first"], refs["body"])):
            auto.add(body.split(), doc)
        auto.close()
        found = [list(zip(*auto.matches(body.split(), window))) or [(), ()] for body in asked["body"]]
        return pd.DataFrame({"first": asked["first"], "digest": asked["digest"], "starts": [list(x[0]) for x in found], "owners": [list(x[1]) for x in found]})

    both = refs.select("shard", "block", "first", F.lit(None).cast("binary").alias("digest"), "body").union(asked.select("shard", "block", "first", "digest", "body"))
    return both.groupBy("shard", "block").applyInPandas(run, "first long, digest binary, starts array<int>, owners array<long>")


def _kept(near: DataFrame, window: int) -> DataFrame:
    """id, key, n_removed, kept_sha256 and text (of the kept words) for texts with ``gone`` windows."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, gone, key in _rows(batch, "gone", "key"):
                words = text.split()
                if _key(hashlib.sha256(b" ".join(words)).digest()) != key:
                    continue  # another row that shares the id
                cover = np.zeros(len(words) + 1, np.int64)
                starts = np.array(gone, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept = b" ".join(w for w, x in zip(words, keep.tolist()) if x)
                out.append((doc, key, int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "key", "n_removed", "kept_sha256", "kept"])

    return near.mapInArrow(run, "id long, key long, n_removed long, kept_sha256 string, kept string")


def repeats(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Two frames: (id, n_words, sha, key, copy) of every row; (id, key, n_removed, kept_sha256, kept) of texts that lose some words."""
    base = stored(measured(docs, window), "measured")
    firsts = base.filter(F.col("n_words") >= window).groupBy("sha").agg(F.min("id").alias("id")).withColumn("copy", F.lit(False))
    marked = base.select("id", "n_words", "sha", "key").join(firsts, ["sha", "id"], "left")  # both keys: copies of one text are dealt out
    marked = marked.withColumn("copy", (F.col("n_words") >= window) & F.coalesce("copy", F.lit(True)))

    # rows meet their text by id and hash: texts of one id, or of all null ids, are told apart
    own = base.filter(F.size("anchors") > 0).join(firsts, ["sha", "id"]).select("id", "raw", "key", F.explode("anchors").alias("a"))
    shared = own.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("a")
    near = own.join(shared, "a").groupBy("id", "raw", "key").agg(F.collect_set("a").alias("shared"))  # the anchors of one text
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("raw"), "text").filter("text is not null")
    near = stored(texts.join(near, ["id", "raw"]).select(F.col("id").alias("doc_id"), "raw", "key", "text", "shared"), "near")

    windows = _hashed_windows(near, window)
    holders = windows.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("hi")).filter("first < hi").select("h", "first")
    held = windows.join(holders, "h").groupBy(F.col("id").alias("doc_id"), "raw").agg(F.collect_list(F.struct("h", "first")).alias("x"))  # the windows of one text
    known = near.select("doc_id", "raw", "text").join(held, ["doc_id", "raw"]).select("doc_id", "text", F.col("x.h").alias("repeated"), F.col("x.first").alias("holders"))
    passages = stored(_passages(known, window), "passages")

    queries = passages.filter("id > first")
    matched = _matched(passages.filter("id = first"), queries, window, shard_words, block_words)
    hits = queries.select("first", "digest", "id", "key", "start").join(matched, ["first", "digest"])
    at = F.filter(F.arrays_zip("starts", "owners"), lambda x: x["owners"] < F.col("id"))
    hits = hits.select("id", "key", F.explode(F.transform(at, lambda x: x["starts"] + F.col("start"))).alias("s"))
    gone = hits.groupBy("id", "key").agg(F.collect_set("s").alias("gone"))  # the windows of one text
    lost = _kept(near.select("doc_id", "key", "text").join(gone.withColumnRenamed("id", "doc_id"), ["doc_id", "key"]).select("doc_id", "text", "gone", "key"), window)
    return marked, lost.dropDuplicates(["id", "key"])


def removed(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of ``docs``."""
    marked, lost = repeats(docs, window, **how)
    out = marked.join(lost.select("id", "key", "n_removed", "kept_sha256"), ["id", "key"], "left")
    return out.select(
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )

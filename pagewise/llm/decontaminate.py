"""Benchmark decontamination with an FM-index per training shard.

A task gathers the words of its documents into shards of ``SHARD_WORDS``
symbols (a longer document spans shards that overlap by one phrase).  Words
that no benchmark phrase contains can't match, so a run of them is one symbol.
For every shard it builds a suffix array, from it the Burrows-Wheeler
transform in a wavelet matrix and sampled suffix positions; all phrases are
then searched backward at once, and the occurrences located and merged into
the spans to remove.

Only the benchmark travels: its phrases go to the tasks in blocks of at most
``BLOCK_WORDS`` words, and each further block is one more pass over the
documents, so its size has no bound.

Defined results: null and empty texts have no words; an item with no words has
no phrase, one with fewer than ``window`` words is one phrase; items that
repeat count by item_id, a null item_id is named ``null``; an empty benchmark
hits nothing; rows that repeat are judged alike; the operator's own columns
start with ``_``, so other columns of the documents pass through unharmed.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewise.llm.common import buffers, fresh, lean

WINDOW = 10
SHARD_WORDS = 1 << 18
SAMPLE = 16  # one suffix position in so many is kept
BLOCK_WORDS = 2_000_000

#: The contract's words, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, in UTF-8.
_IS_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TO_WORDS = bytes((i + 32 if 65 <= i <= 90 else i) if _IS_WORD.match(bytes([i])) else 32 for i in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of symbols >= 1, by prefix doubling that sorts anew only suffixes still tied."""
    n = len(s)
    top = int(s.max()) + 1
    width = 1
    key = s.astype(np.int64)
    span = top
    while span * top < (1 << 62) and width < 4:  # several symbols in the first key
        nxt = np.zeros(n, np.int64)
        if width < n:
            nxt[: n - width] = s[width:]
        key = key * top + nxt
        span *= top
        width += 1
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]  # the first of a tied group as well
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        pos = order[at]
        follow = np.full(len(at), -1, np.int64)
        inside = pos + width < n
        follow[inside] = rank[pos[inside] + width]
        group = starts[at]
        by = np.argsort(group * (n + 2) + follow + 1, kind="stable")
        pos, group, follow = pos[by], group[by], follow[by]
        order[at] = pos
        differs = np.empty(len(at), bool)
        differs[0] = True
        differs[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        new[at] = differs
        starts[at] = np.maximum.accumulate(np.where(differs, at, 0))
        rank[pos] = starts[at]
        width *= 2


class FMIndex:
    """FM-index of a sequence of symbols 1..top-1; 0 ends it."""

    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        text = np.concatenate([s, [0]])
        sa = np.concatenate([[len(s)], suffix_array(s)]) if len(s) else np.zeros(1, np.int64)
        bwt = text[sa - 1]
        self.n, top = len(text), int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])  # rows of smaller symbols
        self.levels = max(1, (top - 1).bit_length())
        self.ones, self.zeros, seq = [], [], bwt.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):  # wavelet matrix, the highest bit first
            bit = (seq >> level & 1).astype(bool)
            rank = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=rank[1:])
            self.ones.append(rank)
            self.zeros.append(self.n - int(rank[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])
        kept = sa % sample == 0
        self.kept = np.zeros(self.n + 1, np.int32)
        np.cumsum(kept, out=self.kept[1:])
        self.samples = sa[kept]
        self.top = top

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before row i of the transform."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros):
            bit = (c >> level & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one symbol earlier."""
        lo, at, c = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.zeros(len(rows), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] > ones[at]
            a, b = ones[lo], ones[at]
            c = c * 2 + bit
            lo, at = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, at - b)
        return self.first[c] + at - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases of one length: (phrase, first row, row after the last) of those that occur."""
        alive = np.flatnonzero((phrases < self.top).all(axis=1))
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            go = hi > lo
            alive, lo, hi = alive[go], lo[go], hi[go]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.kept[at + 1] > self.kept[at]
            out[todo[hit]] = self.samples[self.kept[at[hit]]] + steps
            todo, at = todo[~hit], self.back(at[~hit]) if (~hit).any() else at[:0]
            steps += 1
        return out


class Phrases:
    """The phrases of a block of benchmark items, by length, over their own vocabulary (symbol 1: any other word)."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.longest = 1
        owners: dict[tuple, set] = {}
        for item, text in items:
            found = [self.ids.setdefault(w, len(self.ids) + 2) for w in words(text)]
            if found:
                width = min(window, len(found))
                self.longest = max(self.longest, width)
                for i in range(len(found) - width + 1):
                    owners.setdefault(tuple(found[i : i + width]), set()).add(item)
        self.by_length = {}
        for phrase, names in owners.items():
            self.by_length.setdefault(len(phrase), ([], []))
            self.by_length[len(phrase)][0].append(phrase)
            self.by_length[len(phrase)][1].append(sorted(names))
        self.by_length = {n: (np.array(p, np.int64), names) for n, (p, names) in self.by_length.items()}

    def symbols(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, found, repeat(1)), np.int32, len(found))


def _search_shard(parts: list[tuple[int, int, np.ndarray]], phrases: Phrases, hits: dict) -> None:
    """parts: (document, number of its first word, symbols). Adds to hits[document] its (start, end) words and items."""
    if not parts:
        return
    lengths = np.array([len(x) + 1 for _, _, x in parts])
    ends = np.cumsum(lengths)
    symbols = np.ones(int(ends[-1]), np.int64)  # a part is followed by a symbol that ends it
    for (_, _, x), end in zip(parts, ends.tolist()):
        symbols[end - 1 - len(x) : end - 1] = x
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 1) | (symbols[:-1] != 1)  # a run of other words is one symbol
    at = np.flatnonzero(keep)
    index = FMIndex(symbols[at])
    starts = ends - lengths - np.array([first for _, first, _ in parts])
    for length, (table, names) in phrases.by_length.items():
        which, lo, hi = index.search(table)
        if not len(which):
            continue
        counts = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        pos = at[index.locate(rows)]
        part = np.searchsorted(ends, pos, "right")
        for i, start, phrase in zip(part.tolist(), (pos - starts[part]).tolist(), np.repeat(which, counts).tolist()):
            spans, items = hits.setdefault(parts[i][0], ([], set()))
            spans.append((start, start + length))
            items.update(names[phrase])


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def search_texts(texts: list[bytes | None], phrases: Phrases, shard_words: int = SHARD_WORDS) -> tuple[list[int], dict]:
    """Number of words of each text, and {text's number: (spans, items)} of those with hits."""
    counts, hits, parts, held = [], {}, [], 0
    lap = phrases.longest - 1
    for doc, text in enumerate(texts):
        found = words(text)
        counts.append(len(found))
        s = phrases.symbols(found)
        first = 0
        while first < len(s):
            piece = s[first : first + shard_words]
            parts.append((doc, first, piece))
            held += len(piece)
            last = first + len(piece) >= len(s)
            if held >= shard_words:
                _search_shard(parts, phrases, hits)
                parts, held = [], 0
            if last:
                break
            first += len(piece) - lap
    _search_shard(parts, phrases, hits)
    return counts, hits


def cut_words(text: bytes, spans) -> bytes:
    """The text without the stretches from the first to the last word of each span."""
    at = [m.span() for m in _IS_WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ITEMS = pa.list_(pa.string())


def _pass(docs: DataFrame, phrases: Phrases, shard_words: int, own: list[str], cut: bool) -> DataFrame:
    """Add (or, in a later pass, extend) the columns ``own``: number of words, spans, items; ``cut``: take the spans out of the text."""
    others = [c for c in docs.columns if c not in own]
    schema = T.StructType([docs.schema[c] for c in others] + T.StructType.fromDDL("n long, spans array<struct<start:int,end:int>>, items array<string>").fields)
    for field, name in zip(schema.fields[len(others) :], own):
        field.name = name
    schema = T.StructType(schema.fields)

    @lean
    def run(batches):
        for batch in batches:
            counts, hits = search_texts(list(buffers(batch.column("text"))), phrases, shard_words)
            old = zip(batch.column(own[1]).to_pylist(), batch.column(own[2]).to_pylist()) if own[1] in batch.schema.names else [([], [])] * len(counts)
            spans, items = [], []
            for doc, (was, had) in enumerate(old):
                new, names = hits.get(doc, ((), ()))
                spans.append(merged([*new, *((x["start"], x["end"]) for x in was)]) if new or was else [])
                items.append(sorted({*names, *had}))
            columns = [batch.column(c) for c in others]
            if cut and any(spans):
                texts = [cut_words(t, s) if s else t for t, s in zip(buffers(batch.column("text")), spans)]
                columns[others.index("text")] = pa.array(texts, pa.binary()).cast(batch.column("text").type)
            spans = [[{"start": a, "end": b} for a, b in s] for s in spans]
            columns += [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, _ITEMS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *own])

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, own: list[str], cut: bool = False, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` and three columns named ``own``: number of words, spans (merged, in words: start, end), items that occur
    (names, sorted).  With ``cut`` the spans are taken out of ``text``."""
    name = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    items = benchmark.select(name.alias("item"), F.col("text").cast("binary").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))  # a word and its gap take two bytes at least
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for i in range(blocks):
        phrases = Phrases([(x.item, bytes(x.text)) for x in items.filter(part == i).collect()], window)
        docs = _pass(docs, phrases, shard_words, own, cut and i == blocks - 1)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = find(docs.select("doc_id", "text"), benchmark, ["_n_words", "_spans", "_items"], **how)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col("_spans").alias("spans"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` with the spans cut out of ``text``; rows whose text loses every word go."""
    own = fresh(docs.columns, "_n_words", "_spans", "_items")
    left = find(docs, benchmark, own, cut=True, **how)
    lost = F.aggregate(own[1], F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return left.filter((lost == 0) | (lost < F.col(own[0]))).drop(*own)

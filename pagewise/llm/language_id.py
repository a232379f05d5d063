"""Language ID with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum, by the forward algorithm, over all ways to cut
it into pieces; a text's is the product over its words (a piece never spans
white space).  The probabilities are fitted by EM: a backward pass beside the
forward one gives each piece's expected count over all segmentations.

Sums are scaled where they get small, so words of any length (a script without
spaces is one word) keep their likelihoods apart.  Words of one length are cut
side by side, ``CELLS`` characters at once; of a longer word ``CHUNK``
characters at once, with what the next ones need of the last ones.

The fit uses a bounded sample of the labelled rows (``FIT_ROWS`` rows on
average, drawn by a hash of the id); tasks count its words, run the E-step on
their part and send a table of at most pieces x languages to the driver.  Every
text is scored whole, in its task.

Defined results: null text, and text without a letter (``str.isalpha``; digits,
fractions, raised numbers and marks are none), is ``und`` with score 0; without
labelled rows everything is ``und``; texts that repeat score alike; a null
doc_id is never held out; very long texts and words are scored whole;
characters outside the vocabulary are its unknown piece; equal likelihoods go
to the language first in code-point order; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewise.llm.common import buffers, fresh, held_out, lean, stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FIT_ROWS = 8_000
ROUNDS = 3
SMOOTHING = 0.02
MAX_PIECE = 16
CACHE_WORDS = 1 << 17  # words whose likelihoods a task remembers at once
CELLS = 1 << 17  # characters, words x length, that are cut side by side
CHUNK = 1 << 11  # characters of a word that are cut at once
FEW = 8  # words of one length up to which all pieces are looked up at once
TINY = 1e-60  # sums below are scaled up
TEXT_BYTES = 1 << 20  # bytes of text that are scored at once

WORDLIKE = re.compile(r"[^\W\d_]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


class Vocabulary:
    """Pieces of a public SentencePiece model, found by a rolling hash of their code points."""

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = [p for p in (sp.id_to_piece(i) for i in usable) if 0 < len(p) <= MAX_PIECE]
        self.size = len(pieces) + 1  # the last is the unknown character
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash_one(p) for p in pieces], np.uint64)
        self.tables = []
        left, ids = keys, np.arange(len(pieces))
        for turn in range(6):  # pieces that fall on one slot move on to the next table
            bits = 18
            slot = ((left * (_ODD + np.uint64(2 * turn))) >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            at, key = np.full(1 << bits, self.none, np.int32), np.zeros(1 << bits, np.uint64)
            at[slot[first]], key[slot[first]] = ids[first], left[first]
            self.tables.append((turn, bits, at, key))
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, ids = left[rest], ids[rest]
            if not len(left):
                break

    @staticmethod
    def _hash_one(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for ch in piece:
            h = h * _BASE + np.uint64(ord(ch) + 1)
        return int(h[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashed strings; ``none`` where it is no piece."""
        out = np.full(h.shape, self.none, np.int32)
        for turn, bits, at, key in self.tables:
            slot = ((h * (_ODD + np.uint64(2 * turn))) >> np.uint64(64 - bits)).astype(np.int64)
            hit = key[slot] == h
            out[hit] = at[slot[hit]]
        return out

    def arcs(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length: the pieces that start at each character of the words in the columns of ``codes``."""
        out, h = [], codes
        for length in range(1, min(self.longest, len(codes)) + 1):
            if length > 1:
                h = h[:-1] * _BASE + codes[length - 1 :]
            ids = self.find(h)
            if length == 1:
                ids[ids == self.none] = self.unknown
            out.append(ids)
        return out


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def marked(word: str) -> str:
    """The word with its start mark."""
    return "▁" + word


def _groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words of one length, and their characters (length x words)."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, which in by_length.items():
        step = max(1, CELLS // n)
        for part in range(0, len(which), step):
            rows = which[part : part + step]
            letters = "".join([words[i] for i in rows]).encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(letters, np.uint32).reshape(-1, n).T.astype(np.uint64, order="C") + np.uint64(1)
            yield np.array(rows), codes


class Lattice:
    """All segmentations of words of one length; ``take(pieces, words)`` gives probabilities (pieces x width)."""

    def __init__(self, vocab: Vocabulary, codes: np.ndarray, take: Callable, width: int):
        self.vocab, self.codes, self.take = vocab, codes, take
        self.n, self.count, self.width, self.back = len(codes), codes.shape[1], width, vocab.longest - 1

    def start(self):
        first = np.ones((1, self.count, self.width))
        return 0, first, np.zeros(first.shape)

    def walk(self, lo: int, window: np.ndarray, logs: np.ndarray):
        """Forward sums of the next chunk from those of the places up to ``lo``.

        Returns (first place, sums, their logarithmic scales, arcs); a sum is sums * exp(scales)."""
        hi, off = min(self.n, lo + CHUNK), lo - len(window) + 1
        sums = np.zeros((hi - off + 1, self.count, self.width))
        scales = np.zeros(sums.shape)
        sums[: len(window)], scales[: len(window)] = window, logs
        arcs = self.vocab.arcs(self.codes[off:hi])
        dense = self._dense(arcs, len(sums)) if self.count <= FEW else None
        scale = logs[-1]
        for b in range(len(window), len(sums)):
            low = max(0, b - len(arcs))
            if dense is not None:
                sums[b] = (sums[low:b] * dense[b, len(arcs) - (b - low) :]).sum(axis=0)
            else:
                for a in range(low, b):
                    ids = arcs[b - a - 1][a]
                    hit = np.flatnonzero(ids != self.vocab.none)
                    if len(hit):
                        sums[b, hit] += sums[a, hit] * self.take(ids[hit], hit)
            if sums[b].min() < TINY:
                up = np.where(sums[b] < TINY, 1 / sums[b], 1)
                scale = scale - np.log(up)
                near = max(0, b + 1 - len(arcs))
                sums[near : b + 1] *= up
                scales[near : b + 1] = scale
            else:
                scales[b] = scale
        return off, sums, scales, arcs

    def _dense(self, arcs, places):
        """Probabilities of all arcs by end and start: places x lengths x words x width."""
        out = np.zeros((places, len(arcs), self.count, self.width))
        everyone = np.arange(self.count)
        for i, ids in enumerate(arcs):
            out[i + 1 : i + 1 + len(ids), len(arcs) - 1 - i] = self.take(ids.ravel(), np.tile(everyone, len(ids))).reshape(len(ids), self.count, self.width)
        return out

    def chunks(self):
        """(place before the chunk, what the chunk starts from, walk's result) of each chunk in turn."""
        lo, window, logs = self.start()
        while True:
            got = self.walk(lo, window, logs)
            yield (lo, window, logs), got
            off, sums, scales, _ = got
            lo = off + len(sums) - 1
            if lo >= self.n:
                return
            window, logs = sums[-self.back - 1 :].copy(), scales[-self.back - 1 :].copy()

    def total(self) -> np.ndarray:
        """Log-likelihoods (words x width)."""
        for _, (_, sums, scales, _) in self.chunks():
            pass
        return np.log(sums[-1]) + scales[-1]

    def posterior(self):
        """(pieces, words, posterior probabilities) of a chunk's arcs of each length, over all segmentations; width is 1.

        Chunks are walked again from what they started from, the last first."""
        starts = []
        for begin, (_, sums, scales, _) in self.chunks():
            starts.append(begin)
            whole = np.log(sums[-1]) + scales[-1]
        tail, scale = np.ones((1, self.count, 1)), np.zeros((self.count, 1))  # backward sums up to the place last seen
        for begin in reversed(starts):
            _, sums, scales, arcs = self.walk(*begin)
            dense = self._dense(arcs, len(sums)) if self.count <= FEW else None
            after, scaled = np.zeros(sums.shape), np.zeros(sums.shape)
            after[len(after) - len(tail) :] = tail
            done = len(begin[1])
            for b in range(len(after) - 1, done - 1, -1):
                low = max(0, b - len(arcs))
                if after[b].min() < TINY:
                    up = np.where(after[b] < TINY, 1 / after[b], 1)
                    after[low : b + 1] *= up
                    scale = scale - np.log(up)
                scaled[b] = scale
                if dense is not None:
                    after[low:b] += dense[b, len(arcs) - (b - low) :] * after[b]
                    continue
                for a in range(low, b):
                    ids = arcs[b - a - 1][a]
                    hit = np.flatnonzero(ids != self.vocab.none)
                    if len(hit):
                        after[a, hit] += self.take(ids[hit], hit) * after[b, hit]
            tail = after[:done].copy()
            for i, ids in enumerate(arcs):
                a, hit = np.nonzero(ids != self.vocab.none)
                a, hit = a[a + i + 1 >= done], hit[a + i + 1 >= done]  # earlier ends belong to the chunk before
                b, got = a + i + 1, ids[a, hit]
                p = sums[a, hit] * self.take(got, hit) * after[b, hit] * np.exp(scales[a, hit] + scaled[b, hit] - whole[hit])
                yield got, hit, p[:, 0]


def forward(vocab: Vocabulary, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-likelihood (words x languages) of marked words under ``probs`` (pieces + 1 row of zeros, x languages)."""
    out = np.empty((len(words), probs.shape[1]))
    for rows, codes in _groups(words):
        out[rows] = Lattice(vocab, codes, lambda ids, hit: probs[ids], probs.shape[1]).total()
    return out


def expected(vocab: Vocabulary, probs: np.ndarray, words: list[str], lang: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) over all segmentations of words, each of one language."""
    k = probs.shape[1]
    out = np.zeros(probs.size)
    for rows, codes in _groups(words):
        own, weight = lang[rows], weights[rows]
        found = Lattice(vocab, codes, lambda ids, hit: probs[ids, own[hit]][:, None], 1).posterior()  # noqa: B023
        for ids, hit, p in found:
            out += np.bincount(ids.astype(np.int64) * k + own[hit], p * weight[hit], len(out))
    return out.reshape(probs.shape)[: vocab.size]


class Model:
    """Languages in code-point order and the probabilities of the pieces."""

    def __init__(self, langs: list[str], probs: np.ndarray, path: str):
        self.langs, self.probs, self.path = langs, probs, path

    def table(self) -> np.ndarray:
        return np.vstack([self.probs, np.zeros((1, len(self.langs)))])


def _count_words(batches):
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, raw in zip(batch.column("lang").to_pylist(), buffers(batch.column("text"))):
            counts.setdefault(lang, Counter()).update(raw.split())
        rows = [(lang, w.decode("utf-8", "replace"), n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from text and lang of rows that aren't held out."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = rows.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    sample = rows.filter(u < fit_rows / total) if total > fit_rows else rows
    words = sample.select("lang", "text").mapInArrow(lean(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    vocab = Vocabulary(vocabulary)
    probs = np.full((vocab.size, len(langs)), 1.0 / vocab.size)
    for _ in range(rounds if langs else 0):
        model = spark.sparkContext.broadcast(Model(langs, probs, vocabulary))

        @lean
        def e_step(batches, model=model):
            m = model.value
            vocab, table, at = Vocabulary(m.path), m.table(), {x: i for i, x in enumerate(m.langs)}
            sums = np.zeros((vocab.size, len(m.langs)))
            for batch in batches:
                lang = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
                sums += expected(vocab, table, [marked(w) for w in batch.column("word").to_pylist()], lang, batch.column("n").to_numpy().astype(float))
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(sums[piece, lang])], names=["piece", "lang", "x"])

        got = words.mapInArrow(e_step, "piece int, lang int, x double").groupBy("piece", "lang").agg(F.sum("x").alias("x")).toArrow()
        probs = np.full((vocab.size, len(langs)), SMOOTHING)
        probs[got["piece"].to_numpy(), got["lang"].to_numpy()] += np.round(got["x"].to_numpy(), 6)
        probs /= probs.sum(axis=0)
    return Model(langs, probs, vocabulary)


class Scorer:
    """Scores texts in a task; remembers the likelihoods of words it has met."""

    def __init__(self, model: Model):
        self.model, self.vocab, self.table = model, Vocabulary(model.path), model.table()
        self.forget()

    def forget(self):
        self.at: dict[bytes, int] = {}
        self.known = np.empty((0, len(self.model.langs)))

    def likelihoods(self, texts: list[bytes]) -> np.ndarray:
        if len(self.at) > CACHE_WORDS:
            self.forget()
        at, ids, ends = self.at, [], []
        old = len(at)
        for text in texts:
            ids.append(np.array([at.setdefault(w, len(at)) for w in text.split()], np.int64))
            ends.append(len(ids[-1]))
        new = [w.decode("utf-8", "replace") for w in list(at)[old:]] if len(at) > old else []
        if new:
            self.known = np.vstack([self.known, forward(self.vocab, self.table, [marked(w) for w in new])])
        return np.array([self.known[i].sum(axis=0) for i in ids])

    def __call__(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        langs = self.model.langs
        letters = [bool(langs) and t is not None and has_letter(t.decode("utf-8", "replace")) for t in texts]
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        todo = [i for i, x in enumerate(letters) if x]
        start = 0
        while start < len(todo):
            end, held = start, 0
            while end < len(todo) and held < TEXT_BYTES:
                held += len(texts[todo[end]])
                end += 1
            logs = self.likelihoods([texts[i] for i in todo[start:end]])
            logs -= logs.max(axis=1, keepdims=True)
            post = np.exp(logs)
            post /= post.sum(axis=1, keepdims=True)
            for i, k, p in zip(todo[start:end], post.argmax(axis=1).tolist(), post.max(axis=1).tolist()):
                pred[i], score[i] = langs[k], min(1.0, p)
            start = end
        return pred, score


def predict(docs: DataFrame, model: Model, lang: str, score_: str) -> DataFrame:
    """``docs`` and two columns, the predicted language and its score."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # pieces x languages numbers
    names = docs.columns

    @lean
    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            pred, score = scorer(list(buffers(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, lang, score_])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score_, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = fit(docs, vocabulary, fit_rows)
    out = predict(docs.select("doc_id", "text"), model, "lang_pred", "score")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.5, vocabulary: str = VOCABULARY, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``least`` or more."""
    own = fresh(docs.columns, "_lang_pred", "_score")
    out = predict(docs, fit(docs, vocabulary, fit_rows), *own)
    return out.filter((F.col(own[0]) != "und") & (F.col(own[1]) >= least)).drop(*own)

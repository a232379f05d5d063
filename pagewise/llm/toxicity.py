"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of two hashed rows, one for the word and one for
its first ``PREFIX`` letters.  Filters of widths 1, 2 and 3 slide over the
whole text, each filter's maximum is pooled, and a logistic layer weighs the
maxima.  Gradients reach the words at the maxima only, so training is cheap.

The classifier learns from every labelled row that isn't held out; the driver
sees no more of them than its start.  Their words are stored once.  The net's
start is fitted on the driver over a bounded part of them (``FIT_ROWS`` on
average, drawn by a hash of the id; whole texts, of ``FIT_BYTES`` at most
together: in order of the hash, as many as fit).  If that is not all, the rows
are dealt to shards of about that size; a task for each goes on from the start
over all rows of its shard, and the nets are averaged, weighted by rows.

A quarter of all labelled rows is set aside and calibrates: for each language,
guessed from the text's function words, the logit that parts the labels best is
moved to score 0.7.  Where there are shards, logits are counted to 3 decimals.

Defined results: null and empty texts are padding only and get the score of
padding; very long texts are scored whole, in overlapping parts; with no row of one of the labels every score is 0; texts that repeat
score alike; a label that is null is no label, of several for one id the
highest counts; a null doc_id is never held out and has no label; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import buffers, held_out, lean, stored

FIT_ROWS = 12_000
FIT_BYTES = 64 << 20
BUCKETS = 1 << 15
PREFIX = 4
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PAD = max(WIDTHS) - 1
VISITS, BATCH, RATE = 54_000, 32, 0.08  # training visits so many texts, in 4 to 30 rounds
EPOCHS = (4, 30)
TOXIC_AT = 0.7
CALIBRATION_SHARE = 0.25
PIECES = 256  # of a net, when nets are averaged
CACHE_WORDS = 1 << 20

#: Function words that tell four languages apart.
FUNCTION_WORDS = {
    "de": "der die das und den des ist ein eine zu mit von auf",
    "en": "the of and to in is that for was with this",
    "es": "el los las que del un por con una y se",
    "fr": "le la les des et un une est que du pour dans",
}
_TOKEN = re.compile(r"[^\W_]+")
_LANG_OF = {lang: frozenset(x.split()) for lang, x in FUNCTION_WORDS.items()}


def language_guess(words: list[str]) -> str:
    counts = {lang: sum(map(own.__contains__, words)) for lang, own in _LANG_OF.items()}
    best = max(sorted(counts), key=counts.get)
    return best if counts[best] else "other"


class _Codes(dict):
    """Words and their pairs of embedding rows, made as they are asked for."""

    def __missing__(self, w: str) -> int:
        whole = zlib.crc32(w.encode()) % BUCKETS
        start = zlib.crc32(b"^" + w[:PREFIX].encode()) % BUCKETS
        code = self[w] = whole << 32 | start + BUCKETS
        return code


class Tokens:
    """Words of a text as pairs of embedding rows."""

    def __init__(self):
        self.known = _Codes()

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, str]:
        words = _TOKEN.findall((text or b"").decode("utf-8", "replace").lower())
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), language_guess(words)


def packed(tokens: np.ndarray) -> bytes:
    """Both rows of each word in 4 bytes, as they are stored."""
    return ((tokens >> 32) * BUCKETS + (tokens & 0xFFFFFFFF) - BUCKETS).astype("<i4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    both = np.frombuffer(data, "<i4").astype(np.int64)
    return both // BUCKETS << 32 | both % BUCKETS + BUCKETS


class Net:
    """The classifier. Rows of ``table``: words, then prefixes, then the padding (always zero)."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (2 * BUCKETS + 1, DIM)).astype(np.float32)
        self.table[-1] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.rest = np.float32(-2.0)
        self.seen, self.seen_rest = [np.full_like(p, 1e-6) for p in self.params()], 1e-6
        self.cut: dict[str, float] = {}
        self.usual = 0.0

    @staticmethod
    def rows(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pad = np.full(PAD + 1, 2 * BUCKETS, np.int64)
        return np.concatenate([tokens >> 32, pad]), np.concatenate([tokens & 0xFFFFFFFF, pad])

    def _responses(self, x: np.ndarray):
        n = len(x) - PAD
        for width, f, b in zip(WIDTHS, self.filters, self.bias):
            y = x[:n] @ f[0]
            for j in range(1, width):
                y = y + x[j : j + n] @ f[j]
            yield y + b

    def pooled(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.rows(tokens)
        x = self.table[a] + self.table[b]
        values, places = [], []
        for y in self._responses(x):
            at = y.argmax(axis=0)
            places.append(at)
            values.append(y[at, np.arange(FILTERS)])
        return a, b, x, np.concatenate(values), np.concatenate(places)

    def logit(self, tokens: np.ndarray, block: int = 1 << 16) -> float:
        best = None
        for i in range(0, max(len(tokens), 1), block):  # a long text in overlapping parts
            v = self.pooled(tokens[i : i + block + PAD])[3]
            best = v if best is None else np.maximum(best, v)
        return float(np.maximum(best, 0) @ self.out + self.rest)

    def gradient(self, tokens: np.ndarray, y: float, weight: float):
        """Of the weighted log loss of one text: by filters, biases and output weights; by the free term; (rows of the
        table, gradients)."""
        a, b, x, v, at = self.pooled(tokens)
        act = np.maximum(v, 0)
        p = 1 / (1 + np.exp(-float(act @ self.out + self.rest)))
        d = (p - y) * weight
        back = d * self.out * (v > 0)
        filters, bias, rows, steps = [np.zeros_like(f) for f in self.filters], [], [], []
        for k, width in enumerate(WIDTHS):
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            g, where = back[mine], at[mine]
            bias.append(g)
            for j in range(width):
                filters[k][j] += x[where + j].T * g
                step = (self.filters[k][j] * g).T
                rows += [a[where + j], b[where + j]]
                steps += [step, step]
        return [*filters, *bias, d * act], d, (np.concatenate(rows), np.concatenate(steps))

    def fit(self, texts: list[np.ndarray], y: np.ndarray, visits: int = VISITS, seed: int = 6) -> None:
        epochs = min(EPOCHS[1], max(EPOCHS[0], visits // max(len(texts), 1)))
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            self.learn(texts, y, float(y.mean()), rng)

    def learn(self, texts: list[np.ndarray], y: np.ndarray, share: float, rng: np.random.Generator) -> None:
        """One visit to each text, in an order of ``rng``; ``share`` of all texts, of others too, have label 1."""
        weight = np.where(y == 1, min(5.0, ((1 - share) / share) ** 0.5), 1.0)
        params, seen = self.params(), self.seen
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            grads = [np.zeros_like(p) for p in params[1:]]
            rows, steps, g_rest = [], [], 0.0
            for i in part:
                dense, d, (at, step) = self.gradient(texts[i], y[i], weight[i] / len(part))
                for g, x in zip(grads, dense):
                    g += x
                g_rest += d
                rows.append(at)
                steps.append(step)
            for p, s, g in zip(params[1:], seen[1:], grads):
                s += g * g
                p -= RATE * g / np.sqrt(s)
            self.seen_rest += g_rest**2
            self.rest -= np.float32(RATE * g_rest / self.seen_rest**0.5)
            at, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            g = np.zeros((len(at), DIM), np.float32)
            np.add.at(g, inverse, np.concatenate(steps))
            g[at == 2 * BUCKETS] = 0
            seen[0][at] += g * g
            self.table[at] -= RATE * g / np.sqrt(seen[0][at])

    def params(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.bias, self.out]

    def numbers(self) -> np.ndarray:
        """All that learning changes, in a row."""
        rest = np.array([self.rest, self.seen_rest], np.float64)
        return np.concatenate([rest, *[p.ravel() for p in (*self.params(), *self.seen)]])

    def take(self, numbers: np.ndarray) -> None:
        self.rest, self.seen_rest, at = np.float32(numbers[0]), float(numbers[1]), 2
        for p in (*self.params(), *self.seen):
            p[...] = numbers[at : at + p.size].reshape(p.shape)
            at += p.size

    def calibrate(self, z: np.ndarray, langs: list[str], y: np.ndarray, n: np.ndarray) -> None:
        """``n`` texts of a language have logit ``z``, ``y`` of them label 1."""
        langs = np.array(langs)
        self.usual = _best_cut(z, y, n)
        for lang in sorted(set(langs)):
            own = langs == lang
            if y[own].sum() >= 10 and (n - y)[own].sum() >= 10:
                self.cut[str(lang)] = _best_cut(z[own], y[own], n[own])

    def score(self, tokens: np.ndarray, lang: str) -> float:
        z = self.logit(tokens) - self.cut.get(lang, self.usual) + np.log(TOXIC_AT / (1 - TOXIC_AT))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The logit at which F1 is highest; between two values, their middle."""
    order = np.argsort(-z, kind="stable")
    hits, n = np.cumsum(y[order]), np.cumsum(n[order])
    f1 = 2 * hits / (n + max(y.sum(), 1))
    f1[:-1][z[order][:-1] == z[order][1:]] = -1
    i = int(f1.argmax())
    return float((z[order][i] + z[order][min(i + 1, len(z) - 1)]) / 2)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows to learn from, stored: doc_id, toxic, lang, tokens, bytes, h, aside."""
    known = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    @lean
    def run(batches):
        tokens = Tokens()
        for batch in batches:
            found = [tokens(t) for t in buffers(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("bytes").cast(pa.int64()), pa.array([g for _, g in found], pa.string()), pa.array([packed(x) for x, _ in found], pa.binary())],
                names=["doc_id", "bytes", "lang", "tokens"],
            )

    texts = docs.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    found = texts.mapInArrow(run, "doc_id long, bytes long, lang string, tokens binary")
    # the words are exchanged and not the texts; by the same plan at every size
    found = found.join(known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).hint("shuffle_hash"), "doc_id")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < F.lit(1_000_000 * CALIBRATION_SHARE)
    return stored(found.select("*", F.xxhash64("doc_id", F.lit(13)).alias("h"), aside.alias("aside")), "toxicity")


def start(rows: DataFrame, total: int, fit_rows: int, fit_bytes: int):
    """Labelled rows in order of a hash, about ``fit_rows`` and at most ``fit_bytes`` of them, by doc_id; whether that is all."""
    if total > fit_rows:
        rows = rows.filter(F.pmod("h", F.lit(1_000_000)) < F.lit(1_000_000.0 * fit_rows / total))
    sizes = rows.groupBy("h").agg(F.sum("bytes").alias("n")).toArrow().sort_by([("h", "ascending")])  # two numbers of each
    fits = sizes.column("h").to_numpy()[np.cumsum(sizes.column("n").to_numpy()) <= fit_bytes]
    got = rows.filter(F.col("h") <= F.lit(int(fits.max()))) if len(fits) else rows.limit(0)
    return got.select("doc_id", "toxic", "lang", "tokens", "aside").toArrow().sort_by([("doc_id", "ascending")]), total <= fit_rows and len(fits) == len(sizes)


def averaged(rows: DataFrame, net: Net, shards: int, share: float) -> np.ndarray:
    """The numbers of ``net`` after one visit to every row: a task for each shard goes on from it, their mean by rows."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def learn(own: pa.Table) -> pa.Table:
        own = own.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        net, shard = Net(), own.column("shard")[0].as_py()
        net.take(shared.value.numbers())  # a worker may learn from several shards
        net.learn([unpacked(x.as_py()) for x in own.column("tokens")], own.column("toxic").to_numpy().astype(np.float64), share, np.random.default_rng((7, shard)))
        pieces = np.array_split(net.numbers(), PIECES)
        return pa.table({
            "piece": pa.array(range(PIECES), pa.int32()), "shard": pa.array([shard] * PIECES, pa.int32()),
            "n": pa.array([len(own)] * PIECES, pa.int64()), "numbers": pa.array([x.astype("<f4").tobytes() for x in pieces], pa.binary()),
        })

    def mean(own: pa.Table) -> pa.Table:
        total, n = 0.0, own.column("n").to_numpy()
        own = own.sort_by([("shard", "ascending")])
        for x, k in zip(own.column("numbers"), own.column("n")):
            total = total + np.frombuffer(x.as_py(), "<f4").astype(np.float64) * k.as_py()
        return pa.table({"piece": own.column("piece")[:1], "numbers": pa.array([(total / n.sum()).tobytes()], pa.binary())})

    dealt = rows.select("doc_id", "toxic", "tokens", F.pmod(F.xxhash64("doc_id", "tokens", F.lit(17)), F.lit(shards)).cast("int").alias("shard"))
    nets = dealt.groupBy("shard").applyInArrow(learn, "piece int, shard int, n long, numbers binary")
    pieces = nets.groupBy("piece").applyInArrow(mean, "piece int, numbers binary").toArrow().sort_by([("piece", "ascending")])  # one net
    return np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in pieces.column("numbers")])


def logits(rows: DataFrame, net: Net) -> pa.Table:
    """Of all rows, by language and logit: n, how many have label 1 (y)."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    @lean
    def run(batches):
        for batch in batches:
            z = [shared.value.logit(unpacked(x.as_py())) for x in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(z, pa.float64())], names=["lang", "toxic", "z"])

    found = rows.select("lang", "toxic", "tokens").mapInArrow(run, "lang string, toxic int, z double")
    z = F.round(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("z"))), 3)  # so many values at most, at every size
    return found.groupBy("lang", z.alias("z")).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("y")).toArrow().sort_by([("lang", "ascending"), ("z", "ascending")])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Net | None:
    """The trained and calibrated net, from labels.toxic of rows that aren't held out; None without both labels, or if
    no byte may be read (``fit_bytes`` 0)."""
    rows = labelled(docs, labels)
    counts = {(r.aside, r.toxic): r for r in rows.groupBy("aside", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()}
    total, size = sum(r.n for r in counts.values()), sum(r.bytes for r in counts.values())
    if fit_bytes <= 0 or len({t for _, t in counts}) < 2:
        return None
    got, every = start(rows, total, fit_rows, fit_bytes)
    texts, y = [unpacked(x.as_py()) for x in got.column("tokens")], got.column("toxic").to_numpy().astype(np.float64)
    aside = np.random.default_rng(3).random(len(y)) < CALIBRATION_SHARE if every else np.array(got.column("aside").to_pylist(), bool)
    few = len(set(y[aside])) < 2 or len(set(y[~aside])) < 2 if every else len(counts) < 4
    if few:
        aside[:] = True  # very few rows: calibrate on those that it is fitted to
    learn = aside if few else ~aside
    net = Net()
    if len(set(y[learn])) == 2:
        net.fit([t for t, x in zip(texts, learn) if x], y[learn])
    if every:
        at = np.flatnonzero(aside)
        net.calibrate(np.array([net.logit(texts[i]) for i in at]), [got.column("lang")[i].as_py() for i in at], y[at], np.ones(len(at)))
    else:
        used, rest = (rows, rows) if few else (rows.filter("not aside"), rows.filter("aside"))
        mine = {t: sum(r.n for (a, u), r in counts.items() if u == t and (few or not a)) for _, t in counts}
        net.take(averaged(used, net, max(1, -(-total // fit_rows), -(-size // fit_bytes)), mine[1] / sum(mine.values())))
        at = logits(rest, net)
        net.calibrate(at.column("z").to_numpy(), at.column("lang").to_pylist(), at.column("y").to_numpy().astype(np.float64), at.column("n").to_numpy().astype(np.float64))
    net.seen = None  # learning is over
    return net


def scores(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 2 * BUCKETS x DIM numbers

    @lean
    def run(batches):
        net, tokens = shared.value, Tokens()
        for batch in batches:
            out = [0.0 if net is None else net.score(*tokens(t)) for t in buffers(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scores(docs, fit(docs, labels, fit_rows))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))

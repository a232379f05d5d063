"""Decontamination, language ID, toxicity."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from pagewise.llm import decontaminate, language_id, toxicity
from tests.conftest import SF01
from tests.llm.cases import frame, odd_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# -- FM-index --------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 60, 2000])
def test_fm_index(n):
    rng = np.random.default_rng(n)
    s = rng.integers(1, 4, n)
    if n > 50:
        s[10:30] = s[30:50]
    if n:
        t = s.tolist()
        assert decontaminate.suffix_array(s).tolist() == sorted(range(n), key=lambda i: t[i:])
    index = decontaminate.FMIndex(s, sample=4)
    for width in (1, 2, 5):
        phrases = rng.integers(1, 6, (30, width))
        got = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(*index.search(phrases))}
        for p in range(30):
            assert got.get(p, []) == [i for i in range(n - width + 1) if s[i : i + width].tolist() == phrases[p].tolist()]


def brute_contamination(rows, items, window):
    phrases = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text, *_ in rows:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if own := phrases.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("how", [{}, {"shard_words": 40, "block_words": 60}])
def test_contamination(spark, how):
    rng = random.Random(3)
    vocab = ["Aa", "b", "Ccc", "d-d", "é", "9", "Ünï", "z"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90))), "en", "a") for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 14)))) for i in range(25)] + [(3, "b, b!"), (None, "z z z"), (40, None), (41, "")]
    rows += [(100 + i, f"q w e {items[i][1]} r t y", "en", "a") for i in range(25)] + odd_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows), bench, window=4, **how).drop("spans").collect()
    want = brute_contamination(rows, items, 4)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, rows), nothing, **how).filter("contaminated").count() == 0
    assert decontaminate.contamination(frame(spark, []), bench, **how).count() == 0


def test_remove_cuts_only_the_spans(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    rows = [(1, "Keep, ONE  two; three\nfour (this) one two", "en", "a"), (2, "one two three four!", "en", "a"), (3, "clean one two", "en", "a"), (4, None, "en", "a")]
    docs = frame(spark, rows)
    got = decontaminate.remove(docs, bench)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "Keep,  (this) one two", 3: "clean one two", 4: None}


# -- language ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocab():
    return language_id.Vocabulary()


def test_forward_sums_all_segmentations(vocab):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=language_id.VOCABULARY)
    pieces = {p: i for i, p in enumerate(p for p in map(sp.id_to_piece, (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))) if 0 < len(p) <= language_id.MAX_PIECE)}
    rng = np.random.default_rng(0)
    probs = np.vstack([rng.random((vocab.size, 3)) / vocab.size, np.zeros((1, 3))])
    words = ["▁the", "▁nation", "▁été", "▁\U0001f600a", "▁"]
    got = np.exp(language_id.forward(vocab, probs, words))
    for w, row in zip(words, got):
        total = np.zeros(3)
        for cut in itertools.product([0, 1], repeat=len(w) - 1):
            parts = [w[a:b] for a, b in itertools.pairwise([0, *[i + 1 for i, c in enumerate(cut) if c], len(w)])]
            ids = [pieces.get(p, vocab.unknown if len(p) == 1 else vocab.none) for p in parts]
            total += np.prod(probs[ids], axis=0)
        assert np.allclose(row, total, rtol=1e-9)


def test_expected_counts_agree_with_likelihood(vocab):
    probs = np.vstack([np.full((vocab.size, 2), 1 / vocab.size), np.zeros((1, 2))])
    got = language_id.expected(vocab, probs, ["▁the", "▁hello"], np.array([0, 1]), np.array([2.0, 3.0]))
    h = 1e-6  # the derivative of the log-likelihood by log p is the expected count
    at = int(got[:, 1].argmax())
    more = probs.copy()
    more[at, 1] *= 1 + h
    diff = (language_id.forward(vocab, more, ["▁hello"])[0, 1] - language_id.forward(vocab, probs, ["▁hello"])[0, 1]) / h
    assert abs(3 * diff - got[at, 1]) < 1e-4 and got[:, 0].sum() > 0


LONG = ["▁" + "qxz" * 70, "▁" + "\u4e2d\u6587\u5b57" * 25, "▁Donaudampfschifffahrtsgesellschaftskapitän" * 3, "▁" + "a" * 65]


def exact_sums(vocab, probs, word):
    """log of the sum over all segmentations and the expected counts of pieces, in fractions: nothing is rounded or runs out."""
    from fractions import Fraction

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=language_id.VOCABULARY)
    keep = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    pieces = {p: i for i, p in enumerate(p for p in map(sp.id_to_piece, keep) if 0 < len(p) <= language_id.MAX_PIECE)}
    n = len(word)
    arcs = [(a, b, pieces.get(word[a:b], vocab.unknown if b == a + 1 else None)) for b in range(1, n + 1) for a in range(max(0, b - 16), b)]
    arcs = [(a, b, i, Fraction(float(probs[i]))) for a, b, i in arcs if i is not None]
    alpha, beta = [Fraction(1)] + [Fraction(0)] * n, [Fraction(0)] * n + [Fraction(1)]
    for a, b, _, p in arcs:
        alpha[b] += alpha[a] * p
    for a, b, _, p in sorted(arcs, key=lambda x: -x[1]):
        beta[a] += p * beta[b]
    counts = {}
    for a, b, i, p in arcs:
        counts[i] = counts.get(i, 0) + float(alpha[a] * p * beta[b] / alpha[n])
    log = lambda x: math.log(x.numerator) - math.log(x.denominator)
    return log(alpha[n]), counts


@pytest.mark.parametrize("chunk, few", [(2048, 8), (2048, 0), (7, 8), (16, 0)])
def test_long_words_are_neither_cut_nor_clamped(vocab, monkeypatch, chunk, few):
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    monkeypatch.setattr(language_id, "FEW", few)
    rng = np.random.default_rng(1)
    probs = np.vstack([rng.random((vocab.size, 3)) ** 4 / vocab.size + 1e-12, np.zeros((1, 3))])
    got = language_id.forward(vocab, probs, LONG)
    for w, row in zip(LONG, got):
        want = [exact_sums(vocab, probs[:, k], w) for k in range(3)]
        assert np.allclose(row, [x[0] for x in want], rtol=1e-10, atol=1e-8) and len(set(row.tolist())) == 3
        counts = language_id.expected(vocab, probs, [w], np.array([1]), np.array([1.0]))
        full = np.zeros(vocab.size)
        for i, x in want[1][1].items():
            full[i] = x
        assert np.allclose(counts[:, 1], full, atol=1e-8) and not counts[:, [0, 2]].any()
    assert got.min() < -744  # exp of it is no number


def test_text_without_a_letter(spark):
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(["²", "½ 12", "x²", "٣ 7 __", "◌́ \u0301", "ª", "語", "words of a text that has letters"] * 3)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert [got[i][0] for i in range(8)] == ["und", "und", "en", "und", "und", "en", "en", "en"]
    assert [got[i][1] for i in (0, 1, 3, 4)] == [0.0] * 4


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = language_id.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.97 and got.score.between(0, 1).all()


def test_language_odd_rows(spark):
    rows = odd_rows()
    got = language_id.identify(frame(spark, rows))
    assert got.count() == len(rows)
    assert {r.doc_id for r in got.filter("lang_pred = 'und'").collect()} == {1, 2, 3, 4, None}
    assert got.filter("lang_pred = 'und' and score <> 0").count() == 0
    kept = language_id.known_language(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.filter("doc_id < 5").count() == 0
    assert language_id.identify(frame(spark, [])).count() == 0
    unlabelled = frame(spark, [(1, "some words", None, "a")])
    assert [tuple(r)[1:] for r in language_id.identify(unlabelled).collect()] == [(zlib.crc32(b"1") % 3 == 1, "und", 0.0)]


# -- toxicity -----------------------------------------------------------------------


def planted(n=900, seed=2):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)] + "the of and".split()
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["scum,", "vileix", "vileor***"]))
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = planted()
    lab = spark.createDataFrame(labels + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(spark, rows), lab).toPandas().merge(pd.DataFrame(labels, columns=["doc_id", "q", "toxic"]), on="doc_id")
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.97 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()


def test_toxicity_odd_rows(spark):
    rows = odd_rows()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(frame(spark, rows), none).collect()} == {0.0}
    rows2, labels = planted(60)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(spark, rows + [(1000 + i, t, a, b) for i, t, a, b in rows2]), lab)
    assert got.count() == len(rows) + 60
    blank = {r.score for r in got.filter("doc_id in (1, 2, 3)").collect()}
    assert len(blank) == 1
    assert toxicity.toxicity(frame(spark, []), lab).count() == 0


def test_long_text_in_parts_scores_alike():
    net, tokens = toxicity.Net(), toxicity.Tokens()
    t, _ = tokens((" ".join(f"w{i}" for i in range(500)) + " scum").encode())
    assert abs(net.logit(t) - net.logit(t, block=64)) < 1e-5


def test_gradients_against_finite_differences(monkeypatch):
    """Every kind of parameter, in double precision, on texts with repeated words, one word and none."""
    net, tokens = toxicity.Net(), toxicity.Tokens()
    net.table = net.table.astype(np.float64)
    net.filters, net.bias, net.out = [f.astype(np.float64) for f in net.filters], [b.astype(np.float64) + 0.05 for b in net.bias], net.out.astype(np.float64)
    net.rest = np.float64(net.rest)

    def loss(t, y, w):
        z = net.logit(t)
        return w * (np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z)))

    rng = np.random.default_rng(0)
    for text, y in [("one two one three two two four", 1), ("five six seven eight nine ten", 0), ("word", 1), ("", 0)]:
        t, _ = tokens(text.encode())
        dense, free, (rows, steps) = net.gradient(t, y, 1.7)
        params = [*net.filters, *net.bias, net.out]
        table = np.zeros_like(net.table)
        np.add.at(table, rows, steps)
        table[-1] = 0  # padding stays zero
        for p, g in [*zip(params, dense), (net.table, table)]:
            where = [np.unravel_index(i, p.shape) for i in rng.integers(0, p.size, 8)]
            if p is net.table:
                where = [(int(r), int(rng.integers(0, toxicity.DIM))) for r in np.unique(rows) if r != 2 * toxicity.BUCKETS]
            for at in where:
                old, h = p[at], 1e-6
                p[at] = old + h
                up = loss(t, y, 1.7)
                p[at] = old - h
                down = loss(t, y, 1.7)
                p[at] = old
                assert abs((up - down) / (2 * h) - g[at]) < 1e-5, (text, at)
        net.rest += 1e-6
        up = loss(t, y, 1.7)
        net.rest -= 2e-6
        assert abs((up - loss(t, y, 1.7)) / 2e-6 - free) < 1e-5
        net.rest += 1e-6


def test_pooling_against_plain_loops():
    net, tokens = toxicity.Net(), toxicity.Tokens()
    t, _ = tokens(b"a bb ccc a dddd bb eeeee")
    vectors = [net.table[int(x) >> 32] + net.table[int(x) & 0xFFFFFFFF] for x in t] + [np.zeros(toxicity.DIM)] * (toxicity.PAD + 1)
    want = []
    for width, f, b in zip(toxicity.WIDTHS, net.filters, net.bias):
        for k in range(toxicity.FILTERS):
            want.append(max(sum(float(vectors[i + j] @ f[j][:, k]) for j in range(width)) + b[k] for i in range(len(vectors) - toxicity.PAD)))
    assert np.allclose(net.pooled(t)[3], want, atol=1e-5)


def test_sample_is_bounded_by_bytes(spark):
    rows, labels = planted(300)
    rows += [(5000 + i, "long " * 40_000, "en", "a") for i in range(3)]
    lab = spark.createDataFrame(labels + [(5000 + i, 0, 1) for i in range(3)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    seen = []
    fitted = toxicity.Net.fit

    def fit(self, texts, *more):
        seen.append(sum(map(len, texts)))
        return fitted(self, texts, *more, visits=100)

    toxicity.Net.fit = fit
    try:
        toxicity.fit(docs, lab, fit_bytes=60_000)
        assert toxicity.fit(docs, lab, fit_bytes=0) is None
    finally:
        toxicity.Net.fit = fitted
    assert seen and seen[0] < 60_000 / 2


def test_learns_from_rows_beyond_the_start(spark):
    """Label 1 stands only on rows that the start doesn't hold; the net knows it all the same, and reruns agree."""
    rows, labels = planted(900)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    all_rows = toxicity.labelled(frame(spark, rows), lab)
    first = set(toxicity.start(all_rows, all_rows.count(), 60, 1 << 20)[0].column("doc_id").to_pylist())
    keep = [x for x in labels if x[2] == 0 or x[0] not in first]
    lab = spark.createDataFrame(keep, "doc_id long, quality int, toxic int")
    docs = frame(spark, [r for r in rows if r[0] in {x[0] for x in keep}])
    got = toxicity.toxicity(docs, lab, fit_rows=60).toPandas().merge(pd.DataFrame(keep, columns=["doc_id", "q", "toxic"]), on="doc_id")
    assert got[got.toxic == 1].score.mean() > got[got.toxic == 0].score.mean()
    again = toxicity.toxicity(docs, lab, fit_rows=60).toPandas()
    assert got.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()


def test_every_labelled_row_is_learnt_and_counted(spark):
    rows, labels = planted(300)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    all_rows = toxicity.labelled(frame(spark, rows), lab)
    assert sorted(r.doc_id for r in all_rows.collect()) == known
    net = toxicity.Net()
    counted = toxicity.logits(all_rows, net).to_pandas()
    assert counted.n.sum() == len(known) and counted.y.sum() == sum(t for i, _, t in labels if i in set(known))
    before = net.numbers()
    shards = toxicity.averaged(all_rows, net, 4, 0.3)
    words = {int(w) >> 32 for r in all_rows.collect() for w in toxicity.unpacked(r.tokens)}
    moved = (shards[2 : 2 + net.table.size] != before[2 : 2 + net.table.size]).reshape(net.table.shape).any(axis=1)
    assert moved[sorted(words)].mean() > 0.9 and not moved[-1]
    text, _ = toxicity.Tokens()("the Word word, été".encode())
    assert toxicity.unpacked(toxicity.packed(text)).tolist() == text.tolist()

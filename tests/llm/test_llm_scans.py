"""License scans, filter interaction audit, spelling variants."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewise.llm import filter_audit, license_scan, spelling
from tests.llm.cases import frame, odd_rows

lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")

# -- licences -------------------------------------------------------------------------


def brute_licences(rows):
    """The rules of the module written as loops over every place: no index, no anchors but for the votes."""
    words = [TERM.findall(lower(t)) for _, t, *_ in rows]
    df = Counter(w for own in words for w in set(own))
    weight = {w: math.log((1 + len(rows)) / (1 + df[w])) for w in license_scan.licence_words()}
    rare = lambda text: sorted(range(len(text)), key=lambda i: (-weight[text[i]], i))[: license_scan.ANCHORS]
    out = []
    for (doc, *_), w in zip(rows, words):
        at = lambda i: w[i] if 0 <= i < len(w) else None
        base = [(label, s) for label, p in license_scan.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        labels, best = {x for x, _ in base}, 1.0 if base else 0.0
        for label, text, must in license_scan.NOTICES:
            text = text.split()
            keys = rare(text)
            for s in range(-len(text), len(w)):
                if sum(at(s + i) == text[i] for i in keys) < math.ceil(len(keys) / 2):
                    continue
                window = w[max(s - license_scan.SLACK, 0) : min(s + len(text) + license_scan.SLACK, len(w))]
                if all(any(window[i : i + len(k.split())] == k.split() for i in range(len(window))) for k in must):
                    labels.add(label)
                    whole = sum(weight[x] for x in text)
                    best = max(best, round(sum(weight[x] for i, x in enumerate(text) if at(s + i) == x) / whole, 6) if whole else 0.0)
        starts = [s for _, s in base]
        out.append((doc, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), best))
    return out


def licence_rows(seed=4):
    rng = random.Random(seed)
    vocab = "the a of under by license version mit nc cc apache 2 rights public use this w1 w2 w3 w4 ünder".split()
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = odd_rows()
    for i in range(60):
        label, text, _ = rng.choice(license_scan.NOTICES)
        words = text.split()
        if i % 3 == 1:
            words.insert(rng.randrange(len(words)), "extra")
        if i % 3 == 2:
            words = words[rng.randrange(3) :]
        rows.append((1000 + i, f"{some(rng.randint(0, 30))}\n{' '.join(words).title()}. {some(rng.randint(0, 30))}", "en", "a"))
    rows += [(2000 + i, some(rng.randint(0, 300)), "de", "b") for i in range(60)]
    rows += [
        (3000, "Under THE mit-License, under the MIT license", "en", "a"), (3001, "cc by nc by nc cc by-nc", "en", "a"), (3002, "CC BY", "en", "a"),
        (3003, "apache license version 2 " * 3000, "en", "a"), (3004, "under the mit licensee éunder the mit license", "en", "a"),
        (3005, "public license GNU general, version 3", "en", "a"), (None, "All rights reserved.", None, None), (3000, "all rights (reserved)", "en", "a"),
    ]
    return rows


def test_licences(spark):
    rows = licence_rows()
    got = [tuple(r)[:8] for r in license_scan.scan(frame(spark, rows)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute_licences(rows), key=key)
    by = {r[0]: r for r in got if r[0] is not None and r[0] > 3000}
    assert by[3001][2:6] == (2, 0, 5, "cc-by-nc") and by[3003][2] == 3000 and by[3004][2] == 0 and by[3005][6] == ""


def test_licence_spans_and_odd_tables(spark):
    one = license_scan.scan(frame(spark, [(1, "so: all rights reserved, under the mit license", "en", "a")])).first()
    assert sorted((s.label, s.base, s.start, s.end) for s in one.spans) == [("mit", True, 4, 8), ("reserved", False, 1, 4)]
    assert (one.base_labels, one.labels) == ("mit", "mit,reserved")
    assert license_scan.scan(frame(spark, [])).count() == 0
    empty = license_scan.scan(frame(spark, [(1, None, None, None), (1, "", None, None)])).collect()
    assert [tuple(r) for r in empty] == [(1, 0, 0, None, None, "", "", 0.0, [])] * 2


def test_licence_scan_stays_in_the_jvm_and_moves_no_text(spark):
    plan = license_scan.scan(frame(spark, licence_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# -- filter audit -----------------------------------------------------------------------


def brute_audit(rows, labels):
    text = [(d, t or "", lang or "") for d, t, lang, *_ in rows]
    least = {}
    for d, t, _ in text:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    marks = lambda k: {x[0] for x in labels if x[0] is not None and x[k] == 1}
    good, toxic = marks(1), marks(2)
    docs = []
    for d, t, part in text:
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d,
        }
        docs.append((part, fails, d in good, d in toxic))
    out, shapley = [], Counter()
    for part in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[part, f] += len(gone)
                fails = sum(x[1][f] for x in own)
                alone = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                out.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), alone, sum(x[2] for x in gone), sum(x[3] for x in gone)))
    return {r[:3]: (*r[3:], shapley[r[0], r[1][r[2] - 1]]) for r in out}


def test_filter_audit(spark):
    rng = random.Random(7)
    rows = odd_rows()
    for i in range(300):
        w = [rng.choice(["Ab", "CD", "e", "f#", "ü", "x|"]) + str(rng.randint(0, 60 if i % 2 else 5000)) for _ in range(rng.choice([3, 99, 100, 130]))]
        rows.append((rng.randint(500, 900), " ".join(w), rng.choice(["en", "de", None, ""]), "a"))
    rows += [(950 + i % 20, rows[-1 - i % 7][1], rng.choice(["en", "de"]), "b") for i in range(80)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 980, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(frame(spark, rows), lab).collect()
    assert len(got) == len({r.part for r in got}) * 600
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute_audit(rows, labels)
    assert filter_audit.interactions(frame(spark, []), lab).count() == 0


def test_filter_audit_of_copies_and_one_id(spark):
    """A third of the rows is one text, a third one id."""
    rows = [(i, "same text", "en", "a") for i in range(300)] + [(7, f"text {i % 9}", "en", "a") for i in range(300)] + [(None, "same text", None, "a")] * 300
    none = spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.interactions(frame(spark, rows), none).collect()}
    assert got == brute_audit(rows, [(7, 1, 1)])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 9)), max_size=12))
def test_tensor_and_efficiency_of_shapley(cells):
    mask, n = np.array([m for m, _ in cells], int), np.array([k for _, k in cells], int)
    rows = filter_audit.audit(filter_audit.tensor(mask, np.array([n, n, n])))
    alive = sum(k for m, k in cells if m == 0)
    assert {r[2] for r in rows if r[1] == 5} == {alive}
    values = {r[0][r[1] - 1]: r[8] for r in rows}
    assert sum(values.values()) == 120 * (sum(k for _, k in cells) - alive)  # every removed document is shared out among the filters


# -- spelling ---------------------------------------------------------------------------


def brute_words(rows):
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out, form = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(own))
    rows = set()
    for w, (k, count) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, k, count, n[form[w]] if form[w] else None))
    return rows


def spelling_rows(seed):
    rng = random.Random(seed)
    letters = "abcdéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa"]
    words = []
    for w in base:
        k = rng.choice([3, 6, 13, 40])
        words += [w] * k
        for _ in range(6):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])] * rng.choice([1, 2, 3, 3, 6])
    words += ["chainsaw"] * 3 + ["chainsa"] * 7 + ["chains"] * 20
    rng.shuffle(words)
    rows = odd_rows(seed)
    rows += [(5000 + i, rng.choice([" ", "1", "—"]).join(rng.choice([w, w.title()]) for w in words[i::40]), "en", "a") for i in range(40)]
    long = "z" * 70_000
    rows += [(7000, f"{long} {long} {long}\n{long}y {long}y {long}y", "en", "a"), (None, "naïve naïve Naïve", "fr", None)]
    return rows


@pytest.mark.parametrize("slice_chars", [1 << 14, 60])
def test_spelling(spark, slice_chars):
    rows = spelling_rows(3)
    got = spelling.variants(frame(spark, rows), slice_chars).collect()
    want = brute_variants(brute_words(rows))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r[2] != r[1] and r[1] for r in want)  # some form has a form of its own
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None, None, None), (2, "", None, None)])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("ab", min_size=3, max_size=4), min_size=1, max_size=40))
def test_slice_finds_all_near_pairs(words):
    words = sorted(words)
    q, w = spelling.Slice(words, 3).near()
    got = Counter(zip(q.tolist(), w.tolist()))
    want = Counter((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b) and (len(a), len(b)) != (4, 4))
    assert got == want


def test_chains_of_forms(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [(f"x{i}", "w3") for i in range(50)]
    got = {r.word: r.root for r in spelling.followed(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w20" for w, _ in links}


def test_hot_half_is_dealt_to_blocks(spark):
    """Most words share their first half: no slice holds them all, and no pair is lost."""
    rng = random.Random(2)
    n = {f"prefixed{''.join(rng.choice('abc') for _ in range(8))}": rng.choice([3, 9]) for _ in range(300)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    best = {r.word: r.n_near for r in spelling.near_words(words, 400).collect()}
    want = {w: k for w in n if (k := sum(near(w, x) for x in n))}
    assert best == want

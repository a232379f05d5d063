"""Exact dedup, SimHash, line dedup, substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewise.llm import exact_dedup, graph, line_dedup, simhash, substring_dedup
from tests.llm.cases import frame, odd_rows

WS = re.compile("[\x20\x09-\x0d]")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
order = lambda i: (i is None, i)


# -- exact ---------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_groups(spark, bits):
    rows = odd_rows()
    rows += [(300, rows[12][1].replace(" ", "\n"), "de", "c"), (301, rows[12][1] + "  ", "de", "c")]
    got = exact_dedup.exact_duplicates(frame(spark, rows), bits).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[WS.sub("", t or "")].append((i, t or ""))
    want = []
    for norm, members in groups.items():
        keep_id, keep = min(members, key=lambda m: (-len(m[1]), order(m[0])))
        first = True
        for i, t in members:
            kept = first and i == keep_id and len(t) == len(keep)
            first = first and not kept
            want.append((i, keep_id, len(members), kept, sha(norm)))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == Counter(want)
    assert exact_dedup.exact_duplicates(frame(spark, []), bits).count() == 0


def test_chunks_are_content_defined():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 60_000).astype(np.uint8).tobytes()
    one, two = list(exact_dedup._chunks(body)), list(exact_dedup._chunks(b"head" * 40 + body))
    assert b"".join(one) == body and max(map(len, one)) <= exact_dedup.MAX_CHUNK
    assert len(set(one) & set(two)) > 0.8 * len(one)  # a shift changes the first chunks only
    assert exact_dedup.cuts(b"") == [] and list(exact_dedup._chunks(b"abc")) == [b"abc"]


# -- simhash -------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(grams))


def brute_components(nodes, linked):
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def test_simhash_components(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    comp = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c), key=order) for c in set(comp)}
    want = Counter((r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, comp))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    stay = simhash.representatives(frame(spark, rows))
    assert stay.columns == frame(spark, rows).columns
    assert Counter(r.doc_id for r in stay.collect()) == Counter(least.values())
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.representatives(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [2, 1000])
@pytest.mark.parametrize("k", [1, 2])
def test_links_find_every_component(spark, k, hot):
    rng = random.Random(k)
    fps = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(15):
            fp = center
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                fp ^= 1 << bit
            fps.add(fp)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.a: r.b for r in graph.components(simhash.links(df, k, hot)).collect()}
    comp = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= k)
    groups = defaultdict(set)
    for f, c in zip(fps, comp):
        groups[c].add(signed(f))
    for g in groups.values():
        assert {got.get(f, f) for f in g} == {min(g)}


# -- lines ---------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_aligns_in_order(a, b):
    got = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    if a == b:
        assert got == [(i, i) for i in range(len(a))]


def test_patience_prefers_unique_lines():
    assert line_dedup.patience(list("axbxc"), list("abxc")) == [(0, 0), (2, 1), (3, 2), (4, 3)]
    assert line_dedup.blocks(list("axbxc"), list("abxc"), [9] * 4, 20) == [(1, 4)]


def test_line_dedup(spark):
    line = lambda x: f"{x} is a line that is long enough"
    own = lambda d, n: [line(f"{d}/{i}") for i in range(n)]
    block = [line(f"shared {i}") for i in range(4)]
    rows = [
        (1, "\n".join(own(1, 2) + block + own("1b", 2)), None, None),
        (2, "\n".join(own(2, 3) + block[1:3] + own("2b", 1)), None, None),
        (3, "\n".join(own(3, 3)), None, None),
        (4, "\n".join(own(3, 3)), None, None),  # a copy of 3
        (5, "\n".join([*own(5, 1), "short", *block, "short"]), None, None),
        (6, None, None, None), (7, "", None, None), (None, "\n".join([*own("n", 2), *block]), None, None),
    ]
    rows += [(100 + i, "\n".join([*own("near", 5), line(f"tail {i}")]), None, None) for i in range(90)]  # no rare shared line
    got = {r.doc_id: r for r in line_dedup.deduplicated(frame(spark, rows), rare=8).collect()}
    kept = {
        1: rows[0][1], 2: "\n".join(own(2, 3) + own("2b", 1)), 3: rows[2][1], 4: "", 5: "\n".join([*own(5, 1), "short", "short"]),
        6: "", 7: "", None: "\n".join(own("n", 2)), 100: rows[8][1],
    } | {100 + i: line(f"tail {i}") for i in range(1, 90)}
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: sha(t) for i, t in kept.items()}
    assert (got[2].n_lines, got[2].n_removed, got[4].n_removed, got[150].n_removed, got[6].n_lines) == (6, 2, 3, 5, 0)
    odd = odd_rows()
    assert line_dedup.deduplicated(frame(spark, odd)).count() == len(odd)
    assert line_dedup.deduplicated(frame(spark, [])).count() == 0


def brute_lines(rows):
    """Kept text by id: each text is aligned with the first holder of every line of 20 characters that stands once in both; ids and texts differ."""
    texts = [(i, t.split("\n")) for i, t, *_ in sorted(rows, key=lambda r: order(r[0]))]
    anchors = [{x for x, n in Counter(lines).items() if n == 1 and len(x) >= 20} for _, lines in texts]
    out = {}
    for n, (i, lines) in enumerate(texts):
        firsts = {next(m for m in range(n + 1) if a in anchors[m]) for a in anchors[n]} - {n}
        gone = {j for m in firsts for s, e in line_dedup.blocks(texts[m][1], lines, [len(x) for x in lines]) for j in range(s, e)}
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


@pytest.mark.parametrize("rare", [1, 4, 64])
def test_line_dedup_of_popular_lines(spark, rare):
    line = lambda x: f"{x} is a line that is long enough"
    popular = [[line(f"popular {p}/{i}") for i in range(3)] for p in range(3)]
    rows = [(i, "\n".join([line(f"{i}/0"), *popular[i], line(f"{i}/1")]), None, None) for i in range(3)]
    for i in range(10, 100):  # all passages are popular, most texts have a rare shared line as well
        body = [x for p in popular[: 1 + i % 3] for x in p] + [line(f"pair {i // 2}")] * (i % 5 > 0) + [line(f"{i}/0")]
        rows.append((i, "\n".join(body), None, None))
    got = {r.doc_id: r.kept_sha256 for r in line_dedup.deduplicated(frame(spark, rows), rare=rare).collect()}
    want = brute_lines(rows)
    assert want[12] == "\n".join([line("pair 6"), line("12/0")]) and "popular" not in "".join(want[i] for i in range(10, 100))
    assert got == {i: sha(t) for i, t in want.items()}


def all_pairs(rows):
    """Lines that aligning every text with every earlier one deletes: patience of its own, every pair of texts."""

    def lis(pairs):
        best = [[p] for p in pairs]
        for n, p in enumerate(pairs):
            for m in range(n):
                if pairs[m][1] < p[1] and len(best[m]) + 1 > len(best[n]):
                    best[n] = [*best[m], p]
        return max(best, key=len, default=[])

    def align(a, b, i0, j0):
        if not a or not b:
            return []
        if a[0] == b[0]:
            return [(i0, j0), *align(a[1:], b[1:], i0 + 1, j0 + 1)]
        if a[-1] == b[-1]:
            return [*align(a[:-1], b[:-1], i0, j0), (i0 + len(a) - 1, j0 + len(b) - 1)]
        once = {x for x in a if a.count(x) == 1 and b.count(x) == 1}
        spine = lis([(i, b.index(x)) for i, x in enumerate(a) if x in once])
        if not spine:
            return []
        out, i, j = [], 0, 0
        for x, y in [*spine, (len(a), len(b))]:
            out += align(a[i:x], b[j:y], i0 + i, j0 + j) + [(i0 + x, j0 + y)] * (x < len(a))
            i, j = x + 1, y + 1
        return out

    texts = [(i, t.split("\n")) for i, t, *_ in sorted(rows, key=lambda r: order(r[0]))]
    out = {}
    for n, (doc, lines) in enumerate(texts):
        gone = set()
        for _, other in texts[:n]:
            if other == lines:
                gone |= set(range(len(lines)))
            block = []
            for i, j in [*align(other, lines, 0, 0), (None, None)]:
                if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                    if sum(len(lines[k]) for _, k in block) >= 20:
                        gone |= {k for _, k in block}
                    block = []
                block.append((i, j))
        out[doc] = gone
    return out


@pytest.mark.parametrize("slices", [1, 7, 256])
def test_first_holders_whatever_the_slices(spark, slices):
    rng = random.Random(4)
    texts = {(i, rng.randrange(3)): {0} | set(rng.sample(range(1, 60), rng.randrange(5))) for i in range(120)}  # all hold line 0
    texts |= {(120, 0): {99}, (121, 0): set(), (line_dedup.LAST, 1): {0, 5}, (line_dedup.LAST, 2): {0, 98}, (line_dedup.LAST, 3): {98}}
    first = {}
    for t, anchors in sorted(texts.items()):
        for a in anchors:
            first.setdefault(a, t)
    want = {(*t, a, *first[a]) for t, anchors in texts.items() for a in anchors if t[0] > first[a][0]}
    frame_ = spark.createDataFrame([(*t, sorted(a)) for t, a in texts.items()], "id long, key long, anchors array<long>")
    got = [tuple(r) for r in line_dedup.shared_anchors(frame_, slices).collect()]
    assert len(got) == len(want) and set(got) == want


def test_line_dedup_of_crossing_holders(spark):
    """What the first holder has in another order goes with a later holder that has it in this one."""
    a, b, c, d = (f"line {x} is a line that is long enough" for x in "abcd")
    x = [f"line {i} stands in one text and is long" for i in range(9)]
    rows = [(i, "\n".join(t), None, None) for i, t in enumerate([[a, x[0], b], [b, a, x[1]], [b, a, x[2]], [c, a, x[3], d, b], [d, c, x[4]], [a, d, x[5], c], [x[6], b, a, d, c, x[7]]])]
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicated(frame(spark, rows)).collect()}
    want = all_pairs(rows)
    assert got == {i: len(g) for i, g in want.items()} and got[2] == 2


def test_line_dedup_recall_against_all_pairs(spark):
    """Shared passages, shuffled, cut and repeated, in many texts."""
    rng = random.Random(11)
    passages = [[f"passage {p} line {i} of some length" for i in range(rng.randint(1, 6))] for p in range(12)]
    rows = []
    for n in range(90):
        lines = [f"own {n} {i} a line of its own" for i in range(3)]
        for p in rng.sample(passages, rng.randint(1, 4)):
            part = p[rng.randrange(len(p)) :]
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.sample(part, len(part)) if rng.random() < 0.3 else part
        rows.append((n, "\n".join(lines), None, None))
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicated(frame(spark, rows)).collect()}
    want = all_pairs(rows)
    # which of two equally long orders an alignment keeps is open, so single texts may differ either way
    assert sum(got.values()) >= 0.95 * sum(map(len, want.values()))


def test_line_dedup_of_short_and_repeated_lines(spark):
    line = lambda x: f"{x} is a line that is long enough"
    verse = ["roses are", "", "red", "violets", "blue"]
    twice = [line("x"), line("y")] * 2
    rows = [
        (1, "\n".join([line(1), *verse, line(10)]), None, None), (2, "\n".join([line(2), "head", *verse, line(20)]), None, None),
        (3, "\n".join([*twice, line(3)]), None, None), (4, "\n".join([*twice, line(4)]), None, None),
        (5, "\n".join([*twice[:2], line(5)]), None, None), (6, "\n".join([line(6), "blue", "red", "roses are"]), None, None),
    ]
    got = {r.doc_id: r.kept_sha256 for r in line_dedup.deduplicated(frame(spark, rows)).collect()}
    kept = {1: rows[0][1], 2: "\n".join([line(2), "head", line(20)]), 3: rows[2][1], 4: line(4), 5: line(5), 6: rows[5][1]}
    assert got == {i: sha(t) for i, t in kept.items()}


def test_texts_of_null_ids_are_cut_by_their_key(spark):
    rows = odd_rows() + [(None, f"text {i} é\U0001f600", None, None) for i in range(40)]
    docs = frame(spark, rows)
    base = line_dedup.measured(docs).select("id", "key")
    gone = base.distinct().selectExpr("id", "key", "array(0) as gone")
    found = Counter((r.id, r.key) for r in line_dedup.to_cut(docs, gone).collect())
    assert found == Counter(map(tuple, base.collect())) and sum(found.values()) == len(rows)  # each row meets its own text alone


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9), st.lists(st.integers(0, 9), max_size=9), st.lists(st.integers(0, 9), min_size=1, max_size=9))
def test_a_common_block_gives_a_common_anchor(head, tail, block):
    size = lambda lines: [3 * x for x in lines]
    one, two = head + block + tail, tail + block + head
    if sum(size(block)) >= 20:
        assert set(line_dedup.anchors_of(one, size(one))) & set(line_dedup.anchors_of(two, size(two)))


# -- substrings ------------------------------------------------------------------


def brute_removed(rows, window):
    first = {}
    words = [(i, (t or "").split()) for i, t, *_ in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            p = tuple(w[s : s + window])
            first[p] = min(first.get(p, i), i, key=order)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            f = first[tuple(w[s : s + window])]
            if f != i and order(f) < order(i):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone))))
    return Counter(out)


@pytest.mark.parametrize("window", [1, 4, 50])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    rows = odd_rows(window) if window == 50 else []
    for i in range(80):
        n = rng.randint(0, 40)
        rows.append((1000 + i, " ".join(rng.choice("abcdefgh") if window == 4 else f"{rng.randint(0, 300)}" for _ in range(n)), "en", "a"))
    passage = " ".join(f"p{i}" for i in range(90))
    rows += [(2000 + i, f"{i} a {passage} b {i} {passage[: rng.randint(0, 300)]}", "en", "a") for i in range(25)]
    got = substring_dedup.removed(frame(spark, rows), window, shard_words=200, block_words=300).collect()
    assert Counter(tuple(r) for r in got) == brute_removed(rows, window)
    assert substring_dedup.removed(frame(spark, []), window).count() == 0


def test_substring_dedup_of_many_null_ids(spark):
    """Texts without an id meet their own windows only: joined rows grow with them, not with their square."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage, "en", "a")] + [(None, f"{i} " + passage + f" {rng.random()}", "en", "a") for i in range(400)] + [(None, "same " + passage, "en", "a")] * 200
    docs = frame(spark, rows)
    got = substring_dedup.removed(docs, 50).collect()
    assert Counter(tuple(r) for r in got) == brute_removed(rows, 50)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=4), st.lists(st.integers(0, 2), max_size=12), st.integers(1, 4))
def test_automaton(refs, asked, window):
    auto = substring_dedup.Automaton()
    for doc, words in enumerate(refs):
        auto.add(words, doc)
    auto.close()
    want = {}
    for s in range(len(asked) - window + 1):
        own = [d for d, w in enumerate(refs) if any(w[i : i + window] == asked[s : s + window] for i in range(len(w)))]
        if own:
            want[s] = min(own)
    assert dict(auto.matches(asked, window)) == want

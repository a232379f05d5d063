"""Sharding, mixing, URL filters, the pipeline and the registered queries."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pagewise.llm import decontaminate, mixing, sharding, url_filter
from pagewise.llm.queries import ORACLE, QUERIES
from tests.conftest import SF001
from tests.llm.cases import CLASHING, DOCS, frame, odd_rows
from tests.parity import compare, duck

# -- registration ---------------------------------------------------------------------


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
    assert not any(n.startswith("op") or n == "pipeline" for n in __import__("pagewise.plans.registry", fromlist=["QUERIES"]).QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    r = compare(spark, name, SF001, duck(SF001))
    assert r["values_match"] and r["types_match"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_one_row_for_each_input_row(spark, name):
    rows = spark.read.parquet(f"{SF001}/{'pages' if name.startswith('op5') else 'documents'}.parquet").count()
    assert QUERIES[name](spark, SF001).count() == rows


# -- sharding ---------------------------------------------------------------------------


def check_shards(got, rows, n, most):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(n))
    total = sum(r.size for r in got)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / n) <= most


def test_shards_are_even(spark):
    rng = random.Random(5)
    rows = [(i, "hot text" if i % 3 == 0 else "x" * rng.randint(0, 400) + str(rng.randint(0, 2)), "en", "a") for i in range(3000)]
    rows += [(i % 7, f"text {i % 7}", "en", "a") for i in range(50)] + [(None, None, None, None), (None, "", None, None)]
    got = sharding.shard(frame(spark, rows), 8).collect()
    largest = max(r.size for r in got)
    check_shards(got, rows, 8, 2 * largest)
    groups = defaultdict(list)
    for r in got:
        groups[r.text_crc32].append(r)
    cut = [g for g in groups.values() if len({r.shard for r in g}) > 1]
    assert cut and all(sum(r.size for r in g) > largest for g in cut)  # smaller groups share a shard
    assert Counter(map(tuple, got)) == Counter(map(tuple, sharding.shard(frame(spark, rows), 8).collect()))


def test_very_many_rows_of_one_text_and_no_id(spark):
    """Half of the rows agree in everything: no range, which is a window's group, holds them all."""
    rows = [(None, "one text of all", "en", "a")] * 20_000 + [(i, f"text {i}", "en", "a") for i in range(20_000)]
    docs = frame(spark, rows, clash=False)
    rec = spark.createDataFrame(sharding.records(docs).collect())
    totals = sharding._totals(sharding.ranged(rec, sharding.splitters(rec, 64)))
    assert max(n for _, _, n in totals) <= 4 * 40_000 / 64
    check_shards(sharding.shard(docs, 8).collect(), rows, 8, 40)


def test_shards_odd_tables(spark):
    rows = odd_rows()
    check_shards(sharding.shard(frame(spark, rows), 4).collect(), rows, 4, 1e9)
    assert sharding.shard(frame(spark, []), 4).count() == 0
    check_shards(sharding.shard(frame(spark, [(1, "same", None, None)] * 40), 4).collect(), [(1, "same")] * 40, 4, 10)


def test_overfull_ranges_are_subdivided(spark):
    rows = [(i, "hot" if i % 2 else f"t{i}", None, None) for i in range(4000)]
    rec = sharding.records(frame(spark, rows))
    bounds = sharding.splitters(rec, 16)
    totals = [n for _, _, n in sharding._totals(sharding.ranged(rec, bounds))]
    assert sum(totals) == 4000 and max(totals) <= 2.5 * 2 * 4000 / 16


def test_write_shards(spark, tmp_path):
    rows = odd_rows()
    docs = frame(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))


# -- mixing ---------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100]) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 5]) == [0.0, 5.0] and mixing.targets([]) == []


def test_flow_is_cheapest():
    rng = random.Random(4)
    for _ in range(30):
        arcs = [(a, b, rng.randint(0, 2), rng.randint(0, 4)) for a, b in itertools.permutations(range(4), 2) if a != 3 and b != 0 and rng.random() < 0.8]
        flow = mixing.Flow(4)
        ids = [flow.arc(*x) for x in arcs]
        sent = flow.run(0, 3)
        cost = sum(flow.cap[e ^ 1] * x[3] for e, x in zip(ids, arcs))
        best = {}
        for use in itertools.product(*[range(c + 1) for _, _, c, _ in arcs]):
            net = [0] * 4
            for u, (a, b, _, _) in zip(use, arcs):
                net[a] -= u
                net[b] += u
            if net[1] == net[2] == 0 and net[3] >= 0:
                spent = sum(u * x[3] for u, x in zip(use, arcs))
                best[net[3]] = min(best.get(net[3], 1 << 30), spent)
        assert sent == max(best) and cost == best[sent]


def test_route_repeats_evenly():
    sent = mixing.route({("0", 0): 100, ("0 1", 0): 50, ("0 1", 1): 50, ("1", 1): 100}, {"0": 100, "0 1": 50, "1": 100}, [150, 100])
    assert sum(x for (_, s), x in sent.items() if s == 0) == 150 and sum(x for (_, s), x in sent.items() if s == 1) == 100
    assert sent["0 1", 0] + sent["0 1", 1] == 50  # the shared text is not seen twice while there is another way


def mixed_rows(n=800, seed=9):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60) + [str(i)]), "en", rng.choice(["a", "b", "c", None])) for i in range(n)]
    return rows + [(n + i, rows[i][1], "en", rng.choice("abc")) for i in range(0, 200)]


@pytest.mark.parametrize("patterns", [256, 2])
def test_mix_meets_its_targets(spark, patterns):
    rows = mixed_rows()
    docs = frame(spark, rows)
    got = mixing.plan(docs, max_patterns=patterns).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names])))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= 40 for s in names), (taken, goal)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.plan(docs, max_patterns=patterns).collect()))


def test_every_pattern_takes_part_in_the_flow(spark, monkeypatch):
    """276 patterns of two sources: each keeps both, and how shares reach the rows changes nothing."""
    names = [f"s{i:02d}" for i in range(24)]
    rows = [(i, " ".join(["w"] * (5 + 7 * i) + [str(i)]), "en", s) for i, s in enumerate(names)]
    for a, b in itertools.combinations(names, 2):
        rows += [(len(rows) + k, f"{a} {b} " + "x " * (len(rows) % 9), "en", s) for k, s in enumerate((a, b))]
    seen, route = [], mixing.route
    monkeypatch.setattr(mixing, "route", lambda cells, unique, *x: seen.append((cells, unique)) or route(cells, unique, *x))
    docs = frame(spark, rows)
    got = [Counter(map(tuple, mixing.plan(docs, max_patterns=n).collect())) for n in (mixing.MAX_PATTERNS, 2, 1000)]
    assert got[0] == got[1] == got[2] and sum(got[0].values()) == len(rows)
    patterns = {f"{a} {b}" for a, b in itertools.combinations(range(24), 2)} | {str(i) for i in range(24)}
    for cells, unique in seen:
        assert set(unique) == patterns and set(cells) == {(p, int(s)) for p in patterns for s in p.split()}


def test_mix_rows(spark):
    rows = mixed_rows(200)
    docs = frame(spark, rows)
    got, taken = mixing.mix(docs), {r.doc_id: r.taken for r in mixing.plan(docs).collect()}
    assert got.columns == docs.columns
    times = Counter(r.doc_id for r in got.collect())
    assert {i: times[i] * len(t.split()) for i, t, *_ in rows} == taken


def test_mix_odd_tables(spark):
    rows = odd_rows()
    assert mixing.plan(frame(spark, rows)).count() == len(rows)
    assert mixing.plan(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0
    twice = [(1, "a b", None, "s")] * 2 + [(2, "c d", None, "s")]
    same = [r.taken for r in mixing.plan(frame(spark, twice)).collect() if r.doc_id == 1]
    assert same[0] == same[1]


# -- URLs ------------------------------------------------------------------------------


def brute_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=None)


URLS = [
    None, "", "no scheme", "http://", "http://Blog.EXAMPLE.org/es/1?x=1#y", "https://org", "https://org/", "https://notorg/", "http://a.org?x",
    "ftp://example.org/en/12", "http://x.example.org/en/2", "http://example.com/fr/1", "http://example.com/de/", "a://b://c.org/z", "http://com/de/\nq", "http://É.org/É",
]


def url_pages(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").select("*", F.lit("x").alias("tokens"), F.lit("y").alias("host"), F.lit(1).alias("rule"))


def test_url_rules(spark):
    urls = URLS + URLS[4:6]
    got = {r.page_id: r for r in url_filter.judge(url_pages(spark, urls)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, fit = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, fit and fit[1]), u
        if fit:
            assert got[i].verdict == fit[2]
    assert url_filter.judge(url_pages(spark, [])).count() == 0
    assert {r.verdict for r in url_filter.judge(url_pages(spark, ["http://a.net/x", None])).collect()} == {"allow"}


@pytest.mark.parametrize("tail", ["a/b/c/bad/x", "a/b/c/d/e/f/bad", "a?sid-2=1", "a?x=1&0/é=y=z#&w=2"])
def test_deep_segments_and_all_query_keys_are_tokens(spark, tail):
    """The tail, which only blocked urls have, blocks a url that no fixed rule fits."""
    good = tail.replace("bad", "good").replace("sid-2", "sid-3").replace("0/é", "0/e")
    urls = [f"http://h{i}.com/de/{tail}" for i in range(20)] + [f"http://h{i}.com/fr/{good}" for i in range(20)]
    urls += [f"http://other.net/q/{tail}", f"http://other.net/q/{good}"]
    got = {r.page_id: r for r in url_filter.judge(url_pages(spark, urls)).collect()}
    assert (got[40].rule, got[40].verdict, got[41].verdict) == (None, "block", "allow")


@pytest.mark.parametrize("fp_items", [12, 0])
def test_mined_rules_against_brute_force(spark, fp_items):
    """By FP-growth and level by level."""
    rng = random.Random(8)
    sets = []
    for _ in range(300):
        t = sorted(rng.sample("abcdef", rng.randint(1, 4)))
        bad = ("a" in t and "b" in t) or rng.random() < 0.1
        sets.append((t, "block" if bad else "allow"))
    df = spark.createDataFrame(sets, "tokens array<string>, label string")
    rules = {(tuple(r.antecedent), r.verdict): r.confidence for r in url_filter.mine(df, 0.02, 0.8, 4, fp_items).collect()}
    want = {}
    for n in range(1, 5):
        for c in itertools.combinations("abcdef", n):
            own = [lab for t, lab in sets if set(c) <= set(t)]
            for v in ("allow", "block"):
                k = own.count(v)
                if k >= 0.02 * len(sets) and k / len(own) >= 0.8:
                    want[c, v] = k / len(own)
    pruned = {
        (c, v): x for (c, v), x in want.items()
        if not any(want.get((tuple(y for y in c if y != g), v), -1) >= x for g in c if len(c) > 1)
    }
    assert rules.keys() == pruned.keys() and all(abs(rules[r] - pruned[r]) < 1e-9 for r in rules)
    asked = df.select("tokens").distinct()
    best = {tuple(r.tokens): r.mined for r in url_filter.matched(asked, url_filter.mine(df, 0.02, 0.8, 4, fp_items)).collect()}
    for t in {tuple(t) for t, _ in sets}:
        fit = [x for (c, v), x in pruned.items() if set(c) <= set(t)]
        assert (t in best) == bool(fit)
        if fit:
            assert max(pruned[c, v] for (c, v) in pruned if set(c) <= set(t) and v == best[t]) == max(fit)


@pytest.mark.parametrize("n", [40, 4000])
def test_urls_of_thirty_query_keys(spark, n):
    """Every url has 30 keys, some each, some the same, some one more than the last; a pair of keys gives blocked ones away."""
    rng = random.Random(n)
    keys = [f"k{i}" for i in range(30)]
    ask = lambda own: "&".join(f"{k}=1" for k in own)
    urls = []
    for i in range(n):
        own = [keys, keys[: 1 + i % 30], rng.sample(keys, 15)][i % 3]
        bad = "k0" in own and "k29" in own
        urls.append(f"http://h{i}.com/{'de' if bad else 'fr'}/{i}?{ask(own)}")
    urls += [f"http://a.net/?{ask(['k0', 'k29'])}", f"http://a.net/?{ask(['k0', 'k1', 'k2'])}", "http://a.net/?" + "&".join(f"z{i}=1" for i in range(3000))]
    got = {r.page_id: r for r in url_filter.judge(url_pages(spark, urls)).collect()}
    assert [got[n + i].verdict for i in range(3)] == ["block", "allow", "allow"] and got[n].rule is None
    assert len(got[n].antecedent) <= url_filter.MAX_TOKENS and len(got) == len(urls)


# -- pipeline ------------------------------------------------------------------------------


def tables(spark, tmp_path, rows):
    frame(spark, rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    vocab = {"en": "the of and nation running there".split(), "de": "der und nicht straße über ein".split()}
    text = lambda lang, n: " ".join(rng.choice(vocab[lang]) + str(rng.randint(0, 9)) for _ in range(n))
    rows = [(i, text(lang := rng.choice(["en", "de"]), rng.randint(20, 120)), lang, rng.choice("ab")) for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2], "b") for i in range(20)]  # copies
    rows += [(300 + i, f"{text('en', 30)} {' '.join(f'bench{j}' for j in range(12))} {text('en', 30)}", "en", "a") for i in range(5)]
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (402, "123 ... 456", "en", "a")]
    d = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), before.schema)
        assert docs.columns == before.columns
        kept[name] = Counter(r.doc_id for r in docs.collect())
        if name == "benchmark decontamination":
            assert decontaminate.contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet")).filter("contaminated").count() == 0
            assert docs.filter("n_chars <> length(text)").count() == 0
    assert kept["language ID"] == Counter(r[0] for r in rows if r[0] < 400)
    assert kept["SimHash near-dedup"] == Counter(r[0] for r in rows if r[0] < 200 or 300 <= r[0] < 400)
    assert kept["benchmark decontamination"] == kept["SimHash near-dedup"]
    assert set(kept["mixing sources to target weights"]) <= set(kept["SimHash near-dedup"])
    assert all(docs.filter(F.col(c) == f"x{c}").count() == docs.count() for c in CLASHING)  # extra columns come through unharmed
    out = corpus_pipeline.run(spark, d).collect()
    assert Counter(r.doc_id for r in out) == kept["mixing sources to target weights"]
    assert {r.shard for r in out} <= set(range(8))


def test_pipeline_odd_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "a", odd_rows())).count() > 0
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "b", [])).count() == 0

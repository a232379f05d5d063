"""Mixing overlapping sources to target weights by min-cost flow.

A text may stand in several sources.  Documents are aggregated by membership
pattern (the set of sources that hold their text); a flow routes tokens of
each pattern to the quotas of its sources.  Its costs are convex in how often
a text is repeated, over all sources and within one, so scarce texts are
repeated evenly and late.  Whole rounds of a (pattern, source) cell are taken
in full; for the rest documents are drawn in a seeded order, each with the
chance its cell's flow gives it, until the source's quota is met.

Only sums per pattern and source reach the driver, and every pattern takes
part in the flow.  The shares of the ``MAX_PATTERNS`` patterns with most tokens
are broadcast to the rows; those of rarer patterns are joined by a shuffle,
which changes no result.

The draw is a prefix of an order: a histogram finds the part of it where the
quota is met, and only that part is sorted.

Defined results: null and blank texts have size 0 and are taken 0 times; a
null source is a source of its own, the last; rows that repeat (same id, text
and source) are taken alike; rows with a null doc_id are drawn by their text;
an empty table gives no rows; other columns pass through ``mix`` and are
ignored by ``plan``.
"""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewise.llm.common import fresh, stored

WEIGHTS = (5, 2, 1)  # fixed values, repeating over the sources in order
MAX_REPEAT = 3
MAX_PATTERNS = 256
BINS = 8192
SEED = 17


def targets(sizes: list[int], weights=WEIGHTS, most: int = MAX_REPEAT) -> list[float]:
    """Shares of all tokens by weight; what exceeds ``most`` times a source is shared anew."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(w[i] for i in free)
        over = {i for i in free if left * w[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= over
    return out


class Flow:
    """Min-cost flow by primal-dual steps: a shortest-path search, then a blocking flow along its tight arcs."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, k in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(k)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        n, sent, pot = len(self.out), 0, [0] * len(self.out)
        far = float("inf")
        while True:
            dist = [far] * n
            dist[s], heap = 0, [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for e in self.out[a]:
                    if self.cap[e] and (x := d + self.cost[e] + pot[a] - pot[self.to[e]]) < dist[self.to[e]]:
                        dist[self.to[e]] = x
                        heapq.heappush(heap, (x, self.to[e]))
            if dist[t] == far:
                return sent
            pot = [p + min(d, dist[t]) for p, d in zip(pot, dist)]
            while pushed := self._blocking(s, t, pot):
                sent += pushed

    def _tight(self, a: int, e: int, pot: list[int]) -> bool:
        return self.cap[e] > 0 and self.cost[e] + pot[a] - pot[self.to[e]] == 0

    def _blocking(self, s: int, t: int, pot: list[int]) -> int:
        level, queue = {s: 0}, deque([s])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.to[e] not in level and self._tight(a, e, pot):
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        if t not in level:
            return 0
        at, total = [0] * len(self.out), 0
        while True:
            path, a = [], s
            while a != t:
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    if level.get(self.to[e], -1) == level[a] + 1 and self._tight(a, e, pot):
                        break
                    at[a] += 1
                else:
                    if a == s:
                        return total
                    e = path.pop()
                    a = self.to[e ^ 1]
                    at[a] += 1
                    continue
                path.append(e)
                a = self.to[e]
            some = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= some
                self.cap[e ^ 1] += some
            total += some


def route(cells: dict[tuple[str, int], int], unique: dict[str, int], quotas: list[int], most: int = MAX_REPEAT) -> dict[tuple[str, int], int]:
    """Tokens that each (pattern, source) cell sends to its source's quota.

    cells: tokens of the cell's rows; unique: tokens of the pattern's distinct texts."""
    patterns = sorted(unique)
    flow = Flow(2 + len(patterns) + len(quotas))
    node = {p: 2 + i for i, p in enumerate(patterns)}
    first = 2 + len(patterns)
    room = dict.fromkeys(patterns, 0)
    for (p, _), tokens in cells.items():
        room[p] += most * tokens
    for p in patterns:
        rounds, left, width = 1, room[p], max(unique[p], 1)
        while left > 0:  # the r-th exposure of a text costs 2r - 1; beyond eight, in doubling steps
            some = min(left, width * (1 if rounds <= 8 else rounds))
            flow.arc(0, node[p], some, 4 * (2 * rounds - 1))
            left -= some
            rounds = rounds + 1 if rounds <= 8 else rounds * 2
    arcs = {}
    for (p, s), tokens in sorted(cells.items()):
        arcs[p, s] = [flow.arc(node[p], first + s, tokens, 2 * r + 1) for r in range(most)]
    for s, q in enumerate(quotas):
        flow.arc(first + s, 1, q, 0)
    flow.run(0, 1)
    return {cell: sum(flow.cap[e ^ 1] for e in es) for cell, es in arcs.items()}


def members(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, digest of the text."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest")
    )


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MAX_REPEAT, max_patterns: int = MAX_PATTERNS, bins: int = BINS) -> DataFrame:
    """doc_id, source, digest, size, source_size, target, taken: one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = stored(members(docs), "members")
    sources = sorted(rows.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([r.n for r in sources], weights, most)
    numbered = F.broadcast(spark.createDataFrame([(r.source, i, r.n, t) for i, (r, t) in enumerate(zip(sources, goal))], "source string, s int, source_size long, target double"))
    rows = rows.withColumnRenamed("source", "source_").join(numbered, F.col("source_").eqNullSafe(F.col("source"))).drop("source_")

    shared = rows.groupBy("digest").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.array_sort(F.collect_set("s")).alias("in")).filter("lo < hi")
    shared = shared.select("digest", F.array_join(F.transform("in", lambda x: x.cast("string")), " ").alias("pattern"))
    rows = rows.join(stored(shared, "shared"), "digest", "left").withColumn("pattern", F.coalesce("pattern", F.col("s").cast("string")))
    rows = stored(rows, "patterns")
    cells = {(r.pattern, r.s): r.n for r in rows.groupBy("pattern", "s").agg(F.sum("size").alias("n")).filter("n > 0").collect()}
    texts = rows.groupBy("pattern", "digest").agg(F.max("size").alias("size"))
    unique = {r.pattern: r.n for r in texts.groupBy("pattern").agg(F.sum("size").alias("n")).filter("n > 0").collect()}
    sent = route(cells, unique, [int(t) for t in goal], most)

    share = [(p, s, x // cells[p, s], (x % cells[p, s]) / cells[p, s]) for (p, s), x in sent.items()]
    by_tokens = sorted((p for p in unique if " " in p), key=lambda p: (-unique[p], p))
    rare = set(by_tokens[max_patterns:])
    shares = [spark.createDataFrame([x for x in share if (x[0] in rare) == y], "pattern string, s int, rounds long, chance double") for y in (False, True)]
    u = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("digest")), F.lit(SEED)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    is_common = ~F.col("pattern").contains(" ") | F.col("pattern").isin(by_tokens[:max_patterns]) | (F.col("size") == 0)
    dealt = (rows.filter(is_common) if rare else rows).join(F.broadcast(shares[0]), ["pattern", "s"], "left")  # max_patterns x sources at most
    if rare:
        dealt = dealt.unionByName(rows.filter(~is_common).join(shares[1], ["pattern", "s"], "left"))
    rows = dealt.fillna({"rounds": 0, "chance": 0.0})
    rows = rows.withColumn("z", F.when(F.col("chance") > 0, u / (u + F.col("chance")))).withColumn("bin", F.floor(F.col("z") * bins).cast("int"))
    rest = rows.groupBy("s").agg((F.first("target") - F.sum(F.col("rounds") * F.col("size"))).alias("rest"))
    filled = rows.filter("bin is not null").groupBy("s", "bin").agg(F.sum("size").alias("n"))
    filled = filled.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("bin")))  # at most ``bins`` rows of a source
    last = filled.join(rest, "s").filter("upto >= rest").groupBy("s").agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
    last = rest.join(last, "s", "left").select("s", "rest", F.coalesce("x.bin", F.lit(bins)).alias("last"), F.coalesce("x.before", F.lit(0)).alias("before"))
    rows = rows.join(F.broadcast(last), "s")  # one row per source
    edge = F.col("bin") == F.col("last")
    tied = Window.partitionBy("s", "edge").orderBy("z", "digest")  # rows that repeat are tied, and taken alike
    near = rows.filter(edge).withColumn("edge", F.lit(1)).withColumn("run", F.sum("size").over(tied) + F.col("before") - F.col("size") / 2).drop("edge")
    far = rows.filter(~edge | F.col("bin").isNull()).withColumn("run", F.when(F.col("bin") < F.col("last"), F.lit(-1.0)))
    extra = F.coalesce((F.col("run") <= F.col("rest")).cast("long"), F.lit(0))
    rows = stored(near.unionByName(far).withColumn("extra", extra).drop("z", "bin", "run", "last", "before"), "drawn")

    # the last document drawn may be long: turn the one decision in each source that brings it nearest to its quota
    miss = rows.groupBy("s").agg((F.first("rest") - F.sum(F.col("extra") * F.col("size"))).alias("miss"))
    one = rows.filter("chance > 0").groupBy("s", "digest", "doc_id", "extra").agg(F.sum("size").alias("n")).join(F.broadcast(miss), "s")
    better = one.withColumn("left", F.abs(F.col("miss") - F.when(F.col("extra") == 1, -F.col("n")).otherwise(F.col("n")))).filter("left < abs(miss)")
    turned = better.groupBy("s").agg(F.min(F.struct("left", "digest", "doc_id")).alias("x")).select("s", F.col("x.digest").alias("turn"), F.col("x.doc_id").alias("turn_id"))
    rows = rows.join(F.broadcast(turned), "s", "left")  # one row per source
    is_it = (F.col("chance") > 0) & F.coalesce(F.col("digest") == F.col("turn"), F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("turn_id"))
    taken = F.col("size") * (F.col("rounds") + F.when(is_it, 1 - F.col("extra")).otherwise(F.col("extra")))
    return rows.select("doc_id", "source", "digest", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, rows without a word not at all."""
    own = doc, source, digest, times, copy = fresh(docs.columns, "_doc_id", "_source", "_digest", "_times", "_copy")
    chosen = plan(docs, weights, most).filter("taken > 0")
    chosen = chosen.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("digest").alias(digest), F.expr("cast(taken div size as int)").alias(times)).distinct()
    key = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    on = (key == chosen[digest]) & docs["doc_id"].eqNullSafe(chosen[doc]) & docs["source"].eqNullSafe(chosen[source])
    return docs.join(chosen, on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(*own)

"""Line dedup by pairwise alignment.

Documents that overlap are found through the hashes of lines, each later
document is aligned with the earlier one by patience diff, and the blocks of
lines that align are deleted from the later one.

A run is a line of at least ``MIN_CHARS`` characters, or the shorter lines from
one that isn't blank on until they have as many.  The anchors of a document
are its runs, each with the number of its occurrence, and besides those that
stand there once as such.  A document is paired with the first holders of all
its anchors, however many texts hold them.  So a line held by n texts makes
n - 1 pairs at most.  An alignment keeps an order, so a line may stay that a
later holder has in the same order as the document: where an anchor stays that
an earlier text holds, the document is also paired with that anchor's second
holder and with the first holder of each two neighbouring lines around it.  The pairs of a first holder are dealt to slices of about
``RARE``, each with a copy of its hashes, and the holders of every line to
``SLICES``, so a popular line is not one task.
Equal texts are one text: their later copies go whole, without an alignment.

What only an alignment with some other holder would delete stays: pairing every
two holders of a line would take the square of their number.  README has the
recall against all pairs.

Only line hashes move and are aligned (a match also needs the same length);
texts with deletions are read again to cut them.

Defined results: null and empty texts have no lines; lines are compared with
white space at their ends removed; a block of fewer than ``MIN_CHARS``
characters stays; very long texts are aligned whole; a null doc_id is later than any other, and rows with null
ids or that share an id and text aren't later than each other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewise.llm.common import buffers, stored

MIN_CHARS = 20
RARE = 64
SLICES = 256
LAST = (1 << 63) - 1  # stands for a null id


def lines_of(text: bytes | None) -> list[bytes]:
    return text.split(b"\n") if text else []


def _hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line.strip()) - (1 << 63)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by the first) that also increases in the second."""
    tops, ends, back = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[n] = ends[at - 1] if at else -1
        tops[at : at + 1] = [j]
        ends[at : at + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) of two sequences, in order: patience diff."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once = [x for x, n in Counter(a[a0:a1]).items() if n == 1]
        in_b = Counter(b[b0:b1])
        once = {x for x in once if in_b.get(x) == 1}
        if not once:
            continue
        at_b = {x: j for j, x in enumerate(b[b0:b1], b0) if x in once}
        spine = _increasing([(i, at_b[x]) for i, x in enumerate(a[a0:a1], a0) if x in once])
        i0, j0 = a0, b0
        for i, j in [*spine, (a1, b1)]:
            todo.append((i0, i, j0, j))
            if (i, j) != (a1, b1):
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def blocks(a: list, b: list, chars: list[int], least: int = MIN_CHARS) -> list[tuple[int, int]]:
    """(start, end) in b of the aligned common blocks with at least ``least`` characters; chars: of the lines of b."""
    out, start, last = [], None, None
    for i, j in [*patience(a, b), (-1, -1)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            if last is not None and sum(chars[start : last[1] + 1]) >= least:
                out.append((start, last[1] + 1))
            start = j
        last = (i, j)
    return out


def _mixed(hashes: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(np.array(hashes, np.int64).tobytes()) - (1 << 63)


def runs_of(hashes: list[int], chars: list[int], least: int = MIN_CHARS) -> list[tuple[int, int, list[int]]]:
    """(first line, line after the last, anchors) of each run."""
    runs = []
    for i, c in enumerate(chars):
        n, j = c, i + 1
        while 0 < n < least and j < len(chars) and chars[j] < least:  # a line is passed from fewer than ``least`` starts
            n, j = n + chars[j], j + 1
        if n >= least:
            runs.append((i, j, hashes[i] if j == i + 1 else _mixed(hashes[i:j])))
    times, seen, out = Counter(x for _, _, x in runs), Counter(), []
    for i, j, x in runs:
        out.append((i, j, [x] * (times[x] == 1) + [_mixed([x, seen[x], -1])]))  # the second also where another text repeats it
        seen[x] += 1
    return out


def anchors_of(hashes: list[int], chars: list[int], least: int = MIN_CHARS) -> list[int]:
    """Any common block of ``least`` characters gives two texts an anchor in common."""
    return [a for _, _, own in runs_of(hashes, chars, least) for a in own]


def left_over(hashes: list[int], chars: list[int], shared: set[int], gone: list[int], least: int = MIN_CHARS) -> tuple[list[int], list[tuple[int, int]]]:
    """Anchors that an earlier text has and whose run no alignment has touched; neighbouring lines (their hashes) there."""
    cut, anchors, starts = set(gone), set(), set()
    for i, j, own in runs_of(hashes, chars, least):
        if not cut.intersection(range(i, j)) and shared.intersection(own):
            anchors.update(shared.intersection(own))
            starts.update(range(max(i - 1, 0), min(j, len(hashes) - 1)))
    return sorted(anchors), sorted({(hashes[k], hashes[k + 1]) for k in starts if chars[k] + chars[k + 1] >= least})


def measured(docs: DataFrame) -> DataFrame:
    """id, key (of the text), sha256 of the text, and of each line its hash and length, and the anchors."""

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["id", "key", "sha", "hashes", "chars", "anchors"]
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), buffers(batch.column("text"))):
                lines = lines_of(text)
                h = [_hash(x) for x in lines]
                chars = [len(x.strip().decode("utf-8", "replace")) for x in lines]
                sha = hashlib.sha256(text or b"").digest()
                out.append((LAST if doc is None else doc, int.from_bytes(sha[:8], "big", signed=True), sha.hex(), h, chars, anchors_of(h, chars)))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "id long, key long, sha string, hashes array<long>, chars array<int>, anchors array<long>")


def shared_anchors(texts: DataFrame, slices: int = SLICES) -> DataFrame:
    """(id, key, h, id0, key0): an anchor of a text and the first text that holds it, an earlier one.

    The holders of an anchor are dealt to ``slices``; what its slices know, a row each, is put together and goes back to them."""
    held = texts.select("id", "key", F.explode("anchors").alias("h"), F.pmod(F.xxhash64("id", "key"), F.lit(slices)).cast("int").alias("slice"))
    own = held.groupBy("h", "slice").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key")).alias("first"))
    of_anchor = Window.partitionBy("h")  # a row for each slice
    holders = own.select("h", "slice", F.sum("n").over(of_anchor).alias("n"), F.min("first").over(of_anchor).alias("first")).filter("n > 1")
    return held.join(holders, ["h", "slice"]).filter("id > first.id").select("id", "key", "h", F.col("first.id").alias("id0"), F.col("first.key").alias("key0"))


def dealt(pairs: DataFrame, rare: int = RARE) -> DataFrame:
    """Pairs (id, key, id0, key0) and a slice: a first holder has one for each ``rare`` texts it is paired with."""
    slices = pairs.groupBy("id0", "key0").agg(F.ceil(F.count(F.lit(1)) / rare).alias("slices"))
    return pairs.join(slices, ["id0", "key0"]).select("id", "key", "id0", "key0", F.pmod(F.xxhash64("id", "key"), "slices").alias("slice"))


def _left_over(least: int):
    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("id", "key", "hashes", "chars", "shared", "gone")]
            out = []
            for doc, key, h, c, shared, gone in zip(*cols):
                anchors, two = left_over(h, c, set(shared), gone or [], least)
                out += [(doc, key, a, None) for a in anchors] + [(doc, key, a, b) for a, b in two]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "key", "a", "b"])

    return run


def more_pairs(texts: DataFrame, shared: DataFrame, gone: DataFrame, least: int) -> DataFrame:
    """(id, key, id0, key0): texts that keep a shared anchor, its second holders and the first holders of the lines around it."""
    own = shared.groupBy("id", "key").agg(F.collect_set("h").alias("shared"))  # anchors of one text
    kept = texts.select("id", "key", "hashes", "chars").join(own, ["id", "key"]).join(gone, ["id", "key"], "left")
    asked = stored(kept.mapInArrow(_left_over(least), "id long, key long, a long, b long"), "line_left")
    one, two = asked.filter("b is null").select("id", "key", F.col("a").alias("h")), asked.filter("b is not null")
    least_of = F.min(F.struct("id", "key")).alias("first")
    second = shared.groupBy("h").agg(least_of)  # these rows aren't the first holders; one row for each anchor before it is joined
    lines = texts.select("id", "key", F.explode(F.arrays_zip(F.col("hashes").alias("a"), F.slice("hashes", F.lit(2), F.size("hashes")).alias("b"))).alias("x"))
    lines = lines.select("id", "key", "x.a", "x.b").join(two.select("a", "b").distinct(), ["a", "b"], "left_semi")
    found = one.join(second, "h").drop("h").unionByName(two.join(lines.groupBy("a", "b").agg(least_of), ["a", "b"]).drop("a", "b"))
    near = found.filter("id > first.id").select("id", "key", F.col("first.id").alias("id0"), F.col("first.key").alias("key0")).distinct()
    return near.join(shared.select("id", "key", "id0", "key0").distinct(), ["id", "key", "id0", "key0"], "left_anti")


def _align(least: int):
    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("id", "key", "hashes0", "chars0", "hashes", "chars")]
            out = []
            for doc, key, h0, c0, h, c in zip(*cols):
                gone = [j for s, e in blocks(list(zip(h0, c0)), list(zip(h, c)), c, least) for j in range(s, e)]
                out.append((doc, key, gone))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.list_(pa.int32())])], names=["id", "key", "gone"])

    return run


def to_cut(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """id, key, text, gone: the rows of ``docs`` whose id and text lose lines; null ids are told apart by their texts."""
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    key = F.conv(F.substring(sha, 1, 16), 16, -10).cast("long")  # as measured() has it
    own = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), key.alias("key"), "text")
    return own.join(gone, ["id", "key"]).select("id", "key", "text", "gone")


def _cut(batches):
    for batch in batches:
        out = []
        for doc, key, text, gone in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), buffers(batch.column("text")), batch.column("gone").to_pylist()):
            drop = np.zeros(len(lines := lines_of(text)), bool)
            drop[gone] = True
            kept = b"\n".join(x for x, d in zip(lines, drop.tolist()) if not d)
            out.append((doc, key, len(set(gone)), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])], names=["id", "key", "n_removed", "kept_sha256", "kept"])


def alignments(docs: DataFrame, rare: int = RARE, least: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Two frames: (id, key, sha, n_lines, copy) of every row; (id, key, n_removed, kept_sha256, kept) of texts that lose lines."""
    base = stored(measured(docs), "lines")
    firsts = base.groupBy("sha").agg(F.min("id").alias("id")).withColumn("copy", F.lit(False))
    enough = F.aggregate("chars", F.lit(0), lambda n, x: n + x) >= least
    rows = base.select("id", "key", "sha", F.size("hashes").cast("long").alias("n_lines"), enough.alias("enough"))
    rows = rows.join(firsts, ["sha", "id"], "left")  # both keys: copies of one text are dealt out
    rows = rows.withColumn("copy", F.col("enough") & F.coalesce("copy", F.lit(True)))
    texts = base.join(firsts, ["sha", "id"]).select("id", "key", "hashes", "chars", "anchors").dropDuplicates(["id", "key"])
    earlier = texts.select(F.col("id").alias("id0"), F.col("key").alias("key0"), F.col("hashes").alias("hashes0"), F.col("chars").alias("chars0"))

    def aligned(pairs: DataFrame) -> DataFrame:
        near = stored(dealt(pairs, rare), "line_pairs")
        of = near.select("id0", "key0", "slice").distinct().join(earlier, ["id0", "key0"])  # once a slice: a hot first holder is dealt out
        both = near.join(of, ["id0", "key0", "slice"]).join(texts.drop("anchors"), ["id", "key"])
        gone = both.select("id", "key", "hashes0", "chars0", "hashes", "chars").mapInArrow(_align(least), "id long, key long, gone array<int>")
        return stored(gone.select("id", "key", F.explode("gone").alias("j")).distinct(), "line_gone")

    listed = lambda gone: gone.groupBy("id", "key").agg(F.array_sort(F.collect_set("j")).alias("gone"))  # noqa: E731  lines of one text
    shared = stored(shared_anchors(texts), "line_shared")
    gone = aligned(shared.select("id", "key", "id0", "key0").distinct())
    gone = listed(gone.unionByName(aligned(more_pairs(texts, shared, listed(gone), least))))
    lost = to_cut(docs, gone).mapInArrow(_cut, "id long, key long, n_removed long, kept_sha256 string, kept string")
    return rows.select("id", "key", "sha", "n_lines", "copy"), lost.dropDuplicates(["id", "key"])


def deduplicated(docs: DataFrame, rare: int = RARE, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256: one row per row of ``docs``."""
    rows, lost = alignments(docs, rare, least)
    out = rows.join(lost.select("id", "key", "n_removed", "kept_sha256"), ["id", "key"], "left")
    return out.select(
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"),
        "n_lines",
        F.when(F.col("copy"), F.col("n_lines")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )

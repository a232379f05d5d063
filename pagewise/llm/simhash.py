"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint holds the majority of each bit over the hashes of a
text's word shingles.  For links at ``k`` or fewer differing bits it is cut
into ``k // 2 + 1`` segments: at least one of them differs by at most one bit.
Each segment is indexed under its one-wildcard variants (one bit deleted), so
such segments share a variant, and an equality join followed by a count of the
differing bits finds all links.

Fingerprints are made distinct first, so copies never form pairs.  A variant
shared by more than ``HOT`` fingerprints isn't joined with itself: there, every
fingerprint is put under all values it takes when ``k`` of its bits are
deleted; at most 2**k fingerprints share such a value and all of them are
linked, so a star in each is enough.

Defined results: null and blank texts have fingerprint zero and are linked
like any other; rows with a null doc_id have a fingerprint and are linked but
are never the smallest id (a component of such rows only has a null id); rows
that repeat are linked; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewise.llm import graph
from pagewise.llm.common import buffers, fresh, lean, stored

SHINGLE = 3
MAX_BITS = 2
SEED = 42
HOT = 1000
BLOCK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text's UTF-8 bytes."""
    words = (text or b"").lower().split()  # both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        digests = [xxhash.xxh64_digest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_digest
        digests = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(digests), BLOCK):
        rows = np.frombuffer(b"".join(digests[i : i + BLOCK]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``docs`` and the fingerprint of ``text`` as a signed long."""
    columns = docs.columns

    @lean
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in buffers(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(fps)], names=[*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _segments(k: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of the k // 2 + 1 segments."""
    n = k // 2 + 1
    at = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _variants(k: int) -> list[tuple[int, int]]:
    """(segment's bits, bit that is deleted) as masks of signed longs."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(((1 << n) - 1) << a), signed(1 << (a + j))) for a, n in _segments(k) for j in range(n)]


def variants(fps: DataFrame, k: int = MAX_BITS) -> DataFrame:
    """(v, key, fp): the number of the variant, and the segment without the deleted bit."""
    masks = F.array(*[F.lit(seg & ~bit) for seg, bit in _variants(k)])
    return fps.select("fp", F.posexplode(masks).alias("v", "mask")).select("v", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _linked(k: int, hot: int):
    """For rows (v, key, fp) in order of (v, key): edges (a, b) between fingerprints of one variant at k or fewer
    bits, and (fp, null) for each fingerprint of a variant with more than ``hot``."""

    def edges(fps: np.ndarray):
        bits = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64))
        a, b = np.nonzero(np.triu(bits <= k, 1))
        return np.minimum(fps[a], fps[b]), np.maximum(fps[a], fps[b])

    def run(batches):
        kept = [np.empty(0, np.int64)] * 3  # the last group of a batch may go on in the next
        crowded = None
        for batch in batches:
            v, low, fp = (np.concatenate([old, batch.column(c).to_numpy().astype(np.int64)]) for old, c in zip(kept, ("v", "key", "fp")))
            if not len(fp):
                continue
            cuts = np.flatnonzero((v[1:] != v[:-1]) | (low[1:] != low[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            pairs, crowd = [], []
            for i in np.flatnonzero((ends - starts > 1) | (starts == 0)).tolist():
                group, name = fp[starts[i] : ends[i]], (v[starts[i]], low[starts[i]])
                if name == crowded or len(group) > hot:
                    crowd.append(group)
                    crowded = name
                elif ends[i] < len(fp):
                    pairs.append(edges(group))
            kept = [x[starts[-1] :] if (v[-1], low[-1]) != crowded else x[:0] for x in (v, low, fp)]
            yield from _edge_batch(pairs, crowd)
        yield from _edge_batch([edges(kept[2])], [])

    return run


def _edge_batch(pairs, crowd):
    a, b = (np.concatenate([p[i] for p in pairs] + [np.empty(0, np.int64)]) for i in (0, 1))
    alone = np.concatenate([*crowd, np.empty(0, np.int64)])
    if len(a) + len(alone):
        missing = np.arange(len(a) + len(alone)) >= len(a)
        other = pa.array(np.concatenate([b, alone]), mask=missing)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, alone])), other], names=["a", "b"])


def links(fps: DataFrame, k: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that make the same components as all links at k or fewer bits do.

    Outside hot variants, these are all links.  Variants are dealt out and
    sorted by value, and the fingerprints of one value, at most ``hot`` at
    once, compared in their task."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = variants(fps.repartition(parts, "fp"), k).repartition(parts, "v", "key").sortWithinPartitions("v", "key")
    found = stored(keys.mapInArrow(lean(_linked(k, hot)), "a long, b long").distinct(), "links")
    crowd = found.filter("b is null").select(F.col("a").alias("fp")).repartition(parts, "fp")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = F.array(*[F.lit(signed(((1 << 64) - 1) ^ sum(1 << i for i in bits))) for bits in combinations(range(64), k)])
    spread = crowd.select("fp", F.posexplode(masks).alias("v", "mask")).select("v", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    least = spread.groupBy("v", "key").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)  # 2**k at most
    stars = least.select("a", F.explode("all").alias("b")).filter("a != b")
    return found.filter("b is not null").union(stars)


def _grouped(rows: DataFrame, k: int, hot: int) -> DataFrame:
    """rows (doc_id, fp) and their component: root (its least fingerprint), component_id."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = graph.components(links(nodes.select("fp"), k, hot)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, k: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links), one row per row of ``docs``."""
    rows = stored(fingerprints(docs.select("doc_id", "text"), width).select("doc_id", "fp"), "fingerprints")
    return _grouped(rows, k, hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, width: int = SHINGLE, k: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest doc_id stays.

    Of rows that repeat it, and of rows of that id with other texts in the component, one stays; of a component of
    null ids only, one."""
    last = (1 << 63) - 1  # stands for a null id
    rows = stored(fingerprints(docs.select("doc_id", "text"), width).select("doc_id", "fp"), "fingerprints")
    found = _grouped(rows, k, hot).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    own = fp, key = fresh(docs.columns, "_fp", "_id")
    stay = found.groupBy("root").agg(F.min("fp").alias(fp), F.first("doc_id").alias(key))
    stay = stay.select(fp, F.coalesce(key, F.lit(last)).alias(key))
    full = fingerprints(docs, width, fp).withColumn(key, F.coalesce(F.col("doc_id"), F.lit(last)))
    return full.join(stay, own).dropDuplicates(own).select(*docs.columns)

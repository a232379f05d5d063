"""Sharding by sampled splitters.

Records are ordered by (hash of the text, hash of the id).  A size-weighted
sample of these keys gives quantile boundaries; records are range-partitioned
by them, the ranges are measured, and a range that holds too many bytes or
rows (a text with very many copies) is subdivided by splitters sampled inside
it.  Running sums inside each range, and the totals of the ranges before it,
give every record its exact place in the order of all bytes; shard s takes the
records whose middle byte lies in the s-th part.  Equal texts are neighbours
and placed as one, by the middle of their group, where that is no larger than
the largest record: so shards are as even as single records allow.  A larger
group is divided where a shard ends.

Only (id, size, checksum, key) move; texts are read once, where they lie.

Defined results: a null text has size 1, checksum 0 and sorts like the empty
text; rows with a null id, and rows that repeat, are records like any other
(rows that agree in id and text stand next to each other in any order, and are
dealt out like others, however many); very long texts are records of their
size, and larger than a shard they make it uneven; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewise.llm.common import stored

SAMPLES_PER_RANGE = 32
OVERFULL = 2.0  # times the mean
ALIKE = (1 << 24) - 1  # bits of the second sort key in which rows of one text and id differ
FIRST = -(1 << 63)  # the least value of the second sort key
SEED = 11


def _fraction(*cols) -> F.Column:
    """A number in (0, 1] that depends on the columns only."""
    return (F.pmod(F.xxhash64(*cols, F.lit(SEED)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))


def _second_key(doc_id: str) -> F.Column:
    """A hash of the id, whose last bits depend on the row's place only: so many rows of one id and text have many keys."""
    ids, rows = F.xxhash64(F.col(doc_id), F.lit(SEED)), F.xxhash64(F.monotonically_increasing_id())
    return ids.bitwiseAND(F.lit(~ALIKE)).bitwiseOR(rows.bitwiseAND(F.lit(ALIKE)))


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and the sort key (k, t)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("k"),
        _second_key("doc_id").alias("t"),
    )


def range_of(k: np.ndarray, t: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted boundaries (k, t) are at or below each key."""
    bk = np.array([b[0] for b in bounds], np.int64)
    bt = np.array([b[1] for b in bounds], np.int64)
    lo, hi = np.searchsorted(bk, k, "left"), np.searchsorted(bk, k, "right")
    out = lo.copy()
    for key in np.unique(k[lo < hi]):
        a, b = np.searchsorted(bk, key, "left"), np.searchsorted(bk, key, "right")
        rows = k == key
        out[rows] = a + np.searchsorted(bt[a:b], t[rows], "right")
    return out


def ranged(rec: DataFrame, bounds: list[tuple[int, int]], k: str = "k", t: str = "t", r: str = "r") -> DataFrame:
    """Add the range number ``r`` of the key (k, t)."""

    @F.pandas_udf("int")
    def place(k: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(range_of(k.to_numpy(), t.to_numpy(), bounds).astype(np.int32))

    return rec.withColumn(r, place(k, t)) if bounds else rec.withColumn(r, F.lit(0))


def _totals(rec: DataFrame) -> list[tuple[int, int, int]]:
    """(range, bytes, rows): one small row for each range."""
    got = rec.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((x.r, x.b, x.n) for x in got)


def _quantiles(keys: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """Boundaries between ``parts`` parts; one falls inside a group of equal texts only where the next is the same group."""
    keys = sorted(keys)
    if len(keys) >= parts:
        keys = [keys[len(keys) * i // parts] for i in range(1, parts)]
    return [(k, t) if i and keys[i - 1][0] == k else (k, FIRST) for i, (k, t) in enumerate(keys)]


def splitters(rec: DataFrame, n_ranges: int, rounds: int = 4) -> list[tuple[int, int]]:
    """Boundaries of about ``n_ranges`` ranges of like size.

    The sample is the ``SAMPLES_PER_RANGE * n_ranges`` records with smallest
    -ln(u) / size: drawn without replacement with weights in proportion to size.
    """
    draw = -F.log(_fraction("k", "t")) / F.col("size")
    sample = rec.select("k", "t", draw.alias("p")).orderBy("p", "k", "t").limit(SAMPLES_PER_RANGE * n_ranges).collect()
    bounds = sorted(set(_quantiles([(x.k, x.t) for x in sample], n_ranges)))
    for _ in range(rounds):
        placed = ranged(rec, bounds)
        totals = _totals(placed)
        mean_b, mean_n = sum(x[1] for x in totals) / n_ranges, sum(x[2] for x in totals) / n_ranges
        full = {r: max(b / mean_b, n / mean_n / 2) for r, b, n in totals if max(b / mean_b, n / mean_n / 2) > OVERFULL}
        if not full:
            break
        share = F.element_at(F.create_map(*[F.lit(x) for r, times in full.items() for x in (r, times / next(b for q, b, _ in totals if q == r))]), F.col("r"))
        inside = placed.filter(F.col("r").isin(list(full))).filter(_fraction("t", "k") < share * F.col("size") * SAMPLES_PER_RANGE)
        found: dict[int, list] = {}
        for x in inside.select("r", "k", "t").distinct().collect():  # about SAMPLES_PER_RANGE keys for each mean range's worth of bytes
            found.setdefault(x.r, []).append((x.k, x.t))
        more = sorted(set(bounds) | {b for r, keys in found.items() for b in _quantiles(keys, int(np.ceil(full[r] * 1.5)))})
        if more == bounds:  # one key, of rows that repeat: nothing to cut at
            break
        bounds = more
    return bounds


def shard(docs: DataFrame, n_shards: int = 8, n_ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: all records in ``n_shards`` shards of nearly equal bytes."""
    spark = docs.sparkSession
    n_ranges = n_ranges or max(8 * n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rec = stored(records(docs), "records")
    bounds = splitters(rec, n_ranges)
    placed = ranged(rec, bounds)
    totals = _totals(placed)
    before, sum_b, sum_n = [], 0, 0
    for r, b, n in totals:
        before.append((r, sum_b, sum_n))
        sum_b, sum_n = sum_b + b, sum_n + n
    offsets = F.broadcast(spark.createDataFrame(before, "r int, b0 long, n0 long"))  # one row for each range
    w = Window.partitionBy("r").orderBy("k", "t", "doc_id", "size", "text_crc32")
    run = placed.withColumn("b1", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n1", F.row_number().over(w))
    middle = 2 * (F.col("b0") + F.col("b1")) - F.col("size")
    group = Window.partitionBy("r", "k")  # sorted so already
    run = run.withColumn("whole", F.sum("size").over(group)).withColumn("ahead", F.min(F.col("b1") - F.col("size")).over(group))
    together = F.col("whole") <= F.lit(rec.agg(F.max("size")).first()[0] or 0)
    run = run.join(offsets, "r").select(
        "doc_id",
        "size",
        "text_crc32",
        F.when(together, 2 * (F.col("b0") + F.col("ahead")) + F.col("whole")).otherwise(middle).alias("middle"),
        (F.col("n0") + F.col("n1") - 1).alias("place"),
    )
    part = F.expr(f"least(middle * {n_shards} div {2 * max(sum_b, 1)}, {n_shards - 1})").cast("int")
    run = stored(run.withColumn("shard", part).drop("middle"), "places")
    starts = F.broadcast(run.groupBy("shard").agg(F.min("place").alias("start")))  # one row for each shard
    return run.join(starts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """Write whole records, range-partitioned by the sampled splitters: a folder per shard (column ``_shard``), its
    ranges as files sorted by key.  A range goes to the shard that its middle byte lies in."""
    n_ranges = max(8 * n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rec = stored(records(docs), "records")
    bounds = splitters(rec, n_ranges)
    totals = _totals(ranged(rec, bounds))
    shard_of, before, total = [], 0, max(sum(b for _, b, _ in totals), 1)
    for r, b, _ in totals:
        shard_of += [r, min(n_shards - 1, (before + b // 2) * n_shards // total)]
        before += b
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    full = ranged(docs.withColumn("_k", F.xxhash64(raw)).withColumn("_t", _second_key("doc_id")), bounds, "_k", "_t", "_r")
    full = full.withColumn("_shard", F.element_at(F.create_map(*map(F.lit, shard_of)), F.col("_r")) if shard_of else F.lit(0))
    full.repartition(n_ranges, "_r").sortWithinPartitions("_shard", "_r", "_k", "_t").drop("_r", "_k", "_t").write.partitionBy("_shard").parquet(path)

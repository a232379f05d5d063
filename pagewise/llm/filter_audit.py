"""Filter interaction audit by contraction of a contingency tensor.

Every document fails or passes five filters.  The documents of a part are
counted by which of them they fail: a 2x2x2x2x2 tensor, beside one of good and
one of toxic documents.  What an order of the filters keeps and removes at each
step is a contraction: along each axis a vector selects pass (filters before),
fail (the step's own) or all (filters after).

Spark makes the masks in one pass over the texts; the counts are aggregated
before and after the joins, so a part, a text or an id with very many rows is a
few rows when it is joined.  A task holds one part's 32 cells at a time.

Defined results: a null text is empty; a null lang is the part of the empty
string; a null doc_id has no smaller id, never fails E and has no labels; rows
that repeat count each; an id is good or toxic if any of its label rows says so;
an empty table gives no rows; other columns are ignored.  Texts are whole.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import stored

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask: bits of the filters A to D that each text fails by itself."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    capitals = F.octet_length("text") - F.octet_length(F.translate("text", _UPPER, ""))
    fails = [
        n < 100,
        100 * F.size(F.array_distinct("words")).cast("long") < 80 * n.cast("long"),
        100 * capitals.cast("long") > 10 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit of each failed filter), n, good, toxic: counts of documents."""
    rows = own_failures(docs).groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows, "audit_rows")
    known, unknown = rows.filter("doc_id is not null"), rows.filter("doc_id is null")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = known.join(firsts, ["digest", "doc_id"], "left")  # both keys: copies of one text are dealt out
    known = known.withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << 4)).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.join(marks, "doc_id", "left").select("part", "mask", "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    unknown = unknown.select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(unknown).groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


def tensor(mask: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(kinds, 2, 2, 2, 2, 2) from counts (kinds x cells); the last five axes are A to E, 1 is failed."""
    out = np.zeros((len(counts), *(2,) * len(FILTERS)), np.int64)
    place = tuple(mask >> i & 1 for i in range(len(FILTERS)))
    for kind, values in enumerate(counts):
        np.add.at(out[kind], place, values)
    return out


def audit(t: np.ndarray) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part's tensor."""

    @cache
    def counted(passed: frozenset, failed: str = "") -> tuple:
        along = [PASS if f in passed else FAIL if f == failed else ALL for f in FILTERS]
        return tuple(np.einsum("xabcde,a,b,c,d,e->x", t, *along).tolist())

    rows, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        for step, f in enumerate(order, 1):
            before = frozenset(order[: step - 1])
            removed, good, toxic = counted(before, f)
            shapley[f] += removed
            fails, alone = counted(frozenset(), f)[0], counted(frozenset(FILTERS) - {f}, f)[0]
            rows.append(("".join(order), step, counted(before | {f})[0], removed, fails - removed, alone, good, toxic))
    return [(*r, shapley[r[0][r[1] - 1]]) for r in rows]


def _part(key: tuple, cells: pa.Table) -> pa.Table:
    counts = np.array([cells[c].to_numpy() for c in ("n", "good", "toxic")])
    rows = [(key[0].as_py(), *r) for r in audit(tensor(cells["mask"].to_numpy(), counts))]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    columns = [c.split() for c in COLUMNS.split(", ")]
    return pa.table([pa.array(v, types[t]) for v, (_, t) in zip(zip(*rows), columns)], names=[c for c, _ in columns])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step."""
    return cells(docs, labels).groupBy("part").applyInArrow(_part, COLUMNS)

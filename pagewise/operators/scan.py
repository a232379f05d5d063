"""Running aggregates and row numbers that survive a hot key.

``Window.partitionBy(key)`` puts every row of one key into one task.  When a
key may hold a third of all rows (one reader's whole log), that task is the
job.  The caller therefore names a bucket: columns that lead the order (the
month of a date, a range of sequence numbers), so that a key's rows fall into
many small groups.  The window runs per (key, bucket); the totals of a key's
buckets, one row each, are turned into an exclusive prefix and joined back.
There is one path whatever the sizes, and building the frame runs no job.

Supported: ``sum`` (over non-NULL inputs), ``min``, ``max`` and ``count``; a
frame is "all preceding rows" with or without the current row.  A suffix
aggregate is a prefix over the reversed order.  NULL keys and NULL buckets are
values like any other.

Buckets cost three more exchanges, of the buckets' totals.  Readers that one
task can hold don't need them: ``crowded`` tells the others by a count under
hashes of their ids, and it too runs no job when a frame is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTED = 1 << 16  # hashes of a reader's id under which rows are counted
CROWDED = 1 << 20  # rows of one hash that one task works on at most

_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def _slot() -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(COUNTED)).cast("int")


def crowded_slots(tables: Sequence[DataFrame]) -> DataFrame:
    """One row, ``slots``: the hashes under which ``tables`` have more than ``CROWDED`` rows together, an array of at most
    ``COUNTED`` numbers."""
    rows = reduce(DataFrame.union, [t.select(_slot().alias("slot")) for t in tables])
    many = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED)
    return many.agg(F.collect_list("slot").alias("slots"))


def crowded(slots: Column) -> Column:
    """Whether a row's reader falls under one of ``slots``; never NULL."""
    return F.array_contains(slots, _slot())


def _combine(kind: str, off: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(off.isNull(), local).when(local.isNull(), off).otherwise(off + local)
    return F.least(off, local) if kind == "min" else F.greatest(off, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    aggs: Sequence[tuple[str, str, Column, bool]],
    buckets: Sequence[tuple[Column | str, str]],
    after: Sequence[tuple[str, str, Column, bool]] = (),
) -> DataFrame:
    """Add running aggregates: each spec is (name, kind, value, include_current).

    ``buckets``: (value, direction) pairs that come before ``order`` in the
    wanted order; direction is a Column method such as ``asc_nulls_last``.  A
    value given by its name is a column that ``order`` needn't name again.
    ``after``: specs whose frame is all rows that follow.

    The key and its buckets are one struct, whose NULL fields equal each
    other: the windows and the join of the totals share one exchange.  Keys and
    named buckets are carried in it once, and not beside it as columns too."""
    keys, names = list(keys), [f"_b{i}" for i in range(len(buckets))]
    both = [(spec, False) for spec in aggs] + [(spec, True) for spec in after]

    def frame(w, inclusive, follows):
        if follows:
            return w.rowsBetween(Window.currentRow if inclusive else 1, Window.unboundedFollowing)
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)

    place = F.struct(*keys, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, (c, _) in zip(names, buckets)]).alias("_place")
    inside = {k: f"_place.{k}" for k in keys} | {c: f"_place.{n}" for n, (c, _) in zip(names, buckets) if isinstance(c, str)}
    local = df.select(*[c for c in df.columns if c not in inside], place, *[v.alias(f"_v_{n}") for (n, _, v, _), _ in both])
    w = Window.partitionBy("_place").orderBy(*order)
    totals = local.groupBy("_place").agg(*[_AGG[kind](f"_v_{n}").alias(f"_t_{n}") for (n, kind, _, _), _ in both])
    line = Window.partitionBy(*[f"_place.{c}" for c in keys]).orderBy(*[getattr(F.col(f"_place.{n}"), how)() for n, (_, how) in zip(names, buckets)])
    join_back = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    offsets = totals.select(
        F.col("_place").alias("_at"),
        *[join_back[kind](f"_t_{n}").over(frame(line, False, follows)).alias(f"_o_{n}") for (n, kind, _, _), follows in both],
    )
    out = local.withColumns({n: _AGG[kind](f"_v_{n}").over(frame(w, inclusive, follows)) for (n, kind, _, inclusive), follows in both})
    out = out.join(offsets, F.col("_place") == F.col("_at"), "left")
    out = out.withColumns({n: _combine(kind, F.col(f"_o_{n}"), F.col(n)) for (n, kind, _, _), _ in both})
    return out.select(*[F.col(inside.get(c, c)).alias(c) for c in df.columns], *[n for (n, *_), _ in both if n not in df.columns])


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: Sequence[tuple[Column | str, str]], name: str = "rn") -> DataFrame:
    """1-based position of each row inside its key group, by buckets and then ``order``.

    Ties in ``order`` are numbered in an arbitrary order, as row_number does."""
    return running(df, keys, order, [(name, "count", F.lit(1), True)], buckets)

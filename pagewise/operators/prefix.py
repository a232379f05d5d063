"""Running page totals from a stored tree of sums, kept up under adds and deletes.

The months of a key (a reader's book, or a reader) are the leaves of a binary
tree: node ``i`` of level ``l`` holds the records of months ``i * 2^l`` up to
``(i + 1) * 2^l``, a month being numbered ``year * 12 + month - 1``.  A month
lies in one node of each of the ``LEVELS`` levels, so a batch of added or
deleted records changes so many nodes for each of its (key, month) and no
other, whatever the length of the log.  The months before month ``m`` are the
disjoint union of one node per set bit of ``m``, so a running total up to a
month is the sum of at most ``LEVELS`` nodes.

Nodes are sums, so a batch is stored as the differences it makes (``parts``:
batches that come twice or are lost half way change nothing) and nodes are
added up when they are read; ``compact`` leaves one row per node and drops
those without records.  A batch of a hot key is reduced to one row per month
before it goes up the tree.

A key of few records would have more nodes than records.  What a batch has of
such a key (``FEW`` records at most) stays one row per
month at level ``LOOSE``, beside the tree; ``compact`` adds up the loose months
and takes those of a key with more than ``FEW`` of them up the tree.

Totals of many months come from a cover of all months by disjoint nodes: the
left sisters on the way to the first one asked for, and every month after it.
A key's months are bounded, so one pass over them in order adds them up.

Deletes are given as the rows that go (``removed``), since a sum can only lose
what it held.  Records without a date stand in the last month, after all
others; NULL readers and books are values of their own; a total is NULL until
the first record with pages, as SUM has it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewise.functions.text import date_text, month_label
from pagewise.operators.lists import expanded
from pagewise.operators.parts import Parts
from pagewise.schema import SHELF_KEY
from pagewise.sources.binding import ReadingLog

LEVELS = 17  # months of the years up to 9999, and one for records without a date
UNDATED = (1 << LEVELS) - 1
LOOSE = -1  # level of months that aren't in the tree
FEW = 32
SUMS = ("pages", "n_pages", "n")  # pages, records with pages, records


def month_number(date: Column | str) -> Column:
    number = F.year(date) * 12 + F.month(date) - 1
    return F.coalesce(number, F.lit(UNDATED)).cast("int")


def removed(record: DataFrame, keys: DataFrame) -> DataFrame:
    """Records that a delete of (user_id, b_isbn, r_date) takes."""
    return record.join(keys.select(*SHELF_KEY, "r_date").distinct(), [*SHELF_KEY, "r_date"], "left_semi")


def _same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join in which NULL keys meet; the columns of ``right`` beside ``on`` are added."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in on})
    return left.join(renamed, [left[c].eqNullSafe(renamed[f"_{c}"]) for c in on], how).drop(*[f"_{c}" for c in on])


class PageTree(Parts):
    """The tree of one name under the shared state root; ``keys``: whose totals run."""

    kind, tables = "prefix", ("nodes",)

    def __init__(self, spark: SparkSession, name: str, keys: Sequence[str] = SHELF_KEY):
        super().__init__(spark, name)
        self.keys = list(keys)

    def merged(self, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
        dealt = parts["nodes"].repartition(*self.keys)  # a key's nodes are bounded, and all that follows works by key
        # what a month has in the tree and beside it add up: records may cancel out in one of the two, and their pages not
        return {"nodes": self._summed(dealt).filter("n <> 0 or pages <> 0 or n_pages <> 0")}

    def packed(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        w, loose = Window.partitionBy(*self.keys), F.col("level") == LOOSE
        many = (F.count(F.when(loose, 1)).over(w) > FEW) | (F.max("level").over(w) > LOOSE)
        return {"nodes": self._summed(self._up(tables["nodes"].withColumn("_up", many & loose))).filter("n <> 0")}

    def _summed(self, nodes: DataFrame) -> DataFrame:
        return nodes.groupBy(*self.keys, "level", "node").agg(*[F.sum(c).alias(c) for c in SUMS])

    def _up(self, nodes: DataFrame) -> DataFrame:
        """Months (rows with ``_up``) become the nodes of all levels that hold them; the other rows stay."""
        path = F.when(F.col("_up"), F.sequence(F.lit(0), F.lit(LEVELS - 1))).otherwise(F.array("level"))
        up = nodes.withColumn("level", F.explode(path))
        return up.withColumn("node", F.when(F.col("_up"), F.expr("shiftright(node, level)")).otherwise(F.col("node"))).drop("_up")

    def apply(self, batch: int, added: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Batch number ``batch``: records that came and records that went."""
        signed = [t.select(*self.keys, "r_date", "r_page", F.lit(sign).cast("long").alias("_s")) for t, sign in ((added, 1), (gone, -1)) if t is not None]
        if not signed:
            raise ValueError("a batch has records that came or records that went")
        rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
        months = rows.groupBy(*self.keys, month_number("r_date").alias("node")).agg(
            F.coalesce(F.sum(F.col("_s") * F.col("r_page")), F.lit(0)).cast("long").alias("pages"),
            F.coalesce(F.sum(F.when(F.col("r_page").isNotNull(), F.col("_s"))), F.lit(0)).alias("n_pages"),
            F.sum("_s").alias("n"),
            F.count(F.lit(1)).alias("_rows"),
        )
        many = F.sum("_rows").over(Window.partitionBy(*self.keys)) > FEW
        months = months.withColumn("level", F.lit(LOOSE)).withColumn("_up", many).drop("_rows")
        self.put(batch, {"nodes": self._summed(self._up(months)).sortWithinPartitions(*self.keys, "level", "node")})

    def nodes(self, only: dict | None = None) -> DataFrame:
        """Nodes with records, and loose months; ``only``: values of key columns, pushed into the scan."""
        nodes = self.read()["nodes"]
        for c, value in (only or {}).items():
            nodes = nodes.filter(F.col(c) == F.lit(value))
        return nodes

    def before(self, asked: DataFrame, only: dict | None = None) -> DataFrame:
        """``asked`` (the keys and a month number _m, each once) and the sums of all earlier months, as _pages, _n_pages, _n."""
        nodes = self.nodes(only)
        bits = asked.withColumn("level", F.explode(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda b: F.getbit("_m", b) == 1)))
        parts = bits.withColumn("node", F.expr("shiftright(_m, level) - 1"))  # the left one of two sisters
        found = _same(parts, nodes, [*self.keys, "level", "node"], "inner").select(*self.keys, "_m", *SUMS)
        loose = nodes.filter(F.col("level") == LOOSE).drop("level")
        found = found.unionByName(_same(asked, loose, self.keys, "inner").filter("node < _m").select(*self.keys, "_m", *SUMS))
        return found.groupBy(*self.keys, "_m").agg(*[F.sum(c).alias(f"_{c}") for c in SUMS])

    def totals(self, start: int = 0, only: dict | None = None) -> DataFrame:
        """Every month with records from ``start`` on: the keys, _m, its own sums, and those of all earlier months as
        _pages, _n_pages, _n (NULL if there are none)."""
        level, node = F.col("level"), F.col("node")
        sisters = [(level == i) & (node == (start >> i) - 1) for i in range(LEVELS) if start >> i & 1]
        cover = reduce(or_, sisters, (level == LOOSE) | ((level == 0) & (node >= start)))
        first = F.when(level == LOOSE, node).otherwise(F.expr("shiftleft(node, level)"))
        held = self.nodes(only).filter(cover).groupBy(*self.keys, first.alias("_m")).agg(*[F.sum(c).alias(c) for c in SUMS])
        w = Window.partitionBy(*self.keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        return held.withColumns({f"_{c}": F.sum(c).over(w) for c in SUMS}).filter((F.col("_m") >= start) & (F.col("n") != 0))

    def record_log(self, log: ReadingLog, user=None, since=None) -> DataFrame:
        """``lists.record_log``; ``since``: from the month of this date on, without a look at earlier records."""
        log = log.for_user(user)
        record = log.record
        start = 0
        if since is not None:
            since = dt.date.fromisoformat(str(since)[:10])
            start = since.year * 12 + since.month - 1
            record = record.filter((F.col("r_date") >= F.lit(since.replace(day=1))) | F.col("r_date").isNull())
        g = record.groupBy(*SHELF_KEY, "r_date", "r_page").agg(F.count(F.lit(1)).alias("_n"))
        place = F.struct(*SHELF_KEY, month_number("r_date").alias("_m"))  # NULLs in it equal each other
        g = g.withColumn("_place", place)
        w = Window.partitionBy("_place").orderBy(F.col("r_date").asc_nulls_last(), F.col("r_page").asc_nulls_last())
        g = g.withColumn("_own", F.sum(F.col("r_page") * F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        earlier = self.totals(start, None if user is None else {"user_id": user})
        earlier = earlier.select(F.struct(*SHELF_KEY, "_m").alias("_at"), F.when(F.col("_n_pages") > 0, F.col("_pages")).alias("_off"))
        g = g.join(earlier, g["_place"] == earlier["_at"], "left")
        g = g.withColumn("_upto", F.coalesce(F.col("_off") + F.col("_own"), "_off", "_own")).drop("_place", "_at", "_off", "_own")
        rows = expanded(g, log.shelf)
        return rows.select("user_id", "b_title", "b_author", date_text("r_date").alias("r_date"), "r_page", "sum_page", "b_page", "b_isbn")

    def monthly_cumulative(self) -> DataFrame:
        """``dashboard.monthly_cumulative`` of a tree keyed by reader: its leaves and what comes before them; no record is read."""
        out = self.totals()
        pages = F.col("pages") + F.coalesce("_pages", F.lit(0))
        some = F.col("n_pages") + F.coalesce("_n_pages", F.lit(0)) > 0
        day = F.when(F.col("_m") != UNDATED, F.make_date(F.expr("_m div 12").cast("int"), F.expr("_m % 12 + 1"), F.lit(1)))
        out = out.select(*self.keys, F.date_format(day, "yyyyMM").alias("dt"), F.when(some, pages).alias("page"))
        return out.select(*self.keys, "dt", month_label("dt").alias("mon"), "page")

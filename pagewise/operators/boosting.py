"""Second-order gradient boosting and bagged trees on sufficient statistics.

The model has two features, category and pages.  Each is cut into at most
``max_bins`` bins (a bin per value where there are no more values), so every
row falls into one of at most ``max_bins ** 2`` cells, and of squared loss a
cell's rows matter only by their count and the sum of their labels.  One Spark
aggregate makes that table, whatever the number of rows; every histogram of
every node of every tree is a sum over its cells, so the rounds need no job.

A tree grows level by level.  A node's rows have gradient sum G and hessian sum
H (of squared loss: the count).  It splits where G_l^2/(H_l+lam) +
G_r^2/(H_r+lam) - G^2/(H+lam) is largest (first feature, lowest bin on a tie),
unless that is too little to count; a leaf adds -eta G/(H+lam).  Predictions are whole
numbers of millionths of a day: sums are exact, so a fit doesn't depend on the
order of rows, and SQL can repeat it.

The trees of two binned features are a table of a prediction per cell: a fitted
model is that table beside the stages that find a row's cell.

Defined results: rows with an unknown feature or label are left out by the
caller; without rows there is nothing to fit and ``fit`` raises; a value
between two known ones goes to the nearer, one beyond them to the last; an
unseen category raises, is skipped, or (``keep``) counts as the last one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BINS = 256
MICRO = 1_000_000  # predictions are whole millionths
LEAST_GAIN = 1e6  # of squared millionths: a gain below 1e-6 doesn't split
FEATURES = ("category_number", "page_number")
BINS = ("category_bin", "page_bin")
#: In a bootstrap a row stands k times with Poisson probability e^-1/k!: the cumulated ones, times 2^32.
POISSON = tuple(math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(11))


def _edges(rows: DataFrame, column: str, max_bins: int) -> list[float]:
    """Boundaries of the bins: half way between neighbouring values, or between quantiles where there are more values."""
    values = [r[0] for r in rows.select(column).distinct().limit(max_bins + 1).collect()]
    if len(values) > max_bins:
        values = rows.agg(F.percentile_approx(column, [(i + 0.5) / max_bins for i in range(max_bins)], 100 * max_bins)).first()[0]
    values = sorted(set(map(float, values)))
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def _cell_stages(train: DataFrame, max_bins: int, handle_invalid: str) -> PipelineModel:
    """The stages that give a row its two bins."""
    indexer = StringIndexer(inputCol="b_category", outputCol="b_category_encoded", stringOrderType="alphabetAsc", handleInvalid=handle_invalid)
    numbers = SQLTransformer(statement=f"SELECT *, b_category_encoded + 0.0D AS {FEATURES[0]}, b_page + 0.0D AS {FEATURES[1]} FROM __THIS__")
    prepared = Pipeline(stages=[indexer, numbers]).fit(train)
    rows = prepared.transform(train)
    inf = float("inf")
    # one bin needs two halves, too: nothing lies beyond the largest number
    splits = [[-inf, *(_edges(rows, c, max_bins) or [1.7e308]), inf] for c in FEATURES]
    return PipelineModel(stages=[*prepared.stages, Bucketizer(inputCols=list(FEATURES), outputCols=list(BINS), splitsArray=splits)])


def _shape(stages: PipelineModel) -> tuple[int, int]:
    return tuple(len(s) - 1 for s in stages.stages[-1].getSplitsArray())


def _sums(rows: DataFrame, label: str, weight: Column, *by: str) -> DataFrame:
    """n and the label sum of each cell: at most max_bins ** 2 rows."""
    return rows.groupBy(*by, *[F.col(b).cast("int").alias(b) for b in BINS]).agg(F.sum(weight).cast("long").alias("n"), F.sum(weight * F.col(label)).cast("long").alias("s"))


def _dense(cells: pa.Table, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and label sums (in millionths) of every cell of the grid, as exact doubles."""
    place = np.ravel_multi_index([cells[b].to_numpy() for b in BINS], shape)
    out = np.zeros((2, shape[0] * shape[1]))
    out[0, place], out[1, place] = cells["n"].to_numpy(), cells["s"].to_numpy() * float(MICRO)
    return out[0], out[1]


def grown(g: np.ndarray, h: np.ndarray, shape: tuple[int, int], depth: int, lam: float) -> np.ndarray:
    """The node (0 to 2 ** depth - 1) in which a tree on the grid's gradient and hessian sums puts each cell.

    A node that doesn't split passes its cells on to its first child."""
    bins = np.unravel_index(np.arange(len(g)), shape)
    node = np.zeros(len(g), np.int64)
    for level in range(depth):
        k = 1 << level
        best, feature, cut = np.full(k, LEAST_GAIN), np.zeros(k, np.int64), np.full(k, max(shape))
        for f, (b, size) in enumerate(zip(bins, shape)):
            at = node * size + b
            gl, hl = (np.bincount(at, x, k * size).reshape(k, size).cumsum(axis=1) for x in (g, h))
            gt, ht = gl[:, -1:], hl[:, -1:]
            gr, hr = gt - gl, ht - hl
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((hl > 0) & (hr > 0), gl * gl / (hl + lam) + gr * gr / (hr + lam) - gt * gt / (ht + lam), -np.inf)
            top = gain.argmax(axis=1)
            value = gain[np.arange(k), top]
            better = value > best
            best[better], feature[better], cut[better] = value[better], f, top[better]
        own = np.where(feature[node] == 0, bins[0], bins[1])
        node = 2 * node + (own > cut[node])
    return node


def leaves(g: np.ndarray, h: np.ndarray, node: np.ndarray, depth: int, eta: float, lam: float) -> np.ndarray:
    """What each cell's leaf adds, in whole millionths."""
    gs, hs = (np.bincount(node, x, 1 << depth) for x in (g, h))
    return np.floor(-eta * gs / np.where(hs > 0, hs + lam, 1) + 0.5)[node]


class CellModel:
    """A prediction for each cell, and the stages that find a row's cell."""

    def __init__(self, stages: PipelineModel, grid: DataFrame):
        self.stages, self.grid = stages, grid

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` and prediction; the grid has at most MAX_BINS ** 2 rows."""
        placed = self.stages.transform(rows)
        for b in BINS:
            placed = placed.withColumn(b, F.col(b).cast("int"))
        out = placed.join(F.broadcast(self.grid), list(BINS), "left")
        return out.select(*rows.columns, (F.col("micro") / MICRO).alias("prediction"))

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        self.grid.coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellModel:
        return cls(PipelineModel.load(f"{path}/stages"), spark.read.parquet(f"{path}/grid"))


def _grid(spark: SparkSession, micro: np.ndarray, shape: tuple[int, int]) -> DataFrame:
    a, b = np.unravel_index(np.arange(len(micro)), shape)
    return spark.createDataFrame(pa.table({BINS[0]: a.astype(np.int32), BINS[1]: b.astype(np.int32), "micro": micro.astype(np.int64)}))


@dataclass(frozen=True)
class Boosted:
    """Boosted trees: each fits the second-order step of squared loss; lam 0 is plain gradient boosting."""

    rounds: int = 100
    depth: int = 6
    eta: float = 0.3
    lam: float = 1.0
    max_bins: int = MAX_BINS

    def boost(self, n: np.ndarray, s: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Predictions of all cells in whole millionths, from their counts and label sums."""
        pred = np.full(len(n), np.floor(s.sum() / n.sum() + 0.5))
        for _ in range(self.rounds):
            g = n * pred - s
            pred = pred + leaves(g, n, grown(g, n, shape, self.depth, self.lam), self.depth, self.eta, self.lam)
        return pred

    def fit(self, rows: DataFrame, label: str, handle_invalid: str = "error") -> CellModel:
        stages = _cell_stages(rows, self.max_bins, handle_invalid)
        shape = _shape(stages)
        n, s = _dense(_sums(stages.transform(rows), label, F.lit(1)).toArrow(), shape)
        if not n.any():
            raise ValueError("no rows to fit")
        return CellModel(stages, _grid(rows.sparkSession, self.boost(n, s, shape), shape))


def bootstrap(key: Column, tree: Column, seed: int) -> Column:
    """How often a row stands in a tree's sample: Poisson(1) by a hash, the same wherever the row lies."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), tree.cast("string"), F.lit(":"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return sum((F.when(h >= t, 1).otherwise(0) for t in POISSON), F.lit(0))


@dataclass(frozen=True)
class Forest:
    """Bagged trees, each fitted in a task of its own on its cells; the prediction is their mean."""

    trees: int = 20
    depth: int = 5
    seed: int = 1
    key: str = "b_isbn"
    max_bins: int = MAX_BINS

    def fit(self, rows: DataFrame, label: str, handle_invalid: str = "error") -> CellModel:
        stages = _cell_stages(rows, self.max_bins, handle_invalid)
        shape, depth, trees = _shape(stages), self.depth, self.trees
        drawn = stages.transform(rows).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        drawn = drawn.withColumn("w", bootstrap(F.col(self.key), F.col("tree"), self.seed)).filter("w > 0")

        def one(cells: pa.Table) -> pa.Table:
            n, s = _dense(cells, shape)
            a, b = np.unravel_index(np.arange(len(n)), shape)
            micro = leaves(-s, n, grown(-s, n, shape, depth, 0.0), depth, 1.0, 0.0)
            return pa.table({BINS[0]: a.astype(np.int32), BINS[1]: b.astype(np.int32), "micro": micro.astype(np.int64)})

        grids = _sums(drawn, label, F.col("w"), "tree").groupBy("tree").applyInArrow(one, f"{BINS[0]} int, {BINS[1]} int, micro long")
        # a tree without rows has no say
        grid = grids.groupBy(*BINS).agg(F.floor(F.sum("micro") / F.count(F.lit(1)) + 0.5).alias("micro"))
        return CellModel(stages, rows.sparkSession.createDataFrame(grid.toArrow()))  # one row per cell

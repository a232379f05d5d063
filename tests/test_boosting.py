"""Boosted and bagged trees on cells, against plain loops over the rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewise.operators import ml
from pagewise.operators.boosting import MICRO, POISSON, Boosted, CellModel, Forest, grown


def tree_rows(rows, g, h, depth, lam):
    """Leaf of each row, by trying every split of every node on the rows themselves; rows: (x0, x1)."""
    leaf = [0] * len(rows)
    for _ in range(depth):
        after = leaf[:]
        for node in set(leaf):
            own = [i for i in range(len(rows)) if leaf[i] == node]
            whole = lambda ids: (sum(g[i] for i in ids), sum(h[i] for i in ids))
            part = lambda ids: (lambda a, b: a * a / (b + lam))(*whole(ids))
            best = (1e6, None)
            for f in (0, 1):
                for cut in sorted({rows[i][f] for i in own})[:-1]:
                    left, right = [i for i in own if rows[i][f] <= cut], [i for i in own if rows[i][f] > cut]
                    gain = part(left) + part(right) - part(own)
                    if gain > best[0]:
                        best = (gain, (f, cut))
            for i in own:
                after[i] = 2 * node + (best[1] is not None and rows[i][best[1][0]] > best[1][1])
        leaf = after
    return leaf


def boost_rows(rows, y, m: Boosted):
    pred = [math.floor(sum(y) * MICRO / len(y) + 0.5)] * len(y)
    for _ in range(m.rounds):
        g = [p - v * MICRO for p, v in zip(pred, y)]
        leaf = tree_rows(rows, g, [1] * len(y), m.depth, m.lam)
        for node in set(leaf):
            own = [i for i, x in enumerate(leaf) if x == node]
            w = math.floor(-m.eta * sum(g[i] for i in own) / (len(own) + m.lam) + 0.5)
            for i in own:
                pred[i] += w
    return [p / MICRO for p in pred]


def table(spark, rows, y):
    data = [(i, f"c{a}", b, v, "train") for i, ((a, b), v) in enumerate(zip(rows, y))]
    return spark.createDataFrame(data, "b_isbn long, b_category string, b_page int, total_days int, split string")


def made(n=120, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 5), rng.choice([10, 20, 35, 36, 90])) for _ in range(n)]
    return rows, [a * 7 + b // 3 + rng.randint(0, 9) for a, b in rows]


@pytest.mark.parametrize("model", [Boosted(3, 3), Boosted(4, 2, 0.01, 0.0), Boosted(1, 5, 1.0, 0.0)])
def test_boosting_on_cells_equals_boosting_on_rows(spark, model):
    rows, y = made()
    df = table(spark, rows, y)
    got = {r.b_isbn: r.prediction for r in model.fit(df, "total_days").transform(df).collect()}
    assert [got[i] for i in range(len(y))] == boost_rows(rows, y, model)
    again = {r.b_isbn: r.prediction for r in model.fit(df.repartition(7), "total_days").transform(df).collect()}
    assert got == again


def test_forest_on_cells_equals_forest_on_rows(spark):
    rows, y = made(400)
    df = table(spark, rows, y)
    m = Forest(trees=4, depth=3)
    got = {r.b_isbn: r.prediction for r in m.fit(df, "total_days").transform(df).collect()}
    total = np.zeros(len(y))
    for t in range(4):
        draw = lambda i: sum(int(hashlib.md5(f"1:{t}:{i}".encode()).hexdigest()[:8], 16) >= x for x in POISSON)  # noqa: B023, E731
        w = [draw(i) for i in range(len(y))]
        own = [i for i in range(len(y)) if w[i]]
        leaf = tree_rows([rows[i] for i in own], [-w[i] * y[i] * MICRO for i in own], [w[i] for i in own], 3, 0.0)
        mean = {n: math.floor(sum(w[i] * y[i] * MICRO for i, x in zip(own, leaf) if x == n) / sum(w[i] for i, x in zip(own, leaf) if x == n) + 0.5) for n in set(leaf)}
        cell = {rows[i]: mean[x] for i, x in zip(own, leaf)}
        assert set(cell) == set(rows)  # each cell was drawn in each tree, so rows alone tell its leaf
        total += [cell[r] for r in rows]
    assert [got[i] for i in range(len(y))] == [math.floor(x / 4 + 0.5) / MICRO for x in total]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(-50, 50)), min_size=1, max_size=25), st.sampled_from([0.0, 1.0]))
def test_grown_tree(rows, lam):
    g, h = np.zeros(20), np.zeros(20)
    for a, b, x in rows:
        g[a * 5 + b] += x * MICRO
        h[a * 5 + b] += 1
    node = grown(g, h, (4, 5), 3, lam)
    assert [int(node[a * 5 + b]) for a, b, _ in rows] == tree_rows([r[:2] for r in rows], [r[2] * MICRO for r in rows], [1] * len(rows), 3, lam)


def test_more_values_than_bins(spark):
    rows = [(i % 40, i) for i in range(2000)]
    y = [b // 100 for _, b in rows]
    df = table(spark, rows, y)
    model = Boosted(30, 4, max_bins=16).fit(df, "total_days")
    assert model.grid.count() <= 16 * 16
    m = ml.regression_metrics(model.transform(df)).first()
    assert m.r2 > 0.95


def test_one_value_each_and_unseen_values(spark):
    df = table(spark, [(1, 50)] * 5, [4, 4, 4, 4, 9])
    model = Boosted().fit(df, "total_days")
    asked = spark.createDataFrame([("c1", 1), ("c1", 50), ("c1", 10**9)], "b_category string, b_page int")
    assert [r.prediction for r in model.transform(asked).collect()] == [5.0] * 3
    with pytest.raises(ValueError):
        Boosted().fit(df.limit(0), "total_days")
    two = table(spark, [(0, 10), (0, 20), (1, 10), (1, 20)], [0, 10, 100, 110])
    exact = Boosted(1, 2, 1.0, 0.0)
    kept = exact.fit(two, "total_days", "keep")
    asked = spark.createDataFrame([("c0", 14), ("c0", 15), ("zz", 99)], "b_category string, b_page int")
    assert [r.prediction for r in kept.transform(asked).orderBy("b_page").collect()] == [0.0, 10.0, 110.0]
    with pytest.raises(Exception):
        exact.fit(two, "total_days").transform(asked).collect()


def test_saved_model_is_the_same(spark, tmp_path):
    rows, y = made()
    df = table(spark, rows, y)
    model = Forest(3).fit(df, "total_days")
    path = ml.save_model(spark, model)
    again = ml.load_model(path)
    assert isinstance(again, CellModel)
    assert sorted(map(tuple, again.transform(df).collect())) == sorted(map(tuple, model.transform(df).collect()))


def test_a_fit_runs_few_jobs(spark):
    """The rounds run none: as many jobs for one round as for fifty."""
    rows, y = made()
    df = table(spark, rows, y)
    tracker, used = spark.sparkContext.statusTracker(), []
    for rounds in (1, 50):
        spark.sparkContext.setJobGroup(f"rounds {rounds}", "fit")
        Boosted(rounds).fit(df, "total_days")
        used.append(len(tracker.getJobIdsForGroup(f"rounds {rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert used[0] == used[1]


def test_compare_models(spark):
    rows, y = made(200)
    df = table(spark, rows, y).withColumn("split", F.when(F.col("b_isbn") % 2 == 0, "train").otherwise("test"))
    got = {r.model: r for r in ml.compare_models(df).collect()}
    assert set(got) == {"linear", "random_forest", "gbt_500", "gbt_100"} and all(r.n == 100 and r.r2 > 0.5 for r in got.values())

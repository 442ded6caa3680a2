"""The forest's tasks stream: no group of rows is handed to Python whole, and one level or one tree is held at a time."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from qanat.operators import forest


def cells_of(values, weights):
    return [(*(None if np.isnan(x) else int(x) for x in row), int(n)) for row, n in zip(values, weights)]


def test_levels_take_little_memory():
    rng = np.random.default_rng(1)
    n = 200_000
    columns = [rng.integers(0, 100, n).astype(np.int8) for _ in forest.FEATURES]
    weights = np.ones(n, np.int8)
    tracemalloc.start()
    nodes = sum(len(level["node"]) for level in forest.grow_levels(columns, [1.0] * 6, weights, np.random.default_rng([1, 1])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert nodes > n / 4 and peak < 200 * n


def test_streamed_forest_equals_its_trees(spark):
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(-3, 300, (400, 6)).astype(float), axis=0)
    values[rng.random(values.shape) < 0.01] = np.nan
    weights = rng.integers(1, 9, len(values)).astype(float)
    schema = ", ".join(f"{c} long" for c in (*forest.CELL, "n"))
    cells = spark.createDataFrame(cells_of(values, weights), schema)
    nodes = forest.fit_forest(cells, n_trees=7, trees_per_task=3)
    scores = forest.cell_scores(cells, nodes, F.lit(float(weights.sum())), n_trees=7, trees_per_task=3)
    for df in (nodes, scores):
        assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()

    points = values * np.array([forest.GRID if f.startswith("log_") else 1.0 for f in forest.FEATURES])
    trees = [forest.grow_tree(points, weights, np.random.default_rng([forest.SEED, t])) for t in range(7)]
    found = nodes.toPandas()
    for t, tree in enumerate(trees):
        mine = found[found["tree"] == t].sort_values("node")
        for column in ("node", "feature", "threshold", "left", "right", "path"):
            assert mine[column].tolist() == tree[column].tolist()
    mean = np.round(sum(forest.walk(points, t) for t in trees) / 7, 9)
    norm = float(forest.expected_path(weights.sum()))
    want = {tuple(c[:6]): 2 ** (-m / norm) for c, m in zip(cells_of(values, weights), mean)}
    got = {tuple(r)[:6]: r["score"] for r in scores.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

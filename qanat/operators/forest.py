"""Isolation forest over weighted cells, grown and applied by tasks that each hold a few trees.

Every tree sees every payment: features are laid on a grid, equal grid cells are folded into one row
with a weight, and trees split cells. The table a task receives is the table of occupied cells, whose
size nothing bounds: it grows with the distinct values that occur. A task holds it in the smallest whole
numbers that fit, hands a tree on level by level and walks one tree at a time. Rare single rows (one
duplicate, one night payment) keep a cell of their own. The model is a table of nodes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anomaly import FEATURES
from .skew import spread_join

# The tree functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

N_TREES, SEED, TREES_PER_TASK = 300, 42, 10
GRID = 0.05  # width of a cell along the two logarithms; the other features are whole numbers
CELL = [f"c_{f}" for f in FEATURES]
CELLS = ", ".join(f"{c} long" for c in CELL)
BLOCK = 1 << 16  # nodes, cells or rows handled at once
WALKED = {"feature": np.int8, "threshold": np.float64, "left": np.int32, "right": np.int32, "path": np.float64}
NODES = "task int, tree int, node int, feature int, threshold double, left int, right int, path double"


def with_cells(frame: DataFrame, grid: float = GRID) -> DataFrame:
    def cell(f: str) -> Column:
        value = F.round(F.col(f) / grid) if f.startswith("log_") else F.col(f)
        return value.cast("long").alias(f"c_{f}")

    return frame.select("*", *[cell(f) for f in FEATURES])


def cell_table(frame: DataFrame, grid: float = GRID) -> DataFrame:
    """Occupied cells with the number of payments in each."""
    return with_cells(frame, grid).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points (0 for one point, 1 for two)."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long_path = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long_path))


def grow_levels(columns: Sequence[np.ndarray], scales: Sequence[float], weights: np.ndarray, rng: np.random.Generator) -> Iterator[dict]:
    """The nodes of one tree, level by level: all open nodes of a level are split together, and no level is kept.

    A level's numbers are drawn in blocks of nodes; the generator gives the same numbers in one block or many."""
    limit = math.ceil(math.log2(max(weights.sum(dtype=float), 2)))
    order = np.arange(len(weights), dtype=np.int32 if len(weights) < 2**31 else np.int64)  # cells, node by node
    starts, first = np.zeros(1, np.int64), 0

    def values(f: int, rows: np.ndarray) -> np.ndarray:
        return columns[f][rows] * scales[f]

    for depth in range(limit + 1):
        k, ends = len(starts), np.append(starts[1:], len(order))
        sizes = np.add.reduceat(weights[order], starts, dtype=float)
        feature, lo, hi = np.full(k, -1, np.int8), np.zeros(k), np.zeros(k)
        for b in range(0, k if depth < limit else 0, BLOCK):
            e = min(b + BLOCK, k)
            rows, inside = order[starts[b] : ends[e - 1]], starts[b:e] - starts[b]
            low, high = np.empty((e - b, len(columns))), np.empty((e - b, len(columns)))
            for f in range(len(columns)):
                column = values(f, rows)
                low[:, f], high[:, f] = np.minimum.reduceat(column, inside), np.maximum.reduceat(column, inside)
            splittable = (high > low) & (sizes[b:e] > 1)[:, None]
            # A random splittable feature of each inner node.
            draw = np.where(splittable, rng.random(splittable.shape), -1.0)
            inner, best, pick = splittable.any(axis=1), draw.argmax(axis=1), np.arange(e - b)
            feature[b:e] = np.where(inner, best, -1)
            lo[b:e], hi[b:e] = low[pick, best], high[pick, best]
        inner = feature >= 0
        n_inner, fresh = int(inner.sum()), first + k
        threshold, left = np.zeros(k), np.full(k, -1, np.int64)
        if n_inner:  # and a random threshold inside its range
            lo, hi = lo[inner], hi[inner]
            cut = lo + rng.random(n_inner) * (hi - lo)
            threshold[inner] = np.where(cut >= hi, lo, cut)
            left[inner] = fresh + 2 * np.arange(n_inner)
        yield {
            "node": np.arange(first, fresh), "feature": feature, "threshold": threshold, "left": left,
            "right": np.where(inner, left + 1, -1), "path": depth + expected_path(sizes),
        }
        if not n_inner:
            return
        lengths = ends - starts
        rows, lengths = order[np.repeat(inner, lengths)], lengths[inner]
        by, goes_left = np.repeat(feature[inner], lengths), np.zeros(len(rows), bool)
        cuts = np.repeat(threshold[inner], lengths)
        for f in range(len(columns)):
            mine = np.flatnonzero(by == f)
            goes_left[mine] = values(f, rows[mine]) <= cuts[mine]
        child = np.repeat(2 * np.arange(n_inner, dtype=order.dtype), lengths) + ~goes_left
        place = np.argsort(child, kind="stable")
        order, child = rows[place], child[place]
        starts = np.flatnonzero(np.append(True, child[1:] != child[:-1]))
        first = fresh


def grow_tree(values: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """One whole tree."""
    levels = grow_levels(list(values.T), [1.0] * values.shape[1], weights, rng)
    return pd.concat([pd.DataFrame(level) for level in levels], ignore_index=True)


def _narrow(column: pa.Array) -> np.ndarray:
    """Whole numbers in the smallest type that holds them; with a NULL among them as doubles, NULL as NaN."""
    if column.null_count:
        return column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    values = column.to_numpy(zero_copy_only=False)
    for kind in (np.int8, np.int16, np.int32):
        if not len(values) or (np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max):
            return values.astype(kind)
    return values.copy()


def _runs(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The pieces of a sorted batch with equal keys; a NULL key is -1."""
    found = [batch.column(k).fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
    new = np.zeros(batch.num_rows, bool)
    for column in found:
        new[1:] |= column[1:] != column[:-1]
    starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for start, end in zip(starts, starts[1:]):
        if end > start:
            yield tuple(int(c[start]) for c in found), batch.slice(start, end - start)


def _joined(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(column) for column in zip(*pieces)]


def _scales(grid: float) -> list[float]:
    return [grid if f.startswith("log_") else 1.0 for f in FEATURES]


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _batch(columns: Mapping[str, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """NaN in a column of whole numbers is NULL."""
    arrays = [pa.array(columns[f.name], from_pandas=pa.types.is_integer(f.type)).cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _per_task(cells: DataFrame, n_tasks: int) -> DataFrame:
    return cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1))).alias("task"))


def n_tasks(n_trees: int, trees_per_task: int) -> int:
    return -(-n_trees // trees_per_task)


def fit_forest(
    cells: DataFrame, n_trees: int = N_TREES, seed: int = SEED, grid: float = GRID, trees_per_task: int = TREES_PER_TASK
) -> DataFrame:
    """Node table of the forest. A tree depends on the cells, the seed and its own number only."""

    schema = _arrow_schema(NODES)

    def trees(task: int, columns: list[np.ndarray], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t in range(task * trees_per_task, min((task + 1) * trees_per_task, n_trees)):
            for level in grow_levels(columns, _scales(grid), weights, np.random.default_rng([seed, t])):
                for b in range(0, len(level["node"]), BLOCK):
                    part = {n: v[b : b + BLOCK] for n, v in level.items()}
                    size = len(part["node"])
                    yield _batch({"task": np.full(size, task), "tree": np.full(size, t), **part}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, []
        for batch in batches:
            for (task,), rows in _runs(batch, "task"):
                if task != now and pieces:
                    *columns, weights = _joined(pieces)
                    pieces = []
                    yield from trees(now, columns, weights)
                now = task
                pieces.append([_narrow(rows.column(c)) for c in (*CELL, "n")])
        if pieces:
            *columns, weights = _joined(pieces)
            pieces = []
            yield from trees(now, columns, weights)

    tasks = n_tasks(n_trees, trees_per_task)
    return _per_task(cells, tasks).repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(run, NODES)


def walk(points: np.ndarray, tree: pd.DataFrame | Mapping[str, np.ndarray]) -> np.ndarray:
    """Path length of every point in one tree."""
    t = {c: np.asarray(tree[c]) for c in WALKED}
    at = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    while len(rows):
        here = at[rows]
        inner = t["feature"][here] >= 0
        rows, here = rows[inner], here[inner]
        goes_left = points[rows, t["feature"][here]] <= t["threshold"][here]
        at[rows] = np.where(goes_left, t["left"][here], t["right"][here])
    return t["path"][at]


def cell_scores(cells: DataFrame, forest: DataFrame, sample_size: Column, grid: float = GRID,
                n_trees: int = N_TREES, trees_per_task: int = TREES_PER_TASK) -> DataFrame:
    """Score of each distinct cell: 2^(-mean path / expected path of the training size)."""

    scales, schema = np.array(_scales(grid)), _arrow_schema(f"{CELLS}, path double")

    def add_tree(columns: list[np.ndarray], total: np.ndarray, nodes: list[list[np.ndarray]]) -> None:
        tree = dict(zip(WALKED, _joined(nodes)))
        for b in range(0, len(total), BLOCK):
            points = np.column_stack([c[b : b + BLOCK] for c in columns]).astype(float) * scales
            total[b : b + BLOCK] += walk(points, tree)

    def sums(columns: list[np.ndarray], total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in range(0, len(total), BLOCK):
            yield _batch({c: v[b : b + BLOCK] for c, v in zip((*CELL, "path"), (*columns, total))}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every task first its cells, then its trees one after the other: one tree is held at a time."""
        now, cell_pieces, nodes, columns, total = (None, None), [], [], None, None
        for batch in batches:
            for key, rows in _runs(batch, "task", "tree"):
                if key != now:
                    if nodes and columns is not None:
                        add_tree(columns, total, nodes)
                    nodes = []
                    if key[0] != now[0]:
                        if columns is not None:
                            yield from sums(columns, total)
                        cell_pieces, columns, total = [], None, None
                    now = key
                if key[1] < 0:
                    cell_pieces.append([_narrow(rows.column(c)) for c in CELL])
                    continue
                if cell_pieces:
                    columns, cell_pieces = _joined(cell_pieces), []
                    total = np.zeros(len(columns[0]))
                if columns is not None:
                    nodes.append([rows.column(c).to_numpy(zero_copy_only=False).astype(WALKED[c]) for c in WALKED])
        if columns is not None:
            add_tree(columns, total, nodes)
            yield from sums(columns, total)

    tasks = n_tasks(n_trees, trees_per_task)
    columns = [c.split() for c in f"{CELLS}, {NODES}".split(", ")]
    parts = [
        frame.select(*[(F.col(n) if n in frame.columns else F.lit(None)).cast(kind).alias(n) for n, kind in columns])
        for frame in (_per_task(cells.select(*CELL), tasks), forest)
    ]
    dealt = parts[0].unionByName(parts[1]).repartition(tasks, "task")
    dealt = dealt.sortWithinPartitions("task", F.col("tree").asc_nulls_first(), "node")
    paths = dealt.mapInArrow(run, f"{CELLS}, path double")
    n = sample_size.cast("double")
    long_path = 2.0 * (F.ln(n - 1.0) + F.lit(float(np.euler_gamma))) - 2.0 * (n - 1.0) / n
    norm = F.when(n <= 2, F.lit(1.0)).otherwise(long_path)
    mean = F.round(F.sum("path") / F.lit(float(n_trees)), 9)  # the same in any order of summation
    return paths.groupBy(*CELL).agg(mean.alias("_mean")).select(
        *CELL, F.pow(F.lit(2.0), -F.col("_mean") / norm).alias("score")
    )


def score(frame: DataFrame, forest: DataFrame, sample_size: Column, grid: float = GRID,
          n_trees: int = N_TREES, trees_per_task: int = TREES_PER_TASK) -> DataFrame:
    """Every payment with its score. Each distinct cell walks the forest once; the common cell of ordinary
    payments is a hot join key and is spread."""
    placed = with_cells(frame, grid)
    scores = cell_scores(placed.select(*CELL).distinct(), forest, sample_size, grid, n_trees, trees_per_task)
    return spread_join(placed, scores, CELL, "payment_id", how="inner").drop(*CELL)

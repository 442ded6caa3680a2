"""Embedding near-dedup: an exact metric range join by pivots.

On unit vectors a cosine of at least c means a distance of at most r = sqrt(2 - 2c). A bounded sample of vectors serves
as pivots; a vector's home is the cell of its nearest pivot p. It is also copied to every cell q that may hold a partner:
by the triangle inequality a partner at home in q has d(x, q) <= d(x, p) + 2r, and by the plane between both pivots
d(x, q)^2 - d(x, p)^2 <= 2 r d(p, q). So every pair meets in the home cell of each side, and cells join independently;
a pair of two homes is looked at in the cell with the smaller number only. A cell is cut into blocks of home rows times
blocks of all its rows, so one dense cell is many bounded tasks.

A block counts the partners of its rows and passes on a star for each of its connected parts instead of all pairs;
the stars of all blocks connect what the pairs would connect. Copies of a vector are one class with a number of ids.

Vectors without direction (see vectors.valid) link with nothing: n_links 0 and a component of their own, as have vectors
of a length that no other has. Rows with a null key are left out; repeated rows count once. Empty tables give empty
results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, forest
from .vectors import classes, matrix, unit, valid

COSINE = 0.9
CELL_ROWS, MAX_PIVOTS = 8_192, 256
HOME_BLOCK, BLOCK = 8_192, 32_768
STEP = 512


def linked(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, cosine: float) -> np.ndarray:
    """[x, y] whether the cosine of the rows reaches the limit; u.: the same rows at unit length, in single precision.

    Single precision decides what lies farther from the limit than its own error; the rest is computed in double."""
    near = ux @ uy.T
    hit = near >= cosine
    doubt = 2e-7 * (x.shape[1] + 8)
    i, j = np.nonzero(np.abs(near - np.float32(cosine)) <= doubt)
    for k in range(0, len(i), 100_000):
        a, b = x[i[k : k + 100_000]], y[j[k : k + 100_000]]
        norms = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        hit[i[k : k + 100_000], j[k : k + 100_000]] = (a * b).sum(1) / norms >= cosine
    return hit


def cells_of(u: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit row, and [row, cell] whether it must be in that cell: its home or one of a smaller number."""
    square = np.maximum(2 - 2 * u @ pivots.T, 0)
    home = square.argmin(1)
    own = square[np.arange(len(u)), home][:, None]
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    slack = 1e-9
    near = (np.sqrt(square) <= np.sqrt(own) + 2 * radius + slack) & (square - own <= 2 * radius * between + slack)
    near &= np.arange(len(pivots)) <= home[:, None]  # the other side of a pair comes to the smaller cell
    near[np.arange(len(u)), home] = True
    return home, near


def join(df: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for every key of df; see the module."""
    rows = valid(df, key, vector)
    points = cut(classes(rows, 1).select("h1", "h2", "rep", "n"))
    own = rows.select(F.col("id").alias("rep"), "h1", "h2", "v").dropDuplicates(["rep", "h1", "h2"]).join(points, ["rep", "h1", "h2"])
    own = cut(own.select("rep", "n", F.size("v").alias("dim"), "v"))
    radius = float(np.sqrt(2 - 2 * cosine))
    number = own.count()
    pivots: dict[int, np.ndarray] = {}
    for row in own.orderBy(F.xxhash64("rep"), "rep").limit(min(MAX_PIVOTS, max(1, -(-number // CELL_ROWS)))).collect():
        pivots.setdefault(row.dim, []).append(row.v)
    pivots = {d: unit(np.array(v)) for d, v in pivots.items()}

    def placed(batch):
        """(row, home, near) by dimension; a dimension without a pivot has one cell."""
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            u = unit(matrix(batch.column("v").take(pa.array(at))))
            own_pivots = pivots.get(int(d), np.eye(1, int(d)))
            yield at, int(d), *cells_of(u, own_pivots, radius)

    def sizes(batches):
        for batch in batches:
            for _, d, home, near in placed(batch):
                homes, alls = np.bincount(home, minlength=near.shape[1]), near.sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(homes), pa.int32()), pa.array(np.arange(len(homes), dtype=np.int32)), pa.array(homes), pa.array(alls)], ["dim", "cell", "homes", "alls"])

    held = own.mapInArrow(sizes, "dim int, cell int, homes long, alls long").groupBy("dim", "cell").agg(F.sum("homes"), F.sum("alls")).collect()
    blocks = {(r[0], r[1]): (max(1, -(-r[2] // HOME_BLOCK)), max(1, -(-r[3] // BLOCK))) for r in held}  # a row for each pivot

    def dealt(batches):
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            for at, d, home, near in placed(batch):
                out = []
                for cell in range(near.shape[1]):
                    if (d, cell) not in blocks:
                        continue
                    na, nb = blocks[d, cell]
                    here = np.flatnonzero(home == cell)
                    for a in range(na):
                        mine = here[reps[at[here]] % na == a]
                        out += [(at[mine], cell, a, b, True) for b in range(nb)]
                    here = np.flatnonzero(near[:, cell])
                    for b in range(nb):
                        mine = here[(reps[at[here]] // 7) % nb == b]
                        out += [(at[mine], cell, a, b, False) for a in range(na)]
                homes = np.empty(batch.num_rows, np.int64)
                homes[at] = home
                for which, cell, a, b, is_home in out:
                    if len(which):
                        part = batch.take(pa.array(which))
                        n = len(which)
                        extra = [pa.array(np.full(n, x, np.int32)) for x in (cell, a, b)] + [pa.array(np.full(n, is_home)), pa.array(homes[which] == cell)]
                        yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, "cell", "a", "b", "home", "own"])

    pairs = own.mapInArrow(dealt, "rep long, n long, dim int, v array<double>, cell int, a int, b int, home boolean, own boolean")

    def met(table: pa.Table) -> pa.Table:
        is_home = table.column("home").to_numpy()
        left, right = table.filter(pa.array(is_home)), table.filter(pa.array(~is_home))
        if not len(left) or not len(right):
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        x, y = matrix(left.column("v")), matrix(right.column("v"))
        ux, uy = unit(x).astype(np.float32), unit(y).astype(np.float32)
        n, weight = right.column("n").to_numpy(), left.column("n").to_numpy()
        visits = ~right.column("own").to_numpy()
        ids, others = left.column("rep").to_numpy(), right.column("rep").to_numpy()
        links, back, stars_a, stars_b = np.zeros(len(ids), np.int64), np.zeros(len(others), np.int64), [], []
        for i in range(0, len(ids), STEP):
            hit = linked(x[i : i + STEP], y, ux[i : i + STEP], uy, cosine)
            hit &= ids[i : i + STEP, None] != others
            from_, to = np.nonzero(hit)
            links[i : i + STEP] = np.bincount(from_, n[to], hit.shape[0])
            back += np.bincount(to, weight[i + from_], len(others)).astype(np.int64)
            a, b = forest(ids[i + from_], others[to])
            stars_a.append(a)
            stars_b.append(b)
        member, root = forest(np.concatenate(stars_a), np.concatenate(stars_b))
        back *= visits  # pairs of two homes of this cell are seen from both sides
        some, theirs = links > 0, back > 0
        rep = np.concatenate([ids[some], others[theirs], member])
        return pa.table({
            "rep": pa.array(rep), "links": pa.array(np.concatenate([links[some], back[theirs], np.zeros(len(member), np.int64)])),
            "root": pa.array(np.concatenate([rep[: len(rep) - len(member)], root])),
        })

    found = cut(pairs.groupBy("dim", "cell", "a", "b").applyInArrow(met, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    together = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of = points.join(links, "rep", "left").join(together.withColumnRenamed("v", "rep"), "rep", "left")
    of = of.select("h1", "h2", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked_ids = rows.select("id", "h1", "h2").distinct().join(of, ["h1", "h2"])
    linked_ids = linked_ids.groupBy("id").agg(F.max(F.col("n") - 1 + F.col("links")).alias("n_links"), F.min("component").alias("component"))
    every = df.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct().join(linked_ids, "id", "left")
    component = F.coalesce("component", "id")
    return every.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))

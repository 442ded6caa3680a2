"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard of the vectors.

Shards hold about SHARD_ROWS distinct vectors, dealt by hash. In a shard every point gets at most DEGREE out-edges:
points are inserted in batches of a seeded order, a greedy beam search over the graph so far proposes neighbours, and
relaxed pruning keeps a proposal only if no kept neighbour is ALPHA times closer to it than the point is; back edges
are pruned alike. A query runs a beam search of width BEAM on every shard (in blocks of queries, so that neither side
has to fit one task), its finds are scored exactly on the original vectors, and the best of all shards win.

Copies of a vector are one point of the graph; the class carries its first ids, which stand in for it in results.
Vectors without direction (see vectors.valid) take no part, neither as queries nor as candidates. Vectors of different
lengths never meet. Ties go to smaller ids. Empty tables give empty results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import classes, matrix, unit, valid

SHARD_ROWS = 6_000
QUERY_BLOCK = 4_000
DEGREE, SLACK = 24, 8
ALPHA = 1.15
BUILD_BEAM, BEAM = 48, 120
EXPAND = 4
IN_DEGREE = 4


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities [query, width] of the beam of each query, nearest first; -1 where it is not full."""
    n, q = len(x), len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # stands for missing edges
    row = np.arange(q)[:, None]
    width = min(width, n)
    ids = np.full((q, width), n)
    near = np.full((q, width), -np.inf, np.float32)
    start = entry[:width]
    ids[:, : len(start)], near[:, : len(start)] = start, queries @ x[start].T
    seen[:, start] = True
    order = np.argsort(-near, 1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    done = ids == n
    active = np.arange(q)
    while len(active):
        a_ids, a_near, a_done = ids[active], near[active], done[active]
        pick = np.argsort(a_done, 1, kind="stable")[:, :EXPAND]  # the nearest that are not expanded
        r = row[: len(active)]
        at = np.where(a_done[r, pick], n, a_ids[r, pick])
        a_done[r, pick] = True
        found = []
        for k in range(at.shape[1]):
            new = edges[at[:, k]]
            new = np.where(seen[active[:, None], new], n, new)
            seen[active[:, None], new] = True
            found.append(new)
        new = np.concatenate(found, 1)
        keep = (new < n).any(0)
        new = new[:, keep]
        if new.shape[1]:
            sims = np.einsum("qkd,qd->qk", x[np.minimum(new, n - 1)], queries[active], optimize=True)
            sims[new == n] = -np.inf
            all_ids, all_near = np.concatenate([a_ids, new], 1), np.concatenate([a_near, sims], 1)
            all_done = np.concatenate([a_done, new == n], 1)
            best = np.argpartition(-all_near, width - 1, 1)[:, :width]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_near, best, 1), 1, kind="stable"), 1)
            a_ids, a_near, a_done = (np.take_along_axis(v, best, 1) for v in (all_ids, all_near, all_done))
        ids[active], near[active], done[active] = a_ids, a_near, a_done
        active = active[~a_done.all(1)]
    return np.where(near == -np.inf, -1, ids), near


def prune(x: np.ndarray, points: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The kept proposals [point, degree] of each point, len(x) where there are fewer; proposed holds len(x) for none."""
    n = len(x)
    out = np.full((len(points), degree), n)
    step = max(1, int(4_000_000 // max(1, proposed.shape[1] ** 2)))
    for i in range(0, len(points), step):
        p, c = points[i : i + step], proposed[i : i + step]
        c = np.sort(np.where(c == p[:, None], n, c), 1)
        c[:, 1:] = np.where(c[:, 1:] == c[:, :-1], n, c[:, 1:])
        v = x[np.minimum(c, n - 1)]
        far = 2 - 2 * np.einsum("pcd,pd->pc", v, x[p], optimize=True)
        far[c == n] = np.inf
        order = np.argsort(far, 1, kind="stable")
        c, far, v = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        between = 2 - 2 * (v @ v.transpose(0, 2, 1))
        alive, row = c < n, np.arange(len(p))
        for k in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            out[i : i + step, k] = np.where(some, c[row, first], n)
            alive &= alpha * between[row, first] > far
            alive[row, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Edges [point + 1, degree + slack] (the last row stands for no point) and entry points of the graph over unit rows x."""
    n, rng = len(x), np.random.default_rng(seed)
    edges = np.full((n + 1, degree + SLACK), n)
    used = np.zeros(n + 1, np.int64)
    order = rng.permutation(n)
    entry = order[: min(n, 8)]
    size, at = 32, len(entry)
    edges[entry, : max(0, len(entry) - 1)] = [[e for e in entry if e != o] for o in entry] if len(entry) > 1 else np.empty((len(entry), 0))
    used[entry] = len(entry) - 1
    for again in (False, True):
        at = 0 if again else len(entry)
        while at < n:
            p = order[at : at + size]
            at, size = at + size, min(512, size * 2)
            found, _ = beam_search(x, edges, x[p], entry, beam)
            chosen = prune(x, p, np.concatenate([np.where(found < 0, n, found), edges[p]], 1), degree, alpha)
            edges[p], used[p] = n, (chosen < n).sum(1)
            edges[p, :degree] = chosen
            source, target = np.repeat(p, degree), chosen.ravel()
            back = target < n
            back[back] = ~(edges[target[back]] == source[back][:, None]).any(1)  # not those that are there already
            source, target = source[back], target[back]
            if not len(target):
                continue
            sort = np.argsort(target, kind="stable")
            source, target = source[sort], target[sort]
            heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            counts = np.diff(np.concatenate([heads, [len(target)]]))
            to = target[heads]
            room = edges.shape[1] - used[to]
            fits = counts <= room
            place = np.arange(len(target)) - np.repeat(heads, counts) + np.repeat(used[to], counts)
            easy = np.repeat(fits, counts)
            edges[target[easy], place[easy]] = source[easy]
            used[to[fits]] += counts[fits]
            crowded = np.flatnonzero(~fits)
            crowded = crowded[np.argsort(counts[crowded], kind="stable")]
            for i in range(0, len(crowded), 256):
                part = crowded[i : i + 256]
                widest = counts[part].max()
                more = np.full((len(part), widest), n)
                more[np.arange(widest) < counts[part][:, None]] = np.concatenate([source[heads[j] : heads[j] + counts[j]] for j in part])
                kept = prune(x, to[part], np.concatenate([edges[to[part]], more], 1), degree, alpha)
                edges[to[part]] = n
                edges[to[part], :degree] = kept
                used[to[part]] = (kept < n).sum(1)
    return reachable(edges, n), entry


def reachable(edges: np.ndarray, n: int) -> np.ndarray:
    """The edges, widened so that a point which fewer than IN_DEGREE others point at is pointed at by its first out-neighbours."""
    into = np.bincount(edges[:n].ravel(), minlength=n + 1)[:n]
    lonely = np.flatnonzero(into < IN_DEGREE)
    pairs = [(q, p) for p in lonely.tolist() for q in edges[p, :IN_DEGREE].tolist() if q < n and p not in edges[q]]
    if not pairs:
        return edges
    pairs.sort()
    source, target = (np.array(c) for c in zip(*pairs, strict=True))
    heads = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
    counts = np.diff(np.concatenate([heads, [len(source)]]))
    more = np.full((n + 1, int(counts.max())), n)
    more[source, np.arange(len(source)) - np.repeat(heads, counts)] = target
    return np.concatenate([edges, more], 1)


def index(rows: DataFrame, points: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, n, dim, reps, vectors, edges, entry) of every shard, written to the shared folder."""
    shards = max(1, -(-points.count() // shard_rows))
    own = rows.join(points.select(F.col("rep").alias("id"), "h1", "h2"), ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])
    own = own.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "id", "v")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        v = matrix(table.column("v"))
        edges, entry = build(unit(v).astype(np.float32))
        return pa.table({
            "shard": table.column("shard")[:1], "dim": table.column("dim")[:1],
            "reps": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary()),
            "edges": pa.array([edges.astype(np.int32).tobytes()], pa.binary()), "entry": pa.array([entry.astype(np.int32).tobytes()], pa.binary()),
        })

    built = own.groupBy("shard", "dim").applyInArrow(run, "shard int, dim int, reps binary, vectors binary, edges binary, entry binary")
    return cut(built)


def search(df: DataFrame, wanted: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, key, score): the k nearest rows by cosine of every row that `wanted` (a condition over id) picks."""
    rows = valid(df, key, vector)
    points = cut(classes(rows, k + 1))
    shards = index(rows, points, shard_rows)
    queries = rows.where(wanted).dropDuplicates(["id", "h1", "h2"])
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dim"), "id", "v")

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return pa.table({
            "block": table.column("block")[:1], "dim": table.column("dim")[:1],
            "ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), "asked": pa.array([matrix(table.column("v")).tobytes()], pa.binary()),
        })

    asked = queries.groupBy("block", "dim").applyInArrow(packed, "block int, dim int, ids binary, asked binary")
    each = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, ["block", "dim"])
    each = each.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "block")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reps, entry = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["entry"], np.int32)
                v = np.frombuffer(row["vectors"]).reshape(len(reps), -1)
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(reps) + 1, -1)
                ids = np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["asked"]).reshape(len(ids), -1)
                small, uv, uq = unit(v).astype(np.float32), unit(v), unit(q)
                for i in range(0, len(ids), 256):
                    found, _ = beam_search(small, edges, uq[i : i + 256].astype(np.float32), entry, beam)
                    found = found[:, : max(4 * k, k + 1)]
                    exact = np.einsum("qkd,qd->qk", uv[np.maximum(found, 0)], uq[i : i + 256])
                    exact[found < 0] = -np.inf
                    rep = np.where(found < 0, np.iinfo(np.int64).max, reps[np.maximum(found, 0)])
                    order = np.lexsort([rep, -exact], axis=1)[:, : k + 1]
                    rep, exact = np.take_along_axis(rep, order, 1), np.take_along_axis(exact, order, 1)
                    there = exact > -np.inf
                    own = np.repeat(ids[i : i + 256], there.sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(rep[there]), pa.array(exact[there])], ["query_id", "rep", "score"])

    found = each.mapInArrow(run, "query_id long, rep long, score double")
    members = points.select("rep", F.explode("members").alias("id"))
    near = found.join(members, "rep").where("id <> query_id")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    best = near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")

import numpy as np
import pytest
from pyspark.sql import functions as F

from qanat.llm import graph_ann, pivot_join, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows):
    """id -> unit vector of the rows that take part."""
    out = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            out[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    return out


def clusters(seed, n=900, dim=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 6, dim))
    x = centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.2, 0.5], (n, 1))
    x = np.round(x.astype(np.float32), 3)
    x[100:400] = x[100]  # a third are copies
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    return rows + [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [None] * dim), (n + 4, []), (None, [1.0] * dim), (5, rows[5][1]), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [float("inf")] + [0.0] * (dim - 1))]


@pytest.fixture(params=[1, 2])
def rows(request):
    return clusters(request.param)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)


def test_range_join_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(pivot_join, "CELL_ROWS", 100)
    monkeypatch.setattr(pivot_join, "HOME_BLOCK", 64)
    monkeypatch.setattr(pivot_join, "BLOCK", 128)
    found = {r.vec_id: r for r in pivot_join.join(frame(spark, rows)).collect()}
    own = brute(rows)
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(own[a]) == len(own[b]) and own[a] @ own[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert len(found) == len(parent)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in found.items()} == {i: (links[i], find(i), find(i) == i) for i in parent}


def test_cells_hold_both_sides_of_every_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    home, near = pivot_join.cells_of(u, u[:20], float(np.sqrt(0.2)))
    for i, j in np.argwhere(u @ u.T >= 0.9):
        cell = min(home[i], home[j])
        assert near[i, cell] and near[j, cell]
    assert near.sum() < near.size / 2  # the triangle inequality spares most copies here


def test_search_finds_what_brute_force_finds(spark, rows, monkeypatch):
    monkeypatch.setattr(graph_ann, "QUERY_BLOCK", 7)
    found = {}
    for r in graph_ann.search(frame(spark, rows), F.col("id") % 10 == 0, shard_rows=200).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    own = brute(rows)
    hits = total = 0
    for q in (i for i in own if i % 10 == 0):
        near = sorted(((-round(float(own[q] @ v), 9), i) for i, v in own.items() if i != q and len(v) == len(own[q])))[:5]
        got = sorted(found.get(q, []))
        assert [g[0] for g in got] == list(range(1, len(near) + 1))
        for _, i, score in got:
            assert score == pytest.approx(float(own[q] @ own[i]), abs=1e-12)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got, got[1:], strict=False))
        hits += sum(s <= g[2] + 1e-9 for g, (s, _) in zip(got, [(-x, i) for x, i in near], strict=True))
        total += len(near)
    assert hits / total >= 0.95


def test_copies_come_by_smallest_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0], "") for i in range(100, 150)] + [(7, [3.0, 2.0, 1.0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = graph_ann.search(df, F.col("id") == 100).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [101, 102, 103, 104, 105]
    assert [r.vec_id for r in graph_ann.search(df, F.col("id") == 149).orderBy("rank").collect()] == [100, 101, 102, 103, 104]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert graph_ann.search(df, F.col("id") % 50 == 0).count() == 0
    assert pivot_join.join(df).count() == 0


def test_graph_reaches_its_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1_500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, entry = graph_ann.build(x)
    assert all(len(set(e[e < len(x)])) == (e < len(x)).sum() for e in edges[:-1])  # no edge twice
    found, _ = graph_ann.beam_search(x, edges, x[:300], entry, 60)
    assert (found[:, 0] == np.arange(300)).mean() > 0.99


def test_query_recall(spark):
    data = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(data))
    x = np.array([data[i] / np.linalg.norm(data[i]) for i in ids])
    found = queries.op1_graph_ann(spark, SF).collect()
    hits = 0
    for q in ids[ids % 50 == 0]:
        near = x @ x[q]
        near[q] = -9
        best = ids[np.lexsort([ids, -near])[:5]]
        hits += len({r.vec_id for r in found if r.query_id == q} & set(best.tolist()))
    assert hits >= 0.9 * len(found) and len(found) == 5 * (ids % 50 == 0).sum()

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from qanat.llm import common, jaccard_join, queries, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = WORD.findall(lower)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(rows, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ä", "É", "İ"]
    passage = rng.choices(words, k=25)
    rows = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(1, 90))
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy + passage
            rows.append(rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.2 else w for w in copy))
    rows += [rows[0]] * 20 + [None, "", "  \n", "one two", "ONE\x0btwo", "two one", "x " * 3_000, "x\x85y z", " ".join(passage)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_against_every_two_documents(spark, monkeypatch, seed, n, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "mine", "mine") for i, t in rows], "doc_id long, text string, d string, part string")
    found = jaccard_join.near_duplicates(df, n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, n, percent)
    assert len(found) == len(rows)


def test_null_keys_repeated_rows_and_empty_tables(spark):
    text = "a b c d e f g h i j"
    rows = [(7, text), (7, text), (None, text), (9, "other words stand here alone"), (None, None)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == sorted([(7, 7, 7), (7, 7, 7), (None, 7, 7), (9, 2, 9), (None, 0, None)], key=str)
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 4, 85).count() == 0


@pytest.mark.parametrize("chunk", [16, 64, 1_000_000])
@pytest.mark.parametrize("n", [1, 4])
def test_shingles_against_plain_ones(monkeypatch, chunk, n):
    monkeypatch.setattr(shingles, "CHUNK", chunk)
    rng = random.Random(chunk)
    parts = ["a", "B", "é", "\x0b", " ", "\n", "\x85", "xyz", "漢字", "\t", "\x1c", "longerword"]
    texts = [None, "", "   "] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    ours, plain = shingles.sets(pa.array(texts), n), [shingle_set(t, n) for t in texts]
    assert [len(s) for s in ours] == [len(s) for s in plain]
    for i in range(0, len(texts), 3):
        for j in range(0, len(texts), 5):
            assert len(np.intersect1d(ours[i], ours[j])) == len(plain[i] & plain[j])


def test_trees_lose_no_pair():
    rng = np.random.default_rng(2)
    base = rng.poisson(2.0, (20, jaccard_join.GROUPS))
    base[:10, : jaccard_join.GROUPS // 2] = base[10:, jaccard_join.GROUPS // 2 :] = 0  # two families that the corners tell apart
    v = np.maximum(0, base[rng.integers(0, 20, 700)] + rng.integers(-1, 2, (700, jaccard_join.GROUPS)) * (rng.random((700, jaccard_join.GROUPS)) < 0.1)).astype(np.int32)
    n = v.sum(1).astype(np.int64)
    a, b = np.triu_indices(700, 1)
    want = {tuple(sorted(p)) for p in zip(*(c.tolist() for c in jaccard_join.bounded(v, n, a, b, 85)[:2]), strict=True)}
    a, b = jaccard_join.tree_pairs(v, n, 85)
    looked = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert want <= looked and len(looked) < 0.7 * 700 * 699 / 2  # and the tree rules pairs out


def test_the_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        s, t = (np.unique(rng.integers(0, 500, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        v = jaccard_join.points([jaccard_join.point(s), jaccard_join.point(t)])
        assert np.minimum(v[0], v[1]).sum() >= len(np.intersect1d(s, t))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1_000, 1_120)] + [(0, i) for i in range(1, 300)] + [(rng.randrange(5_000, 5_400), rng.randrange(5_000, 5_400)) for _ in range(250)] + [(9, None), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.component for r in found} == {v: find(v) for v in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = queries.op7_jaccard_join(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 4, 85)


def test_a_task_holds_the_sets_of_few_texts_at_once(monkeypatch):
    class Captured:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(jaccard_join, "cut", lambda x: x)
    run = jaccard_join._described(Captured(), "text", 5)
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", k=5_000)) for _ in range(400)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "text"])
    shingles.words(batch.column("text")[:1])  # its tables
    tracemalloc.start()
    try:
        n = [x for b in run([batch]) for x in b.column("n").to_pylist() if x is not None]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == [len(shingle_set(t, 5)) for t in texts] and peak < 60_000_000

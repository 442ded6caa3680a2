import itertools
import random

import numpy as np
import pytest

from qanat.llm import packing, queries


@pytest.mark.parametrize("seed", range(8))
def test_bounds_need_the_least_padding(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(0, 60), rng.randint(1, 9))))
    counts = np.array([rng.randint(1, 20) for _ in lengths])
    for buckets in (1, 2, 3, 20):
        ends = packing.bounds(lengths, counts, buckets)
        assert len(ends) <= buckets and ends == sorted(set(ends)) and ends[-1] == lengths[-1]

        def padding(chosen):
            return sum(c * (min(e for e in chosen if e >= n) - n) for n, c in zip(lengths.tolist(), counts.tolist(), strict=True))

        best = min(padding((*some, lengths[-1])) for k in range(min(buckets, len(lengths))) for some in itertools.combinations(lengths[:-1].tolist(), k))
        assert padding(ends) == best
    assert packing.bounds(np.array([]), np.array([]), 4) == []


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), "x") for i in range(700)] + [(700, None, "x"), (701, "", "x"), (5, "w", "x"), (5, "w", "x"), (None, "a b", "x"), (702, "w " * 5_000, "x")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket string"), buckets=4, budget=100).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    batches = {}
    for r in found:
        assert r.n_tokens <= r.bound and r.padding == r.bound - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, _), inside in batches.items():
        assert len({r.slot for r in inside}) == len(inside) and len({r.bound for r in inside}) == 1
        assert len(inside) * inside[0].bound <= 100 or len(inside) == 1
    for bucket in {b for b, _ in batches}:
        numbers = sorted(n for b, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))  # no gaps
        full = max(1, 100 // max(1, next(iter(r.bound for r in found if r.bucket == bucket))))
        assert all(len(batches[bucket, n]) == full for n in numbers[:-1])
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    found = queries.op9_packing(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: len((r.text or "").split()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in found.collect()} == texts
    assert found.select("bucket").distinct().count() <= packing.BUCKETS

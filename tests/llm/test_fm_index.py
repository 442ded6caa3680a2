import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qanat.llm import fm_index as M
from qanat.llm import queries
from qanat.llm.shingles import words
from tests.compare import connect, difference

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(texts, items, window=10):
    phrases = {}
    for item, text in items:
        w = words_of(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for text in texts:
        w, hit, owners = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := phrases.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    owners |= found
        out.append((len(w), sorted(hit), sorted(owners)))
    return out


def runs_of(rng, n, letters):
    hashes, starts = [], []
    for _ in range(n):
        starts.append(len(hashes))
        hashes += [rng.randrange(1, letters + 1) for _ in range(rng.randrange(1, 30))] + [0]
    return np.array(hashes, np.uint64), np.array(starts)


@pytest.mark.parametrize("letters", [1, 2, 5, 40])
def test_index_counts_and_locates_every_phrase(letters):
    rng = random.Random(letters)
    hashes, starts = runs_of(rng, 60, letters)
    index = M.Index.build(hashes, starts)
    text = hashes.tolist()
    suffixes = M.suffix_array(hashes.astype(np.int64))
    zero = {i: k for k, i in enumerate(np.flatnonzero(hashes == 0).tolist())}
    order = sorted(range(len(text)), key=lambda i: [(0, zero[j]) if text[j] == 0 else (1, text[j]) for j in range(i, next(z for z in zero if z >= i) + 1)])
    assert suffixes.tolist() == order
    phrases = [[rng.randrange(1, letters + 2) for _ in range(rng.randrange(1, 6))] for _ in range(200)]
    table = np.zeros((len(phrases), 6), np.uint64)
    for row, p in zip(table, phrases, strict=True):
        row[: len(p)] = p
    which, low, high = index.ranges(table, np.array([len(p) for p in phrases]))
    got = {w: sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which.tolist(), low, high, strict=True)}
    want = {k: [i for i in range(len(text)) if text[i : i + len(p)] == p] for k, p in enumerate(phrases)}
    assert got == {k: v for k, v in want.items() if v}


def test_bits_and_wavelet():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        bit = rng.random(n) < 0.3
        b = M.Bits(M.packed(bit))
        at = np.arange(n + 1)
        assert (b.rank(at) == np.concatenate([[0], np.cumsum(bit)])).all() and (b.get(at[:-1]) == bit).all()


def rows_for(rng, n):
    vocabulary = ["a", "B", "cc", "Straße", "ñu", "x1", "7", "the", "漢字", "Éa"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 40])))) for i in range(25)]
    items += [(None, "null id item words " * 4), (77, None), (78, "..."), (79, ""), (3, "second text of item three has eleven words in all here")] + items[:3]
    texts = [None, "", " -- ", "\x00"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.random()
            if kind < 0.3 and (w := words_of(rng.choice(items)[1])):
                start = rng.randrange(len(w))
                parts += w[start : start + rng.randrange(1, 25)]
            else:
                parts += rng.choices([*vocabulary, "other", "WORDS"], k=rng.randrange(1, 12))
        texts.append("".join(p.upper() + rng.choice([" ", ", ", "\n", "-"]) if p.isascii() else p + " " for p in parts))
    return texts, items


@pytest.mark.parametrize("options", [{}, {"shard_words": 40, "block_words": 48, "part_bytes": 64}, {"shard_words": 7, "part_bytes": 30}])
def test_find_and_remove_equal_brute_force(spark, options):
    rng = random.Random(len(options))
    texts, items = rows_for(rng, 150)
    texts += texts[4:9] * 3 + [" ".join(texts[10:60])]
    docs = spark.createDataFrame([(i // 2 if i % 7 else None, t, "mine", i, "mine") for i, t in enumerate(texts)], "doc_id long, text string, row string, n_words long, id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = M.find(docs, bench, **options).collect()
    want = brute(texts, items)
    assert len(found) == len(texts)
    for r in found:
        n, hit, owners = want[r.row.n_words]
        covered = [w for s in r.spans for w in range(s.start, s.end)]
        assert (r.n_words, covered, list(r["items"])) == (n, hit, owners)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    cleaned = M.remove(docs, bench, **options)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        n, hit, _ = want[r.n_words]
        original = texts[r.n_words]
        assert words_of(r.text) == [w for i, w in enumerate(words_of(original)) if i not in set(hit)]
        assert hit or r.text == original


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert [tuple(r)[1:] for r in M.find(docs, bench.limit(0)).collect()] == [(5, [], [])]
    assert M.find(docs.limit(0), bench).count() == 0
    assert M.remove(docs, bench).first().text == " of a text"


def test_words_of_this_class():
    texts = ["Ab-c1 Éa_b漢字", None, "", "x" * 10 + "\x7fy"]
    row, hashes = words(pa.array(texts), M.BREAKS)
    again = words(pa.array(["ab", "c1", "Éa", "b漢字", "x" * 10, "y"]), M.BREAKS)[1]
    assert row.tolist() == [0, 0, 0, 0, 3, 3] and hashes.tolist() == again.tolist()


def test_blocks_are_bounded_and_hold_every_phrase(spark):
    _, items = rows_for(random.Random(5), 0)
    items = items + [(i, items[0][1]) for i in range(100, 400)] + items[:1] * 500
    bench = spark.createDataFrame(items, "item_id long, text string")
    phrases = M.phrases_of(bench, "item_id", "text", 10, block_words=200)
    assert max(len(r.words) for r in phrases.collect()) <= 50
    got = Counter()
    for block in M.phrase_blocks(phrases, 10, 200):
        assert block.sizes.sum() <= 10 * 400
        got.update((tuple(p[:s].tolist()), block.items[i]) for k, (p, s) in enumerate(zip(block.phrases, block.sizes, strict=True)) for i in block.ids[block.starts[k] : block.starts[k + 1]])
    want = set()
    for item, text in items:
        h = words(pa.array([text], pa.string()), M.BREAKS)[1].tolist()
        size = min(10, len(h))
        want |= {(tuple(h[i : i + size]), "" if item is None else str(item)) for i in range(len(h) - size + 1 if h else 0)}
    assert set(got) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert difference(queries.op13_fm_index(spark, path), connect(path), queries.OP13_SQL) is None


def test_query_matches_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()
    want = Counter((d.doc_id, n, len(hit), len(owners), hashlib.sha256(",".join(owners).encode()).hexdigest(), bool(hit)) for d, (n, hit, owners) in zip(docs, brute([d.text for d in docs], items), strict=True))
    found = queries.op13_fm_index(spark, path).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(map(tuple, found.collect())) == want and any(k[-1] for k in want)


def test_nothing_is_shuffled_by_the_search(spark):
    found = M.find(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where(F.size("spans") > 0).count() == 1

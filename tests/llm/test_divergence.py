import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from qanat.llm import divergence as M
from qanat.llm import queries
from tests.compare import connect, difference

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    """The definition in plain integers; rows: (lang, source, text)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall((text or "").translate(UPPER))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        sources = [s for l, s in counts if l == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            order = lambda x: (-x[1], x[0].encode())
            out += [(lang, s, "pair", i, v, k + 1) for k, (i, v) in enumerate(sorted(pairs, key=order))]
            out += [(lang, s, "term", i, v, k + 1) for k, (i, v) in enumerate(sorted(terms, key=order)[:top])]
    return Counter(out)


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(500):
        total, terms = rng.randrange(10 ** rng.randrange(1, 16)), rng.randrange(1, 10**6)
        count = rng.randrange(total + 1)
        assert M.shares(np.array([count]), np.array([total]), terms).tolist() == [1 + 10**9 * (count + 2) // (total + 2 * terms)]


@pytest.mark.parametrize("shape", [(1, 1), (3, 40), (40, 3), (64, 64)])
def test_trees_hold_the_matrix_and_meet_where_both_have_counts(shape):
    rng = np.random.default_rng(sum(shape))
    trees, matrices = [], []
    for _ in range(2):
        m = np.where(rng.random(shape) < 0.2, rng.integers(1, 100, shape), 0)
        m[0, 0] = 5
        row, col = np.nonzero(m)
        levels = max(1, int(max(shape)).bit_length())
        tree = M.QuadTree.build(row, col, m[row, col], levels)
        trees.append(M.QuadTree.read(*tree.stored()))
        matrices.append(m)
        assert sorted(zip(M._leaf_rows(trees[-1], shape[0]).tolist(), trees[-1].leaves.tolist(), strict=True)) == sorted(zip(row.tolist(), m[row, col].tolist(), strict=True))
    for same in (False, True):
        one, two = trees[0], trees[0 if same else 1]
        m, o = matrices[0], matrices[0 if same else 1]
        want = {(a, b, c, m[a, c], o[b, c]) for a in range(shape[0]) for b in range(shape[0]) for c in range(shape[1]) if m[a, c] and o[b, c] and (a < b or not same)}
        got = [t for a, b, c, i, j in M.meetings(one, two, same) for t in zip(a.tolist(), b.tolist(), c.tolist(), one.leaves[i].tolist(), two.leaves[j].tolist(), strict=True)]
        assert len(got) == len(want) and set(got) == want


def test_zero_quadrants_are_not_visited(monkeypatch):
    """Two groups of 2,000 terms each that share 5: the work follows what they share, not the matrix."""
    cols = np.concatenate([np.arange(0, 2000), np.arange(1995, 3995)])
    rows = np.repeat([1, 2], 2000)
    tree = M.QuadTree.build(rows, cols, np.ones(4000, np.int64), 12)
    visited = []
    where = np.concatenate
    monkeypatch.setattr(M.np, "concatenate", lambda x, *a, **k: visited.append(sum(map(len, x))) or where(x, *a, **k))
    met = [c for *_, c, _, _ in M.meetings(tree, tree, True)]
    assert sum(map(len, met)) == 5
    # rows of one group meet themselves on the way down, at most once per level and quadrant
    assert max(visited) < 5 * 4000


def corpus(rng, n):
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["Éa", "漢字", "é", "THE", "the"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S3", "é", None, "hot", "hot", "hot"])
        own = vocabulary[hash_of(source) % 60 :] if rng.random() < 0.7 else vocabulary
        words = rng.choices(own, k=rng.randrange(0, 30))
        rows.append((lang, source, rng.choice([" ", "1", "_-", "\n"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words)))
    rows += [("en", "empty", None), ("en", "empty too", "123 ..."), ("rare", "a", "x y"), ("rare", "b", "y z"), ("alone", "only", "a " * 30)] + [("one", "only", "a b c")] * 12
    rows += rows[:20] * 2 + [("en", "long", " ".join(rng.choices(vocabulary, k=3000)))]
    return rows


def hash_of(source):
    return sum((source or "").encode())


@pytest.mark.parametrize("options", [{}, {"rows": 2, "columns": 8, "part_bytes": 64}, {"rows": 3, "columns": 1000, "top": 3, "min_docs": 30}])
def test_audit_equals_brute_force(spark, options):
    rows = corpus(random.Random(len(options)), 400)
    docs = spark.createDataFrame([(*r, "mine", 1, "mine") for r in rows], "lang string, source string, text string, term string, n int, part string").repartition(5)
    found = M.audit(docs, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, found.collect())) == brute(rows, options.get("min_docs", 10), options.get("top", 10))


def test_empty_table_and_tables_without_terms(spark):
    docs = spark.createDataFrame([("en", "a", "x"), ("en", "b", None), (None, None, None)], "lang string, source string, text string")
    assert M.audit(docs.limit(0)).count() == 0
    assert sorted(map(tuple, M.audit(docs).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_beyond_32_bits_keep_their_sums():
    big = 10**12
    tree = M.QuadTree.build(np.array([0, 1, 2]), np.array([0, 0, 0]), np.array([3 * big, big, 2 * big]), 2)
    totals = np.array([3 * big + 7, big + 3, 2 * big + 4])
    pairs, terms = M.joint(tree, tree, totals, totals, 5, True)
    share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 10)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    p, q, zp, zq = share(big, big + 3), share(2 * big, 2 * big + 4), share(0, big + 3), share(0, 2 * big + 4)
    assert pairs.tolist() == [[1, 2, f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq)]]
    language = share(3 * big, 3 * big + 7)
    assert terms.tolist() == [[r, 0, f(x, language)] for r, x in ((1, p), (2, q)) if x > language]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert difference(queries.op11_divergence(spark, path), connect(path), queries.OP11_SQL) is None

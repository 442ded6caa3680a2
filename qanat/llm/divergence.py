"""Source divergence audit: how far the sources of a language differ in their words.

The matrix has a row for each group (language, source), one more for the whole language, and a column for each term that
MIN_DOCS documents of the language hold. Terms are counted where documents are read and folded before any shuffle. The
matrix is cut into tiles of ROWS groups by COLUMNS terms, and each tile is stored as a K-squared quadtree with K = 2:
for every quadrant that holds a count, four bits say which of its quarters do; the counts are the leaves.

A smoothed share p is computed from each count, and the distance of two groups adds f(p, q) over all terms. Where both
counts are zero the price f(p0, q0) is the same for every term, and where one is zero it depends on the other count only.
So all-zero quadrants are never visited: the price of a pair is taken as if no term met, from V and each group's
histogram of counts, and a joint traversal of two trees, going down only where both have a count, adds what the terms in
common change. The traversal with the language's own row gives the terms that stand out in each source.

All arithmetic is on whole numbers, exact up to 9 * 10^15 occurrences in a language. A task holds one or two tiles, or
the histograms of two blocks of ROWS groups; nothing is sent to the driver.

Null language, source and text are the empty string. Groups without terms, and languages in which no term is kept, have
all their pairs, the latter with value 0. Every row counts, repeated rows too; other columns are not read. Ties are
ranked by the item's UTF-8 bytes. An empty table gives no rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches
from .shingles import PART_BYTES, texts_in_parts

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
ROWS = 256  # groups of a tile
COLUMNS = 512  # terms of a tile, about
FOLD = 500_000  # distinct terms a task counts before it passes them on
FRONTIER = 200_000  # pairs of quadrants that a traversal expands at once
SALTS = 64  # keys of a language where its own numbers are joined to its terms or groups
SHIFT = 1 << 20  # a block number times this, plus the place in the block

TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8
#: Fixed value: what ends a term.
BREAKS = np.ones(256, bool)
BREAKS[97:123] = BREAKS[128:] = False


# ---- whole-number prices --------------------------------------------------------------------------------------------


def shares(count: np.ndarray, total: np.ndarray, terms: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), by long division in thousands."""
    rest, by = np.asarray(count, np.int64) + 2, np.maximum(np.asarray(total, np.int64) + 2 * np.asarray(terms, np.int64), 1)
    out = np.zeros(np.broadcast(rest, by).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


# ---- the quadtree ---------------------------------------------------------------------------------------------------


def interleaved(row: np.ndarray, column: np.ndarray, levels: int) -> np.ndarray:
    code = np.zeros(len(row), np.int64)
    for k in range(levels - 1, -1, -1):
        code = code * 4 + ((row >> k) & 1) * 2 + ((column >> k) & 1)
    return code


class QuadTree:
    """A sparse matrix of side 2^levels: per level four bits for each quadrant with a count, then the counts."""

    def __init__(self, bits: list[np.ndarray], leaves: np.ndarray) -> None:
        self.bits, self.leaves = bits, leaves
        #: the number of a quarter among the quadrants of the next level, or -1 if it is all zero
        self.child = [np.where(b, np.cumsum(b) - 1, -1).reshape(-1, 4) for b in bits]

    @classmethod
    def build(cls, row: np.ndarray, column: np.ndarray, count: np.ndarray, levels: int) -> QuadTree:
        code = interleaved(row, column, levels)
        order = np.argsort(code)
        code = code[order]
        bits, quadrants = [], np.zeros(1, np.int64)
        for level in range(1, levels + 1):
            quarters = np.unique(code >> 2 * (levels - level))
            b = np.zeros(4 * len(quadrants), bool)
            b[4 * np.searchsorted(quadrants, quarters >> 2) + (quarters & 3)] = True
            bits.append(b)
            quadrants = quarters
        return cls(bits, np.asarray(count, np.int64)[order])

    def stored(self) -> tuple[list[int], bytes, bytes]:
        return [len(b) for b in self.bits], np.packbits(np.concatenate(self.bits)).tobytes(), self.leaves.tobytes()

    @classmethod
    def read(cls, sizes: list[int], bits: bytes, leaves: bytes) -> QuadTree:
        flat = np.unpackbits(np.frombuffer(bits, np.uint8))[: sum(sizes)].astype(bool)
        return cls(np.split(flat, np.cumsum(sizes)[:-1]), np.frombuffer(leaves, np.int64))

    @property
    def levels(self) -> int:
        return len(self.bits)


def meetings(one: QuadTree, two: QuadTree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row in one, row in two, column, leaf of one, leaf of two) wherever a column has a count in both rows, in portions.

    same: both are the same tree; then each pair of rows comes once, the smaller row first."""
    start = np.zeros(1, np.int64)
    waiting = [(0, start, start, start, start, start)]  # level, rows and column so far, quadrants
    while waiting:
        level, a, b, c, i, j = waiting.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            waiting += [(level, *(x[half:] for x in (a, b, c, i, j))), (level, *(x[:half] for x in (a, b, c, i, j)))]
            continue
        if level == one.levels:
            if same:
                kept = a < b
                a, b, c, i, j = (x[kept] for x in (a, b, c, i, j))
            yield a, b, c, i, j
            continue
        found = []
        for side in (0, 1):
            for up in (0, 1):
                for down in (0, 1):
                    ci, cj = one.child[level][i, 2 * up + side], two.child[level][j, 2 * down + side]
                    meet = (ci >= 0) & (cj >= 0)
                    if same:
                        meet &= 2 * a + up <= 2 * b + down
                    found.append((2 * a[meet] + up, 2 * b[meet] + down, 2 * c[meet] + side, ci[meet], cj[meet]))
        expanded = [np.concatenate(x) for x in zip(*found, strict=True)]
        if len(expanded[0]):
            waiting.append((level + 1, *expanded))


def joint(one: QuadTree, two: QuadTree, totals_one: np.ndarray, totals_two: np.ndarray, terms: int, same: bool, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(row, row, what the terms in common change) and (row, column, value) of the terms that stand out most in a row.

    Row 0 of a tree is its language; it takes part only where a tree meets itself."""
    zero_one, zero_two = shares(0, totals_one, terms), shares(0, totals_two, terms)
    row_of = lambda tree, totals: _leaf_rows(tree, len(totals))
    p_one = shares(one.leaves, totals_one[row_of(one, totals_one)], terms)
    p_two = p_one if same else shares(two.leaves, totals_two[row_of(two, totals_two)], terms)
    sums = np.zeros((len(totals_one), len(totals_two)), np.int64)
    met = np.zeros(sums.shape, bool)
    standing = [np.empty((0, 3), np.int64)]
    for a, b, c, i, j in meetings(one, two, same):
        groups = (a > 0) & (b > 0)
        x, y, p, q = a[groups], b[groups], p_one[i[groups]], p_two[j[groups]]
        change = price(p, q) - price(p, zero_two[y]) - price(zero_one[x], q) + price(zero_one[x], zero_two[y])
        np.add.at(sums, (x, y), change)
        met[x, y] = True
        if same:
            language = (a == 0) & (p_two[j] > p_one[i])
            p, q = p_two[j[language]], p_one[i[language]]
            standing.append(np.column_stack([b[language], c[language], price(p, q)]))
            standing = [first_per_row(np.concatenate(standing), top)]
    x, y = np.nonzero(met)
    return np.column_stack([x, y, sums[x, y]]), np.concatenate(standing)


def first_per_row(found: np.ndarray, top: int) -> np.ndarray:
    """Of (row, column, value) the first `top` of each row, larger values first, ties by column."""
    found = found[np.lexsort((found[:, 1], -found[:, 2], found[:, 0]))]
    first = np.searchsorted(found[:, 0], found[:, 0])
    return found[np.arange(len(found)) - first < top]


def _leaf_rows(tree: QuadTree, n_rows: int) -> np.ndarray:
    rows = np.zeros(1, np.int64)
    for b in tree.bits:
        at = np.flatnonzero(b)
        rows = 2 * rows[at >> 2] + ((at & 3) >> 1)
    assert not len(rows) or rows.max() < n_rows
    return rows


# ---- the matrix -----------------------------------------------------------------------------------------------------


def count_terms(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents that hold the term, folded by each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple[str, str], Counter] = defaultdict(Counter)
        documents: dict[tuple[str, str], Counter] = defaultdict(Counter)
        held: set[bytes] = set()

        def folded() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in occurrences.items():
                if not (terms := list(found)):
                    continue
                docs_of = documents[lang, source]
                columns = {"lang": [lang] * len(terms), "source": [source] * len(terms), "term": pa.array(terms, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_pydict(columns | {"n": pa.array(found.values(), pa.int64()), "d": pa.array([docs_of[t] for t in terms], pa.int64())})
            occurrences.clear()
            documents.clear()

        for batch, texts, last in texts_in_parts(batches, "text", BREAKS, part_bytes):
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, texts.to_pylist(), strict=True):
                found = TERM.findall((text or "").encode().lower())
                occurrences[lang, source].update(found)
                held.update(found)
                if last:
                    documents[lang, source].update(held)
                    held = set()
            if last and sum(map(len, occurrences.values())) >= FOLD:
                yield from folded()
        yield from folded()

    return small_batches(docs).mapInArrow(count, "lang string, source string, term string, n long, d long")


def _blocks(size: str, by: str, per: int) -> Column:
    return F.pmod(F.xxhash64(by), F.greatest(F.ceil(F.col(size) / per), F.lit(1)))


TILE = "lang string, rblock long, blocks long, cblock long, terms long, rows array<long>, totals array<long>, sizes array<int>, bits binary, leaves binary"


def _tile(cells: pa.Table) -> pa.Table:
    """One tile from its cells (row from 1, col, n) with the totals of its groups and its language."""
    row, col, n = (cells.column(c).to_numpy() for c in ("row", "col", "n"))
    rows, first = np.unique(row, return_index=True)
    totals = cells.column("total").to_numpy()[first]
    cols, at = np.unique(col, return_index=True)
    local = np.searchsorted(rows, row) + 1  # rows that have a count here; 0 is the language
    levels = max(1, int(max(len(rows), cols.max())).bit_length())
    tree = QuadTree.build(np.concatenate([np.zeros(len(cols), np.int64), local]), np.concatenate([cols, col]), np.concatenate([cells.column("lang_n").to_numpy()[at], n]), levels)
    sizes, bits, leaves = tree.stored()
    one = {c: cells.column(c)[:1].combine_chunks() for c in ("lang", "rblock", "blocks", "cblock", "terms")}
    lists = {"rows": [rows.tolist()], "totals": [[cells.column("lang_total")[0].as_py(), *totals.tolist()]], "sizes": pa.array([sizes], pa.list_(pa.int32()))}
    return pa.table(one | lists | {"bits": [bits], "leaves": [leaves]})


def _traverse(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tiles in batch.to_pylist():
            one, two = tiles["one"], tiles["two"]
            same = one["rblock"] == two["rblock"]
            first = QuadTree.read(one["sizes"], one["bits"], one["leaves"])
            second = first if same else QuadTree.read(two["sizes"], two["bits"], two["leaves"])
            if not same:
                first, second = _alike(first, second)
            pairs, terms = joint(first, second, np.array(one["totals"]), np.array(two["totals"]), one["terms"], same, top)
            here, there = np.array([0, *one["rows"]]) + one["rblock"] * SHIFT, np.array([0, *two["rows"]]) + two["rblock"] * SHIFT
            yield _found(one["lang"], "pair", here[pairs[:, 0]], there[pairs[:, 1]], pairs[:, 2])
            yield _found(one["lang"], "term", here[terms[:, 0]], terms[:, 1] + one["cblock"] * SHIFT, terms[:, 2])


def _alike(one: QuadTree, two: QuadTree) -> tuple[QuadTree, QuadTree]:
    """Both trees with as many levels: the smaller one becomes the first quarter of larger ones."""
    levels = max(one.levels, two.levels)
    first = np.array([True, False, False, False])
    grown = lambda t: QuadTree([*[first] * (levels - t.levels), *t.bits], t.leaves)
    return grown(one), grown(two)


FOUND = "lang string, part string, a long, b long, value long"


def _found(lang: str, part: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    n = len(value)
    return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * n, pa.string()), "part": pa.array([part] * n, pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})


PANEL = "lang string, rblock long, blocks long, terms long, rows array<long>, totals array<long>, starts array<long>, counts array<long>, times array<long>"


def _panel(groups: pa.Table, histogram: pa.Table) -> pa.Table:
    """A block of groups, each with its histogram: how many terms have which count."""
    groups = groups.sort_by("row")
    rows = groups.column("row").to_numpy()
    histogram = histogram.sort_by([("row", "ascending"), ("n", "ascending")])
    starts = np.searchsorted(histogram.column("row").to_numpy(), np.append(rows, rows[-1] + 1))
    lists = {"rows": rows, "totals": groups.column("total").to_numpy(), "starts": starts, "counts": histogram.column("n").to_numpy(), "times": histogram.column("times").to_numpy()}
    one = {c: groups.column(c)[:1].combine_chunks() for c in ("lang", "rblock", "blocks", "terms")}
    return pa.table(one | {k: pa.array([v.astype(np.int64)], pa.list_(pa.int64())) for k, v in lists.items()})


def _price_zeros(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The price of every pair as if no term had a count in both groups."""
    for batch in batches:
        for panels in batch.to_pylist():
            one, two = ({k: np.array(v, np.int64) if isinstance(v, list) else v for k, v in p.items()} for p in (panels["one"], panels["two"]))
            terms = one["terms"]
            zero_one, zero_two = shares(0, one["totals"], terms), shares(0, two["totals"], terms)
            value = terms * price(zero_one[:, None], zero_two[None, :]) + _one_sided(one, zero_one, zero_two, terms) + _one_sided(two, zero_two, zero_one, terms).T
            a, b = np.nonzero((one["rows"][:, None] < two["rows"][None, :]) | (one["rblock"] != two["rblock"]))
            yield _found(one["lang"], "pair", one["rows"][a] + one["rblock"] * SHIFT, two["rows"][b] + two["rblock"] * SHIFT, value[a, b])


def _one_sided(panel: dict, zero: np.ndarray, others: np.ndarray, terms: int) -> np.ndarray:
    """What the counts of each group change against others that have none there."""
    out = np.zeros((len(zero), len(others)), np.int64)
    for k, z in enumerate(zero):
        own = slice(panel["starts"][k], panel["starts"][k + 1])
        p, times = shares(panel["counts"][own], panel["totals"][k], terms), panel["times"][own]
        step = max(1, 1_000_000 // max(1, len(others)))
        for at in range(0, len(p), step):
            part = price(p[at : at + step, None], others[None, :]) - price(z, others)[None, :]
            out[k] += (times[at : at + step, None] * part).sum(axis=0)
    return out


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, rows: int = ROWS, columns: int = COLUMNS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group its distance to each other source of the language (`pair`),
    and the `top` terms whose share there exceeds the language's (`term`), larger values first."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(named(lang).alias("lang"), named(source).alias("source"), F.col(text).alias("text"))
    # counts are folded already: one shuffle by (language, term) serves the sums, the choice of terms and their totals
    counted = count_terms(given, part_bytes).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang", "term")  # a row for each source at most
    counted = counted.withColumns({"lang_n": F.sum("n").over(of_term), "docs": F.sum("d").over(of_term)})
    cells = cut(counted.where(F.col("docs") >= min_docs).drop("d", "docs"))

    # columns: the kept terms of each language, in blocks by hash, numbered by name inside a block
    kept = cells.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    sums = cut(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")))
    place = lambda *keys: F.row_number().over(Window.partitionBy("lang", keys[0]).orderBy(keys[1])).cast("long")
    terms = _of_language(kept, sums, "term").withColumn("cblock", _blocks("terms", "term", columns))
    terms = cut(terms.withColumn("col", place("cblock", "term") - 1))
    known = cells.join(terms.drop("lang_n"), ["lang", "term"])

    # rows: every group of the documents, with its total over kept terms
    groups = given.groupBy("lang", "source").agg(F.count("*").alias("documents")).drop("documents")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(sums.select("lang", "terms"), "lang", "left")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _of_language(groups, sizes, "source").join(totals, ["lang", "source"], "left").fillna(0, ["total", "terms"])
    groups = groups.withColumn("blocks", F.ceil(F.col("sources") / rows)).withColumn("rblock", _blocks("sources", "source", rows))
    groups = cut(groups.withColumn("row", place("rblock", "source")).drop("sources"))

    # tiles, and their joint traversal
    matrix = cut(known.drop("terms", "term").join(groups, ["lang", "source"]).drop("source"))
    tiles = cut(matrix.groupBy("lang", "rblock", "cblock").applyInArrow(_tile, TILE))
    met = _met(tiles, ["lang", "cblock"]).mapInArrow(lambda batches: _traverse(batches, top), FOUND)

    # zero quadrants, by histograms of counts
    histogram = matrix.groupBy("lang", "rblock", "row", "n").agg(F.count("*").alias("times"))
    keys = ["lang", "rblock"]
    panels = cut(groups.groupBy(*keys).cogroup(histogram.groupBy(*keys)).applyInArrow(_panel, PANEL))
    zeros = _met(panels, ["lang"]).mapInArrow(_price_zeros, FOUND)

    found = cut(met.unionByName(zeros).groupBy("lang", "part", "a", "b").agg(F.sum("value").alias("value")))
    name = groups.select("lang", (F.col("rblock") * SHIFT + F.col("row")).alias("a"), "source")
    halves = found.where("part = 'pair'").drop("part")
    pairs = halves.unionByName(halves.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = pairs.join(name, ["lang", "a"]).join(name.withColumnsRenamed({"a": "b", "source": "item"}), ["lang", "b"])
    words = terms.select("lang", (F.col("cblock") * SHIFT + F.col("col")).alias("b"), F.col("term").alias("item"))
    ahead = lambda *order: F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    by_value = (F.col("value").desc(), F.col("item"))
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", ahead(*by_value))
    standing = found.where("part = 'term'").join(name, ["lang", "a"]).join(words, ["lang", "b"])
    standing = standing.select("lang", "source", "item", "value").withColumn("rank", ahead(*by_value)).where(F.col("rank") <= top)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(standing.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _met(tables: DataFrame, on: list[str]) -> DataFrame:
    """Every pair of blocks of one language (and columns), each once; a block also meets itself. Each block goes to a key
    for each partner, so that a language with many blocks is spread."""
    one = tables.select(*on, F.col("rblock").alias("i"), F.explode(F.sequence("rblock", F.col("blocks") - 1)).alias("j"), F.struct(*tables.columns).alias("one"))
    two = tables.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), "rblock")).alias("i"), F.col("rblock").alias("j"), F.struct(*tables.columns).alias("two"))
    return one.join(two, [*on, "i", "j"]).select("one", "two")


def _of_language(rows: DataFrame, languages: DataFrame, by: str) -> DataFrame:
    """rows with the columns of their language; each language stands under SALTS keys, so that a large one is spread."""
    salted = languages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")

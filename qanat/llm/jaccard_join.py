"""N-gram Jaccard join over count vectors in R-trees.

A document's set is its distinct word shingles as 64-bit hashes; documents with equal sets (64-bit digest) are one class.
Shingles are hashed into GROUPS groups; a class is the point of its group counts. The sum of the coordinate minima of two
points, or of a point and the upper corner of a tree node, bounds the overlap from above, and with the set sizes the
similarity.

Points are dealt into cells so that no link is lost: sets of similarity t share one of the first n - ceil(t n) + 1
shingles of any common order. The order is rare first, by a sketch of fixed size that counts all shingles of the corpus.
A class lies in the cell of each of these shingles; cells with one class go. Near copies share many such shingles: of
cells with the same members (128-bit digest of them) one stays. A cell's points are cut into blocks of BLOCK rows, each pair of blocks is a task's group, and R-trees (one leaf, for small cells) give the pairs whose bound
reaches the threshold.

Dense cells would give all pairs of a group of near copies, so there are two rounds. The first takes, of each cell, a
spanning forest of the pairs with the highest bounds; the second every remaining pair whose classes are not yet
connected. Their pairs are bounded once more by counts in finer groups, as many as the sets are large. Inside a round every component first tries its best pair, twice; then all pairs that are still between two
components are tried: nothing is left out, and what is skipped could not change a component. Verification counts
the overlap of the whole sets in integers.

Null and empty texts have empty sets and link with nothing; a text of fewer words is one shingle. Rows repeat as in the
input; rows with a null key take part but never name a component. Empty tables give empty results."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, discard, release, slices, small_batches, whole_groups
from .shingles import forget, mix, sets

GROUPS = 128
SKETCH_BITS, SEGMENTS = 20, 64
BLOCK = 1_024
LEAF, FAN = 64, 16
FINE = 4
BEST_ROUNDS = 2
FLUSH = 500_000  # pairs whose repeats a task drops at once
PAIRS = 25_000  # that numpy looks at in one step
SLICE = 1_000_000  # bytes of texts whose sets a task holds at once


def digest(s: np.ndarray) -> int:
    """64-bit digest of a sorted set; two independent sums, mixed."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(mix(np.array([a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(len(s)))], np.uint64))[0].astype(np.int64))


def point(s: np.ndarray) -> bytes:
    """The group counts of a set, in the narrowest whole numbers that hold them."""
    counts = np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint16 if counts.max() < 65_536 else np.uint32).tobytes()


def fine_point(s: np.ndarray) -> bytes:
    """Counts in finer groups, about FINE shingles each: a power of two, so that the counts of a larger set fold."""
    groups = 1 << max(0, (len(s) // FINE).bit_length())
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint16).tobytes()


def fine_bound(one: bytes, two: bytes) -> int:
    """Upper bound of the overlap of two sets by their finer groups."""
    a, b = np.frombuffer(one, np.uint16).astype(np.int64), np.frombuffer(two, np.uint16).astype(np.int64)
    groups = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, groups).sum(0), b.reshape(-1, groups).sum(0)).sum())


def points(raws: list[bytes]) -> np.ndarray:
    out = np.empty((len(raws), GROUPS), np.int32)
    kinds = {GROUPS: np.uint8, 2 * GROUPS: np.uint16, 4 * GROUPS: np.uint32}
    widths = np.array([len(r) for r in raws])
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join([raws[i] for i in at]), kinds[int(width)]).reshape(-1, GROUPS)
    return out


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix(s: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The shingles whose cells the set lies in."""
    n = len(s) - -(-percent * len(s) // 100) + 1
    return s[np.lexsort([s, rank[bucket(s)]])[:n]]


def reaches(bound: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap can give the similarity, for sets of this total size: 100 o >= p (total - o)."""
    return (100 + percent) * bound.astype(np.int64) >= percent * total


def bounded(v: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of positions, those whose bound reaches the threshold, with the bound's similarity."""
    ok = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    a, b = a[ok], b[ok]
    kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for i in range(0, len(a), PAIRS):
        x, y = a[i : i + PAIRS], b[i : i + PAIRS]
        o, total = np.minimum(v[x], v[y]).sum(1), n[x] + n[y]
        ok = reaches(o, total, percent)
        kept.append((x[ok], y[ok], o[ok] / (total[ok] - o[ok])))
    return tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def tree(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Order of the points, and levels from the leaves up: (upper corners, least and largest set size, first child)."""
    tiles = np.argsort(n, kind="stable")
    tile = np.empty(len(n), np.int64)
    tile[tiles] = np.arange(len(n)) // (LEAF * FAN)
    order = np.lexsort([v[:, : GROUPS // 2].sum(1) - v[:, GROUPS // 2 :].sum(1), tile])
    v, n = v[order], n[order]
    levels, upper, low, high, width = [], v, n, n, LEAF
    while True:
        heads = np.arange(0, len(upper), width)
        upper, low, high = np.maximum.reduceat(upper, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
        levels.append((upper, low, high, np.append(heads, 0)))
        levels[-1][3][-1] = len(levels[-2][0]) if len(levels) > 1 else len(v)
        if len(upper) <= FAN:
            return order, levels
        width = FAN


def tree_pairs(v: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that the tree cannot rule out by the corners of its nodes."""
    order, levels = tree(v, n)
    sv, sn = v[order], n[order]
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for first in range(0, len(v), 256):
        q = np.repeat(np.arange(first, min(first + 256, len(v))), len(levels[-1][0]))
        node = np.tile(np.arange(len(levels[-1][0])), len(q) // len(levels[-1][0]))
        for upper, low, high, heads in reversed(levels):
            least = np.maximum(low[node], -(-percent * sn[q] // 100))
            ok = (least <= high[node]) & (100 * sn[q] >= percent * low[node])
            q, node, least = q[ok], node[ok], least[ok]
            ok = np.concatenate([np.empty(0, bool), *(reaches(np.minimum(sv[q[i : i + PAIRS]], upper[node[i : i + PAIRS]]).sum(1), sn[q[i : i + PAIRS]] + least[i : i + PAIRS], percent) for i in range(0, len(q), PAIRS))])
            q, node = q[ok], node[ok]
            count = heads[node + 1] - heads[node]
            start = np.cumsum(count) - count
            node = np.repeat(heads[node], count) + np.arange(count.sum()) - np.repeat(start, count)
            q = np.repeat(q, count)
        ok = q < node
        out.append((order[q[ok]], order[node[ok]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def spanning(m: int, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Positions of edges of a spanning forest of the graph with the highest scores; each round joins every part by its best edge."""
    order = np.lexsort([b, a, -score])
    part, chosen = np.arange(m), []
    while True:
        order = order[part[a[order]] != part[b[order]]]
        if not len(order):
            return np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)
        ends = np.concatenate([part[a[order]], part[b[order]]])
        place = np.concatenate([np.arange(len(order))] * 2)
        by = np.lexsort([place, ends])
        best = np.unique(place[by][np.concatenate([[True], ends[by][1:] != ends[by][:-1]])])
        parent = np.arange(m)

        def find(x: int, parent=parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for e in order[best].tolist():
            x, y = find(int(part[a[e]])), find(int(part[b[e]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                chosen.append(np.array([e]))
        part = np.array([find(int(p)) for p in np.unique(part)])[np.unique(part, return_inverse=True)[1]]


def cell_pairs(group: np.ndarray, block: np.ndarray, mixed: np.ndarray, v: np.ndarray, n: np.ndarray, part: np.ndarray, percent: int, forest_only: bool):
    """(a, b, bound) of candidate pairs of positions in groups (runs of equal numbers): different parts, and if mixed, different blocks."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(heads, len(group)))
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def keep(a, b):
        ok = (part[a] != part[b]) & (~mixed[a] | (block[a] != block[b]))
        a, b, score = bounded(v, n, a[ok], b[ok], percent)
        if forest_only and len(a):
            which = spanning(len(v), a, b, score)  # parts of different groups never touch: an edge stays inside its group
            a, b, score = a[which], b[which], score[which]
        out.append((a, b, score))

    for size in np.unique(sizes):
        here = heads[sizes == size]
        if size < 2:
            continue
        if size > LEAF:
            for h in here:
                a, b = tree_pairs(v[h : h + size], n[h : h + size], percent)
                keep(h + a, h + b)
            continue
        i, j = np.triu_indices(size, 1)
        step = max(1, 8 * PAIRS // len(i))
        for k in range(0, len(here), step):
            some = here[k : k + step, None]
            keep((some + i).ravel(), (some + j).ravel())
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _described(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(key, n, d, point) of every row, and the sketch of each task as rows (segment, counts); written to the shared folder."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches, text, SLICE):
            found = sets(batch.column(text), words)
            for s in found:
                np.add.at(counts, bucket(s), 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array([len(s) for s in found], pa.int64()), pa.array([digest(s) if len(s) else None for s in found], pa.int64()),
                pa.array([point(s) if len(s) else None for s in found], pa.binary()), pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary()),
            ], ["key", "n", "d", "point", "segment", "counts"])
        forget()
        if counts.any():
            parts = [zlib.compress(p.astype(np.uint32).tobytes(), 1) for p in np.split(counts, SEGMENTS)]
            none = [pa.nulls(SEGMENTS, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SEGMENTS), pa.int32()), pa.array(parts, pa.binary())], ["key", "n", "d", "point", "segment", "counts"])

    return cut(docs.select("key", text).mapInArrow(run, "key long, n long, d long, point binary, segment int, counts binary"))


def _summed(blobs: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: 2 ** SKETCH_BITS numbers, whatever the input's size."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, raw in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64)
                total[segment] = total.get(segment, 0) + counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(c, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1) for c in total.values()], pa.binary())], ["segment", "counts"])

    schema = "segment int, counts binary"
    rows = blobs.select("segment", "counts").repartition(SEGMENTS, "segment").mapInArrow(add, schema).collect()
    out = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS), np.int64)
    for r in rows:
        out[r.segment] += np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return out.ravel()


def _cells(docs: DataFrame, text: str, words: int, rank: np.ndarray, percent: int) -> DataFrame:
    """(token, d, size) of the classes in each cell of two classes or more, of cells with the same classes one."""

    def run(batches):
        seen: set[int] = set()  # copies inside a task go once
        for batch in slices(batches, text, SLICE):
            tokens, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for s in sets(batch.column(text), words):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    tokens.append(prefix(s, rank, percent))
                    of.append(np.full(len(tokens[-1]), d, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(of))], ["token", "d"])
        forget()

    rows = docs.select(text).mapInArrow(run, "token long, d long").repartition("token").dropDuplicates(["token", "d"])
    cell = Window.partitionBy("token")
    members = {"size": F.count("*"), "low": F.min("d"), "x": F.bit_xor(F.xxhash64("d")), "y": F.bit_xor(F.xxhash64(F.lit(1), "d"))}
    found = cut(rows.withColumns({k: v.over(cell) for k, v in members.items()}).where("size > 1"))
    once = found.groupBy("low", "size", "x", "y").agg(F.min("token").alias("token")).select("token")
    cells = cut(found.join(once, "token", "left_semi").select("token", "d", "size"))
    discard(found)
    return cells


def _candidates(cells: DataFrame, classes: DataFrame, percent: int, forest_only: bool) -> DataFrame:
    """(a, b), a < b: distinct pairs of classes of different parts whose bound reaches the threshold."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = cells.join(classes, "d").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "d", "n", "point", "part")
    keys = ["token", "x", "y"]
    rows = rows.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "d")

    def pairs_of(table):
        token, x, y, own, d, n, part = (table.column(c).to_numpy() for c in (*keys, "own", "d", "n", "part"))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        once = new | np.concatenate([[True], d[1:] != d[:-1]])
        group = np.cumsum(new)[once]
        v = points(table.column("point").filter(pa.array(once)).to_pylist())
        a, b, score = cell_pairs(group, own[once], (x != y)[once], v, n[once], part[once], percent, forest_only)
        a, b = d[once][a], d[once][b]
        return np.minimum(a, b), np.maximum(a, b), score

    def run(batches):
        kept, size = [], 0

        def flushed():  # near copies meet in many cells: a pair leaves once for so many rows
            low, high, score = (np.concatenate(c) for c in zip(*kept, strict=True))
            order = np.lexsort([high, low])
            low, high, score = low[order], high[order], score[order]
            first = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(low)]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(low[first]), pa.array(high[first]), pa.array(score[first])], ["a", "b", "score"])

        for table in whole_groups(batches, keys):
            kept.append(pairs_of(table))
            size += len(kept[-1][0])
            if size > FLUSH:
                yield flushed()
                size = 0
        if kept:
            yield flushed()
        release()

    return rows.mapInArrow(run, "a long, b long, score double").groupBy("a", "b").agg(F.max("score").alias("score"))


def _sets(docs: DataFrame, text: str, words: int, pairs: DataFrame) -> DataFrame:
    """(d, n, fine, items): the whole sets of the classes that occur in pairs, and their counts in finer groups."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct()

    def sketched(batches):
        bits = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            bits[bucket(batch.column("d").to_numpy().astype(np.uint64))] = 1
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in np.split(bits, SEGMENTS)], pa.binary())], ["segment", "counts"])

    needed = _summed(wanted.mapInArrow(sketched, "segment int, counts binary")) > 0  # fixed size; spares most sets the way

    def whole(batches):
        seen: set[int] = set()
        for batch in slices(batches, text, SLICE):
            found = [(digest(s), s) for s in sets(batch.column(text), words) if len(s)]
            found = [(d, s.tobytes()) for d, s in found if needed[(d % (1 << 64)) >> (64 - SKETCH_BITS)] and not (d in seen or seen.add(d))]
            if found:
                ids, raws = zip(*found, strict=True)
                fine = [fine_point(np.frombuffer(r, np.uint64)) for r in raws]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) // 8 for r in raws], pa.int64()), pa.array(fine, pa.binary()), pa.array(raws, pa.binary())], ["d", "n", "fine", "items"])
        forget()

    own = docs.select(text).mapInArrow(whole, "d long, n long, fine binary, items binary")
    own = own.groupBy("d").agg(*[F.first(c).alias(c) for c in ("n", "fine", "items")])
    return cut(own.join(wanted, "d", "left_semi"))


def _refined(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bound still reaches the threshold in the finer groups, with that bound's similarity as score.

    Large sets fill all GROUPS groups alike, so that the bound in a cell rules little out; these counts are a sixteenth of
    a set's size."""
    fine = whole.select("d", "n", "fine")
    of = lambda c: fine.withColumnsRenamed({"d": c, "n": f"n{c}", "fine": f"fine_{c}"})

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            bound = np.array([fine_bound(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("fine_a"), batch.column("fine_b"), strict=True)], np.int64)
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            ok = reaches(bound, total, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(bound[ok] / (total[ok] - bound[ok]))], ["a", "b", "score"])
        release()

    sides = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a")
    return cut(sides.mapInArrow(run, "a long, b long, score double"))


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(pa, pb) of the pairs (a, b, pa, pb) whose sets are similar enough, by the overlap of the whole sets."""
    one, two = (whole.join(pairs.select(F.col(c).alias("d")).distinct(), "d", "left_semi") for c in ("a", "b"))  # only these sets travel
    right = pairs.join(two.select(F.col("d").alias("b"), F.col("items").alias("theirs")), "b")
    sides = right.join(one.select(F.col("d").alias("a"), F.col("items").alias("ours")), "a").select("pa", "pb", "ours", "theirs")

    def run(batches):
        for batch in batches:
            kept = []
            for ours, theirs in zip(batch.column("ours"), batch.column("theirs"), strict=True):
                s, t = np.frombuffer(ours.as_buffer(), np.uint64), np.frombuffer(theirs.as_buffer(), np.uint64)
                o = len(np.intersect1d(s, t, assume_unique=True))
                kept.append(100 * o >= percent * (len(s) + len(t) - o))
            yield batch.select(["pa", "pb"]).filter(pa.array(kept, pa.bool_()))
        release()

    return sides.mapInArrow(run, "pa long, pb long")


def _joined(parts: DataFrame, pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """parts (d, part) after links among the pairs (a, b, score): no pair that is similar enough is left between two parts.

    BEST_ROUNDS times every part tries its best pair; then all pairs that are still between parts are tried."""
    sides = [parts.select(F.col("d").alias(c), F.col("part").alias(f"p{c}")) for c in ("a", "b")]
    for last in (*[False] * BEST_ROUNDS, True):
        tried = pairs.join(sides[0], "a").join(sides[1], "b").where("pa <> pb")
        if not last:
            best = F.max(F.struct("score", "a", "b", "pa", "pb")).alias("best")
            tried = tried.withColumn("part", F.explode(F.array("pa", "pb"))).groupBy("part").agg(best).select("best.*").distinct()
        tried = cut(tried.select("a", "b", "pa", "pb"))
        if tried.isEmpty():
            break
        links = _verified(tried, whole, percent).select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        labels = components(links)
        merged = labels.select(F.col("v").alias("part"), F.col("component").alias("into"))
        before, parts = parts, cut(parts.join(merged, "part", "left").select("d", F.coalesce("into", "part").alias("part")))
        discard(before, labels)
        sides = [parts.select(F.col("d").alias(c), F.col("part").alias(f"p{c}")) for c in ("a", "b")]
        pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    return parts


def near_duplicates(df: DataFrame, words: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row: links are pairs of sets whose Jaccard similarity is percent / 100 or
    more, component_id is the smallest key that the row reaches by links, its own included."""
    docs = small_batches(df).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    described = _described(docs, "text", words)
    counts = _summed(described.where("segment is not null"))
    rank = np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / max(1.0, counts.mean())))).astype(np.int8)
    rows = described.where("segment is null").select("key", "n", "d", "point")
    classes = rows.where("d is not null").groupBy("d").agg(F.first("n").alias("n"), F.first("point").alias("point"), F.min("key").alias("rep"))
    cells = _cells(docs, "text", words, rank, percent)
    inside = classes.select("d", "n", "point").join(cells.select("d").distinct(), "d", "left_semi")
    first = cut(_candidates(cells, inside.withColumn("part", F.col("d")), percent, True))
    whole = _sets(docs, "text", words, first)
    near = _refined(first, whole, percent)
    parts = _joined(cut(whole.select("d", F.col("d").alias("part"))), near, whole, percent)
    second = inside.join(parts, "d", "left").withColumn("part", F.coalesce("part", "d"))
    held = cells.join(second.select("d", "part"), "d").groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    mixed = cells.join(held.where("low <> high").select("token"), "token")  # the others are one component already
    second = cut(_candidates(mixed, second, percent, False).join(first, ["a", "b"], "left_anti"))
    still = _refined(second, whole, percent)
    parts = _joined(parts, still, whole, percent)
    discard(cells, first, near, second, still, whole)
    named = classes.select("d", "rep").join(parts, "d", "left").withColumn("part", F.coalesce("part", "d"))
    names = named.groupBy("part").agg(F.min("rep").alias("name"))
    named = named.join(names, "part").select("d", "name")
    out = rows.select("key", "n", "d").join(named, "d", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("name", "key").alias("component_id"))

"""Benchmark decontamination with an FM-index per shard of the training documents.

Words of the documents become symbols of a shard's dictionary. A shard keeps the runs of words that all occur somewhere
in the benchmark and are as long as the shortest phrase at least (no other place can hold a phrase; which words occur
is a bit table of fixed size, whose false hits only lengthen runs). Each run ends in a terminator of its own, suffixes
are sorted by prefix doubling, and the shard stores what an FM-index needs: the Burrows-Wheeler transform as a wavelet
matrix, symbol counts, and the position of every SAMPLE-th word of a run. The index is a table in the shared folder.

Test phrases are the windows of WINDOW consecutive words of each item, or all words of a shorter item. They are searched
backwards, all at once, with two wavelet ranks a step; the occurrences are located by walking to a sampled position,
and the places that they cover merge to removal spans in word numbers. Phrases come in blocks of BLOCK_WORDS words, each
checked before it is sent to the tasks; a larger benchmark means more passes over the index, never a larger block.

Shards are cut where the documents are read, nothing is shuffled by a key. A text longer than a shard goes on in the
next one, which repeats its last WINDOW - 1 words; only the parts of such texts meet again, by row.

Every row gives one row, repeated rows too. Null and empty texts have no words and no hits. Items with the same id count
as one item; a null id counts as the empty string. Other columns, whatever their names, travel in the struct `row`.
Words are compared by 64-bit hashes: a false hit needs a window that differs only in words whose hashes agree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .common import cut, small_batches
from .shingles import LOWER, PART_BYTES, texts_in_parts, words

WINDOW = 10
SAMPLE = 8  # every so many words of a run, its first one included, the index keeps the position
SHARD_WORDS = 1_000_000  # a shard is closed after so many indexed words,
SHARD_ROWS = 50_000  # or so many rows
BLOCK_WORDS = 250_000  # phrase words searched in one pass
ALPHABET_BITS = 24  # the bit table of the benchmark's words has 2 to this power bits
BITMAP = 32_768  # bits of one of Spark's bitmaps

#: Fixed value: what ends a word, after A-Z are lower-cased: ASCII that is no letter and no digit.
BREAKS = np.ones(256, bool)
BREAKS[48:58] = BREAKS[97:123] = BREAKS[128:] = False

SPANS = ArrayType(StructType().add("start", "long").add("end", "long"))


# ---- the index of one shard -----------------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes of symbols >= 1 in runs that each end in a 0; of two zeros the earlier one is the smaller."""
    n = len(symbols)
    ends = symbols == 0
    key = np.where(ends, np.cumsum(ends) - 1, int(ends.sum()) + symbols)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, sizes)
    open_ = order[np.repeat(sizes > 1, sizes)]  # suffixes that share their first k symbols with another
    k = 1
    while len(open_):
        own, then = rank[open_], rank[open_ + k]
        by = np.argsort(own * n + then)
        open_, own, then = open_[by], own[by], then[by]
        new_own = np.concatenate([[True], own[1:] != own[:-1]])
        new = new_own | np.concatenate([[True], then[1:] != then[:-1]])
        at = np.arange(len(open_))
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        base = at[new_own][np.cumsum(new_own) - 1]
        rank[open_] = own + start[group] - base
        sizes = np.diff(np.append(start, len(open_)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """64 bits a word, one word more than needed, so that the rank of the length can be asked."""
    words_ = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
    raw = np.packbits(bits, bitorder="little")
    words_[: len(raw)] = raw
    return words_.view(np.uint64)


class Bits:
    """Bit vector with rank."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(data), dtype=np.int64)[:-1]])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.data[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.data[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def wavelet(symbols: np.ndarray, levels: int) -> np.ndarray:
    """Wavelet matrix: for each bit of the symbols, highest first, a packed row; each level deals zeros before ones."""
    rows = []
    for level in range(levels - 1, -1, -1):
        bit = (symbols >> level) & 1 == 1
        rows.append(packed(bit))
        symbols = np.concatenate([symbols[~bit], symbols[bit]])
    return np.concatenate(rows) if rows else np.empty(0, np.uint64)


class Index:
    """FM-index of a shard's runs: counts, sizes and searches; built from arrays or read from a stored row."""

    def __init__(self, n: int, dictionary: np.ndarray, counts: np.ndarray, bits: np.ndarray, marked: np.ndarray, sampled: np.ndarray) -> None:
        self.n, self.dictionary, self.counts, self.bits, self.marked, self.sampled = n, dictionary, counts, bits, marked, sampled
        levels = levels_of(len(dictionary))
        self.levels = [Bits(b) for b in bits.reshape(levels, -1)] if n else []
        self.zeros = [n - int(b.rank(np.array([n]))[0]) for b in self.levels]
        self.marks = Bits(marked)
        every = np.arange(len(dictionary) + 1)
        self.base = self._down(every, np.zeros(len(every), np.int64)) if n else np.zeros(len(every), np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray, run_starts: np.ndarray) -> Index:
        """hashes: the words, with a place for the terminator after each run; run_starts: where the runs begin."""
        n = len(hashes)
        ends = np.zeros(n, bool)
        if n:
            ends[np.append(run_starts[1:], n) - 1] = True
        dictionary = np.unique(hashes[~ends])
        symbols = np.zeros(n, np.int64)
        symbols[~ends] = np.searchsorted(dictionary, hashes[~ends]) + 1
        suffixes = suffix_array(symbols)
        counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(dictionary) + 1))])
        offset = np.arange(n) - np.repeat(run_starts, np.diff(np.append(run_starts, n)))
        chosen = (offset % SAMPLE == 0)[suffixes]
        bits = wavelet(symbols[suffixes - 1], levels_of(len(dictionary)))
        return cls(n, dictionary, counts, bits, packed(chosen), suffixes[chosen].astype(np.int32))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions end up below all levels, following the bits of their symbols."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(at)
            bit = (symbol >> (len(self.levels) - 1 - k)) & 1 == 1
            at = np.where(bit, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step of range ends: suffixes before `at`, now with the symbol in front."""
        return self.counts[symbol] + self._down(symbol, at) - self.base[symbol]

    def back(self, at: np.ndarray) -> np.ndarray:
        """The suffix one word earlier, read off the transform itself."""
        symbol = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = level.get(at), level.rank(at)
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + ones, at - ones)
        return self.counts[symbol] + at - self.base[symbol]

    def ranges(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the phrases that occur; a phrase is the first `size` hashes of its row."""
        which = np.arange(len(sizes))
        if not self.n or not len(sizes):
            return which[:0], which[:0], which[:0]
        at = np.searchsorted(self.dictionary, phrases)
        known = self.dictionary[np.minimum(at, len(self.dictionary) - 1)] == phrases
        inside = np.arange(phrases.shape[1]) < sizes[:, None]
        which = which[(known | ~inside).all(axis=1)]
        symbols = at + 1
        last = symbols[which, sizes[which] - 1]
        low, high = self.counts[last], self.counts[last + 1]
        for back in range(2, phrases.shape[1] + 1):
            more = np.flatnonzero(sizes[which] >= back)
            symbol = symbols[which[more], sizes[which[more]] - back]
            low[more], high[more] = self.step(symbol, low[more]), self.step(symbol, high[more])
            left = low < high
            which, low, high = which[left], low[left], high[left]
        return which, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions in the shard's words of suffixes, by walking back to sampled ones."""
        out, walked = np.empty(len(at), np.int64), np.arange(len(at))
        steps = 0
        while len(walked):
            found = self.marks.get(at)
            out[walked[found]] = self.sampled[self.marks.rank(at[found])] + steps
            walked, at = walked[~found], at[~found]
            at = self.back(at)
            steps += 1
        return out


def levels_of(words_: int) -> int:
    return max(1, int(words_).bit_length())


# ---- phrases --------------------------------------------------------------------------------------------------------


@dataclass
class Block:
    """Distinct phrases, and the items of each: items[ids[starts[p]:starts[p + 1]]]."""

    phrases: np.ndarray
    sizes: np.ndarray
    items: list[str]
    starts: np.ndarray
    ids: np.ndarray


def phrase_block(rows: list[tuple[str, np.ndarray]], window: int) -> Block:
    if not rows:
        none = np.empty(0, np.int64)
        return Block(np.empty((0, window), np.uint64), none, [], np.zeros(1, np.int64), none)
    names = sorted({item for item, _ in rows})
    number = {item: k for k, item in enumerate(names)}
    found, sizes, owners = [np.empty((0, window), np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for item, hashes in rows:
        size = min(window, len(hashes))
        own = np.zeros((len(hashes) - size + 1, window), np.uint64)
        own[:, :size] = np.lib.stride_tricks.sliding_window_view(hashes, size)
        found.append(own)
        sizes.append(np.full(len(own), size))
        owners.append(np.full(len(own), number[item]))
    table = np.column_stack([np.concatenate(sizes).astype(np.uint64), np.concatenate(found)])
    distinct, phrase = np.unique(table, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([phrase.reshape(-1), np.concatenate(owners)]), axis=0)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Block(distinct[:, 1:].copy(), distinct[:, 0].astype(np.int64), names, starts, pairs[:, 1])


def phrases_of(items: DataFrame, item: str, text: str, window: int, block_words: int = BLOCK_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(item, words): the hashes of every item's words, equal rows once, in parts of block_words / 4 that overlap by window - 1."""
    most = max(window, block_words // 4)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty(0, np.uint64)
        opened = False  # the item at hand has given a part
        for batch, texts, last in texts_in_parts(batches, "text", BREAKS, part_bytes):
            row, hashes = words(texts, BREAKS)
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
            names, parts = [], []
            for i in range(len(texts)):
                kept = np.concatenate([kept, hashes[ends[i] : ends[i + 1]]])
                given = []
                while len(kept) > most:
                    given.append(kept[:most])
                    opened, kept = True, kept[most - window + 1 :]
                if last:
                    given += [kept] if len(kept) >= (window if opened else 1) else []
                    opened, kept = False, kept[:0]
                names += [batch.column("item")[i].as_py()] * len(given)
                parts += [g.view(np.int64) for g in given]
            if names:
                yield pa.RecordBatch.from_pydict({"item": pa.array(names, pa.string()), "words": pa.array(parts, pa.list_(pa.int64()))})

    rows = small_batches(items).select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(split, "item string, words array<long>").distinct()


def alphabet(phrases: DataFrame) -> np.ndarray:
    """Bit table of the words that occur in phrases, 2^ALPHABET_BITS bits; folded by Spark in bitmaps of 4 KB."""
    ids = phrases.select(F.explode("words").alias("h")).select((F.shiftrightunsigned("h", 64 - ALPHABET_BITS) + 1).alias("id"))
    folded = ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    table = np.zeros((1 << ALPHABET_BITS) // 8, np.uint8)
    for bucket, bits in folded.collect():  # at most 2^ALPHABET_BITS / BITMAP rows
        start = (bucket - 1) * BITMAP // 8
        table[start : start + len(bits)] = np.frombuffer(bits, np.uint8)
    return table


def phrase_blocks(phrases: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The phrases in blocks of 2 * block_words words at most; sizes are asked before a block is fetched."""
    total = phrases.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // block_words))
    while True:
        dealt = phrases.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(n)))
        if (dealt.groupBy("block").agg(F.sum(F.size("words")).alias("w")).agg(F.max("w")).first()[0] or 0) <= 2 * block_words:
            break
        n *= 2
    for b in range(n):
        got = dealt.where(F.col("block") == b).select("item", "words").toArrow()
        flat = pa.concat_arrays(got.column("words").chunks) if got.num_rows else pa.array([], pa.list_(pa.int64()))
        values, offsets = flat.values.to_numpy().view(np.uint64), flat.offsets.to_numpy()
        yield phrase_block([(i, values[x:y]) for i, x, y in zip(got.column("item").to_pylist(), offsets[:-1], offsets[1:], strict=True)], window)


# ---- tables of shards, searches -------------------------------------------------------------------------------------

STORED = "shard string, n long, dictionary binary, counts binary, bits binary, marked binary, sampled binary, runs binary, parts boolean"


class Shard:
    """Collects rows and their words that occur in phrases, until it is turned into an index."""

    def __init__(self, window: int, shortest: int) -> None:
        self.window, self.shortest = window, shortest
        self.ids: list[int] = []
        self.n_words: list[int] = []
        self.rows: list[pa.Array] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row in the shard, word number, hash
        self.size = 0
        self.parts = False

    def add(self, row: np.ndarray, number: np.ndarray, hashes: np.ndarray) -> None:
        self.found.append((row, number, hashes))
        self.size += len(row)

    def tail(self, row: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash) of a row's last words that a phrase may share with the words to come."""
        number, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for r, w, h in self.found:
            last = (r == row) & (w > n_words - self.window)
            number.append(w[last])
            hashes.append(h[last])
        return np.concatenate(number), np.concatenate(hashes)

    def stored(self, name: str, kind: pa.Schema) -> pa.RecordBatch:
        row, number, hashes = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)])) if len(row) else np.empty(0, np.int64)
        sizes = np.diff(np.append(begins, len(row)))
        kept = sizes >= self.shortest
        hashes = hashes[np.repeat(kept, sizes)]
        begins, sizes = begins[kept], sizes[kept]
        starts = np.cumsum(sizes + 1) - sizes - 1
        words_ = np.zeros(int((sizes + 1).sum()), np.uint64)
        inside = np.ones(len(words_), bool)
        inside[starts + sizes] = False
        words_[inside] = hashes
        index = Index.build(words_, starts)
        runs = np.column_stack([starts, row[begins], number[begins]]).astype(np.int64)
        ids = pa.array([f"{name.partition('-')[0]}-{i}" for i in self.ids], pa.string())
        fields = kind.field("rows").type.value_type
        rows = pa.StructArray.from_arrays([ids, pa.array(self.n_words, pa.int64()), pa.concat_arrays(self.rows)], fields=[fields.field(i) for i in range(3)])
        values = [name, index.n, *(x.tobytes() for x in (index.dictionary, index.counts, index.bits, index.marked, index.sampled, runs)), self.parts]
        columns = [pa.array([v], kind.field(k).type) for k, v in enumerate(values)]
        listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows).cast(kind.field("rows").type)
        return pa.RecordBatch.from_arrays([*columns, listed], schema=kind)


def index_table(docs: DataFrame, text: str, carried: list[str], bits: np.ndarray, shortest: int, window: int, shard_words: int = SHARD_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each shard: its index, and the carried columns of its rows."""
    row = F.struct(*carried) if carried else F.struct(F.lit(None).cast("int").alias("none"))
    given = small_batches(docs).select(row.alias("row"), F.col(text).alias("text"))
    kind = StructType.fromDDL(STORED).add("rows", ArrayType(StructType().add("id", "string").add("n_words", "long").add("row", given.schema["row"].dataType)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        task, made = TaskContext.get().partitionId(), 0
        shard, row_id, so_far = Shard(window, shortest), 0, 0
        for batch, texts, last in texts_in_parts(batches, "text", BREAKS, part_bytes):
            row, hashes = words(texts, BREAKS)
            counts = np.bincount(row, minlength=len(texts))
            number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + so_far
            known = bits[hashes >> np.uint64(64 - ALPHABET_BITS + 3)] >> ((hashes >> np.uint64(64 - ALPHABET_BITS)) & np.uint64(7)).astype(np.uint8) & 1 == 1
            new = so_far == 0 and not (shard.ids and shard.ids[-1] == row_id)
            at = len(shard.ids) if new else len(shard.ids) - 1
            if new:
                shard.ids += range(row_id, row_id + len(texts))
                shard.n_words += [0] * len(texts)
                shard.rows.append(batch.column("row"))
            shard.add(row[known] + at, number[known], hashes[known])
            so_far += int(counts.sum()) if not last or len(texts) == 1 else 0
            for i, c in enumerate(counts.tolist()):
                shard.n_words[at + i] = so_far if len(texts) == 1 else c
            if last:
                row_id, so_far = row_id + len(texts), 0
            if shard.size >= shard_words or len(shard.ids) >= SHARD_ROWS:
                full, shard = shard, Shard(window, shortest)
                full.parts = full.parts or not last
                if not last:  # the row goes on in the next shard
                    shard.parts = True
                    shard.ids.append(row_id)
                    shard.n_words.append(0)
                    shard.rows.append(batch.column("row"))
                    tail = full.tail(len(full.ids) - 1, so_far)
                    shard.add(np.zeros(len(tail[0]), np.int64), *tail)
                yield full.stored(f"{task}-{made}", schema)
                made += 1
        if shard.ids:
            yield shard.stored(f"{task}-{made}", schema)

    return cut(given.mapInArrow(build, kind))


def search(index: DataFrame, block: Block) -> DataFrame:
    """(id, n_words, spans, items, row) for every row of the shards: where phrases of the block occur, and of which items."""
    kind = StructType().add("id", "string").add("n_words", "long").add("spans", SPANS).add("items", ArrayType(StringType())).add("row", index.schema["rows"].dataType.elementType["row"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            for k in range(batch.num_rows):
                stored = {c: batch.column(c)[k] for c in ("n", "dictionary", "counts", "bits", "marked", "sampled", "runs")}
                read = lambda c, t: np.frombuffer(stored[c].as_buffer(), t)  # noqa: B023, E731
                one = Index(stored["n"].as_py(), read("dictionary", np.uint64), read("counts", np.int64), read("bits", np.uint64), read("marked", np.uint64), read("sampled", np.int32))
                rows = batch.column("rows")[k].values
                spans, items = hits(one, read("runs", np.int64).reshape(-1, 3), len(rows), block)
                yield pa.RecordBatch.from_arrays([rows.field("id"), rows.field("n_words"), spans.cast(schema.field("spans").type), items.cast(schema.field("items").type), rows.field("row")], schema=schema)

    return index.mapInArrow(run, kind)


def hits(index: Index, runs: np.ndarray, n_rows: int, block: Block) -> tuple[pa.ListArray, pa.ListArray]:
    """For every row the merged spans of phrases, and the items that they belong to."""
    phrase, low, high = index.ranges(block.phrases, block.sizes)
    covered = np.zeros(index.n + 1, np.int32)
    starts = runs[:, 0]
    pairs = [np.empty((0, 2), np.int64)]
    done, total = 0, np.concatenate([[0], np.cumsum(high - low)])
    while done < len(phrase):  # about a million occurrences at once; one phrase's alone may be more
        upto = max(done + 1, int(np.searchsorted(total, total[done] + 1_000_000, side="right")) - 1)
        counts = (high - low)[done:upto]
        suffix = np.arange(total[done], total[upto]) - np.repeat(total[done:upto] - low[done:upto], counts)
        at, which = index.locate(suffix), np.repeat(phrase[done:upto], counts)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + block.sizes[which], -1)
        row = runs[np.searchsorted(starts, at, side="right") - 1, 1]
        pairs.append(np.unique(np.column_stack([row, which]), axis=0))
        done = upto
    inside = np.concatenate([[False], np.cumsum(covered[:-1]) > 0, [False]])
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    run = np.searchsorted(starts, begin, side="right") - 1
    first = runs[run, 2] + begin - starts[run]
    values = pa.StructArray.from_arrays([pa.array(first), pa.array(first + end - begin)], ["start", "end"])
    offsets = np.searchsorted(runs[run, 1], np.arange(n_rows + 1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    counts = block.starts[pairs[:, 1] + 1] - block.starts[pairs[:, 1]]
    owner = np.repeat(pairs[:, 0], counts)
    item = block.ids[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - block.starts[pairs[:, 1]], counts)]
    owned = np.unique(np.column_stack([owner, item]), axis=0)
    names = pa.array([block.items[i] for i in owned[:, 1]], pa.string())
    return (
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(owned[:, 0], np.arange(n_rows + 1)), pa.int32()), names),
    )


def merged(spans: Column) -> Column:
    """Sorted spans that neither overlap nor touch."""
    none = F.array().cast(SPANS)

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]), longer).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.sort_array(spans), none, add)


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    carry_text: bool = False,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(row, n_words, spans, items) for every row of docs: the words of phrases of items, as merged spans of word numbers
    (from 0, end exclusive), and the ids of the items, as sorted strings. `row` holds the other columns, and the text too
    if that is wanted (it then lies in the index table as well)."""
    phrases = cut(phrases_of(items, item, item_text, window, block_words, part_bytes))
    shortest = phrases.agg(F.min(F.least(F.size("words"), F.lit(window)))).first()[0] or window
    carried = [c for c in docs.columns if c != text or carry_text]
    index = index_table(docs, text, carried, alphabet(phrases), shortest, window, shard_words, part_bytes)
    found = [search(index, block) for block in phrase_blocks(phrases, window, block_words)]
    if len(found) == 1 and index.where("parts").isEmpty():
        return found[0].select("row", "n_words", "spans", F.sort_array("items").alias("items"))
    parts: Callable[[str], Column] = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  # as many as blocks and shards of one text
    together = found[0]
    for more in found[1:]:
        together = together.union(more)
    whole = together.groupBy("id").agg(F.any_value("row").alias("row"), F.max("n_words").alias("n_words"), merged(parts("spans")).alias("spans"), F.sort_array(F.array_distinct(parts("items"))).alias("items"))
    return whole.drop("id")


def n_hit(spans: Column | str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


@F.arrow_udf(StringType())
def without(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the words of their spans: from a span's first word to the end of its last one."""
    out = []
    for t, s in zip(text, spans.to_pylist(), strict=True):
        if not t.is_valid or not s:
            out.append(t.as_py())
            continue
        raw = t.as_py().encode()
        word = np.concatenate([[False], ~BREAKS[LOWER[np.frombuffer(raw, np.uint8)]], [False]])
        begin, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
        pieces, at = [], 0
        for span in s:
            pieces.append(raw[at : begin[span["start"]]])
            at = end[span["end"] - 1]
        out.append(b"".join([*pieces, raw[at:]]).decode())
    return pa.array(out, pa.string())


def remove(docs: DataFrame, items: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """docs with the phrases cut out of their texts. options: those of find."""
    found = find(docs, items, text, carry_text=True, **options)
    fields = {c: F.col("row")[c] for c in docs.columns}
    return found.select(*[(without(v, F.col("spans")) if c == text else v).alias(c) for c, v in fields.items()])

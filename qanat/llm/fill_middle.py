"""Fill-in-the-middle transformation over texts that are stored as seekable compressed frames.

store() cuts a text's UTF-8 bytes into frames of FRAME_BYTES at most, each compressed on its own with zstandard, and
keeps cumulative counts of units, code points and bytes after each frame. A unit is a word with the white space before
it, or the white space at the end; it begins at the text's start and wherever white space follows something else, so
frames need not end where units do. To find where a unit begins, the frame is chosen by its counts and only that one is
decompressed. The output is streamed frame by frame into frames of its own, restoring and digests likewise, so a task
holds one frame of a text at a time, not the text several times.

Every row is kept, repeated rows too; nothing is shuffled. A null text is the empty text: no frames, form `plain`. A
null key is hashed as the empty string. Columns that carry the name of an added column are replaced, others untouched."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .common import small_batches
from .shingles import SPACE

FRAME_BYTES = 65_536
FRAMES = ArrayType(StructType().add("units", "long").add("chars", "long").add("bytes", "long").add("data", "binary"))
#: The marks before prefix, suffix and middle, and the order of the parts in each form.
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
ORDERS = {"psm": "PSM", "spm": "SPM"}
FRAME = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())])


def starts(data: bytes, after_space: bool) -> np.ndarray:
    """Byte positions at which a unit begins because white space follows something else; the text's own start is not one."""
    space = SPACE[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(space & ~np.concatenate([[after_space], space[:-1]]))


def chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class Writer:
    """Collects bytes of one text and cuts them into frames at code points."""

    def __init__(self) -> None:
        self.frames: list[tuple[int, int, int, bytes]] = []
        self.held = bytearray()
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.counts = (0, 0, 0)
        self.after_space = False

    def add(self, data: bytes | memoryview) -> None:
        at = 0
        while at < len(data):
            took = data[at : at + FRAME_BYTES + 4 - len(self.held)]
            self.held += took
            at += len(took)
            if len(self.held) >= FRAME_BYTES + 4:
                end = FRAME_BYTES
                while self.held[end] & 0xC0 == 0x80:
                    end -= 1
                self._flush(end)

    def _flush(self, end: int) -> None:
        data = bytes(self.held[:end])
        del self.held[:end]
        units, n, size = self.counts
        # the first unit of a text begins at its start, whatever stands there
        first = not self.frames
        units += len(starts(data, first or self.after_space)) + first
        self.counts = (units, n + chars(data), size + len(data))
        self.after_space = bool(SPACE[data[-1]])
        self.frames.append((*self.counts, self.pack(data)))

    def done(self) -> list[tuple[int, int, int, bytes]]:
        while self.held:
            end = min(len(self.held), FRAME_BYTES)
            while end < len(self.held) and self.held[end] & 0xC0 == 0x80:
                end -= 1
            self._flush(end)
        return self.frames


class Reader:
    """One text's frames; holds the frame decompressed last."""

    def __init__(self, frames: list[dict]) -> None:
        self.frames = frames
        self.units = [f["units"] for f in frames]
        self.ends = [f["bytes"] for f in frames]
        self.size = self.ends[-1] if frames else 0
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.held = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            self.held = (k, self.unpack(self.frames[k]["data"]))
        return self.held[1]

    def unit(self, u: int) -> tuple[int, int]:
        """(bytes, code points) before unit u; u may be the number of units."""
        if u == 0 or not self.frames:
            return 0, 0
        if u >= self.units[-1]:
            return self.size, self.frames[-1]["chars"]
        k = bisect_right(self.units, u)
        data = self.frame(k)
        before = self.frames[k - 1] if k else {"units": 0, "chars": 0, "bytes": 0}
        at = starts(data, True)  # without a start at the first byte, which the counts tell
        if len(at) < self.units[k] - before["units"]:
            at = np.concatenate([[0], at])
        at = int(at[u - before["units"]])
        return before["bytes"] + at, before["chars"] + chars(data[:at])

    def read(self, start: int, end: int) -> Iterator[memoryview]:
        """The bytes from start to end, a frame's share at a time."""
        k = bisect_right(self.ends, start)
        while start < end:
            begin = self.ends[k - 1] if k else 0
            stop = min(end, self.ends[k])
            yield memoryview(self.frame(k))[start - begin : stop - begin]
            start, k = stop, k + 1

    def find(self, mark: bytes, start: int) -> int:
        """Where the mark first occurs from start on; it may lie across frames."""
        tail = b""
        for part in self.read(start, self.size):
            both = tail + bytes(part)
            if (i := both.find(mark)) >= 0:
                return start - len(tail) + i
            start += len(part)
            tail = both[-len(mark) + 1 :]
        raise ValueError(f"no {mark!r} in an output")


def framed(pieces: Iterable[bytes | memoryview]) -> list[tuple[int, int, int, bytes]]:
    out = Writer()
    for piece in pieces:
        out.add(piece)
    return out.done()


def column(texts: Iterable[list[tuple[int, int, int, bytes]]]) -> pa.ListArray:
    rows: list[tuple[int, int, int, bytes]] = []
    ends = [0]
    for frames in texts:
        rows += frames
        ends.append(len(rows))
    units, n, size, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    values = pa.StructArray.from_arrays([pa.array(units, pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())], fields=list(FRAME))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def arranged(reader: Reader, form: str, prefix: int, middle: int) -> Iterator[bytes | memoryview]:
    """The output's pieces in order; prefix and middle: the bytes at which they end."""
    if form not in ORDERS:
        yield from reader.read(0, reader.size)
        return
    parts = {"P": (0, prefix), "M": (prefix, middle), "S": (middle, reader.size)}
    for name in ORDERS[form]:
        yield MARKS[name]
        yield from reader.read(*parts[name])


def rebuilt(reader: Reader, form: str) -> Iterator[memoryview]:
    """The text's pieces in order, from the output and its form alone: the marks say where the parts are."""
    if form not in ORDERS:
        yield from reader.read(0, reader.size)
        return
    begins = [0]
    for name in ORDERS[form][1:]:
        begins.append(reader.find(MARKS[name], begins[-1] + 3))
    parts = {name: (b + 3, e) for name, b, e in zip(ORDERS[form], begins, [*begins[1:], reader.size], strict=True)}
    for name in "PMS":
        yield from reader.read(*parts[name])


@F.arrow_udf(FRAMES)
def _store(text: pa.Array) -> pa.Array:
    return column(framed([t.as_py().encode()]) if t.is_valid else [] for t in text)


@F.arrow_udf(StructType().add("output", FRAMES).add("prefix_chars", "long").add("middle_chars", "long"))
def _arrange(frames: pa.Array, form: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    counts: list[tuple[int | None, int | None]] = []

    def output(row: pa.ListScalar, kind: str, p: int, m: int) -> list[tuple[int, int, int, bytes]]:
        reader = Reader(row.as_py() or [])
        (b1, c1), (b2, c2) = reader.unit(p), reader.unit(m)
        counts.append((c1, c2 - c1) if kind in ORDERS else (None, None))
        return framed(arranged(reader, kind, b1, b2))

    out = column(output(*x) for x in zip(frames, form.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True))
    return pa.StructArray.from_arrays([out, pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], ["output", "prefix_chars", "middle_chars"])


@F.arrow_udf(FRAMES)
def _restore(frames: pa.Array, form: pa.Array) -> pa.Array:
    return column(framed(rebuilt(Reader(row.as_py() or []), kind)) for row, kind in zip(frames, form.to_pylist(), strict=True))


@F.arrow_udf(StringType())
def _digest(frames: pa.Array) -> pa.Array:
    out = []
    for row in frames:
        reader, h = Reader(row.as_py() or []), hashlib.sha256()
        for part in reader.read(0, reader.size):
            h.update(part)
        out.append(h.hexdigest())
    return pa.array(out, pa.string())


@F.arrow_udf(StringType())
def _text(frames: pa.Array) -> pa.Array:
    return pa.array([b"".join((r := Reader(row.as_py() or [])).read(0, r.size)).decode() for row in frames], pa.string())


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `frames` in place of the text, `n` (its units) and `marked` (it holds one of the marks)."""
    docs = small_batches(docs)
    marked = F.coalesce(F.col(text).rlike("<[PSM]>"), F.lit(False))
    stored = docs.withColumns({"marked": marked, "frames": _store(text)}).drop(text)
    return stored.withColumn("n", F.when(F.size("frames") > 0, F.element_at("frames", -1)["units"]).otherwise(F.lit(0).cast("long")))


def choose(stored: DataFrame, key: str, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """stored with `form` and the units at which prefix and middle end, drawn from the key: `first`, `second`.

    rate: per cent of the texts that are transformed; spm: per cent of these with the suffix first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)

    def drawn(i: int) -> Column:
        return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")

    a, b = drawn(0) % (F.col("n") + 1), drawn(1) % (F.col("n") + 1)
    plain = (F.size("frames") == 0) | F.col("marked") | (drawn(2) % 100 >= rate)
    form = F.when(plain, "plain").when(drawn(3) % 100 < spm, "spm").otherwise("psm")
    return stored.withColumns({"form": form, "first": F.least(a, b), "second": F.greatest(a, b)})


def arrange(chosen: DataFrame) -> DataFrame:
    """chosen with the output as frames (`output`), and `prefix_chars`, `middle_chars` in code points (null if plain)."""
    done = chosen.withColumn("_arranged", _arrange("frames", "form", "first", "second"))
    return done.withColumns({c: F.col("_arranged")[c] for c in ("output", "prefix_chars", "middle_chars")}).drop("_arranged")


def restored(output: str = "output", form: str = "form") -> Column:
    """Frames of the exact text, from an output and its form."""
    return _restore(output, form)


def digest(frames: Column | str) -> Column:
    """SHA-256 of framed UTF-8, lowercase hex, streamed in the order of the frames."""
    return _digest(frames)


def text_of(frames: Column | str) -> Column:
    return _text(frames)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs without the text, with `n`, `form`, `prefix_chars`, `middle_chars` and `output` (frames)."""
    return arrange(choose(store(docs, text), key, seed, rate, spm)).drop("marked", "frames", "first", "second")

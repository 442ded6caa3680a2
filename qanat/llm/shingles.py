"""Word shingles of whole Arrow batches of texts as sorted 64-bit hashes, computed on byte arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from .common import release, slices

CHUNK = 1_000_000
PART_BYTES = 4_000_000  # longer texts can be read in parts of about so many bytes
BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        _TABLES[:] = [powers(BASE, max(n, CHUNK)), powers(pow(BASE, -1, 1 << 64), max(n, CHUNK))]
    return _TABLES[0], _TABLES[1]


def forget() -> None:
    """Give the tables back when a task ends: idle workers, of which an executor may have several, would keep them."""
    _TABLES.clear()
    release()


def words(column: pa.Array, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of the texts in order; A-Z lower-cased. breaks: the bytes that end a word, by default
    ASCII white space; asked after lower-casing."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else offsets
    rows, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    at = 0
    while at < len(raw):
        end = at + CHUNK
        if end < len(raw):  # cut at white space or between rows
            limit = int(np.searchsorted(offsets, end, side="right")) - 1
            spaces = np.flatnonzero(breaks[LOWER[raw[at:end]]])
            end = max(int(offsets[limit]), at + int(spaces[-1]) + 1 if len(spaces) else 0)
            if end <= at:
                later = np.flatnonzero(breaks[LOWER[raw[at:]]])
                following = int(offsets[np.searchsorted(offsets, at, side="right")])
                end = min(following, at + int(later[0]) + 1 if len(later) else len(raw))
        end = min(end, len(raw))
        b = LOWER[raw[at:end]]
        word = ~breaks[b]
        first = np.zeros(len(b) + 1, bool)
        inside = offsets[(offsets >= at) & (offsets <= end)] - at
        first[inside] = True
        start = np.flatnonzero(word & np.concatenate([[True], ~word[:-1] | first[1:-1]]))
        stop = np.flatnonzero(word & np.concatenate([~word[1:] | first[1:-1], [True]])) + 1
        power, inverse = _tables(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
        hashes.append(mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)))
        rows.append(np.searchsorted(offsets, start + at, side="right") - 1)
        at = end
    return np.concatenate(rows), np.concatenate(hashes)


def sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of n words of each text; a shorter text is one shingle, a text without words has none."""
    rows, hashes = words(column)
    counts = np.bincount(rows, minlength=len(column))
    heads = np.concatenate([[0], np.cumsum(counts)])
    if len(hashes) >= n:
        h = np.full(len(hashes) - n + 1, n, np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(BASE) + hashes[i : len(hashes) - n + 1 + i])
    else:
        h = np.empty(0, np.uint64)
    out = []
    for i, c in enumerate(counts.tolist()):
        a = heads[i]
        if c >= n:
            out.append(np.unique(h[a : a + c - n + 1]))
        elif c:
            one = np.array([c], np.uint64)
            for w in hashes[a : a + c]:
                one = mix(one * np.uint64(BASE) + w)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def texts_in_parts(batches: Iterable[pa.RecordBatch], column: str, breaks: np.ndarray = SPACE, most: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array, bool]]:
    """(rows, their texts or one part of the only row's text, whether it is the last part). Parts end where words do."""
    for batch in slices(batches, column, most):
        texts = batch.column(column).cast(pa.large_string())
        if batch.num_rows > 1 or not texts[0].is_valid or len(raw := texts[0].as_buffer()) <= most:
            yield batch, texts, True
            continue
        data, at = np.frombuffer(raw, np.uint8), 0
        while at < len(data):
            end = at + most
            while end < len(data):  # to the next byte that ends a word
                ahead = np.flatnonzero(breaks[LOWER[data[end : end + 4096]]])
                end += int(ahead[0]) + 1 if len(ahead) else 4096
                if len(ahead):
                    break
            end = min(end, len(data))
            yield batch, pa.array([data[at:end].tobytes().decode()], pa.large_string()), end == len(data)
            at = end

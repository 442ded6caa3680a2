"""Byte-level BPE encoding and decoding; long texts are encoded in pieces on many tasks and joined as a tree.

A place where white space follows something else always ends a pre-token, whatever stands around it, so both sides of
such a place encode on their own. At a join of two pieces the last tokens of the left and the first of the right are
encoded again as one window. If the window holds such a place on both sides, what lies between is replaced. If all of
it is one run of letters, digits, signs or spaces, it is inside one pre-token, and there a list of tokens is the
encoding exactly if each two neighbours are: the window counts once its first and last tokens are those of the sides.
Else the window grows, up to the whole.

Nulls count as the empty text, which has no tokens. Every row is kept, repeated rows too; other columns are untouched."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import slices, small_batches

LONG_CHARS = 32_768  # longer texts are cut; code points
PIECE_CHARS = 16_384
FIRST_WINDOW = 8  # tokens on each side of a join
AGREE = 4  # tokens that must be those of the side

# Fixed value: the pre-token pattern of this vocabulary, part of its format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUNS = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+")
CUT = regex.compile(r"(?<=\S)(?=\s)")


class Codec:
    """Encoder and decoder of one tokenizer file (JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_letters().items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        words = {w: i for w, i in spec["model"]["vocab"].items() if w not in added}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in words.items()}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = added
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.core.encode(text, allowed_special="all", disallowed_special=()), np.int32)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.core.decode_bytes(ids.tolist())

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids).decode("utf-8", errors="replace")

    def sections(self, text: str) -> list[tuple[str, bool]]:
        """The text between added tokens, and the added tokens (True)."""
        if not self.split:
            return [(text, False)]
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [s for s in [*out, (text[at:], False)] if s[0]]

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two texts, from the encodings of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        k = FIRST_WINDOW
        while True:
            i, j = max(0, len(left) - k), min(k, len(right))
            if (middle := self.window(left[i:], right[:j], i == 0, j == len(right))) is not None:
                a, ids, b = middle
                return np.concatenate([left[: i + a], ids, right[b:]])
            k *= 2

    def window(self, left: np.ndarray, right: np.ndarray, first: bool, last: bool) -> tuple[int, np.ndarray, int] | None:
        """What replaces left[a:] and right[:b]; None if a larger window is needed. first, last: it holds the whole side."""
        a = 0 if first else self.cut_of(left, True)
        b = len(right) if last else self.cut_of(right, False)
        if a is not None and b is not None:
            text = self.bytes_of(np.concatenate([left[a:], right[:b]])).decode("utf-8")
            return a, self.encode_ordinary(text), b
        raw = self.bytes_of(np.concatenate([left, right]))
        text = raw.decode("utf-8", errors="ignore")
        if min(len(left), len(right)) > AGREE and text and RUNS.fullmatch(text):
            ids = np.asarray(self.core._encode_single_piece(raw), np.int32)
            if np.array_equal(ids[:AGREE], left[:AGREE]) and np.array_equal(ids[-AGREE:], right[-AGREE:]):
                return 0, ids, len(right)
        return None

    def encode_ordinary(self, text: str) -> np.ndarray:
        return np.asarray(self.core.encode_ordinary(text), np.int32)

    def cut_of(self, ids: np.ndarray, is_left: bool) -> int | None:
        """The first (left side) or last (right side) token that starts a place where white space follows something else."""
        text = self.bytes_of(ids).decode("utf-8", errors="surrogateescape")
        starts = np.concatenate([[0], np.cumsum([len(self.core.decode_single_token_bytes(int(t))) for t in ids])])
        position = {int(s): n for n, s in enumerate(starts)}
        cuts = [len(text[: m.start()].encode("utf-8", errors="surrogateescape")) for m in CUT.finditer(text)]
        found = [position[c] for c in cuts if 0 < c < starts[-1] and c in position]
        return (found[0] if is_left else found[-1]) if found else None

    def tree(self, pieces: list[np.ndarray]) -> np.ndarray:
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else np.empty(0, np.int32)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others follow from U+0100 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", long_chars: int = LONG_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """df with an array column of token ids, as the file's own library gives them without adding special tokens.

    Texts of up to long_chars are encoded where they are. Longer ones become pieces that are dealt over the cluster,
    one for copies of the same text, encoded, gathered by text and joined as a tree; a group is one text."""
    fields = [f for f in df.schema.fields if f.name != ids]
    df = small_batches(df.select(*[f.name for f in fields]))
    out = StructType([*fields, StructField(ids, ArrayType(IntegerType()))])
    short = df.where(F.coalesce(F.length(text), F.lit(0)) <= long_chars)
    short = short.mapInArrow(lambda batches: _encoded(batches, path, text, ids), out)
    key, number = "__text_key", "__piece"
    long = df.where(F.length(text) > long_chars).withColumn(key, F.sha2(F.col(text).cast("binary"), 256))
    pieces = long.select(key, F.col(text).alias("text")).mapInPandas(lambda frames: _cut(frames, path, key, number, piece_chars), f"{key} string, {number} int, hard boolean, text string")
    encoded = pieces.groupBy(key, number).agg(F.first("text").alias("text"), F.first("hard").alias("hard"))
    encoded = encoded.mapInPandas(lambda frames: _pieces_encoded(frames, path, key, number), f"{key} string, {number} int, hard boolean, ids binary")
    whole = encoded.groupBy(key).applyInPandas(lambda g: _joined(g, path, key, number, ids), f"{key} string, {ids} array<int>")
    return short.unionByName(long.join(whole, key).select(*out.names))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of the token ids, special tokens included; null ids give the empty text."""

    @F.pandas_udf("string")
    def of(column: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([own.decode(np.asarray(x)) if x is not None else "" for x in column], dtype=object)

    return df.withColumn(text, of(ids))


def _encoded(batches, path, text, ids):
    own = codec(path)
    for batch in slices(batches, text):
        found = [own.encode(t) if t else np.empty(0, np.int32) for t in batch.column(text).to_pylist()]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        values = pa.array(np.concatenate(found) if found else np.empty(0, np.int32))
        column = pa.ListArray.from_arrays(pa.array(ends), values)
        yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])


def _cut(frames, path, key, number, piece_chars):
    own = codec(path)
    for frame in frames:
        for k, t in zip(frame[key], frame["text"], strict=True):
            parts = [(s[i : i + piece_chars], hard) for s, hard in own.sections(t) for i in range(0, len(s), piece_chars)]
            yield pd.DataFrame({key: k, number: range(len(parts)), "hard": [h for _, h in parts], "text": [p for p, _ in parts]})


def _pieces_encoded(frames, path, key, number):
    own = codec(path)
    for frame in frames:
        found = [own.added[t] if hard else own.encode_ordinary(t) for t, hard in zip(frame["text"], frame["hard"], strict=True)]
        yield frame[[key, number, "hard"]].assign(ids=[np.atleast_1d(np.asarray(x, np.int32)).tobytes() for x in found])


def _joined(group, path, key, number, ids):
    own, group = codec(path), group.sort_values(number)
    sections: list[list[np.ndarray]] = [[]]
    for raw, hard in zip(group["ids"], group["hard"], strict=True):
        sections += [[np.frombuffer(raw, np.int32)], []] if hard else []
        if not hard:
            sections[-1].append(np.frombuffer(raw, np.int32))
    whole = np.concatenate([own.tree(s) for s in sections])
    return pd.DataFrame({key: [group[key].iloc[0]], ids: [whole]})

"""Language ID with a linear-chain conditional random field over words.

A word is a run of letters, lower-cased, of at most 32 (longer runs count as several words). Its emission score sums
learned weights of hashed features (affixes of 1 to 3 letters, 2- and 3-grams with word ends) and of a lexicon (words
seen in training, as log-odds by language). Learned transitions link neighbours. Forward-backward gives every word of a
text its marginals, in sequences of at most SEQUENCE words; the text's language is the label with the largest mean
marginal, and that mean is the score.

Training takes a bounded sample: for each language about PER_LANGUAGE texts whose hash is smallest, of each one run of
SEGMENT words at a place drawn from its hash. Some are spliced with a run of another language, so that switches are
learned. Prediction reads whole texts and nothing else.

Null texts and texts without a letter get `und` and score 0. Ties go to the alphabetically first label. Without any
labelled text to learn from every text is `und`. Repeated rows get the same answer; empty tables give empty results."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import slices, small_batches

PER_LANGUAGE = 1_500
SEGMENT = 40
SEQUENCE = 256
STEP = 1_024  # sequences that numpy holds at once
BITS = 16
NONE = 1 << BITS
MAX_WORD = 32
CACHE_WORDS = 400_000
WORDS = re.compile(rf"[^\W\d_]{{1,{MAX_WORD}}}")
HASH = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def hashed_features(words: list[str]) -> np.ndarray:
    """[word, feature] buckets, NONE where a word is too short for the feature."""
    width = max(map(len, words)) + 2
    letters = np.zeros((len(words), width), np.uint64)
    sizes = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le", errors="surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(words)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    letters[row, np.arange(len(flat)) - first[row] + 1] = flat
    letters[:, 0] = 1
    letters[np.arange(len(words)), sizes + 1] = 2
    columns = []

    def bucket(kind: int, parts: list[np.ndarray], there: np.ndarray) -> None:
        h = np.full(parts[0].shape, kind + 1, np.uint64) * HASH[1]
        for p in parts:
            h = (h ^ p) * HASH[0]
            h ^= h >> np.uint64(29)
        columns.append(np.where(there, (h >> np.uint64(64 - BITS)).astype(np.int32), NONE))

    at = np.arange(len(words))
    for n in (1, 2, 3):
        there = sizes >= n
        bucket(n, [letters[:, min(1 + i, width - 1)] for i in range(n)], there)
        bucket(10 + n, [letters[at, np.maximum(sizes - n + 1 + i, 0)] for i in range(n)], there)
    for n in (2, 3):
        for i in range(width - n + 1):
            bucket(20 + n, [letters[:, i + j] for j in range(n)], sizes + 2 >= i + n)
    return np.stack(columns, 1)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # bucket, label; the last row is all zero
    lexicon: dict[str, int]
    odds: np.ndarray  # word, label
    lexicon_weight: float
    transition: np.ndarray  # from, to; log
    start: np.ndarray
    cache: dict = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # so that a few long words do not widen all
        for i in range(0, len(order), 4096):
            part = order[i : i + 4096]
            out[part] = self.weights[hashed_features([words[j] for j in part])].sum(1)
        known = np.array([self.lexicon.get(w, -1) for w in words])
        out[known >= 0] += self.lexicon_weight * self.odds[known[known >= 0]]
        return out

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Forward-backward over padded sequences: [n, t, label] factors (not logs), lengths descending. Marginals [n, t, label],
    and the normalised forward and backward messages."""
    n, t, k = emission.shape
    forward, backward = np.zeros((n, t, k)), np.ones((n, t, k))
    alive = [int(np.searchsorted(-lengths, -i, side="left")) for i in range(t)]  # sequences longer than i
    a = emission[:, 0] * start
    forward[:, 0] = a / a.sum(1, keepdims=True)
    for i in range(1, t):
        m = alive[i]
        a = forward[:m, i - 1] @ transition * emission[:m, i]
        forward[:m, i] = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        m = alive[i + 1]
        b = (backward[:m, i + 1] * emission[:m, i + 1]) @ transition.T
        backward[:m, i] = b / b.sum(1, keepdims=True)
    both = forward * backward
    return both / np.maximum(both.sum(2, keepdims=True), 1e-300), forward, backward


def train(samples: list[tuple[str, str]], epochs: int = 6, seed: int = 7) -> Model | None:
    """The field learned from (language, words joined by spaces); None without samples."""
    samples = sorted((lang, text.split(" ")) for lang, text in samples if text)
    labels = sorted({lang for lang, _ in samples})
    if not labels:
        return None
    k, rng = len(labels), np.random.default_rng(seed)
    of = {lang: i for i, lang in enumerate(labels)}
    counts: dict[str, np.ndarray] = {}
    for lang, words in samples:
        for w in words:
            counts.setdefault(w, np.zeros(k))[of[lang]] += 1
    lexicon = {w: i for i, w in enumerate(sorted(w for w, c in counts.items() if c.sum() >= 3))}
    totals = np.maximum(sum(counts.values()), 1)
    rates = np.array([(counts[w] + 0.5) / (totals + 0.5) for w in lexicon]).reshape(-1, k)
    odds = np.clip(np.log(rates) - np.log(rates).mean(1, keepdims=True), -3, 3)
    every = sorted(counts)
    index = {w: i for i, w in enumerate(every)}
    features = np.concatenate([_padded(hashed_features(every[i : i + 4096])) for i in range(0, len(every), 4096)])
    known = np.array([lexicon.get(w, -1) for w in every])
    in_lexicon = np.where((known >= 0)[:, None], odds[known] if len(odds) else 0, 0.0)
    weights, second = np.zeros(((1 << BITS) + 1, k)), np.full(((1 << BITS) + 1, k), 1e-2)
    transition, transition2 = 2 * np.eye(k), np.full((k, k), 1e-2)
    start, lexicon_weight, lexicon2 = np.zeros(k), 1.0, 1e-2
    sequences = []
    for i, (lang, words) in enumerate(samples):
        ids, gold = [index[w] for w in words], [of[lang]] * len(words)
        if rng.random() < 0.3:
            other, more = samples[rng.integers(len(samples))]
            at = rng.integers(1, len(ids) + 1)
            ids, gold = ids[:at] + [index[w] for w in more[: len(words)]], gold[:at] + [of[other]] * len(more[: len(words)])
        sequences.append((np.array(ids), np.array(gold)))
    rate = 0.1
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for i in range(0, len(order), 64):
            batch = sorted((sequences[j] for j in order[i : i + 64]), key=lambda s: -len(s[0]))
            lengths = np.array([len(s[0]) for s in batch])
            t = lengths.max()
            ids, gold = np.zeros((len(batch), t), np.int64), np.zeros((len(batch), t), np.int64)
            there = np.arange(t) < lengths[:, None]
            ids[there], gold[there] = np.concatenate([s[0] for s in batch]), np.concatenate([s[1] for s in batch])
            scores = weights[features[ids[there]]].sum(1) + lexicon_weight * in_lexicon[ids[there]]
            factor = np.ones((len(batch), t, k))
            factor[there] = np.exp(scores - scores.max(1, keepdims=True))
            flow = np.exp(transition - transition.max())
            p, forward, backward = marginals(factor, lengths, flow, np.exp(start - start.max()))
            delta = np.eye(k)[gold[there]] - p[there]
            pairs = there[:, 1:]
            joint = forward[:, :-1][pairs][:, :, None] * flow * (factor[:, 1:] * backward[:, 1:])[pairs][:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
            slope = (seen - joint.sum(0)) / len(batch)
            transition2 += slope**2
            transition += rate * slope / np.sqrt(transition2)
            start += 0.01 * (np.eye(k)[gold[:, 0]] - p[:, 0]).mean(0)
            slope1 = float((delta * in_lexicon[ids[there]]).sum()) / len(batch)
            lexicon2 += slope1**2
            lexicon_weight += rate * slope1 / np.sqrt(lexicon2)
            spots = features[ids[there]]
            flat, repeated = spots.ravel(), np.repeat(np.arange(len(spots)), spots.shape[1])
            slope2 = np.stack([np.bincount(flat, delta[repeated, j], len(weights)) for j in range(k)], 1) / len(batch)
            second += slope2**2
            weights += rate * slope2 / np.sqrt(second)
            weights[NONE] = 0
    return Model(labels, weights.astype(np.float32), lexicon, odds, lexicon_weight, np.exp(transition - transition.max()), np.exp(start - start.max()))


def _padded(features: np.ndarray) -> np.ndarray:
    out = np.full((len(features), 6 + 2 * (MAX_WORD + 2)), NONE, np.int32)
    out[:, : features.shape[1]] = features
    return out


class _Cache(dict):
    """Word -> row of the emission table; new words queue up until they are scored."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Label and score of each text."""
    k = len(model.labels)
    if not model.cache or len(model.cache["rows"]) > CACHE_WORDS:
        model.cache = {"rows": _Cache(), "table": np.empty((0, k), np.float32)}
    rows = model.cache["rows"]
    found, lengths = [], []
    for text in texts:
        words = words_of(text) if text else []
        if words and not (words[0].isalpha() or any(map(str.isalpha, text))):
            words = []
        found.append(np.fromiter(map(rows.__getitem__, words), np.int32, len(words)))
        lengths.append(len(words))
    if rows.new:
        scores = model.emissions(rows.new)
        factors = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32)
        model.cache["table"] = np.concatenate([model.cache["table"], np.maximum(factors, 1e-30)])
        rows.new = []
    ids, lengths = np.concatenate([*found, np.empty(0, np.int32)]), np.array(lengths, np.int64)
    total = np.zeros((len(texts), k))
    doc = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(ids)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(ids) else ids
    heads = np.flatnonzero(place % SEQUENCE == 0)
    sizes = np.diff(np.concatenate([heads, [len(ids)]]))
    order = np.argsort(-sizes, kind="stable")
    for i in range(0, len(order), STEP):
        part = order[i : i + STEP]
        size = sizes[part]
        there = np.arange(size[0]) < size[:, None]
        factor = np.ones((len(part), size[0], k), np.float32)
        spots = (heads[part][:, None] + np.arange(size[0]))[there]
        factor[there] = model.cache["table"][ids[spots]]
        p, _, _ = marginals(factor, size, model.transition, model.start)
        p *= there[:, :, None]
        np.add.at(total, doc[heads[part]], p.sum(1))
    mean = total / np.maximum(lengths, 1)[:, None]
    best = mean.argmax(1)
    some = lengths > 0
    return [model.labels[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, np.clip(mean.max(1), 0, 1), 0.0)


def held_out(key: str):
    """True for the fold that training never sees; keys without value count as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """The bounded training sample: (language, run of words) of about per_language texts for each language."""
    labelled = df.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang_, n in counts.items() for x in (lang_, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(place < share[F.col(lang)])

    def segments(frames):
        for frame in frames:
            out = []
            for number, lang_, text_ in zip(frame["place"], frame["lang"], frame["text"], strict=True):
                words = words_of(text_)
                at = int(number * 7919 * max(1, len(words) - SEGMENT)) % max(1, len(words) - SEGMENT)
                out.append((lang_, " ".join(words[at : at + SEGMENT])))
            yield pd.DataFrame(out, columns=["lang", "words"])

    rows = chosen.select(place.alias("place"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return [(r.lang, r.words) for r in rows.mapInPandas(segments, "lang string, words string").collect()]


def label(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    if model is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    fields = [f for f in df.schema.fields if f.name not in ("lang_pred", "score")]
    out = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, text, 2_000_000):
            names, scores = predict(model, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return small_batches(df.select(*[f.name for f in fields])).mapInArrow(run, out)

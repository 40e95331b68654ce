"""Quality classifier: averaged hashed subword embeddings and a softmax.

A document is the mean of the learned vectors of its features: each word, the character
n-grams of the word with its ends marked, and whether the word repeats the one before. Features
are hashed into a fixed number of buckets. Training is stochastic gradient descent in numpy on a bounded sample
of the labelled rows.

At scoring the softmax of a mean is linear in the features' own scores, so the model that tasks get is
one number per bucket, and a word's share (the sum over its features, and how many they are) is cached.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationgrid.llm.common import bounded_sample, map_batches, texts

SAMPLE_DOCS = 8000
BUCKETS = 1 << 17
CACHED_WORDS = 300_000
#: Texts whose new words are hashed in one go.
TEXTS_TOGETHER = 64
#: Bytes of words that are hashed in one go; a longer word is hashed in blocks of as many that overlap by an n-gram.
BLOCK_BYTES = 1 << 20
#: Longer words are not cached.
CACHED_BYTES = 200


class Settings(NamedTuple):
    buckets: int = BUCKETS
    dim: int = 16
    grams: tuple[int, int] = (3, 4)
    steps: int = 30_000
    rate: float = 0.2
    seed: int = 7


def blocks(words: list[bytes], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index of its word) of all features of ``words``, a bounded number of bytes at a time: each word and its character n-grams, ends marked."""
    own = np.fromiter((zlib.crc32(w) for w in words), dtype=np.uint32, count=len(words))
    yield (own % settings.buckets).astype(np.int64), np.arange(len(words))
    low, high = settings.grams
    held, owners, size = [], [], 0
    for i, w in enumerate(words):
        marked = b"<%b>" % w
        for s in range(0, max(len(marked) - high + 1, 1), BLOCK_BYTES):
            part = marked[s: s + BLOCK_BYTES + high - 1]
            # n-grams that start in the overlap belong to the next block
            held.append((part, BLOCK_BYTES if s + len(part) < len(marked) else len(part)))
            owners.append(i)
            size += len(part)
            if size >= BLOCK_BYTES:
                yield from _grams(held, owners, low, high, settings.buckets)
                held, owners, size = [], [], 0
    if held:
        yield from _grams(held, owners, low, high, settings.buckets)


def _grams(parts: list[tuple[bytes, int]], owners: list[int], low: int, high: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each part the n-grams that start in its first so many bytes."""
    letters = np.frombuffer(b"".join(p for p, _ in parts), dtype=np.uint8).astype(np.uint32)
    lengths = np.fromiter((len(p) for p, _ in parts), dtype=np.int64, count=len(parts))
    index = np.repeat(np.array(owners), lengths)
    left = np.repeat(lengths.cumsum(), lengths) - np.arange(len(letters))  # letters of the part from here on
    starts = left > np.repeat(lengths - np.fromiter((n for _, n in parts), dtype=np.int64, count=len(parts)), lengths)
    gram = np.zeros(len(letters), dtype=np.uint32)
    for n in range(1, high + 1):
        # the n letters from each place on, as a polynomial; 32-bit overflow is the modulus
        if n > len(letters):
            return
        gram[: len(letters) - n + 1] = gram[: len(letters) - n + 1] * np.uint32(0x01000193) + letters[n - 1:] + np.uint32(1)
        if n >= low:
            inside = (left >= n) & starts
            mixed = gram[inside] * np.uint32(0x9E3779B1)
            yield ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(buckets)).astype(np.int64), index[inside]


def repeat_bucket(settings: Settings, repeats: bool) -> int:
    return zlib.crc32(b"\x00same" if repeats else b"\x00other") % settings.buckets


def document_features(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and their shares of its features."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts = Counter(words)
    times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    shares = np.zeros(settings.buckets)
    for keys, owners in blocks(list(counts), settings):
        keys, where = np.unique(keys, return_inverse=True)
        shares[keys] += np.bincount(where, times[owners], len(keys))
    same = sum(map(operator.eq, words, words[1:]))
    # the pair features weigh as much as the n-grams of a word do together
    weight = shares.sum() / len(words)
    shares[repeat_bucket(settings, True)] += same * weight
    shares[repeat_bucket(settings, False)] += (len(words) - 1 - same) * weight
    keys = np.flatnonzero(shares)
    return keys.astype(np.int32), (shares[keys] / shares.sum()).astype(np.float32)


class Model(NamedTuple):
    """Score of each bucket (difference of the two softmax inputs) and the bias."""

    scores: np.ndarray
    bias: float
    settings: Settings


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings = Settings()) -> Model:
    """SGD with a falling rate over (buckets, shares, label); an empty sample scores everything 0.5."""
    rng = np.random.default_rng(settings.seed)
    table = (rng.random((settings.buckets, settings.dim), dtype=np.float32) - 0.5) / settings.dim
    out = np.zeros((2, settings.dim), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    epochs = -(-settings.steps // len(rows)) if rows else 0
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            keys, shares, label = rows[i]
            rate = settings.rate * (1 - done / (epochs * len(rows)))
            done += 1
            mean = shares @ table[keys] if len(keys) else np.zeros(settings.dim, dtype=np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            if len(keys):
                # each feature moves in proportion to its share; the mean as a whole moves by the rate, however many features share it
                table[keys] -= np.outer(shares * (rate / (shares @ shares)), back)
    return Model((table @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]), settings)


class WordScores(dict):
    """Sum of the scores of a word's features (real part) and their number (imaginary part), so that one pass adds up both."""

    def __init__(self, model: Model):
        self.model = model

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > CACHED_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        short = [w for w in new if len(w) <= CACHED_BYTES]
        for k in range(0, len(short), 50_000):
            part = short[k: k + 50_000]
            self.update(zip(part, self.sums(part)))
        for w in new:
            if len(w) > CACHED_BYTES:
                self[w] = self.sums([w])[0]

    def sums(self, words: list[bytes]) -> list[complex]:
        total = np.zeros(len(words), dtype=complex)
        for keys, owners in blocks(words, self.model.settings):
            total += np.bincount(owners, self.model.scores[keys], len(words)) + 1j * np.bincount(owners, minlength=len(words))
        return total.tolist()

    def forget_long(self, words: set[bytes]) -> None:
        for w in words:
            if len(w) > CACHED_BYTES:
                self.pop(w, None)


def probabilities(texts: list[str], cache: WordScores) -> list[float]:
    """Probability of label 1 of each text; an empty text has the bias alone."""
    model, out = cache.model, []
    pair = [float(model.scores[repeat_bucket(model.settings, r)]) for r in (False, True)]
    for k in range(0, len(texts), TEXTS_TOGETHER):
        split = [t.encode().split() for t in texts[k: k + TEXTS_TOGETHER]]
        distinct = set().union(*split)
        cache.learn(distinct)
        for words in split:
            z = model.bias
            if words:
                total = sum(map(cache.__getitem__, words), 0j)
                same = sum(map(operator.eq, words, words[1:]))
                weight = total.imag / len(words)
                pairs = same * pair[1] + (len(words) - 1 - same) * pair[0]
                z += (total.real + weight * pairs) / (total.imag + weight * (len(words) - 1))
            out.append(1 / (1 + math.exp(-min(max(z, -500.0), 500.0))))
        cache.forget_long(distinct)
    return out


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, settings: Settings = Settings()) -> Model:
    """Learns from at most ``sample_docs`` labelled documents outside the held-out fold.

    Rows without a label (null or neither 0 nor 1) teach nothing; of several labels for a document the smallest counts.
    """
    known = (
        labels.select("doc_id", F.col("quality").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("_label").cast("int").alias("_label"))
    )
    sample = bounded_sample(known, sample_docs)
    # at most ``sample_docs`` ids and labels
    rows = texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_label")

    def teach(batch):
        found = [document_features(t, settings) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id").cast("string"), "keys": [k.tobytes() for k, _ in found], "shares": [s.tobytes() for _, s in found], "label": batch.column("_label")}

    taught = map_batches(rows, teach, "doc_id string, keys binary, shares binary, label int")
    # repeated documents would make the sample unbounded: one row of each id
    one = taught.groupBy("doc_id").agg(F.min(F.struct("label", "keys", "shares")).alias("row")).select("doc_id", "row.*")

    def learn(batches):
        import pyarrow as pa

        parts = [
            (np.frombuffer(k, np.int32), np.frombuffer(s, np.float32), label)
            for b in batches for k, s, label in zip(b.column("keys").to_pylist(), b.column("shares").to_pylist(), b.column("label").to_pylist(), strict=True)
        ]
        model = fit(parts, settings)
        yield pa.RecordBatch.from_arrays([pa.array([model.scores.tobytes()], pa.binary()), pa.array([model.bias])], names=["scores", "bias"])

    # the bounded sample meets in one task, in order of ids; the driver gets one number per bucket
    found = one.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "scores binary, bias double").collect()
    if not found:
        return fit([], settings)
    return Model(np.frombuffer(found[0]["scores"], np.float64), found[0]["bias"], settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null texts count as empty, repeated rows each give a row."""
    docs = texts(docs)
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    def run(batch):
        p = probabilities(batch.column("text").to_pylist(), _cache(shared))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": p, "predicted": [int(x >= 0.5) for x in p]}

    return map_batches(docs.withColumn("held_out", held_out()), run, f"doc_id {key}, held_out boolean, score double, predicted int")


_CACHES: dict[int, WordScores] = {}


def _cache(shared) -> WordScores:
    """The word cache of this worker for one broadcast model."""
    if shared._jbroadcast is None and id(shared.value) not in _CACHES:  # in a worker
        _CACHES.clear()
        _CACHES[id(shared.value)] = WordScores(shared.value)
    return _CACHES.get(id(shared.value)) or WordScores(shared.value)


def classify(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, settings: Settings = Settings()) -> DataFrame:
    return score(docs, train(docs, labels, sample_docs, settings))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` with all their columns whose text scores ``threshold`` or more."""
    model = train(docs, labels, sample_docs)  # sees to small batches
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = probabilities([t or "" for t in batch.column(columns.index("text")).to_pylist()], _cache(shared))
            yield batch.filter(pa.array([x >= threshold for x in p], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Quality classifier (3): random-indexing word vectors, pooled per document, and a two-layer network.

Every white-space word is read as two words of two streams: its form (lower-cased
letters and digits) and its shape (runs of capitals, letters and digits as one
sign each, all else as it is). A word owns a sparse index vector (``SIGNS`` entries
of +1 or -1, drawn from its hash); a word's vector is the sum of the index vectors
of its neighbours within ``REACH`` words, over all documents. Words share
``BUCKETS`` rows by hash, so the table is of one size for any corpus: each task adds
up its own table and sends its rows once, summed per bucket in a shuffle.

A document is the mean of its words' vectors in each stream, rarer words weighing
more, and a few ratios of the same words. A network of one hidden layer (numpy,
on the driver, at most ``PER_CLASS`` labelled documents of each label: a bound of
the fit) is trained on these; its temperature is fitted on a part held back from
training, so that scores are probabilities.

Defined results: a null or empty text has the zero vector and is scored like any
other; a null id is scored and never learned from; repeated rows score alike; with
labels of one kind only, or none, every score is the smoothed share of label 1; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import cut_lineage, fair_batches, is_training, slim, table
from maskwright.llm.labelled import training_sample
from maskwright.llm.registry import query

PER_CLASS = 5000
BUCKETS, DIMENSIONS, SIGNS, REACH = 8192, 32, 2, 2
HIDDEN, EPOCHS, RATE, DECAY, HELD_BACK = 32, 60, 0.01, 1e-4, 0.2
THRESHOLD = 0.5
CHUNK_WORDS = 1 << 18
#: Rarer words weigh more: weight = SMOOTH / (SMOOTH + share of the word).
SMOOTH = 1e-3
_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
_FORM, _UPPER, _LOWER, _DIGIT = re.compile(r"[\W_]+"), re.compile(r"[A-Z]+"), re.compile(r"[^\W\dA-Z_]+"), re.compile(r"\d+")


class _Buckets(dict):
    """Word to the buckets of its form and its shape, each computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 19:
            self.clear()
        form = _FORM.sub("", word).lower()
        shape = _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word)))
        self[word] = both = (zlib.crc32(form.encode()) % BUCKETS) * BUCKETS + zlib.crc32(b"\0" + shape.encode()) % BUCKETS
        return both


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector; the same on every machine."""
    draw = np.random.default_rng(7)
    return draw.integers(0, DIMENSIONS, (2 * BUCKETS, SIGNS)), draw.choice([-1.0, 1.0], (2 * BUCKETS, SIGNS))


def _streams(texts: list[str | None], memo: _Buckets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of documents as (lengths, buckets of both streams: two rows); shapes use the second half of the table."""
    held, lengths, size = [], [], 0
    for i, text in enumerate(texts):
        words = _SPACE.findall(text) if text else []
        held.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
        lengths.append(len(words))
        size += len(words)
        if size >= CHUNK_WORDS or i == len(texts) - 1:
            both = np.concatenate(held)
            yield np.array(lengths), np.stack([both // BUCKETS, both % BUCKETS + BUCKETS])
            held, lengths, size = [], [], 0


def context_sums(docs: DataFrame) -> DataFrame:
    """(bucket, n, v0 ...): how often a bucket's words stand in all documents, and the sums of their neighbours' index vectors."""
    fair_batches(docs.sparkSession)
    columns = ["bucket", "n", *[f"v{i}" for i in range(DIMENSIONS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        memo, times = _Buckets(), np.zeros(2 * BUCKETS, np.int64)
        sums = np.zeros(2 * BUCKETS * DIMENSIONS)
        for batch in batches:
            for lengths, streams in _streams(batch.column("text").to_pylist(), memo):
                document = np.repeat(np.arange(len(lengths)), lengths)
                for words in streams:
                    times += np.bincount(words, minlength=2 * BUCKETS)
                    for reach in range(1, min(REACH, len(words) - 1) + 1):
                        near = document[reach:] == document[:-reach]
                        left, right = words[:-reach][near], words[reach:][near]
                        for word, other in ((left, right), (right, left)):
                            for sign in range(SIGNS):
                                sums += np.bincount(word * DIMENSIONS + places[other, sign], weights=signs[other, sign], minlength=len(sums))
        used = np.flatnonzero(times)
        rows = sums.reshape(-1, DIMENSIONS)[used].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(times[used]), *[pa.array(c) for c in rows.T]], columns)

    texts = slim(docs, text="text").mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))
    return texts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns[1:]])


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of unit length or zero, weights): one row for each bucket; 2 x BUCKETS rows whatever the corpus."""
    vectors, times = np.zeros((2 * BUCKETS, DIMENSIONS), np.float32), np.zeros(2 * BUCKETS)
    for row in context_sums(docs).collect():
        vectors[row[0]], times[row[0]] = row[2:], row[1]
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-12)
    share = times / max(times[:BUCKETS].sum(), 1.0)
    return vectors, SMOOTH / (SMOOTH + share)


def pooled(docs: DataFrame, vectors: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(doc_id, same, features) of every document, from its whole text. No shuffle."""
    fair_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, weights))
    rows = slim(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("same"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weights = sent.value
        weighed, memo = vectors * weights[:, None].astype(np.float32), _Buckets()
        for batch in batches:
            found = []
            for lengths, streams in _streams(batch.column("text").to_pylist(), memo):
                filled = lengths > 0
                starts = (np.cumsum(lengths) - lengths)[filled]
                parts = []
                for words in streams:
                    mean, rare = np.zeros((len(lengths), DIMENSIONS)), np.zeros(len(lengths))
                    if len(starts):
                        mean[filled] = np.add.reduceat(weighed[words], starts, axis=0)
                        rare[filled] = np.add.reduceat(weights[words], starts)
                    parts += [mean / np.maximum(rare, 1e-9)[:, None], (rare / np.maximum(lengths, 1))[:, None]]
                found.append(np.concatenate([*parts, np.log1p(lengths)[:, None]], axis=1))
            features = np.concatenate(found).astype(np.float32) if found else np.empty((0, 1), np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("same"), pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), features.shape[1]).cast(pa.list_(pa.float32()))],
                ["doc_id", "same", "features"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, same bigint, features array<float>")


class Network:
    """Standardised features, one hidden layer, a logit; then a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, stands: np.ndarray, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        order = draw.permutation(len(x))
        held, taught = order[: int(len(x) * HELD_BACK)], order[int(len(x) * HELD_BACK) :]
        z = self._standard(x)
        self.w1, self.b1 = draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0
        parameters = [self.w1, self.b1, self.w2, np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
        for _ in range(EPOCHS):
            for part in np.array_split(draw.permutation(taught), max(1, len(taught) // 64)):
                a = np.maximum(z[part] @ parameters[0] + parameters[1], 0)
                p = self._sigmoid(a @ parameters[2] + parameters[3])
                off = stands[part] * (p - y[part]) / stands[part].sum()
                back = np.outer(off, parameters[2]) * (a > 0)
                gradients = [z[part].T @ back + DECAY * parameters[0], back.sum(axis=0), a.T @ off + DECAY * parameters[2], np.array([off.sum()])]
                step += 1
                for i, g in enumerate(gradients):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    parameters[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = parameters[0], parameters[1], parameters[2], float(parameters[3][0])
        self.temperature = 1.0
        if len(held):
            logits = self.logits(x[held])
            losses = {t: float((stands[held] * np.logaddexp(0, np.where(y[held] == 1, -logits, logits) / t)).sum()) for t in np.geomspace(0.25, 16, 49)}
            self.temperature = min(losses, key=lambda t: (losses[t], t))

    @staticmethod
    def _sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self._standard(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self.logits(x) / self.temperature)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Per document: doc_id, same, score."""
    spark = docs.sparkSession
    sample = F.broadcast(cut_lineage(training_sample(labels, label, PER_CLASS)))  # at most 2 x PER_CLASS rows
    features = cut_lineage(pooled(docs, *word_vectors(docs)))
    taught = features.join(sample, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "features", "label", "weight").collect()
    taught.sort(key=lambda r: r.doc_id)
    y = np.array([r.label for r in taught], float)
    stands = np.array([r.weight for r in taught])
    if len(set(y)) < 2:
        return features.select("doc_id", "same", F.lit(float((y.sum() + 0.5) / (len(y) + 1))).alias("score"))
    sent = spark.sparkContext.broadcast(Network(np.array([r.features for r in taught]), y, stands / stands.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(sent.value.score(x))], ["doc_id", "same", "score"])

    return features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, same bigint, score double")


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

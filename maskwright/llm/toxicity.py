"""Toxicity (2): nearest labelled examples by exact TF-IDF cosine, found through a block-max inverted index.

Terms are words and beginnings (of the lengths ``STEMS``) of longer words. From the
labelled training documents (at most ``PER_CLASS`` of each label, a bound of the
fit) those terms are chosen that mark toxic ones: by the chi-square test, and
``LIFT`` times as common in toxic examples as in others. Document frequencies of
the chosen terms are counted over all documents.

Each document becomes a TF-IDF vector over these terms and one more that stands
for all its words (weighted by ``REST``): what part of a text is marked then
counts, not only by which terms. The examples' vectors are
sorted by their heaviest term, cut into blocks, and posted by term; each (term,
block) keeps its largest weight. A query bounds every block by these maxima,
opens blocks from the best bound down, and stops when the next bound is below
its k-th cosine, which makes the search exact. Votes of the k nearest, weighted
by closeness, give a raw share; a logistic curve fitted on the examples (each
judged by the others) turns it into a probability. The neighbours are kept as
evidence. A document without any chosen term has no neighbours: its score is the
share of toxic ones among examples like it.

Defined results: a null or empty text has no terms; a null id is scored and never
learned from; repeated rows score alike; without toxic training rows no term is
chosen and every score is the (smoothed) share of toxic labels; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import cut_lineage, fair_batches, is_training, slim, table
from maskwright.llm.labelled import training_sample
from maskwright.llm.registry import query

PER_CLASS, MOST_TERMS, STEMS = 4000, 4096, (4, 5, 6, 7)
#: A chosen term stands in so many toxic examples at least (and in that part of them), and passes the test at this value of chi-square.
LEAST_DOCS, LEAST_PART, CHI_SQUARE, LIFT = 3, 0.01, 24.0, 4.0
K, BLOCK, REST = 15, 32, 0.1
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


def terms_of(word: str) -> tuple[str, ...]:
    """The terms of one lower-cased word: itself, and its beginnings."""
    return (word, *[f"{word[:n]}-" for n in STEMS if len(word) > n])


class _Ids(dict):
    """Word to the numbers of its chosen terms."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 1 << 19:
            self.clear()
        self[word] = ids = tuple(self.numbers[t] for t in terms_of(word) if t in self.numbers)
        return ids


def _document_counts(examples: DataFrame) -> DataFrame:
    """(term, label, n): how many examples of a label hold a term. Counted in the tasks before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[label].update({t for w in set(_WORD.findall((text or "").lower())) for t in terms_of(w)})
            for label, held in enumerate(counts):
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([label] * len(held), pa.int32()), pa.array(list(held.values()), pa.int64())], ["term", "label", "n"])

    return examples.select("text", "label").mapInArrow(run, "term string, label int, n bigint").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")
    )


def chosen_terms(examples: DataFrame, most: int = MOST_TERMS) -> list[str]:
    """The terms that mark toxic examples, strongest first; at most ``most`` (the size of the model)."""
    examples = examples.dropDuplicates(["text", "label"])  # copies are one example here
    sizes = {r.label: r["count"] for r in examples.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return []
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d, n = n1 - a, n0 - b, float(n1 + n0)
    chi = n * (a * d - b * c) ** 2 / F.greatest((a + b) * (c + d) * n1 * max(n0, 1), F.lit(1e-9))
    counted = _document_counts(examples).where((a >= max(LEAST_DOCS, LEAST_PART * n1)) & (a * max(n0, 1) > b * n1 * LIFT)).withColumn("chi", chi)
    if n0:
        counted = counted.where(F.col("chi") >= CHI_SQUARE)
    return [r.term for r in counted.orderBy(F.desc("chi"), "term").limit(most).collect()]


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, same, n_words, terms, times) of every document: the chosen terms of its whole text. One pass, no shuffle."""
    fair_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    rows = slim(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("same"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(sent.value)
        for batch in batches:
            found, sizes = [], []
            for text in batch.column("text").to_pylist():
                words = _WORD.findall(text.lower()) if text else []
                found.append(dict(sorted(Counter([t for w in words for t in ids[w]]).items())))
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("same"), pa.array(sizes, pa.int64()), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))],
                ["doc_id", "same", "n_words", "terms", "times"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, same bigint, n_words bigint, terms array<int>, times array<int>")


class BlockMax:
    """A block-max inverted index over unit vectors, given as lists of (terms, weights)."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.block, self.n = block, len(vectors)
        heaviest = [(int(t[np.argmax(w[:-1])]), -float(w.max())) if len(t) > 1 else (int(t[0]), 0.0) for t, w in vectors]
        #: Place in the index to the example's number: alike examples share blocks, so their maxima say something.
        self.order = np.array(sorted(range(self.n), key=lambda i: (heaviest[i], i)), np.int64)
        self.blocks = -(-self.n // block)
        place = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in self.order])
        term = np.concatenate([vectors[i][0] for i in self.order]) if self.n else np.empty(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in self.order]) if self.n else np.empty(0)
        by = np.lexsort((place, term))
        self.place, self.weight = place[by], weight[by]
        key = term[by] * max(self.blocks, 1) + self.place // block
        #: Postings of a (term, block) are those from start to the next start.
        self.start = np.searchsorted(key, np.arange(n_terms * max(self.blocks, 1) + 1))
        self.largest = np.zeros((n_terms, max(self.blocks, 1)))
        np.maximum.at(self.largest, (term[by], self.place // block), self.weight)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine (fewer if fewer share a term), ties to smaller numbers. ``but`` is left out."""
        bounds = weights @ self.largest[terms]
        best, scores = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or (len(scores) >= k and bounds[b] < scores[-1] - 1e-12):
                break
            at = b * self.block
            dots = np.zeros(min(self.block, self.n - at))
            for t, w in zip(terms, weights, strict=True):
                s, e = self.start[t * self.blocks + b], self.start[t * self.blocks + b + 1]
                dots[self.place[s:e] - at] += w * self.weight[s:e]
            ids = self.order[at : at + len(dots)]
            stay = (dots > 0) & (ids != but)
            best, scores = np.r_[best, ids[stay]], np.round(np.r_[scores, dots[stay]], 12)
            first = np.lexsort((best, -scores))[:k]
            best, scores = best[first], scores[first]
        return best, scores


class Model:
    """Everything a task needs to score: bounded by ``PER_CLASS`` examples and ``MOST_TERMS`` terms."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[object, int, float, int, list[int], list[int]]], k: int = K):
        """``examples``: id, label, weight, words, chosen terms and their times."""
        self.idf, self.k = idf, k
        held = [(i, *e) for i, e in enumerate(examples) if e[4]]
        bare = [e for e in examples if not e[4]]
        self.ids = [h[1] for h in held]
        self.label = np.array([h[2] for h in held], float)
        self.stands = np.array([h[3] for h in held], float)
        vectors = [self.vector(*h[4:]) for h in held]
        self.index = BlockMax(vectors, len(idf) + 1)
        rest = sum(e[2] for e in bare) if bare else sum(e[2] for e in examples)
        self.bare = (sum(e[2] for e in (bare or examples) if e[1]) + 0.5) / (rest + 1)
        raw = np.array([self.share(*self.index.nearest(*v, k, but=i)) for i, v in enumerate(vectors)])
        self.slope, self.middle = self._calibrated(raw)

    def vector(self, n_words: int, terms: list[int], times: list[int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array([*terms, len(self.idf)], np.int64)
        w = np.array([*times, REST * n_words]) * np.r_[self.idf[t[:-1]], 1.0]
        return t, w / math.sqrt(float(w @ w))

    def share(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """The toxic part of the votes: each neighbour's is 1 / distance, with equal vectors at a small distance."""
        if not len(near):
            return self.bare
        votes = self.stands[near] / (1.05 - cosine)
        return float(votes @ self.label[near] / votes.sum())

    def _calibrated(self, raw: np.ndarray) -> tuple[float, float]:
        """Slope and offset of a logistic curve from shares to probabilities, lightly held back so that it stays finite."""
        slope, offset = 4.0, -2.0
        if not len(raw):
            return slope, offset
        x = np.stack([raw, np.ones(len(raw))], 1)
        beta, prior = np.array([slope, offset]), np.array([slope, offset])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            gradient = x.T @ (self.stands * (p - self.label)) + 0.01 * (beta - prior)
            step = np.linalg.solve((x * (self.stands * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), gradient)
            beta = beta - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        return float(max(beta[0], 0.0)), float(beta[1])

    def score(self, n_words: int, terms: list[int], times: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(terms):
            return self.bare, np.empty(0, np.int64), np.empty(0)
        near, cosine = self.index.nearest(*self.vector(n_words, terms, times), self.k)
        return 1 / (1 + math.exp(-(self.slope * self.share(near, cosine) + self.middle))), near, cosine


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Per document: doc_id, same, score, and evidence (the nearest examples: doc_id, label, cosine)."""
    spark = docs.sparkSession
    sample = cut_lineage(training_sample(labels, label, PER_CLASS))
    known = F.broadcast(sample)  # at most 2 x PER_CLASS rows
    rows = slim(docs, doc_id="doc_id", text="text")
    examples = cut_lineage(rows.join(known, "doc_id"))
    terms = chosen_terms(examples)
    counts = cut_lineage(term_counts(docs, terms))
    n = counts.count()
    frequency = {r.term: r.n for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_TERMS
    idf = np.array([math.log((n + 1) / (frequency.get(i, 0) + 1)) + 1 for i in range(len(terms))])
    taught = counts.join(known, "doc_id").select("doc_id", "label", "weight", "n_words", "terms", "times").dropDuplicates(["doc_id"]).collect()
    model = Model(idf, sorted(((r.doc_id, r.label, r.weight, r.n_words, r.terms, r.times) for r in taught), key=lambda e: e[0]))
    sent = spark.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        evidence_type = None
        for batch in batches:
            evidence_type = evidence_type or pa.list_(pa.struct([("doc_id", batch.schema.field("doc_id").type), ("label", pa.int32()), ("cosine", pa.float64())]))
            found = [model.score(n, t, m) for n, t, m in zip(batch.column("n_words").to_pylist(), batch.column("terms").to_pylist(), batch.column("times").to_pylist(), strict=True)]
            evidence = [[{"doc_id": model.ids[i], "label": int(model.label[i]), "cosine": float(c)} for i, c in zip(near, cosine, strict=True)] for _, near, cosine in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("same"), pa.array([f[0] for f in found], pa.float64()), pa.array(evidence, evidence_type)], ["doc_id", "same", "score", "evidence"]
            )

    # Rows are a few bytes now, so a file of them would be very many for one task to score: dealt out anew.
    dealt = counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "same")
    return dealt.mapInArrow(run, f"doc_id {kind}, same bigint, score double, evidence array<struct<doc_id: {kind}, label: int, cosine: double>>")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not scored as toxic."""
    bad = scored(docs, table(spark, sf_dir, "labels")).where(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias("_doc"), F.col("same").alias("_same"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & (F.xxhash64(docs["text"]) == bad["_same"]), "left_anti")

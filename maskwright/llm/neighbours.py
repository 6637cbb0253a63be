"""Approximate nearest neighbours (10): a permutation index.

``PIVOTS`` vectors of the table are pivots. A vector is represented by its
``PREFIX`` nearest pivots in order, and posted under each of them with its place.
Two such prefixes are compared by Spearman's footrule, a pivot missing from one
counting as one place beyond its end; the postings of a query's own pivots give
that distance for every vector that shares any. Those within a radius are
reranked by exact cosine on the original vectors, in double precision.

Pivots and radius are fitted on a sample (``SAMPLE`` rows whose ids hash lowest;
the bound of the fit): the radius is the footrule distance within which
``FITTED_RECALL`` of the sample's true nearest neighbours lie. It is a radius, not
a number of candidates, so it does not bind harder as tables grow. Every row is
indexed. The index is a row per segment of at most ``SEGMENT`` vectors, made and
searched without a shuffle; queries come in blocks of at most ``BLOCK``, one
pass over the index each. A query that finds fewer than k within the radius is
asked again without one, which is exact.

Defined results: vectors that are null, zero, hold null or non-finite parts, or
are not of the table's usual length (the commonest; of equals the longest) take
no part, nor do rows without an id; rows with a query's id are its own and not
its neighbours; equal vectors tie and come by id; an id that stands in several
rows takes one rank, with its nearest vector; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright.llm.common import cut_lineage, fair_batches, slim, table
from maskwright.llm.registry import query

PIVOTS, PREFIX, SAMPLE, FITTED_RECALL = 128, 32, 2000, 0.97
SEGMENT, BLOCK = 4096, 2048
K = 5


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vector as doubles) of the rows that take part."""
    rows = slim(vectors, id=vec_id, vector=embedding).select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(vector, x -> x <> 0)")
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == (usual.d if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow, no underflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Index:
    """Pivots, prefix length and radius: what is fitted, and sent to every task."""

    def __init__(self, sample: np.ndarray, pivots: int = PIVOTS, prefix: int = PREFIX, recall: float = FITTED_RECALL):
        unit = _unit(sample) if len(sample) else sample
        self.pivots = np.unique(unit, axis=0)
        order = np.random.default_rng(0).permutation(len(self.pivots))[:pivots]
        self.pivots = self.pivots[order]
        self.prefix = max(1, min(prefix, len(self.pivots) // 2))
        asked = unit[: max(1, len(unit) // 5)]
        shared, likeness = self._compared(asked, unit)
        near = np.argsort(-likeness, axis=1, kind="stable")[:, :K] if len(unit) > K else np.empty((0, 0), np.int64)
        #: The least overlap that a candidate must have: footrule = prefix * (prefix + 1) - 2 * overlap.
        self.least = float(np.quantile(np.take_along_axis(shared, near, 1), 1 - recall)) if near.size else 0.0

    def prefixes(self, unit: np.ndarray) -> np.ndarray:
        return np.argsort(-(unit @ self.pivots.T), axis=1, kind="stable")[:, : self.prefix]

    def _compared(self, asked: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(unit):
            return np.empty((0, 0)), np.empty((0, 0))
        members, places, ends = self.posted(self.prefixes(unit))
        likeness = asked @ unit.T
        np.fill_diagonal(likeness, -2)
        return np.stack([self.overlap(p, members, places, ends, len(unit)) for p in self.prefixes(asked)]), likeness

    def posted(self, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The inverted files: members and their places, pivot after pivot, and where each pivot ends."""
        order = np.argsort(prefixes, axis=None, kind="stable")
        ends = np.cumsum(np.bincount(prefixes.ravel(), minlength=len(self.pivots)))
        return (order // self.prefix).astype(np.int32), (order % self.prefix).astype(np.int32), ends

    def overlap(self, prefix: np.ndarray, members: np.ndarray, places: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """For each of n vectors the sum over shared pivots of (prefix length - the later place)."""
        starts = np.r_[0, ends[:-1]]
        took = np.concatenate([np.arange(starts[p], ends[p]) for p in prefix])
        own = np.repeat(np.arange(len(prefix)), ends[prefix] - starts[prefix])
        return np.bincount(members[took], weights=self.prefix - np.maximum(places[took], own), minlength=n)


def fit(rows: DataFrame, sample: int = SAMPLE) -> Index:
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    return Index(np.array([r.vector for r in picked], float) if picked else np.empty((0, 1)))


def build(rows: DataFrame, index: Index, segment: int = SEGMENT) -> DataFrame:
    """The index, written to the shared folder: ids, vectors and inverted files of each segment."""
    fair_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, segment):
                part = batch.slice(at, segment)
                vectors = _matrix(part.column("vector"))
                members, places, ends = sent.value.posted(sent.value.prefixes(_unit(vectors)))
                yield pa.RecordBatch.from_pylist([{
                    "ids": part.column("id").to_pylist(), "vectors": np.ascontiguousarray(vectors).tobytes(), "members": members.tobytes(),
                    "places": places.tobytes(), "ends": ends.astype(np.int64).tobytes(),
                }])

    return cut_lineage(rows.mapInArrow(run, "ids array<bigint>, vectors binary, members binary, places binary, ends binary"))


def cosines(vectors: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Exact cosines of rows to one vector; a row's value does not depend on its neighbours in memory."""
    scale, own = np.abs(vectors).max(axis=1), np.abs(asked).max()
    a, b = vectors / scale[:, None], asked / own
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids, each once with its best score: repeated rows take one place."""

    def first(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))
        once = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]
        return ids[once], scores[once]

    if len(ids) > k:
        stay = scores >= np.partition(scores, -k)[-k]
        if len((found := first(ids[stay], scores[stay]))[0]) == k:
            return found
    return first(ids, scores)


def _pass(segments: DataFrame, index: Index, asked: list, k: int, exact: bool) -> DataFrame:
    """The k best of each task's segments for every query of one block."""
    sent = segments.sparkSession.sparkContext.broadcast((index, np.array([r.id for r in asked], np.int64), np.array([r.vector for r in asked], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, query_ids, queries = sent.value
        prefixes = index.prefixes(_unit(queries))
        best = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        for batch in batches:
            for at in range(batch.num_rows):
                row = [c[at] for c in batch.columns]
                ids = row[0].values.to_numpy()
                vectors = np.frombuffer(row[1].as_py()).reshape(len(ids), -1)
                members, places, ends = (np.frombuffer(x.as_py(), t) for x, t in zip(row[2:], (np.int32, np.int32, np.int64), strict=True))
                for q, (own, prefix) in enumerate(zip(query_ids, prefixes, strict=True)):
                    close = ids != own
                    if not exact:
                        close &= index.overlap(prefix, members, places, ends, len(ids)) >= index.least
                    near = np.flatnonzero(close)
                    if len(near):
                        score = cosines(vectors[near], queries[q])
                        best[q] = _best(np.r_[best[q][0], ids[near]], np.r_[best[q][1], score], k)
        found = [len(i) for i, _ in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(query_ids, found)), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["query_id", "vec_id", "score"]
        )

    return segments.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def search(segments: DataFrame, index: Index, queries: DataFrame, k: int = K, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (id, vector)."""
    queries = cut_lineage(queries.dropDuplicates(["id"]))
    blocks = max(1, -(-queries.count() * 5 // 4 // BLOCK))  # hashed: some are larger than the mean
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    passes = []
    for number in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).collect()
        if asked:
            found = cut_lineage(_pass(segments, index, asked, k, exact).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k))
            passes.append(found)
            if not exact:
                full = {r.query_id for r in found.groupBy("query_id").count().where(F.col("count") >= k).collect()}
                if short := [r for r in asked if r.id not in full]:
                    passes[-1] = found.join(F.broadcast(segments.sparkSession.createDataFrame([(r.id,) for r in short], "query_id bigint")), "query_id", "left_anti")
                    passes.append(_pass(segments, index, short, k, True).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k))
    if not passes:
        return segments.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "rank", "vec_id", "score")


@query("op10_neighbours")
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(usable(table(spark, sf_dir, "embeddings")))
    index = fit(rows)
    return search(build(rows, index), index, rows.where("id % 50 = 0"))

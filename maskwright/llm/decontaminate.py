"""Benchmark decontamination (1): a distributed positional inverted index.

:func:`build_index` tokenises the documents where they lie and writes one row
per segment (about ``SEGMENT_WORDS`` words of whole documents): its documents,
its terms in order, and for each term the sorted word positions at which it
stands. Positions run through the segment with a gap between documents, so one
sorted array holds document and offset. Nothing is shuffled. With ``terms`` (the
words of the tests in mind) only their postings are stored, which answers those
tests alike at a fraction of the size; without, every word's.

:func:`search` cuts the tests into phrases and lets every segment find them:
for each phrase the rarest of its terms in the segment gives the possible
starts, and the offset-adjusted lists of the others, rarest first, are
intersected with these. ``exact`` finds the words in order, ``near`` all words
of the phrase in any order within ``within`` words. Tests travel in blocks of at
most ``BLOCK_PHRASES`` phrases, one pass over the index for each block, so a
test set of any size fits.

Defined results: a null or wordless document has 0 words and is clean; a null
or wordless test matches nothing; a null item id is listed as an empty string;
an item id that stands in several rows is one item; rows with the same doc_id
are judged each for itself; empty tables give no matches (or no rows); other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import LOWER, UPPER, cut_lineage, fair_batches, slim, table
from maskwright.llm.registry import query

#: A word is a run of these bytes after A-Z are lowered: digits, a-z, and all of any character beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SEGMENT_WORDS = 1 << 20
BLOCK_PHRASES = 50_000
#: Positions left free between two documents of a segment: no phrase or nearness reaches across.
GAP = 1 << 10


class _Numbers(dict):
    """Each new word gets the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _segment(number: int, docs: list[dict], ids: list[np.ndarray], words: list[bytes]) -> dict:
    """One row of the index from the word numbers of its documents (-1: not stored)."""
    starts = np.cumsum([0, *[len(x) + GAP for x in ids]])[:-1]
    every = np.concatenate([x for x in ids]) if ids else np.empty(0, np.int64)
    at = np.concatenate([np.arange(len(x), dtype=np.int64) + s for x, s in zip(ids, starts, strict=True)]) if ids else every
    at, every = at[every >= 0], every[every >= 0]
    order = np.argsort(every, kind="stable")
    terms, counts = np.unique(every, return_counts=True)
    return {
        "segment": number, "docs": [d | {"start": int(s)} for d, s in zip(docs, starts, strict=True)],
        "terms": [words[t] for t in terms], "counts": counts.tolist(), "positions": at[order].tobytes(),
    }


def build_index(docs: DataFrame, terms: list[bytes] | None = None, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of (doc_id, text), written to the shared folder. ``terms``: lower-cased words to keep, all if None."""
    fair_batches(docs.sparkSession)
    rows = slim(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("same"), F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"segment bigint, docs array<struct<doc_id: {kind}, same: bigint, n_words: bigint, start: bigint>>, terms array<binary>, counts array<bigint>, positions binary"
    wanted = None if terms is None else docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(sorted(terms))})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        own = _Numbers() if wanted is None else None
        lookup = own.__getitem__ if wanted is None else lambda w, get=wanted.value.get: get(w, -1)
        into: pa.Schema | None = None
        held, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            row = _segment(part + made, held, ids, list(own) if own is not None else sorted_terms)
            made, size = made + 1, 0
            held.clear(), ids.clear()
            if own is not None:
                own.clear()
            return pa.RecordBatch.from_pylist([row], schema=into)

        sorted_terms = None if wanted is None else list(wanted.value)
        for batch in batches:
            if into is None:
                doc = pa.struct([("doc_id", batch.schema.field("doc_id").type), ("same", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64())])
                into = pa.schema([("segment", pa.int64()), ("docs", pa.list_(doc)), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("positions", pa.binary())])
            for doc_id, same, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = (text or b"").translate(_FOLD).split()
                ids.append(np.fromiter(map(lookup, words), np.int64, len(words)))
                held.append({"doc_id": doc_id, "same": same, "n_words": len(words)})
                size += len(words) + 1
                if size >= segment_words:
                    yield flush()
        if held:
            yield flush()

    return cut_lineage(rows.mapInArrow(index, schema))


def phrases_of(tests: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(phrase_id, words) of the different phrases, and (phrase_id, item_id): which items have them."""
    rows = slim(tests, item_id="item_id", text="text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.expr(f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), r'{_WORD}', 0)").alias("w"),
    ).where("size(w) > 0")
    cut = rows.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {window - 1}, 1)), i -> slice(w, i, {window}))")).alias("words")).distinct()
    cut = cut_lineage(cut)
    phrases = cut_lineage(cut.select("words").distinct().withColumn("phrase_id", F.monotonically_increasing_id()))
    return phrases, cut.join(phrases, "words").select("phrase_id", "item_id")


class _Phrases:
    """A block of phrases as numbers, ready to be looked up in segments."""

    def __init__(self, rows: list[tuple[int, list[bytes]]]):
        numbers = _Numbers()
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.lengths = np.array([len(w) for _, w in rows])
        self.words = np.full((len(rows), max(map(len, (w for _, w in rows)), default=1)), -1)
        for k, (_, words) in enumerate(rows):
            self.words[k, : len(words)] = [numbers[w] for w in words]
        self.vocabulary = list(numbers)

    def matches(self, terms: list[bytes], counts: list[int], positions: np.ndarray, within: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first position, position after) of every match in one segment."""
        ends = np.cumsum(counts)
        where = {t: i for i, t in enumerate(terms)}
        at = np.array([where.get(w, -1) for w in self.vocabulary], np.int64)
        lists: list[np.ndarray | None] = [None if i < 0 else positions[ends[i] - counts[i] : ends[i]] for i in at]
        size = np.array([0 if x is None else len(x) for x in lists] + [1 << 60])  # the last is for the places beyond a phrase's end
        sizes = size[self.words]
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(sizes.min(axis=1) > 0):
            n = self.lengths[k]
            words, order = self.words[k, :n], np.argsort(sizes[k, :n], kind="stable")
            starts, stops = _in_order([lists[words[i]] for i in order], order, n) if within is None else _near([lists[w] for w in dict.fromkeys(words[order])], within)
            if len(starts):
                found.append((k, starts, stops))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return np.repeat(self.ids[[k for k, _, _ in found]], [len(s) for _, s, _ in found]), np.concatenate([s for _, s, _ in found]), np.concatenate([e for _, _, e in found])


def _in_order(lists: list[np.ndarray], offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts at which every list has its offset; the lists come rarest first."""
    starts = lists[0] - offsets[0]
    for held, offset in zip(lists[1:], offsets[1:], strict=True):
        want = starts + offset
        place = np.searchsorted(held, want)
        place[place == len(held)] = 0
        starts = starts[held[place] == want]
        if not len(starts):
            break
    return starts, starts + n


def _near(lists: list[np.ndarray], within: int) -> tuple[np.ndarray, np.ndarray]:
    """Shortest spans from some list's position that hold a position of every list, at most ``within`` long."""
    starts, stops = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for held in lists:
        near = np.searchsorted(lists[0], held - within)  # the rarest term must stand close by
        begin = held[(near < len(lists[0])) & (lists[0][np.minimum(near, len(lists[0]) - 1)] < held + within)]
        last = begin
        for other in lists:
            place = np.searchsorted(other, begin)
            last = np.maximum(last, np.where(place < len(other), other[np.minimum(place, len(other) - 1)], begin + within))
        fits = last - begin < within
        starts.append(begin[fits]), stops.append(last[fits] + 1)
    return np.concatenate(starts), np.concatenate(stops)


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as spans that neither touch nor overlap."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.r_[True, starts[1:] > reach[:-1]]
    return starts[fresh], reach[np.r_[fresh[1:], True]]


def search(index: DataFrame, phrases: DataFrame, within: int | None = None, block: int = BLOCK_PHRASES) -> DataFrame:
    """Per indexed document: doc_id, same, n_words, n_hit, spans (start, stop; in words) and the phrases found."""
    spark = index.sparkSession
    fair_batches(spark)
    if within is not None and within > GAP:
        raise ValueError(f"within is at most {GAP} words")
    kind = index.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    schema = f"segment bigint, ordinal bigint, doc_id {kind}, same bigint, n_words bigint, spans array<struct<start: bigint, stop: bigint>>, phrases array<bigint>"
    blocks = max(1, -(-phrases.count() // block))
    cut = phrases.withColumn("block", F.pmod(F.xxhash64("phrase_id"), F.lit(blocks))).select("block", "phrase_id", F.transform("words", lambda w: w.cast("binary")).alias("words"))

    def passed(number: int) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r.phrase_id, [bytes(w) for w in r.words]) for r in cut.where(F.col("block") == number).collect()])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = _Phrases(sent.value)
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    segment, docs, terms, counts, positions = (c[0] for c in row.columns)
                    docs = docs.values if hasattr(docs, "values") else docs
                    starts_of = docs.field("start").to_numpy()
                    phrase, start, stop = asked.matches(terms.as_py(), counts.as_py(), np.frombuffer(positions.as_py(), np.int64), within)
                    doc = np.searchsorted(starts_of, start, side="right") - 1
                    inside = stop <= starts_of[doc] + docs.field("n_words").to_numpy()[doc]
                    phrase, start, stop, doc = phrase[inside], start[inside], stop[inside], doc[inside]
                    spans, held = [[] for _ in range(len(docs))], [[] for _ in range(len(docs))]
                    if len(doc):
                        order = np.argsort(doc, kind="stable")
                        for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                            d = doc[own[0]]
                            a, b = _merged(start[own] - starts_of[d], stop[own] - starts_of[d])
                            spans[d] = [{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)]
                            held[d] = np.unique(phrase[own]).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([segment.as_py()] * len(docs), pa.int64()), pa.array(range(len(docs)), pa.int64()), docs.field("doc_id"), docs.field("same"), docs.field("n_words"),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(held, pa.list_(pa.int64()))],
                        ["segment", "ordinal", "doc_id", "same", "n_words", "spans", "phrases"],
                    )

        return index.select("segment", "docs", "terms", "counts", "positions").mapInArrow(find, schema)

    if blocks == 1:
        return passed(0).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)"))
    every = passed(0)
    for number in range(1, blocks):
        every = every.unionAll(passed(number))
    by = ["segment", "ordinal", "doc_id", "same", "n_words"]
    return every.groupBy(*by).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("phrases")).alias("phrases")).withColumn(
        "n_hit", F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.stop - 1)))))").cast("long")
    )


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, within: int | None = None) -> DataFrame:
    """Per document: doc_id, same, n_words, n_hit, spans, items (ids of the tests found, sorted), contaminated."""
    phrases, items = phrases_of(tests, window)
    words = phrases.select(F.explode("words").alias("word")).distinct()
    few = words.limit(BLOCK_PHRASES * window + 1).collect()  # the terms of one block at most; beyond that, all words are indexed
    terms = [r.word.encode() for r in few] if len(few) <= BLOCK_PHRASES * window else None
    found = cut_lineage(search(build_index(docs, terms), phrases, within))
    by = ["segment", "ordinal"]
    listed = (
        found.where("size(phrases) > 0").select(*by, F.explode("phrases").alias("phrase_id")).join(items, "phrase_id")
        .select(*by, "item_id").distinct().groupBy(*by).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    )
    return found.join(listed, by, "left").select(
        "doc_id", "same", "n_words", "n_hit", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_WORD}'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
), h AS (
  SELECT s.doc_id, s.n, s.i, p.item FROM s JOIN p ON s.phrase = p.phrase AND s.n = p.n
), c AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


@query("op1_decontamination", ORACLE)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no benchmark passage contaminates."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = found.select(F.col("doc_id").alias("_doc"), F.col("same").alias("_same"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & (F.xxhash64(docs["text"]) == bad["_same"]), "left_anti")

"""Entities from a name finder: words, chunks, scores to spans, and what counts as a name or an address."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.detectors import rlike
from maskwright.functions.spans import FOUND_TYPE, NO_SPANS, SPAN_TYPE, find, span
from maskwright.functions.sql import fresh, let, lit, lits, lookup

ENTITY_TYPE = "array<struct<start:int,end:int,label:string,score:double,text:string>>"
# Names come after every pattern when they cover exactly the same span.
NAME_PRIORITY = 100
# Words that leave a Python worker together (a chunk more at most).
WORDS_AT_A_TIME = 1 << 16

Finder = Callable[[Sequence[str], Sequence[str], float], Sequence[Sequence[tuple[int, int, str, float]]]]


def ner_entities(
    texts: DataFrame, load: Callable[[], Finder], labels: Sequence[str] = P.NAME_LABELS, threshold: float = P.NAME_THRESHOLD
) -> DataFrame:
    """Entities of each distinct text by a finder of the user's own.

    ``load`` builds the finder once per Python worker task. It gets a list of
    texts, labels and a cutoff, and returns (start, end, label, score) per
    text; its answer for a text must not depend on the others. Texts are
    passed one at a time, whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = load()
        for batch in batches:
            rows = [
                (text, label, start, end, float(score), text[start:end])
                for text in batch["source_text"]
                for start, end, label, score in finder([text], labels, threshold)[0]
            ]
            yield pd.DataFrame(rows, columns=["source_text", "label", "start", "end", "score", "text"])

    distinct = texts.where("text <> ''").selectExpr("text AS source_text").distinct()
    return distinct.mapInPandas(run, "source_text string, label string, start int, end int, score double, text string")


def split_words(text: str) -> str:
    """Words with offsets: letter and digit runs joined by - or _, or single other visible characters."""
    return find(text, lit(P.java(P.WORD)))


def chunk_words(texts: DataFrame, size: int = P.MAX_WORDS, id_column: str = "text_id") -> DataFrame:
    """One row per piece of at most ``size`` words; offsets stay those of the whole text.

    Every word of every text becomes an element of its own, which interpreted folds do some ten times slower than
    one pass of a pattern over Arrow batches, written out a bounded number of words at a time.
    """
    kind = texts.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(P.PYTHON_WORD)
        for batch in batches:
            rows, chunks, ends, starts, stops, words = [], [], [0], [], [], []

            def out() -> pa.RecordBatch:
                parts = [pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(words, pa.string()), pa.nulls(len(words), pa.string())]
                elements = pa.StructArray.from_arrays(parts, ["start", "end", "text", "label"])
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(chunks, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), elements)],
                    [id_column, "chunk", "words"],
                )

            for row, text in enumerate(batch.column(1).to_pylist()):
                for number, match in enumerate(word.finditer(text or "")):
                    if number % size == 0:
                        if number:
                            ends.append(len(words))
                        if len(words) >= WORDS_AT_A_TIME:
                            yield out()
                            rows, chunks, ends, starts, stops, words = [], [], [0], [], [], []
                        rows.append(row)
                        chunks.append(number // size)
                    starts.append(match.start())
                    stops.append(match.end())
                    words.append(match.group())
                if len(words) > ends[-1]:
                    ends.append(len(words))
            yield out()

    return texts.select(id_column, "text").mapInArrow(run, f"{id_column} {kind}, chunk int, words {FOUND_TYPE}")


def decode_word_scores(
    scores: DataFrame, threshold: float, keys: list[str], labels: Sequence[str] = P.NAME_LABELS
) -> DataFrame:
    """Word scores to spans: a start and an end above the cutoff with every word between at or above it.

    ``scores``: keys (text and chunk), word_no, label, and the logits s_start,
    s_end, s_inside. A chunk holds at most 256 words, so its arrays are
    bounded. A span's score is the lowest it rests on; overlaps go to the best,
    equal scores to the label asked for first.
    """
    sig = {k: f"1 / (1 + exp(-s_{k}))" for k in ("start", "end", "inside")}
    per_label = scores.groupBy(*keys, "label").agg(
        F.expr(
            "array_sort(collect_list(struct(word_no AS word_no, "
            f"{sig['start']} AS a, {sig['end']} AS z, {sig['inside']} AS i)))"
        ).alias("w")
    )
    s, e, acc, x = fresh("s"), fresh("e"), fresh("acc"), fresh("x")
    # From each start, walk right while the inside holds; every good end on the way closes a span.
    walk = (
        f"aggregate(slice(w, {s} + 1, size(w)), named_struct('low', cast(1 AS double), 'go', true, 'out', "
        "cast(array() AS array<struct<start_word:int,end_word:int,score:double>>)), "
        f"({acc}, {x}) -> if(NOT {acc}.go OR {x}.i < {threshold}, "
        f"named_struct('low', {acc}.low, 'go', false, 'out', {acc}.out), "
        f"named_struct('low', least({acc}.low, {x}.i), 'go', true, 'out', if({x}.z > {threshold}, "
        f"concat({acc}.out, array(named_struct('start_word', get(w, {s}).word_no, 'end_word', {x}.word_no, "
        f"'score', least({acc}.low, {x}.i, get(w, {s}).a, {x}.z)))), {acc}.out))), {acc} -> {acc}.out)"
    )
    spans = per_label.selectExpr(
        *keys, "label",
        f"inline(flatten(transform(filter(sequence(0, size(w) - 1), {e} -> get(w, {e}).a > {threshold}), {s} -> {walk})))",
    )
    per_chunk = spans.groupBy(*keys).agg(
        F.expr(
            f"array_sort(collect_list(struct(-score AS worst, array_position(array({lits(labels)}), label) AS label_order, start_word AS start_word, "
            "end_word AS end_word, score AS score, label AS label)))"
        ).alias("found")
    )
    k = fresh("k")
    empty = "cast(array() AS array<struct<start_word:int,end_word:int,score:double,label:string>>)"
    best = (
        f"aggregate(found, {empty}, ({acc}, {x}) -> if(exists({acc}, {k} -> {x}.start_word <= {k}.end_word AND "
        f"{x}.end_word >= {k}.start_word), {acc}, concat({acc}, array(named_struct('start_word', {x}.start_word, "
        f"'end_word', {x}.end_word, 'score', {x}.score, 'label', {x}.label)))))"
    )
    return per_chunk.selectExpr(*keys, f"inline(array_sort({best}))")


def entity_category(label: str) -> str:
    return lookup(P.ENTITY_CATEGORY, f"lower({label})")


def is_business_address(text: str) -> str:
    """A business word that names no street, and nothing that hints at a home."""
    return f"({rlike(text, P.BUSINESS_NOT_STREET)} AND NOT {rlike(text, P.HOME_CUE)})"


def entity_candidates(entities: str, minimum: float = P.NAME_THRESHOLD) -> str:
    """An array of entities as name spans: known labels above the cutoff, best score first, no overlaps, in order."""
    e, a, k, s = fresh("e"), fresh("a"), fresh("k"), fresh("s")
    good = (
        f"filter({entities}, {e} -> {entity_category(e + '.label')} IS NOT NULL AND {e}.score >= {minimum} "
        f"AND {e}.start >= 0 AND {e}.end > {e}.start AND length({e}.text) = {e}.end - {e}.start "
        f"AND NOT ({entity_category(e + '.label')} = 'NAME' AND lower(trim({e}.text)) IN ({lits(P.NOT_NAMES)})) "
        f"AND NOT ({entity_category(e + '.label')} = 'ADDRESS' AND {is_business_address(e + '.text')}))"
    )
    ordered = f"array_sort(transform({good}, {e} -> named_struct('worst', -{e}.score, 'at', {e}.start, 'e', {e})))"
    one = span(
        f"{e}.e.start", f"{e}.e.end", entity_category(f"{e}.e.label"), lit("ner"), f"{e}.e.score", str(NAME_PRIORITY), f"{e}.e.text"
    )
    kept = (
        f"aggregate({ordered}, {NO_SPANS}, ({a}, {e}) -> if(exists({a}, {k} -> {e}.e.start < {k}.end AND {e}.e.end > {k}.start), "
        f"{a}, concat({a}, array({one}))))"
    )
    return f"cast(array_sort({kept}) AS {SPAN_TYPE})"


def extend_address(text: str, spans: str) -> str:
    """An address preceded only by short comma-separated parts grows to the first visible character of the text."""
    visible = lit("^[" + P.SPACE + "]*")
    s, o, p = fresh("s"), fresh("o"), fresh("p")

    def grown(both: str) -> str:
        before = f"substring({both}.t, 1, {s}.start)"
        trimmed = f"regexp_replace({p}, {visible}, '')"

        def parts_ok(parts: str) -> str:
            head = f"slice({parts}, 1, size({parts}) - 1)"
            return (
                f"size({parts}) > 1 AND NOT {rlike(f'element_at({parts}, -1)', '[^%S%]')} AND forall({head}, {p} -> "
                f"length({p}) >= 1 AND length({trimmed}) <= 40 AND NOT {p} rlike '[.;:!?]')"
            )

        first = f"(length({before}) - length(regexp_replace({before}, {visible}, '')))"
        whole = f"substring({both}.t, {first} + 1, {s}.end - {first})"
        grow = let(f"split({before}, ',', -1)", parts_ok)
        bigger = span(first, f"{s}.end", f"{s}.category", f"{s}.source", f"{s}.confidence", f"{s}.priority", whole)
        alone = f"NOT exists({both}.v, {o} -> {o}.end <= {s}.start)"
        return (
            f"transform({both}.v, {s} -> CASE WHEN {s}.category <> 'ADDRESS' OR {s}.start = 0 THEN {s} "
            f"WHEN {alone} AND {grow} AND NOT {is_business_address(whole)} THEN {bigger} ELSE {s} END)"
        )

    return let(f"named_struct('t', {text}, 'v', cast({spans} AS {SPAN_TYPE}))", grown)


# --- the finder used when no model is plugged in: rules only -------------------

# One to four capitalised words right after words that address the user, and a number, words and a street word.
_CUE_NAME = r"(?i:(?<![\p{L}\p{N}])(?:" + P.CUES + r"))[%S%,:!-]*(\p{Lu}[\p{L}\p{N}'#.-]*(?: \p{Lu}[\p{L}\p{N}'.-]*){0,3})"
_STREET = r"(?i)%L%[0-9]{1,6}[A-Z]? (?:[\p{L}'.-]+ ){1,4}" + P.STREET_WORD


def rule_entities(text: str) -> str:
    """Entities by cue words and street words: the default when no model is plugged in."""
    m = fresh("m")
    trimmed = f"regexp_extract({m}.text, {lit(P.java(_CUE_NAME))}, 1)"
    names = (
        f"transform({find(text, lit(P.java(_CUE_NAME)), rlike(text, P.CUE_MENTION))}, {m} -> named_struct("
        f"'start', {m}.end - length({trimmed}), 'end', {m}.end, 'label', 'person', 'score', 0.9D, 'text', {trimmed}))"
    )
    places = (
        f"transform({find(text, lit(P.java(_STREET)), rlike(text, '[0-9]'))}, {m} -> named_struct('start', {m}.start, "
        f"'end', {m}.end, 'label', 'address', 'score', 0.8D, 'text', {m}.text))"
    )
    return f"cast(concat({names}, {places}) AS {ENTITY_TYPE})"

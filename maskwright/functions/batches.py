"""Detection over whole Arrow batches: the same candidates and spans as the SQL expressions, without a call per row.

Arrow's own regular expressions (RE2) mark every match of a detector in a column at once; places, labels and overlaps are
then worked out on the flat list of matches. RE2 has no look-around, so a batch leaves a text to the SQL expression, by
giving NULL for it, where the two could differ: texts with the marks in them, with one of the two letters that RE2 takes
for k and s when case is ignored, or with an id without a digit that runs on into one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import detectors as D
from maskwright.functions import patterns as P
from maskwright.functions.spans import SPAN_TYPE
from maskwright.session import fair_batches

_OPEN, _CLOSE = "\x01", "\x02"
_ODD_TEXT = "[\x01\x02ſK]"
_ID_RUNS_ON = f"{_OPEN}[A-Za-z-]+{_CLOSE}{_OPEN}?[A-Za-z0-9-]"
_SPAN = pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("source", pa.string()),
    ("confidence", pa.float64()), ("priority", pa.int32()), ("text", pa.string()),
])
#: Labels each detector asks for, and those it refuses (its gate is the first, over the whole text).
_CONTEXT = {
    "aadhaar": P.AADHAAR_CONTEXT, "passport": P.PASSPORT_CONTEXT, "account_number": P.ACCOUNT_CONTEXT,
    "other_id": P.OTHER_ID_CONTEXT, "dob": P.DOB_CONTEXT, "labelled_phone": P.PHONE_CONTEXT,
}
_REFUSED = {"local_mobile": P.NOT_A_PHONE}


def _is_card(match: str) -> bool:
    digits = [int(c) for c in match if c in "0123456789"]
    doubled = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return doubled % 10 == 0 and digits[0] != 0 and not (len(digits) == 13 and digits[:2] == [9, 7] and digits[2] in (8, 9))


def _marked(texts: pa.Array, detector: D.Detector) -> tuple[pa.Array, pa.Array | None]:
    """(texts with each match between marks, which texts are left to the SQL expression)."""
    if detector.name == "upi":  # the look-ahead as the characters that may follow
        pattern = "(?i)(" + P.re2(P.UPI_CORE) + r")([^a-z0-9.-]|\.[^a-z0-9]|\.\z|\z)"
        return pc.replace_substring_regex(texts, pattern=pattern, replacement=rf"{_OPEN}\1{_OPEN}\2"), None
    if detector.name == "other_id":  # words are marked with the ids, then let go
        marked = pc.replace_substring_regex(texts, pattern=P.re2(P.OTHER_ID_PLAIN), replacement=rf"{_OPEN}\0{_CLOSE}")
        runs_on = pc.match_substring_regex(marked, pattern=_ID_RUNS_ON)
        ids = pc.replace_substring_regex(marked, pattern=f"{_OPEN}([A-Za-z-]+){_CLOSE}", replacement=r"\1")
        return pc.replace_substring(ids, pattern=_CLOSE, replacement=_OPEN), runs_on
    return pc.replace_substring_regex(texts, pattern=P.re2(detector.pattern), replacement=rf"{_OPEN}\0{_OPEN}"), None


def _labels(pieces: pa.Array, at: np.ndarray, first: np.ndarray) -> pa.Array:
    """The label before each match: what stands before it, back to the last digit."""
    before = pieces.take(pa.array(at - 1))
    matched = pc.if_else(pa.array(first), "", pieces.take(pa.array(np.maximum(at - 2, 0))))
    window = pc.utf8_slice_codeunits(pc.binary_join_element_wise(matched, before, ""), start=-P.LABEL_WINDOW)
    return pc.replace_substring_regex(window, pattern="(?s)^.*[0-9]", replacement="")


def _found(texts: pa.Array, detector: D.Detector) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, start, end, text) of every candidate of one detector, and the rows left to the SQL expression."""
    rows = np.arange(len(texts))
    context = _CONTEXT.get(detector.name)
    if context is not None:
        rows = np.flatnonzero(pc.match_substring_regex(texts, pattern=P.re2(context)).to_numpy(zero_copy_only=False))
        texts = texts if len(rows) == len(texts) else texts.take(pa.array(rows))
    marked, left = _marked(texts, detector)
    lists = pc.split_pattern(marked, pattern=_OPEN)
    offsets, pieces = lists.offsets.to_numpy(), lists.flatten()
    lengths = pc.utf8_length(pieces).to_numpy()
    sizes = np.diff(offsets)
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(of)) - offsets[:-1][of] if len(of) else of
    sums = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
    at = np.flatnonzero(place % 2 == 1)
    if context is not None or detector.name in _REFUSED:
        labels = _labels(pieces, at, place[at] == 1)
        fits = pc.match_substring_regex(labels, pattern=P.re2(context or _REFUSED[detector.name])).to_numpy(zero_copy_only=False)
        at = at[fits if context is not None else ~fits]
    text = pieces.take(pa.array(at))
    if detector.name == "card" and len(at):
        fits = np.array([_is_card(t) for t in text.to_pylist()])
        at, text = at[fits], text.filter(pa.array(fits))
    start = sums[at] - sums[offsets[:-1]][of[at]]
    skipped = rows[:0] if left is None else rows[left.to_numpy(zero_copy_only=False)]
    return rows[of[at]], start, start + lengths[at], text, skipped


def _earliest(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As resolve_overlaps, over spans sorted by row, start, longest, priority."""
    keep, here, reach = np.ones(len(row), bool), -1, 0
    for i, (r, s, e) in enumerate(zip(row.tolist(), start.tolist(), end.tolist(), strict=True)):
        if r != here:
            here, reach = r, e
        elif s >= reach:
            reach = e
        else:
            keep[i] = False
    return keep


def _first_listed(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As first_wins, over spans sorted by row and place in the list."""
    keep, here, starts, ends = np.ones(len(row), bool), -1, [], []
    for i, (r, s, e) in enumerate(zip(row.tolist(), start.tolist(), end.tolist(), strict=True)):
        if r != here:
            here, starts, ends = r, [], []
        k = bisect_left(starts, s)
        if (k < len(starts) and starts[k] < e) or (k and ends[k - 1] > s):
            keep[i] = False
        else:
            starts.insert(k, s)
            ends.insert(k, e)
    return keep


def spans_of(texts: pa.Array, detectors: Sequence[D.Detector], merge: str | None) -> pa.Array:
    """For each text its candidates (``merge`` None), or what is left of them by position ("earliest") or place in the list ("listed")."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, pattern=_ODD_TEXT).to_numpy(zero_copy_only=False).copy()
    if odd.any():
        texts = pc.if_else(pa.array(odd), "", texts)
    groups = list(dict.fromkeys(d.must_hold for d in detectors))
    listed = sorted(enumerate(detectors), key=lambda x: groups.index(x[1].must_hold))
    parts = []
    for priority, detector in listed:
        row, start, end, text, skipped = _found(texts, detector)
        odd[skipped] = True
        parts.append((row, start, end, np.full(len(row), priority), text))
    row, start, end, priority = (np.concatenate([p[k] for p in parts]) for k in range(4))
    text = pa.concat_arrays([p[4].cast(pa.string()) for p in parts])
    place = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((priority, -end, start, row)) if merge == "earliest" else np.lexsort((start, place, row))
    order = order[~odd[row[order]]]
    if merge is not None:
        order = order[(_earliest if merge == "earliest" else _first_listed)(row[order], start[order], end[order])]
    if merge == "listed":
        order = order[np.lexsort((end[order], start[order], row[order]))]
    kind = pa.array(priority[order])
    spans = pa.StructArray.from_arrays(
        [
            pa.array(start[order].astype(np.int32)), pa.array(end[order].astype(np.int32)),
            pa.array([d.category for d in detectors], pa.string()).take(kind),
            pa.array(["regex"], pa.string()).take(pa.array(np.zeros(len(order), np.int64))),
            pa.array([float(d.confidence) for d in detectors]).take(kind), pa.array(priority[order].astype(np.int32)),
            text.take(pa.array(order)),
        ],
        fields=list(_SPAN),
    )
    offsets = np.r_[0, np.cumsum(np.bincount(row[order], minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), spans, mask=pa.array(odd))


def _column(text: str, detectors: Sequence[D.Detector], merge: str | None, slow: str) -> Column:
    bank = tuple(detectors)
    if any(d not in D.ALL for d in bank):
        return F.expr(slow)  # a detector of the caller's own has only its SQL

    @F.arrow_udf(SPAN_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        return spans_of(texts, bank, merge)

    return run(F.expr(text))


def with_spans(df: DataFrame, text: str = "text", detectors: Sequence[D.Detector] = D.ALL, merge: str | None = "earliest", name: str = "spans") -> DataFrame:
    """``df`` with the column ``name``: what ``detect`` ("earliest"), ``detect_one`` ("listed") or ``candidates`` (None) give for ``text``."""
    fair_batches(df.sparkSession)
    found = D.candidates(text, detectors)
    slow = found if merge is None else D.resolve_overlaps(found) if merge == "earliest" else D.first_wins(found)
    quick = df.withColumn(name, _column(text, detectors, merge, slow))
    return quick.withColumn(name, F.when(F.col(name).isNull(), F.expr(slow)).otherwise(F.col(name)))


def with_candidates_in_context(df: DataFrame, text: str = "text", context: str = "context", name: str = "found") -> DataFrame:
    """``df`` with the column ``name``: what ``candidates_in_context`` gives."""
    prefix = D.context_prefix(context)
    whole = with_spans(df.withColumn("_whole", F.expr(f"concat({prefix}, {text})")), "_whole", merge=None, name=name).drop("_whole")
    return whole.withColumn(name, F.expr(f"if(coalesce({context}, '') = '', {name}, {D.out_of_context(name, f'length({prefix})')})"))

"""The detector registry: each detector is a SQL expression from text to spans.

Add a kind by building a ``Detector`` and passing it to ``detect``; no Python
runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from maskwright.functions import patterns as P
from maskwright.functions.spans import NO_SPANS, SPAN_TYPE, apart, find, in_blocks, resolve_overlaps, span, without_marks
from maskwright.functions.sql import fresh, let, lit, lookup


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    confidence: float
    pattern: str
    # A cheap test of the whole text that must hold before the pattern is tried.
    gate: Callable[[str], str]
    # Accepts a match from its text and the label before it.
    keep: Callable[[str, str], str] | None = None
    needs_label: bool = False
    # What every match must hold: tested once for all detectors that share it.
    must_hold: str = "digit"

    def __post_init__(self) -> None:
        if self.category not in P.CATEGORIES:
            raise ValueError(f"{self.name}: there are no tokens of category {self.category}")

    def candidates(self, text: str, priority: int) -> str:
        found = find(text, lit(P.java(self.pattern)), self.gate(text), labels=self.needs_label, clean=True)
        m = fresh("m")
        if self.keep is not None:
            found = f"filter({found}, {m} -> {self.keep(m + '.text', m + '.label')})"
        one = span(
            f"{m}.start", f"{m}.end", lit(self.category), lit("regex"), lit(float(self.confidence)),
            str(priority), f"{m}.text",
        )
        return f"transform({found}, {m} -> {one})"


MUST_HOLD = {"digit": lambda t: f"{t} rlike '[0-9]'", "at": lambda t: f"contains({t}, '@')"}


def rlike(value: str, pattern: str) -> str:
    return f"({value} rlike {lit(P.java(pattern))})"


def _labelled(name: str, category: str, pattern: str, context: str) -> Detector:
    return Detector(
        name, category, 0.95, pattern,
        gate=lambda t: rlike(t, context),
        keep=lambda _, label: rlike(label, context),
        needs_label=True,
    )


def looks_like_card(match: str) -> str:
    """Luhn holds, does not start with 0, and is not a 13-digit book number (978 / 979)."""
    return let(
        f"regexp_replace({match}, '[^0-9]', '')",
        lambda d: f"luhn_check({d}) AND NOT startswith({d}, '0') AND NOT (length({d}) = 13 AND {d} rlike '^97[89]')",
    )


EMAIL = Detector("email", "EMAIL", 1.0, P.EMAIL, MUST_HOLD["at"], must_hold="at")
PHONE = Detector("phone", "PHONE", 1.0, P.PHONE, lambda t: rlike(t, r"\+[0-9]"))
CARD = Detector(
    "card", "CARD", 1.0, P.CARD, lambda t: rlike(t, "[0-9](?:[ -]?[0-9]){12}"), keep=lambda m, _: looks_like_card(m)
)
PAN = Detector("pan", "GOV_ID", 1.0, P.PAN, lambda t: rlike(t, "[0-9]{4}[A-Za-z]"))
IFSC = Detector("ifsc", "ACCOUNT", 1.0, P.IFSC, lambda t: rlike(t, "[A-Za-z]0[A-Za-z0-9]{6}"))
UPI = Detector("upi", "ACCOUNT", 1.0, P.UPI, MUST_HOLD["at"], must_hold="at")
AADHAAR = _labelled("aadhaar", "GOV_ID", P.AADHAAR, P.AADHAAR_CONTEXT)
PASSPORT = _labelled("passport", "GOV_ID", P.PASSPORT, P.PASSPORT_CONTEXT)
ACCOUNT_NUMBER = _labelled("account_number", "ACCOUNT", P.ACCOUNT_NUMBER, P.ACCOUNT_CONTEXT)
OTHER_ID = _labelled("other_id", "OTHER", P.OTHER_ID, P.OTHER_ID_CONTEXT)
DOB = _labelled("dob", "DOB", P.DATE, P.DOB_CONTEXT)
LABELLED_PHONE = _labelled("labelled_phone", "PHONE", P.LABELLED_PHONE, P.PHONE_CONTEXT)
LOCAL_MOBILE = Detector(
    "local_mobile", "PHONE", 0.9, P.LOCAL_MOBILE,
    gate=lambda t: rlike(t, "[6-9](?:[ -]?[0-9]){9}"),
    keep=lambda _, label: f"NOT {rlike(label, P.NOT_A_PHONE)}",
    needs_label=True,
)

# In priority order: on exactly the same span, the earlier detector wins.
ALL = (
    EMAIL, PHONE, CARD, PAN, IFSC, UPI, AADHAAR, PASSPORT, ACCOUNT_NUMBER, OTHER_ID, DOB, LABELLED_PHONE, LOCAL_MOBILE,
)
# Single-kind entry points; the phone kinds merge in list order.
KINDS = {
    "email": (EMAIL,),
    "phone": (PHONE, LABELLED_PHONE, LOCAL_MOBILE),
    "card": (CARD,),
    "pan": (PAN,),
    "ifsc": (IFSC,),
    "upi": (UPI,),
    "aadhaar": (AADHAAR,),
    "account": (ACCOUNT_NUMBER,),
    "passport": (PASSPORT,),
    "other": (OTHER_ID,),
}


def candidates(text: str, detectors: Sequence[Detector] = ALL) -> str:
    """Every candidate of every detector, unresolved.

    Detectors are grouped by the character every match of theirs must hold, so
    a text with no digit and no "@" costs two cheap tests.
    """

    def bank(t: str) -> str:
        groups: dict[str, list[str]] = {}
        for priority, detector in enumerate(detectors):
            groups.setdefault(detector.must_hold, []).append(detector.candidates(t, priority))
        found = [
            f"if(coalesce({MUST_HOLD[holds](t)}, false), concat({', '.join(columns)}), {NO_SPANS})"
            for holds, columns in groups.items()
        ]
        return f"concat({', '.join(found)})"

    return let(without_marks(text), bank)


def detect(text: str, detectors: Sequence[Detector] = ALL) -> str:
    """The resolved spans of ``text``: disjoint, in order."""
    return resolve_overlaps(candidates(text, detectors))


def out_of_context(found: str, shift: str) -> str:
    """Candidates of "context: text" as candidates of the text, which begins at ``shift``; a match starting before it is dropped whole."""
    s = fresh("s")

    def moved(v: str) -> str:
        one = span(
            f"{s}.start - {v}.shift", f"{s}.end - {v}.shift", f"{s}.category", f"{s}.source", f"{s}.confidence",
            f"{s}.priority", f"{s}.text",
        )
        return f"transform(filter({v}.found, {s} -> {s}.start >= {v}.shift), {s} -> {one})"

    return let(f"named_struct('found', {found}, 'shift', {shift})", moved)


def context_prefix(context: str) -> str:
    return f"if(coalesce({context}, '') = '', '', concat({context}, ': '))"


def candidates_in_context(text: str, context: str, detectors: Sequence[Detector] = ALL) -> str:
    """Candidates of ``text`` read as "context: text". A match starting in the context is dropped whole."""
    prefix = context_prefix(context)
    return let(f"concat({prefix}, {text})", lambda whole: out_of_context(candidates(whole, detectors), f"length({prefix})"))


def detect_in_context(text: str, context: str, detectors: Sequence[Detector] = ALL) -> str:
    return resolve_overlaps(candidates_in_context(text, context, detectors))


def first_wins(spans: str) -> str:
    """Single-kind merge: a span is dropped when one kept from an earlier place in the list touches it.

    Disjoint spans are only sorted. Else, as only spans that touch through each other can decide on each other, the list
    is cut, in order of position, into runs that touch; each run is then merged by place in the list.
    """
    entry = f"struct<start:int,i:int,s:{SPAN_TYPE[6:-1]}>"

    def merged(placed: str) -> str:
        a, s, k, c = fresh("a"), fresh("s"), fresh("k"), fresh("c")
        runs = in_blocks(
            placed, f"named_struct('reach', -1, 'open', cast(array() AS array<{entry}>))", f"array<array<{entry}>>",
            lambda f, x: (
                f"if({x}.start < {f}.state.reach, named_struct('state', named_struct('reach', greatest({f}.state.reach, {x}.s.end), "
                f"'open', concat({f}.state.open, array({x}))), 'kept', {f}.kept), named_struct('state', named_struct('reach', {x}.s.end, "
                f"'open', array({x})), 'kept', concat({f}.kept, array({f}.state.open))))"
            ),
            lambda state: f"array({state}.open)",
        )
        each = (
            f"aggregate(array_sort(transform({c}, {s} -> named_struct('i', {s}.i, 's', {s}.s))), {NO_SPANS}, ({a}, {s}) -> "
            f"if(exists({a}, {k} -> {s}.s.start < {k}.end AND {k}.start < {s}.s.end), {a}, concat({a}, array({s}.s))))"
        )
        return f"array_sort(flatten(transform({runs}, {c} -> {each})))"

    def sort(v: str) -> str:
        s, i = fresh("s"), fresh("i")
        return f"array_sort(transform({v}, ({s}, {i}) -> named_struct('start', {s}.start, 'i', {i}, 's', {s})))"

    def choose(placed: str) -> str:
        s = fresh("s")
        sorted_spans = f"cast(transform({placed}, {s} -> {s}.s) AS {SPAN_TYPE})"
        return f"if({apart(f'transform({placed}, {s} -> {s}.s)')}, {sorted_spans}, {merged(placed)})"

    return let(spans, lambda v: let(sort(v), choose))


def detect_one(text: str, kind: str) -> str:
    return first_wins(candidates(text, KINDS[kind]))


def whole_value_span(value: str, category: str, confidence: float) -> str:
    return f"array({span('0', f'length({value})', category, lit('dom-type'), lit(confidence), '0', value)})"


def field_category(input_type: str, autocomplete: str) -> str:
    """The category a form field names: its first known autocomplete word, else its input type."""
    w, c = fresh("w"), fresh("c")
    words = f"split(lower(coalesce({autocomplete}, '')), {lit('[' + P.SPACE + ']+')})"
    known = f"filter(transform({words}, {w} -> {lookup(P.AUTOCOMPLETE_CATEGORY, w)}), {c} -> {c} IS NOT NULL)"
    return f"coalesce(get({known}, 0), {lookup(P.INPUT_TYPE_CATEGORY, f'lower({input_type})')})"


def is_password(input_type: str, autocomplete: str) -> str:
    return (
        f"(coalesce({input_type} = 'password', false) OR "
        f"coalesce({rlike(autocomplete, P.PASSWORD_AUTOCOMPLETE)}, false))"
    )


def field_spans(value: str, input_type: str, autocomplete: str) -> str:
    """The whole value as one span, when the field itself says what it holds; NULL when it does not."""
    visible = f"coalesce({value}, '') rlike {lit('[^' + P.SPACE + ']')}"

    def choose(category: str) -> str:
        return (
            f"CASE WHEN {is_password(input_type, autocomplete)} AND length({value}) > 0 "
            f"THEN cast({whole_value_span(value, lit('OTHER'), 1.0)} AS {SPAN_TYPE}) "
            f"WHEN {category} IS NOT NULL AND {visible} "
            f"THEN cast({whole_value_span(value, category, 0.9)} AS {SPAN_TYPE}) END"
        )

    return let(field_category(input_type, autocomplete), choose)


def normalize_ocr(text: str) -> str:
    """Join an email's local part that was read with a space or a comma for its dot."""
    stops = "|".join(P.LEADS_INTO_ADDRESS)
    dotted = lit(r"(\w)[.,] (\w[^" + P.SPACE + "]*@)")
    spaced = lit("(^|[" + P.SPACE + r":(<])(?!(?i:" + stops + r") )([A-Za-z0-9._%+-]+) ([A-Za-z0-9._%+-]+@)")
    return f"regexp_replace(regexp_replace({text}, {dotted}, '$1.$2'), {spaced}, '$1$2.$3')"

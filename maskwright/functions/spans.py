"""Span expressions: find matches with offsets, resolve overlaps, replace by tokens.

Each function takes and returns Spark SQL text, so a whole detector bank is
one parsed expression that stays in the JVM. Offsets are 0-based,
end-exclusive and count code points, as Spark's own string functions do.
"""

from __future__ import annotations

from collections.abc import Callable

from maskwright.functions.patterns import LABEL_WINDOW
from maskwright.functions.sql import fresh, let, lit

MARK = "\u0001"
FOUND_TYPE = "array<struct<start:int,end:int,text:string,label:string>>"
SPAN_TYPE = "array<struct<start:int,end:int,category:string,source:string,confidence:double,priority:int,text:string>>"
NO_SPANS = f"cast(array() AS {SPAN_TYPE})"
# Entries whose running lengths are summed in one fold.
BLOCK = 256
# Results appended one by one in a fold.
FOLD_BLOCK = 64
# Up to this many pieces, a start is simply the length of what comes before it.
FEW = 33


def _running(lengths: str) -> str:
    a, n = fresh("a"), fresh("n")
    return f"aggregate({lengths}, array(0), ({a}, {n}) -> concat({a}, array(element_at({a}, -1) + {n})))"


def running_lengths(lengths: str) -> str:
    """Sum of the lengths before each entry. Near linear in the input, however long it is: summed block by block."""
    b, block, i, s, t, a, n = (fresh(x) for x in ("b", "block", "i", "s", "t", "a", "n"))

    def shifted(v: str) -> str:
        inner = let(
            f"get({v}.base, {i})",
            lambda base: f"transform(slice({_running(block)}, 1, size({block})), {s} -> {s} + {base})",
        )
        return f"flatten(transform({v}.blocks, ({block}, {i}) -> {inner}))"

    def with_base(v: str) -> str:
        totals = f"transform({v}, {t} -> aggregate({t}, 0, ({a}, {n}) -> {a} + {n}))"
        return let(f"named_struct('blocks', {v}, 'base', {_running(totals)})", shifted)

    def blocks(whole: str) -> str:
        return let(
            f"transform(sequence(0, cast(floor((size({whole}) - 1) / {BLOCK}) AS int)), "
            f"{b} -> slice({whole}, {b} * {BLOCK} + 1, {BLOCK}))",
            with_base,
        )

    return let(lengths, blocks)


def without_marks(text: str) -> str:
    """The text free of the mark its pieces are cut at; same length."""
    return f"if(contains({text}, {lit(MARK)}), translate({text}, {lit(MARK)}, {lit(chr(0xFFFD))}), {text})"


def pieces(text: str, pattern: str, clean: bool = False) -> str:
    """The text cut around every match: literal, match, literal, ... ``pattern`` is SQL text."""
    whole = text if clean else without_marks(text)
    return f"split(regexp_replace({whole}, {pattern}, {lit(MARK + '$0' + MARK)}), {lit(MARK)}, -1)"


def find(text: str, pattern: str, gate: str | None = None, labels: bool = False, clean: bool = False) -> str:
    """Every match of ``pattern`` in ``text``: array of start, end, text and, if asked, the label before it.

    ``gate`` is a cheap test that must hold for any match to exist; texts that
    fail it never reach the pattern. The label of a match is the 48 characters
    before it, cut after the last digit in them. ``clean``: the text is known
    to hold no mark.
    """

    def label_of(p: str, i: str) -> str:
        if not labels:
            return "cast(NULL AS string)"
        before = f"right(concat(coalesce(get({p}, {i} - 2), ''), get({p}, {i} - 1)), {LABEL_WINDOW})"
        return f"regexp_replace({before}, {lit(r'^[\s\S]*[0-9]')}, '')"

    def matches(p: str) -> str:
        i, k, n, at = fresh("i"), fresh("k"), fresh("n"), fresh("at")
        odd = f"sequence(1, greatest(size({p}) - 2, 1), 2)"
        near = f"transform({odd}, {i} -> length(array_join(slice({p}, 1, {i}), '')))"
        sums = running_lengths(f"transform({p}, {n} -> length({n}))")
        far = f"filter({sums}, ({n}, {i}) -> {i} % 2 = 1)"

        def each(q: str) -> str:
            here = f"({k} * 2 + 1)"
            one = (
                f"named_struct('start', {at}, 'end', {at} + length(get({q}.p, {here})), "
                f"'text', get({q}.p, {here}), 'label', {label_of(q + '.p', here)})"
            )
            return f"transform({q}.s, ({at}, {k}) -> {one})"

        return let(f"named_struct('p', {p}, 's', if(size({p}) <= {FEW}, {near}, {far}))", each)

    empty = f"cast(array() AS {FOUND_TYPE})"
    found = let(pieces(text, pattern, clean), lambda p: f"if(size({p}) < 3, {empty}, {matches(p)})")
    if gate is None:
        return f"coalesce({found}, {empty})"
    return f"if(coalesce({gate}, false), {found}, {empty})"


def label_before(text: str, start: str) -> str:
    """The 48 characters before ``start``, cut after the last digit: a label describes only the next number."""
    window = f"substring({text}, greatest({start} - {LABEL_WINDOW}, 0) + 1, least({start}, {LABEL_WINDOW}))"
    return f"regexp_replace({window}, {lit(r'^[\s\S]*[0-9]')}, '')"


def span(start: str, end: str, category: str, source: str, confidence: str, priority: str, text: str) -> str:
    return (
        f"named_struct('start', {start}, 'end', {end}, 'category', {category}, 'source', {source}, "
        f"'confidence', {confidence}, 'priority', {priority}, 'text', {text})"
    )


def in_blocks(items: str, state: str, kept: str, step: Callable[[str, str], str], last: Callable[[str], str] | None = None) -> str:
    """A fold that appends to ``kept`` (its type) as it goes, in near linear time however long ``items`` is.

    Appending copies what is already there, so a block's results are appended one by one, and whole blocks to the end.
    ``step`` takes the names of the fold (with fields ``state`` and ``kept``) and of the item, and gives the next fold.
    ``last``: an array, made of the final state, that ends the result.
    """
    a, b, x, v, n, done = (fresh(p) for p in ("a", "b", "x", "v", "n", "done"))
    inner = (
        f"aggregate({b}, named_struct('state', {a}.state, 'kept', cast(array() AS {kept})), ({v}, {x}) -> {step(v, x)})"
    )
    after = let(inner, lambda d: f"named_struct('state', {d}.state, 'kept', concat({a}.kept, array({d}.kept)))")

    def folded(whole: str) -> str:
        blocks = (
            f"transform(sequence(0, cast(floor((size({whole}) - 1) / {FOLD_BLOCK}) AS int)), "
            f"{n} -> slice({whole}, {n} * {FOLD_BLOCK} + 1, {FOLD_BLOCK}))"
        )
        end = f"flatten({done}.kept)" if last is None else f"concat(flatten({done}.kept), {last(done + '.state')})"
        return (
            f"aggregate({blocks}, named_struct('state', {state}, 'kept', cast(array() AS array<{kept}>)), "
            f"({a}, {b}) -> {after}, {done} -> {end})"
        )

    return let(items, folded)


def apart(placed: str) -> str:
    """Whether spans in order of their starts are disjoint: each starts where the one before it ends, or later."""
    x, i = fresh("x"), fresh("i")
    return let(placed, lambda v: f"NOT exists(transform({v}, ({x}, {i}) -> coalesce(get({v}, {i} - 1).end, 0) > {x}.start), {x} -> {x})")


def resolve_overlaps(spans: str) -> str:
    """Keep the earliest, then longest, then first-listed of overlapping spans.

    Kept spans are disjoint and in order, so a candidate need only be compared with the last one kept. Most texts have
    no overlaps at all: theirs are only sorted. Short lists are folded plainly, long ones in blocks.
    """

    def fold(v: str) -> str:
        a, x = fresh("a"), fresh("x")
        step = lambda f, y: f"if({y}.start >= {f}.state, named_struct('state', {y}.end, 'kept', concat({f}.kept, array({y}))), {f})"
        plain = f"aggregate({v}, named_struct('state', -1, 'kept', {NO_SPANS}), ({a}, {x}) -> {step(a, x)}, {a} -> {a}.kept)"
        return f"CASE WHEN {apart(v)} THEN {v} WHEN size({v}) <= {FOLD_BLOCK} THEN {plain} ELSE {in_blocks(v, '-1', SPAN_TYPE, step)} END"

    def sort(v: str) -> str:
        s = fresh("s")
        keyed = f"array_sort(transform({v}, {s} -> named_struct('at', {s}.start, 'far', -{s}.end, 'p', {s}.priority, 's', {s})))"
        return f"cast(transform({keyed}, {s} -> {s}.s) AS {SPAN_TYPE})"

    return let(spans, lambda v: f"if(size({v}) < 2, cast({v} AS {SPAN_TYPE}), {let(sort(v), fold)})")


def replace_spans(text: str, replacements: str) -> str:
    """Swap each replacement's range for its token. ``replacements``: sorted, disjoint, with start, end, token.

    A NULL token fails the job: joining the pieces would silently drop it and the text before it.
    """

    def build(v: str) -> str:
        s, i = fresh("s"), fresh("i")
        token = f"coalesce({s}.token, raise_error('a span without a token: its category is not one of the known'))"
        part = let(
            f"coalesce(get({v}.r, {i} - 1).end, 0)",
            lambda before: f"concat(substring({v}.t, {before} + 1, {s}.start - {before}), {token})",
        )
        return (
            f"if(size({v}.r) > 0, concat(array_join(transform({v}.r, ({s}, {i}) -> {part}), ''), "
            f"substring({v}.t, element_at({v}.r, -1).end + 1)), {v}.t)"
        )

    return let(f"named_struct('r', {replacements}, 't', {text})", build)

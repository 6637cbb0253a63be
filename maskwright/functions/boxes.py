"""Box expressions: SQL text over structs of x, y, w, h (sizes of zero are safe)."""

from __future__ import annotations


def area(b: str) -> str:
    return f"(greatest(0D, {b}.w) * greatest(0D, {b}.h))"


def intersection(a: str, b: str) -> str:
    wide = f"greatest(0D, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    high = f"greatest(0D, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"({wide} * {high})"


def iou(a: str, b: str) -> str:
    union = f"({area(a)} + {area(b)} - {intersection(a, b)})"
    return f"(if({union} > 0, {intersection(a, b)} / {union}, 0D))"


def centre_distance(a: str, b: str) -> str:
    return f"sqrt(pow({a}.x + {a}.w / 2 - {b}.x - {b}.w / 2, 2) + pow({a}.y + {a}.h / 2 - {b}.y - {b}.h / 2, 2))"


def match_score(a: str, b: str) -> str:
    """IoU when they touch; 0.1 when only their centres are close."""
    scale = f"greatest(least({a}.w, {a}.h), least({b}.w, {b}.h), 1D)"
    union = f"({area(a)} + {area(b)} - {intersection(a, b)})"
    return (
        f"(CASE WHEN {intersection(a, b)} > 0 AND {union} > 0 THEN {intersection(a, b)} / {union} "
        f"WHEN {centre_distance(a, b)} <= {scale} * 0.75D THEN 0.1D ELSE 0D END)"
    )


def text_score(a: str, b: str) -> str:
    """Share of the text box ``b`` inside ``a`` when at least half of it is; else their IoU."""
    share = f"({intersection(a, b)} / {area(b)})"
    return (
        f"(CASE WHEN {intersection(a, b)} <= 0 OR {area(b)} <= 0 THEN 0D WHEN {share} >= 0.5D THEN {share} ELSE {iou(a, b)} END)"
    )

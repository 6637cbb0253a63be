"""Small helpers to write Spark SQL expressions as text.

The heavy expressions of this package (a bank of detectors is well over a
thousand nodes) are written as SQL text and parsed once, which is far cheaper
for the driver than building them call by call.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

_names = itertools.count()


def fresh(prefix: str = "v") -> str:
    """A lambda variable name used nowhere else."""
    return f"{prefix}_{next(_names)}"


def lit(value: str | int | float | bool | None) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value) + ("D" if isinstance(value, float) else "")
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(values: Iterable[str]) -> str:
    return ", ".join(lit(v) for v in values)


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it many times in ``body``.

    A column used inside a higher-order function is evaluated again for every
    element; a lambda variable is not.
    """
    name = fresh()
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def lookup(table: dict[str, str], key: str) -> str:
    """A fixed table as a CASE expression; NULL for an unknown key."""
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"(CASE {key} {arms} END)"


def once(value: str) -> str:
    """The same value, but never copied below a filter that uses it: an expensive column is evaluated one time per row."""
    return f"if(spark_partition_id() >= 0, {value}, NULL)"

"""Run a registered query and its check SQL side by side."""

from __future__ import annotations

import glob
import os

import duckdb

from maskwright.plans import catalog


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when they match, else what differs."""
    ours = catalog.QUERIES[name](spark, folder)
    got_columns, got = _rows(ours.columns, [tuple(r) for r in ours.collect()])
    if name not in catalog.ORACLES:
        return None if got else "no rows"
    rel = con.sql(catalog.ORACLES[name])
    want_columns, want = _rows(rel.columns, rel.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got == want:
        return None
    extra = [r for r in got if r not in want][:3] if len(got) < 3000 else [a for a, b in zip(got, want) if a != b][:3]
    missing = [r for r in want if r not in got][:3] if len(want) < 3000 else [b for a, b in zip(got, want) if a != b][:3]
    return f"rows {len(got)} vs {len(want)}; extra {str(extra)[:600]}; missing {str(missing)[:600]}"

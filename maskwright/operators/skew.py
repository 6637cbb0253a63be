"""Joins and ordered computations that survive one key holding a third of all rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.session import settled

# At most this many rows of the right side are broadcast, whatever the data: the keys used most on the left.
HOT_KEYS = 512
SALTS = 16
#: A task sorts or windows at most about so many rows, whatever the number of shuffle partitions.
TASK_ROWS = 1_000_000
#: Rows of a turn: what is shuffled and written for so many lies on disk at once, whatever the size of the table.
TURN_ROWS = 4_000_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: never broadcast.

    Spark goes by the size of files and of shuffled columns, which says little of what is built from them (a text of
    two numbers, a row for each salt), and a broadcast is held whole by the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` (of about so many ``rows``) dealt out by ``key``, over more tasks than there are shuffle partitions where these would get over ``TASK_ROWS`` each."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def in_turns(df: DataFrame, by: list[str], make: Callable[[DataFrame], DataFrame], rows: int | None = None) -> DataFrame:
    """``make(df)``, which must not let rows of different ``by`` (SQL) meet, for a share of the keys at a time.

    A large table would fill the disk with the shuffle files of all its rows. Each turn takes about ``rows`` of them
    (``TURN_ROWS``), reads no others, and leaves its result in the shared folder and nothing else. A key is never
    parted, so one of more rows than that makes a turn as large.
    """
    turns = -(-df.count() // (rows or TURN_ROWS))
    if turns < 2:
        return make(df)
    share = F.pmod(F.xxhash64(*map(F.expr, by)), F.lit(turns))
    done = [settled(df.sparkSession, lambda t=t: make(df.where(share == t))) for t in range(turns)]
    return reduce(DataFrame.unionByName, done)


def join_hot(
    left: DataFrame, right: DataFrame, on: list[str], values: list[str], weight: str, spread: list[str]
) -> DataFrame:
    """Left join to a right side with one row per key, when a few keys hold most of the left.

    The ``HOT_KEYS`` rows of ``right`` with the largest ``weight`` (their uses
    on the left) are broadcast: a fixed bound. Left rows that found theirs
    there are spread by ``spread`` in the shuffle, and match nothing in it;
    all other rows shuffle on their key.
    """
    hot = right.orderBy(F.desc(weight)).limit(HOT_KEYS).select(*on, F.struct(*values).alias("_hot"))
    marked = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1)
    )
    cold = right.select(*on, *[F.col(v).alias(f"_cold_{v}") for v in values]).withColumn("_salt", F.lit(0).cast("bigint"))
    joined = marked.withColumn("_salt", F.col("_salt").cast("bigint")).join(shuffled(cold), [*on, "_salt"], "left")
    found = [F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold_{v}")).alias(v) for v in values]
    return joined.select(*left.columns, *found)


def join_salted(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose hot left keys are cut in ``SALTS`` parts; the right side is repeated for each, in the shuffle."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(shuffled(repeated), [*on, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, keys: list[str], order: str, bucket: str, name: str, one: str = "1L") -> DataFrame:
    """1-based position of each row within its keys, without ever sorting one key's rows in one task.

    ``bucket`` is SQL that never falls as ``order`` rises. Rows are numbered
    within (keys, bucket), and shifted by the size of the buckets before.
    ``one`` is SQL that gives 1 for every row. Made of columns that the result holds, it lets Spark count and number the
    rows of one and the same shuffle, where ``df`` ends in one; else the count leaves them out, and is a shuffle of its own.
    """
    part = ", ".join(keys)
    bucketed = df.withColumn("_bucket", F.expr(bucket))
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.expr(f"sum({one})").alias("_n"))
    base = sizes.selectExpr(
        *keys, "_bucket",
        f"coalesce(sum(_n) OVER (PARTITION BY {part} ORDER BY _bucket "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _base",
    )
    local = bucketed.selectExpr("*", f"row_number() OVER (PARTITION BY {part}, _bucket ORDER BY {order}) AS _rn")
    return local.join(shuffled(base), [*keys, "_bucket"]).withColumn(name, F.col("_base") + F.col("_rn")).drop(
        "_bucket", "_base", "_rn"
    )


def ordered(
    df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, str]], bucket: str | None = None
) -> DataFrame:
    """Previous, next, running and last-known values in order within ``keys``.

    ``specs`` maps a new column to (kind, SQL value), with kind one of:
    ``lag``, ``lead``, ``sum`` (running, this row included), ``last`` (latest
    non-null up to this row), ``last_before`` (latest non-null before it).

    Without ``bucket`` the groups must be bounded (a page, a task of at most a
    few dozen steps). With it, each (keys, bucket) is a task of its own, and
    one row per bucket carries what the buckets before it left behind.
    ``order`` must be unique within the keys; ``bucket`` never falls as it rises.
    """
    part = ", ".join(keys)
    if bucket is None:
        return df.selectExpr("*", *[f"{_local(k, v, part, order, None)} AS {n}" for n, (k, v) in specs.items()])
    bucketed = df.withColumn("_bucket", F.expr(bucket))
    summary = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.expr(f"{_summary(k, v, order)}").alias(f"_c_{n}") for n, (k, v) in specs.items()]
    )
    over = f"OVER (PARTITION BY {part} ORDER BY _bucket"
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = {
        "lag": f"lag(_c_{{n}}) {over})",
        "lead": f"lead(_c_{{n}}) {over})",
        "sum": f"sum(_c_{{n}}) {over} {earlier}",
        "last": f"last(_c_{{n}}, true) {over} {earlier}",
        "last_before": f"last(_c_{{n}}, true) {over} {earlier}",
    }
    carry = summary.selectExpr(
        *keys, "_bucket", *[f"{carried[k].format(n=n)} AS _p_{n}" for n, (k, _) in specs.items()]
    )
    joined = bucketed.join(shuffled(carry), [*keys, "_bucket"])
    out = joined.selectExpr(
        "*", *[f"{_local(k, v, part + ', _bucket', order, f'_p_{n}')} AS {n}" for n, (k, v) in specs.items()]
    )
    return out.drop("_bucket", *[f"_p_{n}" for n in specs])


def _summary(kind: str, value: str, order: str) -> str:
    if kind == "lag":
        return f"max_by(struct({value} AS v), {order})"
    if kind == "lead":
        return f"min_by(struct({value} AS v), {order})"
    if kind == "sum":
        return f"sum({value})"
    return f"max_by({value}, {order}) FILTER (WHERE {value} IS NOT NULL)"


def _local(kind: str, value: str, part: str, order: str, carry: str | None) -> str:
    over = f"OVER (PARTITION BY {part} ORDER BY {order}"
    if kind in ("lag", "lead"):
        near = f"{kind}(struct({value} AS v)) {over})"
        return f"({near}).v" if carry is None else f"coalesce({near}, {carry}).v"
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND " + ("1 PRECEDING" if kind == "last_before" else "CURRENT ROW")
    if kind == "sum":
        near = f"sum({value}) {over} {frame})"
        return near if carry is None else f"coalesce({near}, 0) + coalesce({carry}, 0)"
    near = f"last({value}, true) {over} {frame})"
    return near if carry is None else f"coalesce({near}, {carry})"

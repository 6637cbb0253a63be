"""Session helpers: sensible defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Spark drops the shuffle files of a query when it ends, instead of when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the tables of cut_lineage() lie; the paths that the innermost settled() has written so far.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. On a cluster, use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("maskwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    Where it is unset, a local session (one machine, as in tests) gets a temporary folder that goes when Python ends;
    on a cluster that would be a folder of the driver alone, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a reused intermediate table to the shared folder and read it back.

    A lost executor then rereads files instead of rerunning everything that
    fed the table, and each reader takes only the columns it needs. The
    shuffle files of the query that made it go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/maskwright-{uuid.uuid4().hex}"
    made = _written.get()
    if made is not None:
        made.append(path)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut_lineage` that nothing reads any more, given as it returned them."""
    for df in tables:
        _delete(df.sparkSession, _paths[df])


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written to the shared folder; the tables written on the way to it are deleted.

    Nothing that ``make`` has built but not returned may be read afterwards.
    """
    made: list[str] = []
    token = _written.set(made)
    last = ""
    try:
        out = cut_lineage(make())
        last = made[-1]
    finally:
        _written.reset(token)
        for path in made:
            if path != last:
                _delete(spark, path)
    outer = _written.get()
    if outer is not None:
        outer.append(last)
    return out


def fair_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bound the batches that go to Python by bytes as well as by rows: a few very long texts cannot fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > megabytes << 20:
        spark.conf.set(key, str(megabytes << 20))

"""Shared helpers of the training-data operators: reading, shared tables, Arrow mapping."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows per Arrow batch for operators that read whole texts: a batch of very
# long documents must still fit beside the JVM in an executor's memory.
TEXT_BATCH_ROWS = 512


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local session (tests) gets a fresh folder of its own;
    a cluster session is refused, since no machine-local folder is shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
        root = tempfile.mkdtemp(prefix="shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    A lost executor only costs re-reading files; each reader reads only the
    columns it needs.  The write's shuffle files go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


BATCH_SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@contextmanager
def batch_settings(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes for what is written meanwhile; then as before."""
    before = {k: spark.conf.get(k) for k in BATCH_SETTINGS}
    try:
        for key, value in zip(BATCH_SETTINGS, (rows, size)):
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def mapped_table(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str, rows: int = 4096, size: int = 16 << 20) -> DataFrame:
    """``mapInArrow`` written as a shared table, in batches of at most ``rows`` rows and about ``size`` bytes.

    The session's own batch settings are back when the write ends, so no later
    query sees these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from fn(batches)

    with batch_settings(df.sparkSession, rows, size):
        return shared_table(df.mapInArrow(run, schema), name)


def drop_shared(df: DataFrame) -> None:
    """Delete the files of a table made by ``shared_table`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    root = shared_root(spark).removeprefix("file://").removeprefix("file:")
    for folder in folders:
        if root in folder and "/tables/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_KEPT: dict = {}


def keep(key, make: Callable):
    """What ``make`` makes, kept by a Python worker until another operator's task runs in it: one thing at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    _KEPT.clear()


def without_cycles(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` with Python's search for reference cycles off: it makes many objects but no cycles, and the search takes a quarter of its time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from fn(batches)
        finally:
            gc.enable()

    return run


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` over batches of at most ``TEXT_BATCH_ROWS`` rows.

    What an earlier operator kept in the worker goes, unless ``fn`` ``keeps`` something.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        yield from without_cycles(fn)(batches)

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_side(table: DataFrame, max_rows: int = 400_000) -> DataFrame:
    """Hint a broadcast for a narrow table in files, if its counted rows are few enough; otherwise leave it to a shuffle."""
    return F.broadcast(table) if table.count() <= max_rows else table

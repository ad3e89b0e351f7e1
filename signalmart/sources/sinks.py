"""State and report sinks.

No MERGE-capable table format is assumed: every state table is written as a
new ``v=<n>`` version folder and readers pick the newest committed one
(``state.read_latest``), so a table is never overwritten while it is being
read and a failed job leaves the previous version intact.  Append-only logs
(snapshots, discovered sources) are partitioned by date and appended
idempotently (anti-join on the key first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import state


KEEP_VERSIONS = 3


def _next_version(df: DataFrame, path: str) -> str:
    """The folder after all present ones, whether committed or left by a failed write."""
    present = state.versions(df.sparkSession, path)
    return f"{path.rstrip('/')}/v={present[-1][0] + 1 if present else 0}"


def drop_old_versions(spark, path: str, keep: int = KEEP_VERSIONS) -> None:
    """Delete all but the newest ``keep`` committed versions, and failed ones older than those."""
    found = state.versions(spark, path)
    kept = [n for n, _, done in found if done][-keep:]
    if len(kept) < keep:
        return
    jvm = spark.sparkContext._jvm
    for n, folder, _ in found:
        if n < kept[0]:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_versioned(df: DataFrame, path: str) -> str:
    """Write ``df`` as the next version of the table at ``path``; returns the version folder."""
    target = _next_version(df, path)
    df.write.mode("errorifexists").parquet(target)
    drop_old_versions(df.sparkSession, path)
    return target


def write_partitioned(df: DataFrame, path: str, partition: str) -> str:
    """Write ``df`` replacing only the partitions it holds (dynamic overwrite): idempotent per partition."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return path


def write_digest(articles: DataFrame, path: str, run_date: str, partition: str = "run_date") -> str:
    """Articles table partitioned by run date; re-running a date replaces only that partition."""
    (
        articles.withColumn(partition, F.lit(run_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    return path


def write_digest_json(articles: DataFrame, path: str, run_date: str, partition: str = "run_date") -> str:
    """Digest as JSON lines (one article per line) partitioned by run date.

    The dashboard's single-document file is a presentation format; written
    as one document it would pass every article through one task, so the
    job writes JSON lines from every task instead.
    """
    (
        articles.withColumn(partition, F.lit(run_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .json(path)
    )
    return path


def digest_resource(spark, path: str) -> DataFrame:
    """Whole digest as one JSON string; the empty digest when missing."""
    d = state.scan_digest(spark, path)
    return d.select(F.to_json(F.struct(*d.columns)).alias("value"))


def write_digest_text(lines: DataFrame, path: str) -> str:
    """Append markdown digest lines, in reading order, as the next batch folder under ``path``.

    The sort is range-partitioned, so the part files of a batch hold
    consecutive slices of the order (no task receives the whole digest); the
    digest is the batches in version order, each batch's part files in name
    order (``state.read_text_lines``).
    """
    ordered = lines.orderBy("feed_ord", F.desc_nulls_first("score"), "entry_ord", "line_no")
    target = _next_version(lines, path)
    ordered.select("line").write.mode("errorifexists").text(target)
    return target


def append_snapshot(snapshot: DataFrame, path: str, key: str = "date") -> str:
    """Append rows whose date is not stored yet (idempotent by date), partitioned by date."""
    spark = snapshot.sparkSession
    if state._exists(spark, path):
        have = spark.read.parquet(path).select(key).distinct()
        snapshot = snapshot.join(have, key, "left_anti")
    snapshot.write.mode("append").partitionBy(key).parquet(path)
    return path


def sink_discovered(found: DataFrame, path: str) -> str:
    """Append newly discovered sources; urls stored before are left out, so a repeated run adds nothing."""
    spark = found.sparkSession
    if state._exists(spark, path):
        found = found.join(spark.read.parquet(path).select("url").distinct(), "url", "left_anti").select(*found.columns)
    found.write.mode("append").parquet(path)
    return path


def append_rows(df: DataFrame, path: str) -> str:
    """Append to a versioned table by writing a new version holding old + new rows."""
    prev = state.read_latest(df.sparkSession, path, df.schema)
    return write_versioned(prev.unionByName(df), path)

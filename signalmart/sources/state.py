"""State readers: digest, seen cache, momentum / matrix / recent / history tables.

Missing state is an empty DataFrame of the fixed schema.  A versioned table that is
there but can't be read is an error (``read_latest``); the JSON readers take malformed text
for empty state, as the tracked pipeline does, and read with an explicit schema (no
inference pass).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

ARTICLE_SCHEMA = schemas.ARTICLE
MOMENTUM_SCHEMA = schemas.MOMENTUM
MATRIX_SCHEMA = schemas.MATRIX
SEEN_SCHEMA = schemas.SEEN
DIGEST_SCHEMA = schemas.DIGEST


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(number, folder, committed) of a table's ``v=<n>`` folders, by number; none where the path is missing."""
    if not _exists(spark, path):
        return []
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and name[2:].isdigit():
            found.append((int(name[2:]), st.getPath().toString(), fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))))
    return sorted(found)


def latest_version(spark: SparkSession, path: str) -> str | None:
    """Newest committed ``v=<n>`` folder of a versioned table.

    Where a commit record of the parent folder (``commits``) names the table, its version
    counts; otherwise the newest folder that a job has finished (``sinks.write_versioned``).
    """
    from . import commits

    parent, _, name = path.rstrip("/").rpartition("/")
    named = commits.record(spark, parent).get("tables", {}).get(name)
    if named is not None:
        return f"{path.rstrip('/')}/v={named}"
    committed = [n for n, _, done in versions(spark, path) if done]
    return f"{path.rstrip('/')}/v={committed[-1]}" if committed else None


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Latest committed version of a Parquet state table; empty only where none was ever committed.

    A table that can't be listed or read is an error: taking it for empty would
    make the next write drop the history.
    """
    from . import commits

    if commits.numbers(spark, path.rstrip("/")):
        return commits.read_seen(spark, path)
    v = latest_version(spark, path)
    return empty(spark, schema) if v is None else spark.read.schema(schema).parquet(v)


scan_table = read_latest


def scan_digest(spark: SparkSession, path: str) -> DataFrame:
    """One-document digest JSON -> one row per file; missing or corrupt -> the empty digest row.

    Each file is read whole and parsed with the fixed schema (``from_json`` is
    permissive: malformed text gives null, which becomes the empty digest).
    """
    if not _exists(spark, path):
        return spark.createDataFrame([("", [], None)], DIGEST_SCHEMA)
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", DIGEST_SCHEMA).alias("d"))
    return d.select(
        F.coalesce(F.col("d.date"), F.lit("")).alias("date"),
        F.coalesce(F.col("d.articles"), F.array().cast(DIGEST_SCHEMA["articles"].dataType)).alias("articles"),
        F.col("d.standardization").alias("standardization"),
    )


def digest_articles(digest: DataFrame) -> DataFrame:
    """Articles of a digest as rows, with their list position as ``entry_ord``."""
    return digest.select(F.posexplode("articles").alias("entry_ord", "a")).select("entry_ord", "a.*")


def scan_seen(spark: SparkSession, path: str) -> DataFrame:
    """Map-shaped seen file ``{md5: {url, title, processed_date}}`` -> rows; error -> empty."""
    if not _exists(spark, path):
        return empty(spark, SEEN_SCHEMA)
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,struct<url:string,title:string,processed_date:string>>")
    rows = raw.select(F.explode(m).alias("article_id", "meta"))
    return rows.select("article_id", "meta.url", "meta.title", "meta.processed_date")


def scan_matrix_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested matrix JSON ``{src: {tgt: w}}`` -> long (source, target, weight); wrong type -> empty."""
    if not _exists(spark, path):
        return empty(spark, MATRIX_SCHEMA)
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,map<string,double>>")
    a = raw.select(F.explode(m).alias("source", "row"))
    return a.select("source", F.explode("row").alias("target", "weight"))


def scan_momentum_json(spark: SparkSession, path: str) -> DataFrame:
    """List-of-objects momentum JSON -> rows; a top-level non-list -> empty."""
    if not _exists(spark, path):
        return empty(spark, MOMENTUM_SCHEMA)
    raw = spark.read.text(path, wholetext=True)
    arr = F.from_json("value", T.ArrayType(MOMENTUM_SCHEMA))
    return raw.select(F.explode(arr).alias("m")).select("m.*")


def matrix_as_of(spark: SparkSession, snapshots: str, current, date: str) -> DataFrame:
    """The matrix stored for ``date`` (``sinks.append_snapshot``), else what ``current()`` gives: (source, target, weight, origin).

    Only that date's folder is read, and ``current`` isn't called where it exists.
    """
    if _exists(spark, f"{snapshots.rstrip('/')}/date={date}"):
        rows = spark.read.schema(MATRIX_SCHEMA).parquet(f"{snapshots.rstrip('/')}/date={date}")
        return rows.select("source", "target", "weight", F.lit("snapshot").alias("origin"))
    return current().select("source", "target", "weight", F.lit("current").alias("origin"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the committed batches of a text sink (``sinks.write_digest_text``); empty when nothing was written."""
    done = [folder for _, folder, committed in versions(spark, path) if committed]
    if not done:
        return spark.createDataFrame([], "line string")
    return spark.read.text(done).select(F.col("value").alias("line"))

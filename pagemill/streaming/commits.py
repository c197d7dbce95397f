"""Idempotent output of micro-batches.

Each batch overwrites its own folder per table and then writes its number to a manifest. A batch
that is repeated after a failure replaces what it wrote; readers see only batches that the manifest
names, so the tables of one batch appear together or not at all.

A keyed table further splits a batch by two hex digits of a hash of its key, so a reader
that knows the keys it looks for opens only the folders they can be in.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "_commits"
PREFIX = "key_prefix"


def _batch_path(directory: str, table: str, batch_id: int) -> str:
    return f"{directory}/{table}/batch_id={batch_id}"


def key_prefix(*key: Column | str) -> Column:
    """The folder of a key: h and two hex digits, 256 folders; the letter keeps them text."""
    return F.concat(F.lit("h"), F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 2))


def write_batch(
    tables: dict[str, DataFrame], directory: str, batch_id: int, keyed: dict[str, list[str]] | None = None
) -> None:
    """Write the tables of a batch; ``keyed`` names the key columns of those split by key."""
    for name, frame in tables.items():
        key = (keyed or {}).get(name)
        if key:
            frame = frame.withColumn(PREFIX, key_prefix(*key)).repartition(PREFIX)
        writer = frame.write.mode("overwrite")
        (writer.partitionBy(PREFIX) if key else writer).parquet(_batch_path(directory, name, batch_id))


def commit_batch(spark: SparkSession, directory: str, batch_id: int) -> None:
    spark.range(1).select(F.lit(batch_id).cast("bigint").alias("committed")).write.mode(
        "overwrite"
    ).parquet(_batch_path(directory, _COMMITS, batch_id))


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before anything was written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_committed(
    spark: SparkSession,
    directory: str,
    table: str,
    before: int | None = None,
    prefixes: list[str] | None = None,
    with_batch: bool = False,
) -> DataFrame | None:
    """Rows of ``table`` from committed batches (with a number below ``before``), or None.

    With ``prefixes`` only those folders of a keyed table are opened; ``with_batch`` keeps the number
    of the batch as ``batch_id``.
    """
    commits = read_if_present(spark, f"{directory}/{_COMMITS}")
    rows = read_if_present(spark, f"{directory}/{table}") if commits is not None else None
    if rows is None:
        return None
    # One row per batch: small enough that Spark broadcasts it by its measured size.
    commits = commits.select(F.col("committed").alias("batch_id"))
    if PREFIX in rows.columns:
        if prefixes is not None:
            rows = rows.where(F.col(PREFIX).isin(*prefixes))
        rows = rows.drop(PREFIX)
    rows = rows.withColumn("batch_id", F.col("batch_id").cast("bigint"))
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    rows = rows.join(commits, "batch_id", "left_semi")
    return rows if with_batch else rows.drop("batch_id")


def prefixes_of(keys: DataFrame, *key: str) -> list[str]:
    """The folders that the given keys fall in, at most 256."""
    rows = keys.select(key_prefix(*key).alias("prefix")).distinct().collect()
    return sorted(row["prefix"] for row in rows)


def read_batch(spark: SparkSession, directory: str, table: str, batch_id: int) -> DataFrame:
    """What this batch has just written; reading it back ends the lineage of the work before."""
    return spark.read.parquet(_batch_path(directory, table, batch_id))

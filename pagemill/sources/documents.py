"""Writing documents and events."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.documents import canonical_documents


def distinct_documents(documents: DataFrame) -> DataFrame:
    """One row per distinct canonical body: (digest, prefix, layout, body, page_id of the first)."""
    return (
        canonical_documents(documents)
        .groupBy("digest", "prefix", "layout")
        .agg(F.first("body").alias("body"), F.min("page_id").alias("page_id"))
    )


def write_documents(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Canonical JSON laid out by the first two hex digits of its SHA-256.

    Equal bytes are stored once: appended rows whose digest the folder already holds are left out.
    Rows are spread over the 256 prefixes by digest, so no single writer holds a popular prefix.
    """
    rows = distinct_documents(documents)
    if mode == "append" and (stored := _stored(documents, path)) is not None:
        rows = rows.join(stored, ["prefix", "digest"], "left_anti")
    rows.repartition("prefix", F.substring("digest", 3, 1)).write.mode(mode).partitionBy(
        "prefix"
    ).parquet(path)


def _stored(documents: DataFrame, path: str) -> DataFrame | None:
    """Address of each stored document, or null before the first write."""
    reader = documents.sparkSession.read.schema("digest string, prefix string")
    try:
        return reader.parquet(path).select("prefix", "digest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_events(outbox: DataFrame, path: str, batch_id: int) -> None:
    """Publish one batch. The batch id and message id form the path and key, so repeating a
    batch overwrites the same files: at least once, with a stable key to drop repeats by."""
    outbox.dropDuplicates(["message_id"]).select(
        "message_id", "subject", "payload"
    ).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

"""Content-addressed references: verification and dedup."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import rules

_MEDIA_TYPE = r"^[A-Za-z0-9!#$&^_.+-]+/[A-Za-z0-9!#$&^_.+-]+$"


def stored_blobs(pages: DataFrame) -> DataFrame:
    """(digest_hex, stored_bytes): one row per distinct content, recomputed from the bytes."""
    return (
        pages.select(
            F.sha2("html", 256).alias("digest_hex"),
            F.octet_length("html").cast("bigint").alias("stored_bytes"),
        )
        .groupBy("digest_hex")
        .agg(F.first("stored_bytes").alias("stored_bytes"))
    )


def verify_blobs(refs: DataFrame, stored: DataFrame, owner: str = rules.OWNER_SERVICE) -> DataFrame:
    """Add ``verification``: wrong_owner, unsupported_algorithm, mismatch, missing or ok.

    First failing check wins. ``stored`` has one row per digest, computed from the bytes, so a
    reference that finds its digest has matching content and only its length can still differ. Only
    references that pass the cheap checks look for bytes.
    """
    checkable = (
        (F.col("owner_service") == owner)
        & (F.col("digest_algorithm") == "sha256")
        & F.col("media_type").rlike(_MEDIA_TYPE)
        & (F.col("digest_hex").rlike("^[0-9a-f]{64}$"))
    )
    # References that fail a cheap check join on a key no blob has; a digest-like spread of such
    # keys keeps them from meeting in one task, as nulls would.
    wanted = F.when(checkable, F.col("digest_hex")).otherwise(
        F.concat(F.lit("-"), F.xxhash64(*refs.columns).cast("string"))
    )
    joined = refs.withColumn("_wanted", wanted).join(
        stored.select(F.col("digest_hex").alias("_wanted"), "stored_bytes"), "_wanted", "left"
    )
    verification = (
        F.when(F.coalesce(F.col("owner_service") != owner, F.lit(True)), "wrong_owner")
        .when(F.col("digest_algorithm") != "sha256", "unsupported_algorithm")
        .when(~F.col("media_type").rlike(_MEDIA_TYPE), "mismatch")
        .when(F.col("stored_bytes").isNull(), "missing")
        .when(F.col("stored_bytes") != F.col("length_bytes"), "mismatch")
        .otherwise("ok")
    )
    return joined.withColumn("verification", verification).drop("_wanted", "stored_bytes")


def content_dedup(rows: DataFrame, content: str, key: str) -> DataFrame:
    """(digest_hex, length_bytes, n_observations, first_key): identical bytes share one row.

    Combines before the shuffle, so a body that a third of all rows share costs one row per task.
    """
    return (
        rows.select(
            F.sha2(content, 256).alias("digest_hex"),
            F.octet_length(content).cast("bigint").alias("length_bytes"),
            F.col(key).alias("key"),
        )
        .groupBy("digest_hex", "length_bytes")
        .agg(F.count("*").alias("n_observations"), F.min("key").alias("first_key"))
    )

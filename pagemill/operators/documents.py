"""Documents, their per-block provenance and the content-addressed form in which they are kept."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.operators.quality import candidate_blocks, page_decisions

DOCUMENT_LAYOUT = "document-json-v1"


def documents_of(decisions: DataFrame) -> DataFrame:
    """One document per accepted page. The digest covers the blocks alone, not the title."""
    chosen = F.try_element_at("candidates", F.col("winner") + 1)
    picked = decisions.where(F.col("winner").isNotNull()).withColumn("chosen", chosen)
    return picked.select(
        "page_id",
        "title",
        "language",
        F.col("chosen.strategy").alias("strategy"),
        F.col("chosen.score").alias("score"),
        candidate_blocks(F.col("chosen"), F.col("blocks")).alias("blocks"),
        "source",
    ).withColumn("content_digest", F.sha2(F.to_json("blocks"), 256))


def build_documents(pages: DataFrame, **limits) -> DataFrame:
    return documents_of(page_decisions(pages, **limits))


def source_blobs(pages: DataFrame, owner: str = rules.OWNER_SERVICE) -> DataFrame:
    """The reference of each page's source bytes: owner, digest, media type, exact length."""
    return pages.select(
        "page_id",
        F.lit(owner).alias("owner_service"),
        F.lit("sha256").alias("digest_algorithm"),
        F.sha2("html", 256).alias("digest_hex"),
        F.lit("text/html").alias("media_type"),
        F.octet_length("html").cast("bigint").alias("length_bytes"),
    )


def blobs_of(decisions: DataFrame, owner: str = rules.OWNER_SERVICE) -> DataFrame:
    """``source_blobs`` of the parsed pages, from the digests their page rows carry."""
    return decisions.select(
        "page_id",
        F.lit(owner).alias("owner_service"),
        F.lit("sha256").alias("digest_algorithm"),
        F.col("source.digest_hex").alias("digest_hex"),
        F.lit("text/html").alias("media_type"),
        F.col("source.length_bytes").alias("length_bytes"),
    )


def provenance(documents: DataFrame) -> DataFrame:
    """One row per block naming the strategy and the source blob it came from; a narrow job."""
    return documents.select(
        "page_id", "strategy", F.col("source.digest_hex").alias("blob_digest"), F.posexplode("blocks").alias("block_index", "b")
    ).select("page_id", "block_index", "strategy", "blob_digest")


def with_provenance(documents: DataFrame) -> DataFrame:
    """Documents with ``provenance`` as an array beside ``blocks``, one entry per block."""
    entry = lambda block, index: F.struct(
        index.alias("block_index"),
        F.col("strategy").alias("strategy"),
        F.col("source.digest_hex").alias("blob_digest"),
    )
    return documents.withColumn("provenance", F.transform("blocks", entry))


def canonical_documents(documents: DataFrame) -> DataFrame:
    """(page_id, digest, prefix, layout, body): the JSON form of each document and its address.

    Struct fields are in alphabetical order and the layout is named, so equal documents give equal
    bytes on every run.
    """
    body = F.to_json(F.struct("blocks", "content_digest", "language", "strategy", "title"))
    return documents.select(
        "page_id", F.lit(DOCUMENT_LAYOUT).alias("layout"), body.alias("body")
    ).withColumn("digest", F.sha2("body", 256)).withColumn(
        "prefix", F.substring("digest", 1, 2)
    )

"""Reading pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html). Binary bodies become text with each invalid byte replaced."""
    pages = spark.read.parquet(path)
    if dict(pages.dtypes)["html"] == "binary":
        pages = pages.withColumn("html", F.make_valid_utf8(F.col("html").cast("string")))
    return pages.select("page_id", "url", "html")


def scan_pages(spark: SparkSession, directory: str) -> DataFrame:
    return read_pages(spark, f"{directory}/pages.parquet")


def write_bucketed(pages: DataFrame, name: str, buckets: int, path: str) -> DataFrame:
    """Store pages as table ``name`` at ``path``, clustered on ``page_id``, and return the table.

    The pages are shuffled once, here; every extraction job with ``partitioned=True`` then runs without
    an exchange. Each bucket is one file per writing task, so the rows are dealt by bucket first.
    """
    spark = pages.sparkSession
    dealt = pages.repartition(buckets, "page_id")
    dealt.write.bucketBy(buckets, "page_id").sortBy("page_id").option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name).select("page_id", "url", "html")

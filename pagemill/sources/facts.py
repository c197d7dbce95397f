"""Fact tables: fixed-schema reads, idempotent merges and writes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.schemas import FACTS


def scan_facts(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the seven fact tables with its fixed schema; nothing is inferred."""
    return spark.read.schema(FACTS[name]).parquet(f"{directory}/{name}")


def conform(frame: DataFrame, name: str) -> DataFrame:
    """The columns of fact table ``name`` in order and type; absent ones are null."""
    target = frame.sparkSession.createDataFrame([], FACTS[name]).schema
    return frame.select(
        *(
            (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target
        )
    )


def write_facts(frame: DataFrame, directory: str, name: str, mode: str = "append") -> None:
    conform(frame, name).write.mode(mode).parquet(f"{directory}/{name}")


def upsert_facts(
    existing: DataFrame,
    incoming: DataFrame,
    key: list[str],
    keep_first: list[str],
    order: list[str],
) -> DataFrame:
    """Merge by ``key``: ``keep_first`` columns keep their first value, others take the last.

    Existing rows precede incoming ones; ``order`` ranks rows within each side. One combining
    aggregation, no window, so a key written very many times is reduced before the shuffle.
    """
    columns = existing.columns
    last = [c for c in columns if c not in key and c not in keep_first]
    ranked = existing.withColumn("_side", F.lit(0)).unionByName(
        incoming.withColumn("_side", F.lit(1))
    )
    rank = F.struct("_side", *order)
    merged = ranked.groupBy(*key).agg(
        F.min_by(F.struct(*keep_first), rank).alias("_first"),
        F.max_by(F.struct(*last), rank).alias("_last"),
    )
    return merged.select(
        *(
            F.col(c) if c in key else F.col(f"_first.{c}" if c in keep_first else f"_last.{c}").alias(c)
            for c in columns
        )
    )

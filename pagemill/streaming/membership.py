"""Which keys of a batch earlier batches hold, without reading those batches.

Every batch leaves a Bloom filter for each of its 256 key folders beside the keys themselves. A new
key is looked up in the filters first; only the folders in which a filter says "maybe" are opened for
the exact anti join. A batch of new keys therefore opens next to nothing, however long the history
is. A false "maybe" opens a folder and costs time, never a result.

A filter is a set of rows (folder, word, bits), made by one combining ``bit_or`` and joined on
(folder, word), so no filter passes through the driver; what does is the list of folders to open.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.streaming.commits import PREFIX, key_prefix, read_if_present

FILTERS = "_filters"
#: Words of 64 bits per folder of a batch: ten bits a key for batches of about 1.7 million keys.
WORDS = 1024
PROBES = 4


def _probes(key: Column) -> Column:
    """The words and bits that stand for a key."""
    spots = [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(WORDS * 64)) for seed in range(PROBES)]
    return F.array(
        *(
            F.struct(
                F.shiftright(spot, 6).cast("int").alias("word"), (spot % 64).cast("int").alias("bit")
            )
            for spot in spots
        )
    )


def _spread(keys: DataFrame, key: str) -> DataFrame:
    """(key, key_prefix, word, bits): one row per key and probe."""
    rows = keys.select(F.col(key).alias("key"), key_prefix(key).alias(PREFIX), F.explode(_probes(F.col(key))).alias("probe"))
    return rows.select("key", PREFIX, "probe.word", F.expr("shiftleft(1L, probe.bit)").alias("bits"))


def filters_of(keys: DataFrame, key: str) -> DataFrame:
    """The filters of one batch: (key_prefix, word, bits)."""
    return _spread(keys, key).groupBy(PREFIX, "word").agg(F.bit_or("bits").alias("bits"))


def folders_to_open(spark: SparkSession, keys: DataFrame, key: str, directory: str, table: str, before: int) -> list[tuple[int, str]]:
    """(batch, folder) pairs of ``table`` that may hold one of the keys."""
    filters = read_if_present(spark, f"{directory}/{table}{FILTERS}")
    commits = read_if_present(spark, f"{directory}/_commits")
    if filters is None or commits is None:
        return []
    filters = filters.withColumn("batch_id", F.col("batch_id").cast("bigint")).where(F.col("batch_id") < before)
    filters = filters.join(commits.select(F.col("committed").alias("batch_id")), "batch_id", "left_semi")
    asked = _spread(keys, key).groupBy("key", PREFIX, "word").agg(F.bit_or("bits").alias("wanted"))
    n_words = asked.groupBy("key").agg(F.count("*").alias("words"))
    hits = asked.join(filters, [PREFIX, "word"]).where(F.col("bits").bitwiseAND(F.col("wanted")) == F.col("wanted"))
    maybe = hits.groupBy("key", PREFIX, "batch_id").agg(F.count("*").alias("hit")).join(n_words, "key")
    found = maybe.where(F.col("hit") == F.col("words")).select("batch_id", PREFIX).distinct().collect()
    return sorted((row["batch_id"], row[PREFIX]) for row in found)


def known_keys(spark: SparkSession, keys: DataFrame, key: str, directory: str, table: str, before: int) -> DataFrame | None:
    """The keys in the folders of committed earlier batches that may hold some of ``keys``, or None if
    no folder can. Folders are opened by path, so nothing else is even listed."""
    folders = folders_to_open(spark, keys, key, directory, table, before)
    if not folders:
        return None
    paths = [f"{directory}/{table}/batch_id={batch}/{PREFIX}={prefix}" for batch, prefix in folders]
    return spark.read.parquet(*paths).select(key)

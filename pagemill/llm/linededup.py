"""Line dedup: lines found in many documents leave all of them.

Normalised lines are exploded to two 64-bit hashes, distinct documents are counted per hash, and the
positions of the frequent ones go back to their document. A thin table of line hashes is written
once; text is shuffled once, by document.

Defined results: null or empty text is one empty line, which has no key and stays; a document is a
row with its id and text, so exact repeats of a row count once and are cut alike; an empty table
gives an empty table; other columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.store import work_folder, written
from pagemill.llm.text import LOWER, UPPER, boxed, text_of

MIN_CHARS = 1
MIN_DOCUMENTS = 10
SALTS = 16


def line_key(line: Column) -> Column:
    """Line without white space at its ends; letters were folded before."""
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    frame = boxed(docs, text=text_of(), id=F.col(key))
    return frame.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(1), "id", "text")})


def line_hashes(docs: DataFrame, key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line with a key: document (k1, k2), position, line hash (h1, h2)."""
    folded = F.split(F.translate("text", UPPER, LOWER), "\n")
    lines = _keyed(docs, key).select("k1", "k2", F.posexplode(folded).alias("pos", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= max(1, min_chars))
    return lines.select("k1", "k2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def drop_lines(docs: DataFrame, key: str = "doc_id", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Every row as ``row`` with ``kept_text``, ``n_lines`` and ``n_dropped``."""
    hashes = written(line_hashes(docs, key, min_chars), f"{work_folder(docs.sparkSession)}/lines")
    frequent = hashes.groupBy("h1", "h2").agg(F.count_distinct("k1", "k2").alias("n")).filter(F.col("n") >= min_documents).select("h1", "h2")
    # The places of a line that very many documents hold are dealt over salts; the few frequent lines stand in each.
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64("k1", "pos"), F.lit(SALTS)).cast("int"))
    frequent = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = salted.join(frequent, ["h1", "h2", "salt"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("pos").alias("cut"))
    frame = _keyed(docs, key).join(places, ["k1", "k2"], "left").withColumn("lines", F.split("text", "\n"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.array_except(every, F.coalesce("cut", F.array().cast("array<int>")))
    frame = frame.withColumn("stay", stay)
    return frame.select(
        "row",
        F.array_join(F.transform("stay", lambda p: F.get("lines", p)), "\n").alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
    )

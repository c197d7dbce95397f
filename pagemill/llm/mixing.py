"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has an exponential key -ln(u) / quality, u drawn from a hash of its id, so reruns
agree. A source whose target is e whole epochs and a rest takes every document e times, then the
documents of smallest key until the rest is met. Prefix sums need no full sort: keys fall into bins of
their own range, sums per bin find the one bin where the rest ends, that bin is cut again until it is
small, and only then is it ordered.

Defined results: null text has size 0 and quality 1; a null source is a source of its own, last in
order; a source of no words has target 0; rows with one id and equal text move together; an empty
table gives an empty table; other columns are carried, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.plan import once
from pagemill.llm.store import work_folder, written
from pagemill.llm.text import WORD, boxed, text_of, unboxed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
ROWS_PER_BIN = 20_000
BINS = 256


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (number + 1.0) / F.lit(float(2**52 + 1))


def quality(text: Column) -> Column:
    """Share of distinct lines: repetitive documents are drawn less often."""
    lines = F.split(text, "\n")
    return F.size(F.array_distinct(lines)).cast("double") / F.size(lines).cast("double")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Every row as ``row`` with its source, size and sampling key."""
    frame = boxed(docs, source=F.col("source"), id=F.col("doc_id"), text=text_of())
    frame = frame.withColumns({"size": F.regexp_count("text", F.lit(WORD)).cast("long"), "quality": quality(F.col("text"))})
    frame = frame.withColumn("key", -F.log(uniform(F.col("id"), seed)) / F.col("quality"))
    return frame.select("row", F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "id", "size", "key")


def targets(thin: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: its size and its target. Sources below the level take it times their
    weight, the others stop at their cap; the level is where the targets add up to the whole.
    The frame holds a row per source, so its windows stay small."""
    groups = thin.groupBy("none", "source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy("none", "source")) - 1) % len(weights)
    groups = groups.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place).cast("long")).withColumn("limit", cap * F.col("source_size"))
    order = Window.orderBy(F.col("limit").cast("double") / F.col("weight"), "none", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.lit(share) * F.sum("source_size").over(every).cast("double")
    groups = groups.withColumns(
        {
            "level": (total - F.coalesce(F.sum("limit").over(before), F.lit(0)).cast("double"))
            / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"),
        }
    )
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    groups = groups.withColumn("water", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("limit").cast("double")))
    return groups.select("none", "source", "source_size", target.alias("target"))


def edges(thin: DataFrame, plan: DataFrame, folder: str, rows: int = ROWS_PER_BIN) -> DataFrame:
    """For each source with a rest the range of keys in which it ends: lo, hi, words before it, rows in it.

    A range of more than ``rows`` rows is cut into ``BINS`` by its own least and greatest key, and the
    one bin where the rest ends is the next range, so ranges follow the keys however they are spread.
    Each round is one aggregation; one number a round reaches the driver. Rows of one key stay together.
    """
    by_source = ["none", "source"]
    spans = thin.groupBy(*by_source).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))
    found = plan.filter("rest > 0").join(spans, by_source).select(*by_source, "rest", "lo", "hi", "n", F.lit(0).cast("long").alias("before"))
    for turn in itertools.count():
        found = written(found, f"{folder}/edges{turn}")
        wide = (F.col("n") > rows) & (F.col("lo") < F.col("hi"))
        if found.filter(wide).isEmpty():
            return found
        inside = thin.join(found.filter(wide).drop("n"), by_source).filter(F.col("key").between(F.col("lo"), F.col("hi")))
        place = F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)
        sums = inside.groupBy(*by_source, "rest", "before", F.least(F.lit(BINS - 1), place).alias("bin")).agg(
            F.sum("size").alias("in_bin"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")
        )
        upto = F.sum("in_bin").over(Window.partitionBy(*by_source).orderBy("bin"))
        sums = sums.withColumn("before", F.col("before") + upto - F.col("in_bin"))
        here = sums.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("in_bin")))
        found = here.select(*found.columns).unionByName(found.filter(~wide))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, rows: int = ROWS_PER_BIN) -> DataFrame:
    """Every row as ``row`` with ``size``, ``source_size``, ``target`` and ``times`` it is taken."""
    frame = sized(docs, seed)
    folder = work_folder(docs.sparkSession)
    thin = written(frame.drop("row"), f"{folder}/sizes")
    plan = written(targets(thin, weights, share, cap), f"{folder}/targets")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    by_source = ["none", "source"]
    edge = edges(thin, plan, folder, rows)
    run = F.sum("size").over(Window.partitionBy(*by_source).orderBy("key", "id"))
    ordered = thin.join(edge, by_source).filter(F.col("key").between(F.col("lo"), F.col("hi"))).withColumn("run", run)
    inside = ordered.filter(F.col("before") + F.col("run") - F.col("size") / 2 <= F.col("rest"))
    last = inside.groupBy(*by_source).agg(F.max(F.struct("key", "id")).alias("last"))
    plan = plan.join(edge.select(*by_source, "lo", "hi"), by_source, "left").join(last, by_source, "left")
    plan = written(plan.select(*by_source, "source_size", "target", "epochs", "lo", "hi", "last"), f"{folder}/plan")
    drawn = F.coalesce((F.col("key") < F.col("lo")) | ((F.col("key") <= F.col("hi")) & (F.struct("key", "id") <= F.col("last"))), F.lit(False))
    return frame.join(plan, by_source).select("row", "size", "source_size", "target", (F.col("epochs") + drawn.cast("int")).alias("times"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows taken twice stand twice, rows not taken are left out."""
    taken = once(mix(docs, **options), ["row"], [F.col("times")]).filter("times > 0")
    return unboxed(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))), docs.columns)

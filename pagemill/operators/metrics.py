"""Outcome counts and distributions. Every one combines before its shuffle; none carries a URL."""

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import rules


def command_outcomes(commands: DataFrame) -> DataFrame:
    """A1: deliveries by outcome (applied, duplicate, rejected, failed)."""
    return commands.groupBy("outcome").agg(F.count("*").alias("n"))


def run_outcome_counts(runs: DataFrame) -> DataFrame:
    """A2: runs by status and error class."""
    return runs.groupBy("status", "last_error_class").agg(F.count("*").alias("n"))


def fetch_totals(fetches: DataFrame) -> DataFrame:
    """A3: (cache_outcome, representation, n, bytes), representation wire or decoded."""
    totals = fetches.groupBy("cache_outcome").agg(
        F.count("*").alias("n"),
        F.sum("wire_bytes").alias("wire"),
        F.sum("decoded_bytes").alias("decoded"),
    )
    return totals.unpivot(["cache_outcome", "n"], ["wire", "decoded"], "representation", "bytes")


def duration_histogram(fetches: DataFrame, seconds: str = "duration_s") -> DataFrame:
    """A4: cumulative counts (le, n), with +Inf last.

    Each duration is counted once, in its own bucket; cumulating happens over the dozen totals.
    """
    bounds = rules.DURATION_BUCKETS
    own = F.lit(len(bounds))
    for place, bound in reversed(list(enumerate(bounds))):
        own = F.when(F.col(seconds) <= bound, place).otherwise(own)
    counted = fetches.groupBy(own.alias("place")).agg(F.count("*").alias("n"))
    labels = [f"{bound:g}" for bound in bounds] + ["+Inf"]
    names = F.create_map(*chain.from_iterable((F.lit(i), F.lit(v)) for i, v in enumerate(labels)))
    reached = counted.select(F.explode(F.sequence("place", F.lit(len(bounds)))).alias("place"), "n")
    empty = fetches.sparkSession.range(len(labels)).select(
        F.col("id").cast("int").alias("place"), F.lit(0).cast("bigint").alias("n")
    )
    return (
        reached.unionByName(empty)
        .groupBy("place")
        .agg(F.sum("n").alias("n"))
        .select(names[F.col("place")].alias("le"), "n")
    )


def fetch_failures(fetches: DataFrame) -> DataFrame:
    """A5: failed fetches by bounded class, ``other`` for failures outside the list; the output has
    no URL, host or address."""
    (failure, name), *rest = rules.FAILURE_CLASSES
    bounded = F.when(F.col("failure") == failure, name)
    for failure, name in rest:
        bounded = bounded.when(F.col("failure") == failure, name)
    return (
        fetches.where(F.col("failure").isNotNull())
        .groupBy(bounded.otherwise("other").alias("failure_class"))
        .agg(F.count("*").alias("n"))
    )


def run_counts(candidates: DataFrame, key: str = "run_id") -> DataFrame:
    """Candidates, selected and scored per run."""
    return candidates.groupBy(key).agg(
        F.count("*").alias("candidates"),
        F.count_if("selected").alias("selected"),
        F.count("score").alias("scored"),
    )


def validate_candidate_sets(candidates: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, state): ok, or invalid_run_state unless a run has three decisions of which one is
    selected (succeeded) or none (failed)."""
    wanted = F.when(F.col("status") == "succeeded", 1).otherwise(0)
    ok = (F.col("candidates") == 3) & (F.col("selected") == wanted)
    # A run without any decision has no counts, which is not ok either.
    return runs.select(key, "status").join(run_counts(candidates, key), key, "left").select(
        key, F.when(ok, "ok").otherwise("invalid_run_state").alias("state")
    )

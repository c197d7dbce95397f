"""The terminal commit: everything that a set of processed runs leaves, visible together or not at all.

One manifest entry covers the ended runs, their fetches, artifacts, candidate decisions and events, and
what became of each call. A commit that is repeated under its number replaces what it wrote; a run that
an earlier commit ended is a duplicate and leaves nothing more. Earlier ends are found through the
filters of ``streaming.membership``, so a commit does not reread the runs before it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.documents import blobs_of, documents_of
from pagemill.operators.ledger import run_outcomes, terminal_facts
from pagemill.operators.quality import candidate_rows, page_decisions, refused_pages
from pagemill.streaming.commits import commit_batch, read_batch, write_batch
from pagemill.streaming.membership import FILTERS, filters_of, known_keys

#: Tables of one terminal commit.
TABLES = ("runs", "fetches", "artifacts", "candidates", "outbox", "completions")


def judge_calls(work: DataFrame, ended: DataFrame | None = None) -> DataFrame:
    """Each distinct call with ``completion`` (applied, duplicate or invalid_run_state) and ``n_calls``.

    ``work`` has the run columns with their ``status`` and ``completed_at``; ``ended`` (run_id) holds
    runs that earlier commits ended. Only running runs may end, and the first call of a run wins. Equal
    calls are counted before anything else, so a call repeated very often is one row.
    """
    calls = work.groupBy(*work.columns).agg(F.count("*").alias("n_calls"))
    rank = F.struct(F.col("completed_at"), F.sha2(F.to_json(F.struct(*work.columns)), 256))
    ranked = calls.withColumn("_rank", rank)
    ranked = ranked.join(ranked.groupBy("run_id").agg(F.min("_rank").alias("_first")), "run_id")
    over = F.col("status").isin("succeeded", "failed")
    if ended is not None:
        known = ended.select("run_id", F.lit(True).alias("_ended")).distinct()
        ranked = ranked.join(known, "run_id", "left")
        over = over | F.col("_ended").isNotNull()
    completion = (
        F.when(over, "duplicate")
        .when(F.coalesce(F.col("status") != "running", F.lit(True)), "invalid_run_state")
        .when(F.col("_rank") > F.col("_first"), "duplicate")
        .otherwise("applied")
    )
    return ranked.withColumn("completion", completion).select(*work.columns, "completion", "n_calls")


def ended_work(applied: DataFrame, decisions: DataFrame, refused: DataFrame) -> DataFrame:
    """Applied calls with their final ``status``, ``error_class`` and ``retryable``.

    A page that was neither decided nor refused was not stored: its run ends with ``artifact``.
    """
    decided = decisions.select("page_id", "winner", F.lit(True).alias("_decided"))
    parse = refused.select("page_id", F.col("outcome").alias("parse_failure"))
    joined = applied.drop("status").join(decided, "page_id", "left").join(parse, "page_id", "left")
    stored = F.col("_decided").isNotNull() | F.col("parse_failure").isNotNull()
    joined = joined.withColumn("verification", F.when(stored, "ok").otherwise("missing"))
    return run_outcomes(joined).drop("_decided", "winner", "parse_failure", "verification")


def ended_runs(finished: DataFrame) -> DataFrame:
    """L5 and its like: run rows after their end, the lease cleared, the error class of 1..64 letters."""
    return finished.select(
        "run_id", "command_id", "operation_id", "owner_id", "correlation_id", "document_id", "page_id",
        "status", "completed_at", F.substring("error_class", 1, 64).alias("last_error_class"), "retryable",
        F.lit(None).cast("timestamp").alias("claimed_until"), F.lit(None).cast("string").alias("claimed_by"),
    )


def terminal_tables(applied: DataFrame, pages: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """All tables of a terminal commit but ``completions``.

    ``applied`` has run columns, page_id, fetch columns, ``fetch_failure`` and ``completed_at``;
    ``pages`` the stored bodies by page_id and ``decisions`` their page-level rows.
    """
    finished = ended_work(applied, decisions, refused_pages(pages))
    facts = terminal_facts(finished, candidate_rows(decisions), documents_of(decisions), blobs_of(decisions))
    return {"runs": ended_runs(finished), **facts}


def commit_terminal(
    spark: SparkSession, directory: str, commit_id: int, work: DataFrame, pages: DataFrame
) -> None:
    """End the runs of ``work`` as one unit.

    The calls and the decisions of their pages are written first and read back; every fact table is made
    from them, and the manifest entry that makes all of them visible is the last write.
    """
    asked = work.select("run_id").distinct()
    ended = known_keys(spark, asked, "run_id", directory, "runs", commit_id)
    write_batch({"calls": judge_calls(work, ended)}, directory, commit_id)
    calls = read_batch(spark, directory, "calls", commit_id)
    applied = calls.where(F.col("completion") == "applied").drop("completion", "n_calls")
    wanted = pages.join(applied.select("page_id").distinct(), "page_id", "left_semi")
    write_batch({"decisions": page_decisions(wanted)}, directory, commit_id)
    tables = terminal_tables(applied, wanted, read_batch(spark, directory, "decisions", commit_id))
    tables["completions"] = calls.select("run_id", "completed_at", "completion", "n_calls")
    tables[f"runs{FILTERS}"] = filters_of(applied.select("run_id"), "run_id")
    write_batch(tables, directory, commit_id, keyed={"runs": ["run_id"]})
    commit_batch(spark, directory, commit_id)

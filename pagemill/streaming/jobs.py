"""Streaming forms of the batch jobs. Each micro-batch runs the same functions as the batch job."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill import rules
from pagemill.operators.documents import documents_of
from pagemill.operators.ledger import (
    accepted_commands, current_sources, intake_routed, route_commands,
)
from pagemill.operators.outbox import changed_rows, due_outbox
from pagemill.operators.quality import (
    candidate_rows, decided_pages, low_quality, page_decisions, refused_pages,
)
from pagemill.sources.commands import decode_commands, split_commands
from pagemill.sources.documents import write_events
from pagemill.streaming.commits import (
    PREFIX, commit_batch, prefixes_of, read_batch, read_committed, write_batch,
)
from pagemill.streaming.membership import FILTERS, filters_of, known_keys
from pagemill.streaming.terminal import commit_terminal


def _start(stream: DataFrame, handler: Callable, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def intake_stream(
    deliveries: DataFrame, directory: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Apply each command once however often it is delivered, and keep one source per (owner, URL).

    Ids applied in earlier batches are found through filters, and only the folders in which a filter
    says "maybe" are opened; of the sources only the folders of this batch's keys are read.
    ``ledger.current_sources`` folds what batches wrote to one row per key.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commands, malformed = split_commands(decode_commands(batch))
        rejects = malformed.select("delivery_id", "command_id", "reject_reason")
        write_batch({"routed": route_commands(commands), "malformed": rejects}, directory, batch_id)
        routed = read_batch(spark, directory, "routed", batch_id)
        accepted = accepted_commands(routed)
        known = known_keys(spark, accepted.select("command_id"), "command_id", directory, "inbox", batch_id)
        named = accepted.select("owner_id", F.col("normalized").alias("normalized_url"))
        folders = prefixes_of(named, "owner_id", "normalized_url")
        written = read_committed(spark, directory, "sources", batch_id, folders, with_batch=True)
        facts = intake_routed(routed, known, None if written is None else current_sources(written))
        facts["rejects"] = facts["rejects"].unionByName(
            read_batch(spark, directory, "malformed", batch_id)
        )
        facts[f"inbox{FILTERS}"] = filters_of(facts["inbox"].select("command_id"), "command_id")
        keyed = {"inbox": ["command_id"], "sources": ["owner_id", "normalized_url"]}
        write_batch(facts, directory, batch_id, keyed)
        commit_batch(spark, directory, batch_id)

    return _start(deliveries, handle, checkpoint, once)


def completion_stream(
    work: DataFrame, pages: DataFrame, directory: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """X3 with its facts: processed runs in; each batch ends its runs by one terminal commit.

    ``pages`` is the table of stored bodies that the runs name by page_id.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        commit_terminal(batch.sparkSession, directory, batch_id, batch, pages)

    return _start(work, handle, checkpoint, once)


def distinct_messages(messages: DataFrame, at: str = "at") -> DataFrame:
    """Drop repeats of a message id inside the broker's duplicate window; state is bounded."""
    timed = messages.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, rules.DUPLICATE_WINDOW).dropDuplicatesWithinWatermark(
        ["message_id"]
    )


def extraction_stream(
    pages: DataFrame, directory: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Pages in; documents, candidate decisions, rejects and one outcome per page out, one commit
    per batch.

    Decisions are written first and read back, so the three outputs share one pass over the pages.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch({"decisions": page_decisions(batch)}, directory, batch_id)
        decisions = read_batch(spark, directory, "decisions", batch_id)
        outputs = {
            "documents": documents_of(decisions),
            "candidates": candidate_rows(decisions),
            "rejects": low_quality(decisions),
            "outcomes": decided_pages(decisions).unionByName(refused_pages(batch)),
        }
        write_batch(outputs, directory, batch_id)
        commit_batch(spark, directory, batch_id)

    return _start(pages, handle, checkpoint, once)


def run_states(
    events: DataFrame, now: Column, lease_seconds: int = rules.RUN_LEASE_SECONDS
) -> DataFrame:
    """State of each run, folded from its event log, as of ``now``.

    ``events`` has (run_id, at, event): queued, claimed, succeeded or failed. The first terminal
    event after a claim wins; the first start is kept; a lease that has run out makes a running run
    eligible again until its claims reach the delivery limit. Combines before the shuffle.
    """
    is_event = lambda *names: F.col("event").isin(*names)
    past = events.where(F.col("at") <= now)
    folded = past.groupBy("run_id").agg(
        F.min(F.when(is_event("queued"), F.col("at"))).alias("queued_at"),
        F.min(F.when(is_event("claimed"), F.col("at"))).alias("started_at"),
        F.max(F.when(is_event("claimed"), F.col("at"))).alias("last_claim"),
        F.count_if(is_event("claimed")).alias("deliveries"),
    )
    # An end counts only after the first claim: the side with the claims has one row per run.
    ends = (
        past.where(is_event("succeeded", "failed"))
        .join(folded.select("run_id", "started_at"), "run_id")
        .where(F.col("at") >= F.col("started_at"))
        .groupBy("run_id")
        .agg(F.min(F.struct("at", "event")).alias("end"))
    )
    folded = folded.join(ends, "run_id", "left")
    ended = F.col("started_at").isNotNull() & F.col("end").isNotNull()
    held = F.col("last_claim") + F.make_dt_interval(secs=F.lit(lease_seconds)) > now
    status = (
        F.when(ended, F.col("end.event"))
        .when(F.col("started_at").isNotNull(), "running")
        .otherwise("queued")
    )
    eligible = (
        ~ended
        & ~F.coalesce(held, F.lit(False))
        & (F.col("deliveries") < rules.MAX_DELIVERIES)
    )
    return folded.select(
        "run_id", status.alias("status"), "queued_at", "started_at",
        F.when(ended, F.col("end.at")).alias("completed_at"), "deliveries",
        eligible.alias("eligible"),
    )


def run_state_stream(
    events: DataFrame, directory: str, checkpoint: str, now: Column, once: bool = True
) -> StreamingQuery:
    """X4 as a stream: every batch appends its events and rewrites the states of the runs it saw.

    Only runs named in the batch are folded again, and of the event log only the folders that these
    runs fall in are opened.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch({"events": batch}, directory, batch_id, {"events": ["run_id"]})
        fresh = read_batch(spark, directory, "events", batch_id).drop(PREFIX)
        folders = prefixes_of(fresh, "run_id")
        earlier = read_committed(spark, directory, "events", batch_id, folders)
        log = fresh
        if earlier is not None:
            touched = fresh.select("run_id").distinct()
            log = fresh.unionByName(earlier.join(touched, "run_id", "left_semi"))
        states = run_states(log, now).withColumn("as_of_batch", F.lit(batch_id).cast("bigint"))
        write_batch({"states": states}, directory, batch_id)
        commit_batch(spark, directory, batch_id)

    return _start(events, handle, checkpoint, once)


def latest_states(states: DataFrame) -> DataFrame:
    """The newest state of each run over all batches."""
    columns = [c for c in states.columns if c not in ("run_id", "as_of_batch")]
    return states.groupBy("run_id").agg(
        F.max_by(F.struct(*columns), "as_of_batch").alias("s")
    ).select("run_id", "s.*")


def publish_all(due: DataFrame) -> DataFrame:
    """Results of a sink that accepts every row it was given."""
    return due.select(
        "outbox_id", F.lit(True).alias("published"), F.lit(None).cast("string").alias("error")
    )


def outbox_pass(
    outbox: DataFrame,
    sink: str,
    pass_id: int,
    now: Column,
    results_of: Callable[[DataFrame], DataFrame] = publish_all,
    limit: int | None = rules.OUTBOX_BATCH,
) -> DataFrame:
    """Publish one pass of due rows and return those rows as they are after it.

    Only changed rows come back, with ``pass_id``: store them beside the outbox and read the newest of
    each with ``outbox.current_rows``, so what a pass writes follows the pass. The pass number names
    the sink folder, so repeating a pass rewrites the same messages. ``results_of`` says which of the
    due rows the sink accepted.
    """
    due = due_outbox(outbox, now, limit)
    results = results_of(due)
    accepted = due.join(results.where("published").select("outbox_id"), "outbox_id", "left_semi")
    write_events(accepted, sink, pass_id)
    return changed_rows(due, results, now).withColumn("pass_id", F.lit(pass_id).cast("bigint"))

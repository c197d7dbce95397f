"""The run ledger: commands, sources, runs, terminal facts and events, each applied once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.operators.urls import canonicalize_urls, classify_sources
from pagemill.sources.facts import upsert_facts

_DELIVERY_ORDER = ["received_at", "delivery_id"]


def stable_id(kind: str, *parts: Column | str) -> Column:
    """A repeatable identifier: SHA-256 of its kind and natural key."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *parts), 256)


# --- Delivery dedup -------------------------------------------------------------------------
def first_deliveries(deliveries: DataFrame) -> DataFrame:
    """The first delivery of each command.

    Catalyst turns the rank filter into a group limit below the shuffle, so each task sends at most
    one delivery per command however often a command was repeated.
    """
    order = Window.partitionBy("command_id").orderBy(*_DELIVERY_ORDER)
    return (
        deliveries.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def mark_duplicates(deliveries: DataFrame, salts: int = 32) -> DataFrame:
    """W1 for every delivery: ``outcome`` applied for the first of its command, else duplicate.

    Two passes: within (command, salt) all but the first are duplicates at once; only the first of
    each salt meets the others of its command. A command that a third of all deliveries repeat is
    thereby spread over ``salts`` groups.
    """
    salted = deliveries.withColumn("_salt", F.pmod(F.xxhash64("delivery_id"), F.lit(salts)))
    near = Window.partitionBy("command_id", "_salt").orderBy(*_DELIVERY_ORDER)
    far = Window.partitionBy("command_id").orderBy(*_DELIVERY_ORDER)
    ranked = salted.withColumn("_near", F.row_number().over(near))
    repeats = ranked.where(F.col("_near") > 1).withColumn("outcome", F.lit("duplicate"))
    leaders = ranked.where(F.col("_near") == 1).withColumn(
        "outcome",
        F.when(F.row_number().over(far) == 1, "applied").otherwise("duplicate"),
    )
    return leaders.unionByName(repeats).drop("_salt", "_near")


# --- Intake ---------------------------------------------------------------------------------
def route_commands(commands: DataFrame) -> DataFrame:
    """Add the canonical URL parts, route and reject_reason to decoded commands."""
    return classify_sources(canonicalize_urls(commands))


def upsert_sources(existing: DataFrame | None, routed: DataFrame) -> DataFrame:
    """One source per (owner_id, normalized_url): the first row stays, canonical_url refreshes."""
    key = ["owner_id", "normalized_url"]
    incoming = routed.select(
        stable_id("source", "owner_id", "normalized").alias("source_id"),
        "owner_id",
        F.col("original").alias("original_url"),
        F.col("normalized").alias("normalized_url"),
        F.col("normalized").alias("canonical_url"),
        "host",
        F.col("route").alias("classification"),
        F.col("received_at").alias("created_at"),
        "delivery_id",
    )
    if existing is None:
        existing = incoming.limit(0)
    else:
        existing = existing.withColumn("delivery_id", F.lit(None).cast("bigint"))
        # Of the rows kept so far only those that these commands name can change.
        touched = incoming.select(*key).distinct()
        existing = existing.join(touched, key, "left_semi")
    keep = [c for c in incoming.columns if c not in (*key, "canonical_url")]
    return upsert_facts(existing, incoming, key, keep, ["created_at", "delivery_id"]).drop(
        "delivery_id"
    )


def current_sources(written: DataFrame) -> DataFrame:
    """One row per (owner, URL) of all source rows that batches wrote: the last batch's row, which
    holds the first row's columns and the last canonical URL. ``written`` has ``batch_id``."""
    columns = [c for c in written.columns if c not in ("owner_id", "normalized_url", "batch_id")]
    newest = F.max_by(F.struct(*columns), "batch_id").alias("newest")
    return written.groupBy("owner_id", "normalized_url").agg(newest).select(
        "owner_id", "normalized_url", "newest.*"
    )


def accepted_commands(routed: DataFrame) -> DataFrame:
    """The first delivery of each routed command that the URL policy lets through."""
    return first_deliveries(routed.where(F.col("reject_reason").isNull()))


def intake(
    commands: DataFrame, known: DataFrame | None = None, sources: DataFrame | None = None
) -> dict[str, DataFrame]:
    """L1: inbox, sources, runs, queued reports and rejects of decoded commands.

    Each new command makes one run with a document id fixed here. A URL the policy refuses rejects
    the command before it can claim its id. ``known`` (command_id) holds ids applied earlier and
    ``sources`` the source rows kept so far that these commands may meet.
    """
    return intake_routed(route_commands(commands), known, sources)


def intake_routed(
    routed: DataFrame, known: DataFrame | None = None, sources: DataFrame | None = None
) -> dict[str, DataFrame]:
    """``intake`` of commands that ``route_commands`` has seen."""
    rejected = F.col("reject_reason").isNotNull()
    accepted = accepted_commands(routed)
    if known is not None:
        accepted = accepted.join(known.select("command_id"), "command_id", "left_anti")
    runs = accepted.select(
        stable_id("run", "command_id").alias("run_id"),
        "command_id", "operation_id", "owner_id", "correlation_id",
        stable_id("source", "owner_id", "normalized").alias("source_id"),
        F.lit("queued").alias("status"),
        F.lit(rules.POLICY_VERSION).alias("policy_version"),
        F.lit(rules.NORMALIZER_VERSION).alias("normalizer_version"),
        F.lit(rules.PARSER_VERSION).alias("parser_version"),
        stable_id("document", "command_id").alias("document_id"),
        F.col("received_at").alias("queued_at"),
    )
    inbox = accepted.select(
        "command_id",
        F.lit(rules.COMMAND_SUBJECT).alias("subject"),
        F.lit(rules.COMMAND_TYPE).alias("command_type"),
        F.lit(rules.COMMAND_PRODUCER).alias("producer"),
        "received_at",
        F.col("received_at").alias("applied_at"),
        F.lit("applied").alias("outcome"),
    )
    return {
        "inbox": inbox,
        "sources": upsert_sources(sources, accepted),
        "runs": runs,
        "outbox": report_events(runs, "queued", F.col("queued_at")),
        "rejects": routed.where(rejected).select("delivery_id", "command_id", "reject_reason"),
    }


# --- Events ---------------------------------------------------------------------------------
def utc_text(at: Column) -> Column:
    """ISO form of an instant in UTC with six decimals, whatever the session's zone."""
    micros = F.unix_micros(at.cast("timestamp"))
    within = F.pmod(micros, F.lit(86_400_000_000))
    day = F.date_from_unix_date(((micros - within) / 86_400_000_000).cast("int")).cast("string")
    seconds = F.floor(within / 1_000_000)
    clock = F.format_string(
        "%02d:%02d:%02d.%06dZ",
        F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60, within % 1_000_000,
    )
    return F.when(at.isNotNull(), F.concat(day, F.lit("T"), clock))


def envelope(
    event_type: str, aggregate: Column, occurred_at: Column, payload: Column
) -> Column:
    """The JSON envelope of one event; fields are in alphabetical order.

    Needs columns command_id, owner_id and correlation_id.
    """
    return F.to_json(
        F.struct(
            aggregate.alias("aggregate_id"),
            F.concat(F.lit("command:"), F.col("command_id")).alias("causation_id"),
            F.col("correlation_id").cast("string").alias("correlation_id"),
            stable_id("event", F.col("command_id").cast("string"), F.lit(event_type),
                      payload["status"] if event_type == rules.REPORT_TYPE else F.lit("document"))
            .alias("event_id"),
            F.lit(event_type).alias("event_type"),
            utc_text(occurred_at).alias("occurred_at"),
            payload.alias("payload"),
            F.lit(rules.OWNER_SERVICE).alias("producer"),
            F.lit(1).alias("schema_version"),
            F.concat(F.lit("user:"), F.col("owner_id")).alias("tenant_id"),
        )
    )


def _outbox_row(subject: str, kind: Column | str, payload: Column, at: Column) -> list[Column]:
    message = stable_id("message", F.col("command_id").cast("string"), F.lit(subject), kind)
    return [
        stable_id("outbox", F.col("command_id").cast("string"), F.lit(subject), kind).alias(
            "outbox_id"
        ),
        message.alias("message_id"),
        F.col("command_id").alias("causation_command_id"),
        F.col("operation_id"),
        F.lit(subject).alias("subject"),
        payload.alias("payload"),
        at.alias("enqueued_at"),
        at.alias("next_attempt_at"),
        F.lit(0).alias("attempts"),
    ]


def report_events(
    runs: DataFrame, status: str, at: Column, retryable: Column | None = None
) -> DataFrame:
    """Operation reports: queued, succeeded (naming the document) or failed (with retryable)."""
    fields = [F.col("operation_id").cast("string").alias("operation_id"), F.lit(status).alias("status")]
    if status == "failed":
        fields.append(
            F.struct(
                F.lit("content.extraction.failed").alias("code"),
                F.lit("No document came out of this page.").alias("message"),
                (F.lit(False) if retryable is None else retryable).alias("retryable"),
            ).alias("error")
        )
    if status == "succeeded":
        fields.append(
            F.array(
                F.struct(
                    F.lit("content.document").alias("result_kind"),
                    F.concat(F.lit("document:"), F.col("document_id")).alias("target"),
                )
            ).alias("results")
        )
    payload = envelope(
        rules.REPORT_TYPE,
        F.concat(F.lit("operation:"), F.col("operation_id")),
        at,
        F.struct(*fields),
    )
    return runs.select(*_outbox_row(rules.REPORT_SUBJECT, F.lit(status), payload, at))


def document_events(documents: DataFrame, at: Column) -> DataFrame:
    """The extracted-document event of each succeeded run."""
    body = F.struct("blocks", "content_digest", "document_id", "language", "strategy", "title")
    payload = envelope(
        rules.DOCUMENT_TYPE, F.concat(F.lit("document:"), F.col("document_id")), at, body
    )
    return documents.select(*_outbox_row(rules.DOCUMENT_SUBJECT, F.lit("document"), payload, at))


def terminal_events(finished: DataFrame, documents: DataFrame, at: str = "completed_at") -> DataFrame:
    """O2: success gives a document event and a succeeded report; failure gives a failed report.

    ``finished`` has runs with final ``status`` and ``retryable``; ``documents`` has the run and
    document columns of the succeeded ones.
    """
    when = F.col(at)
    succeeded = finished.where(F.col("status") == "succeeded")
    failed = finished.where(F.col("status") == "failed")
    return (
        document_events(documents, when)
        .unionByName(report_events(succeeded, "succeeded", when))
        .unionByName(report_events(failed, "failed", when, F.col("retryable")))
    )


# --- Work and leases ------------------------------------------------------------------------
def due_runs(runs: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Queued runs, and running ones whose lease is missing or over, oldest first."""
    lease_over = F.col("claimed_until").isNull() | (F.col("claimed_until") <= now)
    due = runs.where(
        (F.col("status") == "queued") | ((F.col("status") == "running") & lease_over)
    ).orderBy("queued_at", "run_id")
    return due if limit is None else due.limit(limit)


def work_list(runs: DataFrame, sources: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next runs with the URL to fetch; the limit applies before the join."""
    next_runs = due_runs(runs, now, limit)
    return next_runs.join(sources.select("source_id", "normalized_url"), "source_id")


def claim(
    runs: DataFrame, due: DataFrame, now: Column, worker: str,
    lease_seconds: int = rules.RUN_LEASE_SECONDS,
) -> DataFrame:
    """Runs after leasing the due ones: running, first start kept, lease from ``now``."""
    lease = F.greatest(F.lit(1), F.least(F.lit(lease_seconds), F.lit(3600)))
    claimed = F.col("_claimed").isNotNull()
    until = now + F.make_dt_interval(secs=lease)
    return (
        runs.join(due.select("run_id", F.lit(True).alias("_claimed")), "run_id", "left")
        .withColumns(
            {
                "status": F.when(claimed, "running").otherwise(F.col("status")),
                "started_at": F.when(claimed, F.coalesce("started_at", now)).otherwise(
                    F.col("started_at")
                ),
                "claimed_until": F.when(claimed, until).otherwise(F.col("claimed_until")),
                "claimed_by": F.when(claimed, F.lit(worker)).otherwise(F.col("claimed_by")),
            }
        )
        .drop("_claimed")
    )


def mark_owner(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Every fact with ``error``: ``owner_mismatch`` unless its run belongs to its owner.

    One join of both inputs; ``run_id`` is the key of ``runs``.
    """
    owned = runs.select("run_id", "owner_id", F.lit(True).alias("_owned"))
    mismatch = F.when(F.col("_owned").isNull(), F.lit("owner_mismatch"))
    return facts.join(owned, ["run_id", "owner_id"], "left").select(*facts.columns, mismatch.alias("error"))


def owner_scope(facts: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts whose run belongs to their owner, the others with ``error``), for two sinks; write
    ``mark_owner`` once where both are needed."""
    marked = mark_owner(facts, runs)
    return marked.where(F.col("error").isNull()).drop("error"), marked.where(F.col("error").isNotNull())


# --- Terminal state -------------------------------------------------------------------------
def run_outcomes(results: DataFrame) -> DataFrame:
    """Add ``status``, ``error_class`` and ``retryable`` to processed runs.

    ``results`` has one row per run with ``fetch_failure`` (null on success), ``media_type``,
    ``verification``, ``parse_failure`` and ``winner``. Checks run in the order the work does: fetch,
    media type, stored bytes, parser limits, quality.
    """
    error = (
        F.when(F.col("fetch_failure").isNotNull(), "fetch")
        .when(F.col("media_type") != "text/html", "unsupported_media")
        .when(F.col("verification") != "ok", "artifact")
        .when(F.col("parse_failure").isNotNull(), "parse")
        .when(F.col("winner").isNull(), "quality")
    )
    return results.withColumns(
        {
            "status": F.when(error.isNull(), "succeeded").otherwise("failed"),
            "error_class": error,
            "retryable": (error == "fetch")
            & F.coalesce(F.col("fetch_failure").isin(*rules.RETRYABLE_FAILURES), F.lit(False)),
        }
    ).withColumn("retryable", F.coalesce("retryable", F.lit(False)))


def terminal_state(runs: DataFrame, completions: DataFrame) -> DataFrame:
    """L2: one row per run: status after all completion calls and what became of each call.

    Only running runs may finish and the first completion wins. A later failure, or a later success
    of a succeeded run, is a duplicate; a success reported for any other run is
    ``invalid_run_state``. Calls reduce to one row per run before the shuffle.

    ``completions`` has (run_id, at, attempt, result, error_class), result succeeded or failed.
    """
    good = F.col("result") == "succeeded"
    calls = completions.groupBy("run_id").agg(
        F.min(F.struct("at", "attempt", "result", "error_class")).alias("first"),
        F.count_if(good).alias("successes"),
        F.count_if(~good).alias("failures"),
    )
    joined = runs.select("run_id", F.col("status").alias("status_before")).join(
        calls, "run_id", "left"
    )
    applies = (F.col("status_before") == "running") & F.col("first").isNotNull()
    after = F.when(applies, F.col("first.result")).otherwise(F.col("status_before"))
    won = F.when(applies, 1).otherwise(0)
    won_good = F.when(applies & (F.col("first.result") == "succeeded"), 1).otherwise(0)
    extra_good = F.coalesce("successes", F.lit(0)) - won_good
    extra_bad = F.coalesce("failures", F.lit(0)) - (won - won_good)
    return joined.select(
        "run_id",
        "status_before",
        after.alias("status"),
        F.when(applies, F.col("first.error_class")).alias("last_error_class"),
        F.when(applies, F.col("first.at")).alias("completed_at"),
        won.cast("bigint").alias("applied"),
        (extra_bad + F.when(after == "succeeded", extra_good).otherwise(0)).alias("duplicates"),
        F.when(after != "succeeded", extra_good).otherwise(0).cast("bigint").alias("invalid_state"),
    )


def terminal_facts(
    finished: DataFrame, candidates: DataFrame, documents: DataFrame, blobs: DataFrame
) -> dict[str, DataFrame]:
    """Every fact a set of finished runs leaves, to be committed as one unit.

    ``finished`` has the run columns, page_id, final ``status``, ``error_class``, ``retryable``,
    ``completed_at`` and the fetch columns. Succeeded runs leave a fetch, two artifacts, three
    candidates and two events; quality rejects leave a fetch, the source artifact, three unselected
    candidates and one event; other failures leave one event. ``candidates``, ``documents`` and
    ``blobs`` are keyed by page_id; read them from their tables, so that a page many runs asked for
    stays a join input that adaptive execution can split.
    """
    kept = finished.where(
        (F.col("status") == "succeeded") | (F.col("error_class") == "quality")
    )
    succeeded = finished.where(F.col("status") == "succeeded")
    fetches = kept.select(
        stable_id("fetch", "run_id").alias("fetch_id"), "run_id", "final_url", "http_status",
        "media_type", "wire_bytes", "decoded_bytes", "attempts", "cache_outcome", "etag",
        "last_modified", F.col("completed_at").alias("fetched_at"),
    )
    raw = kept.select("run_id", "page_id", "completed_at").join(blobs, "page_id").select(
        "run_id", F.lit("raw_source").alias("kind"), "owner_service", "digest_algorithm",
        "digest_hex", "media_type", "length_bytes", F.col("completed_at").alias("created_at"),
    )
    run_columns = [
        "run_id", "command_id", "operation_id", "owner_id", "correlation_id", "document_id",
        "page_id", "completed_at",
    ]
    run_documents = succeeded.select(*run_columns).join(documents, "page_id")
    body = F.to_json(
        F.struct("blocks", "content_digest", "document_id", "language", "strategy", "title")
    )
    rendered = run_documents.select(
        "run_id", F.lit("document_ir").alias("kind"),
        F.lit(rules.OWNER_SERVICE).alias("owner_service"),
        F.lit("sha256").alias("digest_algorithm"), F.sha2(body, 256).alias("digest_hex"),
        F.lit("application/json").alias("media_type"),
        F.octet_length(body).cast("bigint").alias("length_bytes"),
        F.col("completed_at").alias("created_at"),
    )
    artifacts = raw.unionByName(rendered).withColumn(
        "artifact_id", stable_id("artifact", "run_id", "kind")
    )
    decisions = kept.select("run_id", "page_id", "completed_at").join(candidates, "page_id").select(
        stable_id("candidate", "run_id", "strategy", "extractor_version").alias("candidate_id"),
        "run_id", "strategy", "extractor_version",
        F.struct("metrics.*", "accepted").alias("metrics"),
        (F.col("score") / 1000.0).alias("score"), "reasons", "selected",
        F.col("completed_at").alias("created_at"),
    )
    return {
        "fetches": fetches,
        "artifacts": artifacts,
        "candidates": decisions,
        "outbox": terminal_events(finished, run_documents),
    }


def commands_without_runs(inbox: DataFrame, runs: DataFrame) -> DataFrame:
    """O3: applied commands that no run belongs to."""
    return inbox.where(F.col("outcome") == "applied").join(
        runs.select("command_id"), "command_id", "left_anti"
    )


def runs_without_end(runs: DataFrame, events: DataFrame) -> DataFrame:
    """O3: finished runs that no terminal event belongs to."""
    return runs.where(F.col("status").isin("succeeded", "failed")).join(
        events.select(F.col("causation_command_id").alias("command_id")), "command_id", "left_anti"
    )

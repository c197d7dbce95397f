"""Constraint checks over the fact tables: rules, uniqueness, references, golden expectations."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import rules


def _bounded(column: str, high: int) -> str:
    return f"length({column}) between 1 and {high}"


_CLAIM = {
    "claim_has_both_parts": "(claimed_until is null) = (claimed_by is null)",
    "claimant_length": f"claimed_by is null or {_bounded('claimed_by', 64)}",
}
# SQL conditions each row must satisfy. As in a CHECK constraint, null passes.
ROW_RULES = {
    "sources": {
        "url_lengths": " and ".join(
            _bounded(c, 8192) for c in ("original_url", "normalized_url", "canonical_url")
        ),
        "host_length": _bounded("host", 253),
    },
    "inbox": {
        "wrong_subject": f"subject = '{rules.COMMAND_SUBJECT}'",
        "wrong_command_type": f"command_type = '{rules.COMMAND_TYPE}'",
        "producer_length": _bounded("producer", 64),
        "outcome_without_time": "(outcome is not null) = (applied_at is not null)",
        "outcome_name": "outcome is null or outcome in ('applied', 'duplicate', 'rejected')",
    },
    "runs": {
        "run_status_name": "status in ('queued', 'running', 'succeeded', 'failed')",
        "times_against_status": (
            "(started_at is not null) = (status in ('running', 'succeeded', 'failed')) and "
            "(completed_at is not null) = (status in ('succeeded', 'failed'))"
        ),
        "error_class_length": f"last_error_class is null or {_bounded('last_error_class', 64)}",
        **_CLAIM,
    },
    "fetches": {
        "http_status_range": "http_status between 100 and 599",
        "byte_counts": "wire_bytes >= 0 and decoded_bytes >= 0",
        "attempt_count": "attempts > 0",
        "cache_outcome_name": "cache_outcome in ('fresh', 'revalidated')",
    },
    "artifacts": {
        "artifact_kind": "kind in ('raw_source', 'document_ir', 'diagnostics')",
        "artifact_owner": f"owner_service = '{rules.OWNER_SERVICE}'",
        "digest_form": "digest_algorithm = 'sha256' and digest_hex rlike '^[0-9a-f]{64}$'",
        "artifact_length": "length_bytes >= 0",
    },
    "candidates": {
        "strategy_length": _bounded("strategy", 64),
        "metrics_present": "metrics is not null",
        "reasons_present": "reasons is not null",
        "score_range": "score is null or score between 0.0 and 1.0",
    },
    "outbox": {
        "event_subject": f"subject in ('{rules.DOCUMENT_SUBJECT}', '{rules.REPORT_SUBJECT}')",
        "payload_form": "payload is null or json_object_keys(payload) is not null",
        "publish_attempts": "attempts >= 0",
        **_CLAIM,
        "error_text": (
            "last_error is null or "
            r"(length(last_error) <= 512 and not last_error rlike '[\\r\\n]')"
        ),
        "published_and_dead": (
            "not (published_at is not null and dead_lettered_at is not null)"
        ),
    },
}
# (rule, key columns, optional row condition): at most one row per key.
UNIQUE_RULES = {
    "sources": [("one_source_per_owner_url", ["owner_id", "normalized_url"], None)],
    "inbox": [("one_row_per_command", ["command_id"], None)],
    "runs": [
        ("one_row_per_run", ["run_id"], None),
        ("one_row_per_command", ["command_id"], None),
        ("one_run_per_document", ["document_id"], None),
    ],
    "fetches": [("one_fetch_per_run", ["run_id"], None)],
    "artifacts": [("one_artifact_per_kind", ["run_id", "kind"], None)],
    "candidates": [
        ("one_decision_per_strategy", ["run_id", "strategy", "extractor_version"], None),
        ("one_winner_per_run", ["run_id"], "selected"),
    ],
    "outbox": [("one_row_per_message", ["message_id"], None)],
}
ROW_KEYS = {
    "sources": "source_id", "inbox": "command_id", "runs": "run_id", "fetches": "fetch_id",
    "artifacts": "artifact_id", "candidates": "candidate_id", "outbox": "outbox_id",
}
#: Key of the rows that stand for rules that could not be tested.
NOT_TESTED = "not_tested"
# Foreign keys: (name, table, column, referenced table, referenced column).
REFERENCES = (
    ("runs_command", "runs", "command_id", "inbox", "command_id"),
    ("runs_source", "runs", "source_id", "sources", "source_id"),
    ("fetches_run", "fetches", "run_id", "runs", "run_id"),
    ("artifacts_run", "artifacts", "run_id", "runs", "run_id"),
    ("candidates_run", "candidates", "run_id", "runs", "run_id"),
    ("candidates_artifact", "candidates", "artifact_id", "artifacts", "artifact_id"),
    ("outbox_command", "outbox", "causation_command_id", "inbox", "command_id"),
)


def _words(sql: str) -> set[str]:
    return set(re.findall("[a-z_]+", sql))


def _untested(frame: DataFrame, table: str, rules_: list[str]) -> DataFrame:
    """One row per rule that could not be tested, so that silence always means no violation."""
    named = F.explode(F.array(*map(F.lit, rules_)))
    rows = frame.sparkSession.range(1).select(F.lit(table).alias("table_name"), named.alias("rule"))
    return rows.select("table_name", "rule", F.lit(NOT_TESTED).alias("key"), F.lit(None).cast("bigint").alias("n"))


def constraint_violations(table: DataFrame, name: str) -> DataFrame:
    """K1: (table_name, rule, key, n): one row per broken row rule, one per repeated unique key.

    All row rules of a table are tested in one pass; a uniqueness rule is one combining count. A rule
    whose columns the frame lacks gives one row with the key ``not_tested``.
    """
    columns = set(table.columns)
    known = {word for sqls in ROW_RULES.values() for sql in sqls.values() for word in _words(sql)} & _ALL_COLUMNS
    lacking = [rule for rule, sql in ROW_RULES[name].items() if _words(sql) & known - columns]
    lacking += [rule for rule, key, condition in UNIQUE_RULES[name] if {*key, *filter(None, [condition])} - columns]
    broken = [
        F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.lit(rule))
        for rule, sql in ROW_RULES[name].items()
        if rule not in lacking
    ]
    rows = table.select(
        F.lit(name).alias("table_name"),
        F.col(ROW_KEYS[name]).cast("string").alias("key"),
        F.explode(F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")).alias("rule"),
    ).select("table_name", "rule", "key", F.lit(1).cast("bigint").alias("n"))
    for rule, key, condition in UNIQUE_RULES[name]:
        if rule in lacking:
            continue
        scope = table if condition is None else table.where(condition)
        repeated = (
            scope.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
            .select(
                F.lit(name).alias("table_name"), F.lit(rule).alias("rule"),
                F.concat_ws("|", *key).alias("key"), "n",
            )
        )
        rows = rows.unionByName(repeated)
    return rows.unionByName(_untested(table, name, lacking)) if lacking else rows


_ALL_COLUMNS = {
    "original_url", "normalized_url", "canonical_url", "host", "subject", "command_type",
    "producer", "outcome", "applied_at", "status", "started_at", "completed_at",
    "last_error_class", "claimed_until", "claimed_by", "http_status", "wire_bytes",
    "decoded_bytes", "attempts", "cache_outcome", "kind", "owner_service", "digest_algorithm",
    "digest_hex", "length_bytes", "strategy", "metrics", "reasons", "score", "payload",
    "last_error", "published_at", "dead_lettered_at",
}


def dangling_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(reference, key, n): values of each of the seven foreign keys that its target lacks.

    Keys reduce to distinct values with a count before the anti join, so a hot key is one row. A
    reference whose table or column is absent gives one row with the key ``not_tested``.
    """
    some = next(iter(tables.values()))
    missing = None
    for name, table, column, target, target_column in REFERENCES:
        if not all(t in tables and c in tables[t].columns for t, c in ((table, column), (target, target_column))):
            found = _untested(some, table, [name]).select(F.col("rule").alias("reference"), "key", "n")
        else:
            keys = (
                tables[table].where(F.col(column).isNotNull())
                .groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n"))
            )
            known = tables[target].select(F.col(target_column).cast("string").alias("key"))
            found = keys.join(known, "key", "left_anti").select(
                F.lit(name).alias("reference"), "key", "n"
            )
        missing = found if missing is None else missing.unionByName(found)
    return missing


def corpus_report(expected: DataFrame, decisions: DataFrame) -> DataFrame:
    """(case_name, verdict): ok, missing, unexpected, wrong_strategy or score_out_of_range.

    ``expected`` has (case_name, expect_strategy, score_lo, score_hi), a null strategy meaning
    rejection; ``decisions`` has (case_name, strategy, score) of the selected candidate, null when
    none was.
    """
    verdict = (
        F.when(~F.coalesce("is_expected", F.lit(False)), "unexpected")
        .when(~F.coalesce("is_decided", F.lit(False)), "missing")
        .when(~F.col("strategy").eqNullSafe(F.col("expect_strategy")), "wrong_strategy")
        .when(~F.col("score").between(F.col("score_lo"), F.col("score_hi")), "score_out_of_range")
        .otherwise("ok")
    )
    return expected.withColumn("is_expected", F.lit(True)).join(
        decisions.withColumn("is_decided", F.lit(True)), "case_name", "full_outer"
    ).select("case_name", verdict.alias("verdict"))


def forbidden_columns(frame: DataFrame, names: tuple[str, ...]) -> list[str]:
    """K2: columns of ``frame`` that must not exist in a fact table."""
    return [c for c in frame.columns if c in names]



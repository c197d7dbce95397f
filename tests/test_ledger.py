import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.operators import checks, derived, ledger, outbox
from pagemill.plans import catalog
from pagemill.schemas import FACTS, FORBIDDEN_FACT_COLUMNS
from pagemill.sources.commands import decode_commands
from pagemill.sources.facts import conform, scan_facts, upsert_facts, write_facts

T0 = datetime(2024, 5, 1)


def now():
    return F.lit("2024-05-02 00:00:00").cast("timestamp")


ID = "00000000-0000-7000-8000-00000000000{}"


def _body(**changes):
    command = {
        "command_id": ID.format(1), "command_type": rules.COMMAND_TYPE,
        "requested_at": "2026-08-21T10:00:00Z", "operation_id": ID.format(2),
        "tenant_id": f"user:{ID.format(3)}", "correlation_id": "operation:7",
        "idempotency_key": "k", "payload": {"url": "https://e.org/a"}, "later_member": [1],
    }
    command.update(changes)
    return json.dumps(command)


def test_decode_reasons(spark):
    cases = {
        "ok": (rules.COMMAND_SUBJECT, _body(), None),
        "subject": ("cmd.else", _body(), "invalid_subject"),
        "type": (rules.COMMAND_SUBJECT, _body(command_type="x.v1"), "invalid_command_type"),
        "instant": (rules.COMMAND_SUBJECT, _body(requested_at="yesterday"), "malformed"),
        "tenant": (rules.COMMAND_SUBJECT, _body(tenant_id=f"admin:{ID.format(3)}"), "malformed"),
        "file": (rules.COMMAND_SUBJECT, _body(payload={"url": "file:///x"}), "invalid_url_scheme"),
        "json": (rules.COMMAND_SUBJECT, _body()[:-3], "malformed"),
        "missing": (rules.COMMAND_SUBJECT, "{}", "malformed"),
    }
    frame = spark.createDataFrame(
        [(n, s, b) for n, (s, b, _) in cases.items()], "name string, subject string, body string"
    )
    found = {r.name: r.reject_reason for r in decode_commands(frame).collect()}
    assert found == {name: case[2] for name, case in cases.items()}


def _deliveries(spark, rows):
    return spark.createDataFrame(
        [(d, c, c, o, f"operation:{c}", T0 + timedelta(seconds=s), u) for d, c, o, s, u in rows],
        "delivery_id long, command_id string, operation_id string, owner_id string, "
        "correlation_id string, received_at timestamp, url string",
    )


def test_first_delivery_wins_even_when_one_command_is_hot(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"c{i % 50}", "o", rng.randrange(1000), "u") for i in range(900)]
    frame = _deliveries(spark, rows)
    best = {}
    for d, c, _, s, _ in rows:
        best[c] = min(best.get(c, (s, d)), (s, d))
    winners = {d for _, d in best.values()}
    marked = {r.delivery_id: r.outcome for r in ledger.mark_duplicates(frame, salts=4).collect()}
    assert {d for d, outcome in marked.items() if outcome == "applied"} == winners
    assert len(marked) == 900
    assert {r.delivery_id for r in ledger.first_deliveries(frame).collect()} == winners


def test_intake_applies_each_command_once_and_rejects_bad_urls(spark):
    commands = _deliveries(spark, [
        (1, "a", "o1", 1, "https://E.org/x?utm_source=1"), (2, "a", "o1", 2, "https://e.org/x"),
        (3, "b", "o1", 3, "https://e.org/x#y"), (4, "c", "o2", 4, "ftp://e.org/"),
        (5, "d", "o2", 5, "https://e.org/x"),
    ])
    facts = ledger.intake(commands, spark.createDataFrame([("d",)], "command_id string"))
    assert {r.command_id for r in facts["runs"].collect()} == {"a", "b"}
    source = facts["sources"].collect()
    assert len(source) == 1 and source[0].original_url == "https://E.org/x?utm_source=1"
    assert [(r.command_id, r.reject_reason) for r in facts["rejects"].collect()] == [
        ("c", "unsupported_scheme")
    ]
    events = [json.loads(r.payload) for r in facts["outbox"].collect()]
    assert all(e["payload"]["status"] == "queued" for e in events) and len(events) == 2
    assert events[0]["tenant_id"] == "user:o1" and events[0]["causation_id"].startswith("command:")
    runs = conform(facts["runs"], "runs")
    assert checks.constraint_violations(runs, "runs").count() == 0
    assert checks.constraint_violations(facts["inbox"], "inbox").count() == 0


def test_upsert_keeps_first_identity_and_last_values(spark):
    schema = "id string, run_id string, value int, at int"
    old = spark.createDataFrame([("a", "r1", 1, 1), ("b", "r2", 2, 1)], schema)
    new = spark.createDataFrame([("c", "r1", 5, 3), ("d", "r1", 4, 2), ("e", "r3", 9, 1)], schema)
    rows = upsert_facts(old, new, ["run_id"], ["id"], ["at"]).collect()
    assert {(r.run_id, r.id, r.value) for r in rows} == {("r1", "a", 5), ("r2", "b", 2), ("r3", "e", 9)}


def test_facts_round_trip_with_their_fixed_schema(spark, tmp_path):
    made = spark.createDataFrame([("f", "r", 200)], "fetch_id string, run_id string, http_status int")
    write_facts(made, str(tmp_path), "fetches")
    back = scan_facts(spark, str(tmp_path), "fetches")
    assert back.columns == conform(made, "fetches").columns
    assert back.first().http_status == 200 and back.first().etag is None
    for name in ("fetches", "artifacts", "candidates"):
        frame = spark.createDataFrame([], FACTS[name])
        assert checks.forbidden_columns(frame, FORBIDDEN_FACT_COLUMNS) == []


def test_due_runs_and_claims(spark):
    rows = [
        ("q", "queued", 3, None), ("free", "running", 2, None), ("over", "running", 1, -60),
        ("held", "running", 0, 60), ("done", "succeeded", 0, None),
    ]
    runs = spark.createDataFrame(
        [(r, s, T0 + timedelta(minutes=m), None if s == "queued" else T0,
          None if c is None else datetime(2024, 5, 2) + timedelta(seconds=c), None)
         for r, s, m, c in rows],
        "run_id string, status string, queued_at timestamp, started_at timestamp, "
        "claimed_until timestamp, claimed_by string",
    )
    due = ledger.due_runs(runs, now())
    assert [r.run_id for r in due.collect()] == ["over", "free", "q"]
    after = {r.run_id: r for r in ledger.claim(runs, ledger.due_runs(runs, now(), 2), now(), "w").collect()}
    assert after["over"].claimed_by == "w" and after["over"].started_at == T0
    assert after["q"].status == "queued" and after["free"].claimed_until > datetime(2024, 5, 2)


def test_first_terminal_result_wins(spark):
    runs = spark.createDataFrame(
        [("a", "running"), ("b", "running"), ("c", "queued"), ("d", "succeeded")],
        "run_id string, status string",
    )
    calls = [
        ("a", 1, "succeeded"), ("a", 2, "succeeded"), ("a", 3, "failed"), ("b", 1, "failed"),
        ("b", 2, "succeeded"), ("c", 1, "succeeded"), ("d", 1, "succeeded"), ("d", 2, "failed"),
    ]
    frame = spark.createDataFrame(
        [(r, T0 + timedelta(seconds=n), n, s, None if s == "succeeded" else "fetch") for r, n, s in calls],
        "run_id string, at timestamp, attempt int, result string, error_class string",
    )
    found = {
        r.run_id: (r.status, r.applied, r.duplicates, r.invalid_state)
        for r in ledger.terminal_state(runs, frame).collect()
    }
    assert found == {
        "a": ("succeeded", 1, 2, 0), "b": ("failed", 1, 0, 1), "c": ("queued", 0, 0, 1),
        "d": ("succeeded", 0, 2, 0),
    }


def test_run_outcomes_follow_the_order_of_work(spark):
    rows = [
        (1, "dns", "text/html", "ok", None, 0), (2, "remote_status", "x", "ok", None, None),
        (3, None, "application/pdf", "missing", None, 0), (4, None, "text/html", "missing", None, 0),
        (5, None, "text/html", "ok", "resource_limit", None), (6, None, "text/html", "ok", None, None),
        (7, None, "text/html", "ok", None, 1),
    ]
    frame = spark.createDataFrame(
        rows, "run_id int, fetch_failure string, media_type string, verification string, "
        "parse_failure string, winner int",
    )
    found = {r.run_id: (r.status, r.error_class, r.retryable) for r in ledger.run_outcomes(frame).collect()}
    assert found == {
        1: ("failed", "fetch", True), 2: ("failed", "fetch", False),
        3: ("failed", "unsupported_media", False), 4: ("failed", "artifact", False),
        5: ("failed", "parse", False), 6: ("failed", "quality", False), 7: ("succeeded", None, False),
    }


def test_backoff_dead_letter_and_report(spark):
    rows = [(i, a, "one\r\ntwo " + "x" * 600) for i, a in enumerate((0, 3, 8, 11, 30))]
    frame = spark.createDataFrame(rows, "outbox_id int, attempts int, last_error string").withColumns(
        {c: F.lit(None).cast("timestamp") for c in ("dead_lettered_at", "claimed_until")}
    ).withColumn("claimed_by", F.lit("w"))
    after = outbox.outbox_backoff(frame, now()).orderBy("outbox_id").collect()
    waits = [(r.next_attempt_at - datetime(2024, 5, 2)).total_seconds() for r in after]
    assert waits == [1, 8, 256, 300, 300]
    assert [r.dead_lettered_at is not None for r in after] == [False, False, False, True, True]
    assert after[0].last_error.startswith("onetwo") and len(after[0].last_error) == 512
    results = spark.createDataFrame([(0, True), (11, False), (2, False)], "attempts int, published boolean")
    assert tuple(outbox.outbox_report(results).first()) == (3, 1, 2, 1)


def test_one_pass_closes_backs_off_and_leaves(spark):
    rows = spark.createDataFrame([(1, 0), (2, 11), (3, 4), (4, 2)], "outbox_id int, attempts int").withColumns(
        {c: F.lit(None).cast("timestamp") for c in ("published_at", "dead_lettered_at")}
    ).withColumns(
        {"next_attempt_at": now(), "enqueued_at": now(), "claimed_until": now(), "claimed_by": F.lit("w"), "last_error": F.lit("old")}
    )
    results = spark.createDataFrame([(1, True, None), (2, False, "a\nb"), (4, None, "x")], "outbox_id int, published boolean, error string")
    after = outbox.apply_results(rows, results, now())
    found = {r.outbox_id: r for r in after.collect()}
    assert after.columns == rows.columns
    assert found[1].published_at and found[1].claimed_by is None and found[1].last_error is None and found[1].attempts == 0
    assert found[2].dead_lettered_at and found[2].last_error == "ab" and found[2].attempts == 12 and not found[2].published_at
    assert [(found[k].claimed_by, found[k].last_error, found[k].published_at) for k in (3, 4)] == [("w", "old", None)] * 2
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "Union" not in plan


def test_due_rows_without_a_limit_are_all(spark):
    rows = spark.range(1500).selectExpr("id as outbox_id").withColumns(
        {c: F.lit(None).cast("timestamp") for c in ("published_at", "dead_lettered_at", "claimed_until")}
    ).withColumns({"next_attempt_at": now(), "enqueued_at": now()})
    assert outbox.due_outbox(rows, now(), None).count() == 1500
    assert outbox.due_outbox(rows, now(), 1000).count() == 1000
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            outbox.due_outbox(rows, now(), limit)


def test_owner_marks_keep_every_fact(spark):
    facts = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (9, 9, "d")], "run_id int, owner_id int, fact string")
    runs = spark.createDataFrame([(1, 1), (2, 2)], "run_id int, owner_id int")
    found = {r.fact: r.error for r in ledger.mark_owner(facts, runs).collect()}
    assert found == {"a": None, "b": "owner_mismatch", "c": "owner_mismatch", "d": "owner_mismatch"}
    good, bad = ledger.owner_scope(facts, runs)
    assert [r.fact for r in good.collect()] == ["a"] and bad.count() == 3


def test_every_rule_finds_its_violation(spark):
    bad = spark.createDataFrame(
        [("f1", "r", 99, -1, 0, 0, "odd"), ("f2", "r", 200, 1, 1, 1, "fresh")],
        "fetch_id string, run_id string, http_status int, wire_bytes long, decoded_bytes long, "
        "attempts int, cache_outcome string",
    )
    found = {(r.rule, r.key, r.n) for r in checks.constraint_violations(bad, "fetches").collect()}
    assert found == {
        ("http_status_range", "f1", 1), ("byte_counts", "f1", 1),
        ("attempt_count", "f1", 1), ("cache_outcome_name", "f1", 1),
        ("run_is_unique", "r", 2),
    }
    null_passes = conform(spark.createDataFrame([("x",)], "outbox_id string"), "outbox")
    rules_hit = {r.rule for r in checks.constraint_violations(null_passes, "outbox").collect()}
    assert rules_hit == set()


def test_retention_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, T0 + timedelta(hours=rng.choice((1, 2, 2, 2, 5, 9, 20))), rng.randrange(1, 9))
            for i in range(300)]
    frame = spark.createDataFrame(rows, "message_id int, at timestamp, bytes long")
    for count, size in ((50, 10**6), (10**6, 321), (1000, 10**6), (0, 10)):
        young = [r for r in rows if r[1] >= datetime(2024, 5, 2) - timedelta(hours=22)]
        kept, total = [], 0
        for row in sorted(young, key=lambda r: (-r[1].timestamp(), r[0])):
            total += row[2]
            if len(kept) + 1 > count or total > size:
                break
            kept.append(row[0])
        found = derived.retained(frame, now(), 22, count, size).collect()
        assert sorted(r.message_id for r in found) == sorted(kept)


def test_derived_texts(spark):
    frame = spark.createDataFrame(
        [(1, [("heading", 2, "Top"), ("paragraph", None, "abc"), ("paragraph", None, "defg")])],
        "page_id int, blocks array<struct<kind:string,level:int,text:string>>",
    )
    row = derived.derived_views(frame, 7).first()
    assert row.plain_text == "Top\n\nabc\n\ndefg" and row.markdown == "## Top\n\nabc\n\ndefg"
    assert row.context == "Top\nabc"


def test_event_times_are_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    micros = [0, -1, 1_700_000_000_123_456, 1_678_602_600_000_000, 1_699_163_999_999_999, None]
    expected = [None if m is None else (datetime(1970, 1, 1) + timedelta(microseconds=m)).strftime("%Y-%m-%dT%H:%M:%S.%fZ") for m in micros]
    frame = spark.createDataFrame([(k, m) for k, m in enumerate(micros)], "k int, m long")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            shown = frame.select("k", ledger.utc_text(F.timestamp_micros("m")).alias("t")).orderBy("k")
            assert [r["t"] for r in shown.collect()] == expected, name
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rules_that_cannot_be_tested_say_so(spark):
    sources = spark.createDataFrame([("s", "o", "u", "u", "u")], "source_id string, owner_id string, original_url string, normalized_url string, canonical_url string")
    rows = checks.constraint_violations(sources, "sources").collect()
    assert [(r.rule, r.key, r.n) for r in rows] == [("host_length", checks.NOT_TESTED, None)]
    tables = {
        "runs": spark.createDataFrame([("r", "c")], "run_id string, command_id string"),
        "inbox": spark.createDataFrame([("c",)], "command_id string"),
        "fetches": spark.createDataFrame([("r",), ("x",), ("x",), (None,)], "run_id string"),
    }
    found = {(r.reference, r.key): r.n for r in checks.dangling_references(tables).collect()}
    assert found[("fetches_run", "x")] == 2
    lacking = {name for name, *_ in checks.REFERENCES} - {"runs_command", "fetches_run"}
    assert {k for k, v in found.items() if v is None} == {(name, checks.NOT_TESTED) for name in lacking}


def test_facts_are_made_only_for_the_runs_asked_for(spark, sf, monkeypatch):
    made, given = ledger.terminal_facts, []

    def watched(finished, *others):
        given.append(finished)
        return made(finished, *others)

    monkeypatch.setattr(ledger, "terminal_facts", watched)
    rows = catalog.queries()["reject_runs"](spark, sf).collect()
    assert {(r.status, r.error_class) for r in given[0].collect()} == {("failed", "quality")}
    assert sorted(r.run_id for r in given[0].collect()) == sorted(r.run_id for r in rows)

import json
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagemill import rules
from pagemill.operators import derived, ledger, outbox
from pagemill.operators.documents import build_documents
from pagemill.operators.quality import page_decisions
from pagemill.plans.fixtures import fixture, table
from pagemill.sources.commands import decode_commands, split_commands
from pagemill.streaming import jobs, membership, terminal
from pagemill.streaming.commits import key_prefix, prefixes_of, read_committed, write_batch

T0 = datetime(2024, 5, 1)


def _stream(spark, frame, path, files):
    frame.repartition(files).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_intake_stream_equals_batch(spark, sf, tmp_path):
    deliveries = fixture(spark, sf, "command_json")
    stream = _stream(spark, deliveries, f"{tmp_path}/in", 3)
    jobs.intake_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    streamed = {r.run_id for r in read_committed(spark, f"{tmp_path}/out", "runs").collect()}
    batch = {r.run_id for r in ledger.intake(split_commands(decode_commands(deliveries))[0])["runs"].collect()}
    assert streamed == batch
    assert read_committed(spark, f"{tmp_path}/out", "runs").count() == len(batch)


def test_uncommitted_batches_are_invisible(spark, tmp_path):
    write_batch({"runs": spark.range(3)}, str(tmp_path), 0)
    assert read_committed(spark, str(tmp_path), "runs") is None


def test_extraction_stream_equals_batch(spark, sf, tmp_path):
    pages = table(spark, sf, "pages")
    stream = _stream(spark, pages, f"{tmp_path}/in", 2)
    jobs.extraction_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    streamed = read_committed(spark, f"{tmp_path}/out", "documents")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, build_documents(pages).collect()))
    assert read_committed(spark, f"{tmp_path}/out", "candidates").count() == 3 * pages.count()


def test_repeated_messages_inside_the_window_are_dropped(spark, tmp_path):
    rows = [("m1", T0), ("m1", T0 + timedelta(seconds=30)), ("m2", T0 + timedelta(seconds=40))]
    frame = spark.createDataFrame(rows, "message_id string, at timestamp")
    stream = _stream(spark, frame, f"{tmp_path}/in", 1)
    query = (
        jobs.distinct_messages(stream).writeStream.format("memory").queryName("kept_messages")
        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.message_id for r in spark.table("kept_messages").collect()) == ["m1", "m2"]


def test_run_state_stream_equals_batch(spark, tmp_path):
    now = F.lit("2024-05-01 01:00:00").cast("timestamp")
    log = [
        ("a", 0, "queued"), ("a", 10, "claimed"), ("a", 20, "succeeded"), ("a", 30, "failed"),
        ("b", 0, "queued"), ("b", 5, "claimed"), ("c", 0, "queued"), ("d", 0, "queued"),
        ("d", 3590, "claimed"), ("e", 0, "queued"), ("e", 5, "succeeded"), ("e", 10, "claimed"),
    ]
    frame = spark.createDataFrame(
        [(r, T0 + timedelta(seconds=s), e) for r, s, e in log],
        "run_id string, at timestamp, event string",
    )
    batch = {r.run_id: r for r in jobs.run_states(frame, now).collect()}
    assert (batch["a"].status, batch["a"].eligible) == ("succeeded", False)
    assert (batch["b"].status, batch["b"].eligible) == ("running", True)
    assert (batch["c"].status, batch["c"].eligible) == ("queued", True)
    assert (batch["d"].status, batch["d"].eligible) == ("running", False)
    assert (batch["e"].status, batch["e"].completed_at) == ("running", None)
    stream = _stream(spark, frame, f"{tmp_path}/in", 3)
    jobs.run_state_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", now).awaitTermination()
    states = jobs.latest_states(read_committed(spark, f"{tmp_path}/out", "states"))
    assert {r.run_id: (r.status, r.eligible) for r in states.collect()} == {
        k: (r.status, r.eligible) for k, r in batch.items()
    }


def test_outbox_passes_publish_each_message_once(spark, tmp_path):
    schema = (
        "outbox_id int, message_id string, subject string, payload string, enqueued_at timestamp, "
        "next_attempt_at timestamp, attempts int, claimed_until timestamp, claimed_by string, "
        "published_at timestamp, dead_lettered_at timestamp, last_error string"
    )
    rows = [(i, f"m{i}", "s", "{}", T0, T0, 11 if i == 3 else 0, None, None, None, None, None)
            for i in range(5)]
    state = spark.createDataFrame(rows, schema)
    now = F.lit("2024-05-02 00:00:00").cast("timestamp")

    def refuse_three(due):
        return due.select(
            "outbox_id", (F.col("outbox_id") != 3).alias("published"),
            F.when(F.col("outbox_id") == 3, F.lit("no\nroute")).alias("error"),
        )

    changes = None
    for number in range(2):
        seen = state if changes is None else outbox.current_rows(state, changes)
        made = jobs.outbox_pass(seen, f"{tmp_path}/bus", number, now, refuse_three, limit=3)
        made.write.parquet(f"{tmp_path}/changes/pass={number}")
        assert made.count() == (3, 2)[number]
        changes = spark.read.parquet(f"{tmp_path}/changes").select(*made.columns)
    state = outbox.current_rows(state, changes)
    sent = spark.read.parquet(f"{tmp_path}/bus").collect()
    assert sorted(r.message_id for r in sent) == ["m0", "m1", "m2", "m4"]
    dead = state.where("dead_lettered_at is not null").collect()
    assert [(r.outbox_id, r.attempts, r.last_error) for r in dead] == [(3, 12, "noroute")]
    assert outbox.due_outbox(state, now).count() == 0


def _commands(rows):
    """JSON deliveries (delivery_id, command number, user number, path, second)."""
    uuid = "00000000-0000-7000-8000-{:012d}"
    made = []
    for delivery, command, user, path, second in rows:
        body = {
            "command_id": uuid.format(command), "command_type": rules.COMMAND_TYPE,
            "requested_at": "2026-08-21T10:00:00Z", "operation_id": uuid.format(command),
            "tenant_id": "user:" + uuid.format(user), "correlation_id": f"operation:{command}",
            "idempotency_key": f"k{command}", "payload": {"url": f"https://example.com/{path}"},
        }
        made.append((delivery, rules.COMMAND_SUBJECT, json.dumps(body), T0 + timedelta(seconds=second)))
    return made


def _run_intake(spark, batches, tmp_path):
    """One file and so one batch for each list of commands, in order."""
    schema = "delivery_id bigint, subject string, body string, received_at timestamp"
    for rows in batches:
        spark.createDataFrame(_commands(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.intake_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()


def test_one_source_per_owner_and_url_after_any_number_of_batches(spark, tmp_path):
    batches = [
        [(1, 1, 1, "a", 5), (2, 2, 1, "b", 6), (3, 3, 2, "a", 7)],
        [(4, 4, 1, "a?utm_source=x", 1), (5, 1, 1, "a", 9)],
        [(6, 5, 1, "a", 2), (7, 6, 1, "c", 3)],
    ]
    _run_intake(spark, batches, tmp_path)
    out = f"{tmp_path}/out"
    sources = ledger.current_sources(read_committed(spark, out, "sources", with_batch=True)).collect()
    kept = {(r.owner_id[-1], r.normalized_url[-1]): r for r in sources}
    assert len(sources) == 4 and set(kept) == {("1", "a"), ("1", "b"), ("2", "a"), ("1", "c")}
    # The first row stays, though a later batch brought an earlier instant and another spelling.
    assert kept["1", "a"].created_at == T0 + timedelta(seconds=5)
    assert kept["1", "a"].original_url == "https://example.com/a"
    runs = read_committed(spark, out, "runs").collect()
    assert len(runs) == 6 and {r.source_id for r in runs} == {r.source_id for r in sources}


def test_a_batch_opens_only_the_folders_its_keys_can_be_in(spark, tmp_path):
    _run_intake(spark, [[(k, k, 1, f"p{k}", k) for k in range(300)]], tmp_path)
    out = f"{tmp_path}/out"
    ids = lambda *ks: spark.createDataFrame([(f"00000000-0000-7000-8000-{k:012d}",) for k in ks], "command_id string")
    new = ids(*range(1000, 1100))
    assert membership.folders_to_open(spark, new, "command_id", out, "inbox", 1) == []
    assert membership.known_keys(spark, new, "command_id", out, "inbox", 1) is None
    old = ids(3, 1200, 77)
    folders = membership.folders_to_open(spark, old, "command_id", out, "inbox", 1)
    expect = {r.p for r in ids(3, 77).select(key_prefix("command_id").alias("p")).collect()}
    assert {p for _, p in folders} == expect
    found = membership.known_keys(spark, old, "command_id", out, "inbox", 1)
    assert len({f.split("key_prefix=")[1][:3] for f in found.inputFiles()}) == len(expect)
    assert old.join(found, "command_id", "left_semi").count() == 2
    named = spark.createDataFrame([("u", "https://example.com/p1")], "owner_id string, normalized_url string")
    read = read_committed(spark, out, "sources", 1, prefixes_of(named, "owner_id", "normalized_url"))
    assert read is not None
    # Nothing of a batch that is not committed counts.
    assert membership.folders_to_open(spark, old, "command_id", out, "inbox", 0) == []


def _work(spark, sf):
    pages = table(spark, sf, "pages").withColumn(
        "html", F.when(F.col("page_id") % 6 == 0, F.substring_index("html", "<article>", 1)).otherwise(F.col("html"))
    )
    key = F.col("run_id")
    runs = fixture(spark, sf, "runs").where("run_id < 400").select(
        key.cast("string").alias("run_id"), key.cast("string").alias("command_id"), key.cast("string").alias("operation_id"),
        F.col("owner_id").cast("string").alias("owner_id"), F.concat(F.lit("operation:"), key).alias("correlation_id"),
        F.concat(F.lit("d"), key).alias("document_id"),
        F.when(key % 9 == 0, F.lit(-1)).otherwise(F.col("page_id")).alias("page_id"),
        F.when(key % 5 == 0, F.lit("queued")).otherwise(F.lit("running")).alias("status"),
        F.col("queued_at").alias("completed_at"), F.lit("https://example.com/").alias("final_url"),
        F.when(key % 7 == 0, F.lit("dns")).alias("fetch_failure"), F.lit(200).alias("http_status"),
        F.lit("text/html").alias("media_type"), F.lit(10).cast("bigint").alias("wire_bytes"),
        F.lit(20).cast("bigint").alias("decoded_bytes"), F.lit(1).alias("attempts"), F.lit("fresh").alias("cache_outcome"),
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
    )
    return runs, pages


def _state(spark, directory):
    found = {}
    for name in terminal.TABLES:
        rows = read_committed(spark, directory, name)
        if rows is not None:
            found[name] = sorted(map(str, rows.select(*sorted(rows.columns)).collect()))
    return found


def test_terminal_commits_show_whole_runs_once(spark, sf, tmp_path):
    work, pages = _work(spark, sf)
    whole = f"{tmp_path}/whole"
    # A crash before the manifest entry: everything is written and nothing shows.
    applied = terminal.judge_calls(work).where("completion = 'applied'").drop("completion", "n_calls")
    write_batch(terminal.terminal_tables(applied, pages, page_decisions(pages)), whole, 0)
    assert _state(spark, whole) == {}
    terminal.commit_terminal(spark, whole, 0, work, pages)
    once = _state(spark, whole)
    runs = {r.run_id: r for r in read_committed(spark, whole, "runs").collect()}
    statuses = Counter((r.status, r.last_error_class) for r in runs.values())
    assert set(statuses) == {("succeeded", None), ("failed", "quality"), ("failed", "fetch"), ("failed", "artifact")}
    assert all(int(k) % 5 for k in runs)
    one = lambda name, key="run_id": Counter(r[key] for r in read_committed(spark, whole, name).collect())
    fetches, artifacts, candidates, events = one("fetches"), one("artifacts"), one("candidates"), one("outbox", "causation_command_id")
    for key, run in runs.items():
        left = (fetches[key], artifacts[key], candidates[key], events[key])
        expect = {None: (1, 2, 3, 2), "quality": (1, 1, 3, 1)}.get(run.last_error_class, (0, 0, 0, 1))
        assert left == expect, run
    selected = Counter(r.run_id for r in read_committed(spark, whole, "candidates").where("selected").collect())
    assert selected == {k: 1 for k, r in runs.items() if r.status == "succeeded"}
    # The same commit again, and the same calls under a later number, leave the facts as they are.
    terminal.commit_terminal(spark, whole, 0, work, pages)
    assert _state(spark, whole) == once
    terminal.commit_terminal(spark, whole, 1, work.unionByName(work), pages)
    again = _state(spark, whole)
    assert {k: v for k, v in again.items() if k != "completions"} == {k: v for k, v in once.items() if k != "completions"}
    later = read_committed(spark, whole, "completions").groupBy("completion").agg(F.sum("n_calls").alias("n")).collect()
    n = work.count()
    queued = work.where("status = 'queued'").count()
    assert {r.completion: r.n for r in later} == {
        "applied": n - queued, "duplicate": 2 * (n - queued), "invalid_run_state": 3 * queued,
    }


def test_completion_stream_equals_one_commit(spark, sf, tmp_path):
    work, pages = _work(spark, sf)
    terminal.commit_terminal(spark, f"{tmp_path}/whole", 0, work, pages)
    stream = _stream(spark, work, f"{tmp_path}/in", 3)
    jobs.completion_stream(stream, pages, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert _state(spark, f"{tmp_path}/out") == _state(spark, f"{tmp_path}/whole")


def test_batch_form_of_distinct_messages(spark):
    """A repeat is dropped until the window of the message kept before it is over."""
    seconds = {"a": [0, 30, 119, 120, 239, 240, 1000], "b": [5], None: [1, 50, 200]}
    rows = [(k, T0 + timedelta(seconds=s), i) for k, times in seconds.items() for i, s in enumerate(times)]
    rows += [("a", T0, 99), ("a", None, 7), ("hot", T0, 500)]
    rows += [("hot", T0 + timedelta(seconds=s % 3600), s) for s in range(4000)]
    frame = spark.createDataFrame(rows, "message_id string, at timestamp, n int")
    kept = Counter((r.message_id, None if r.at is None else int((r.at - T0).total_seconds()), r.n)
                   for r in derived.distinct_messages(frame, "n", 120).collect())
    expect = [("a", 0, 0), ("a", 120, 3), ("a", 240, 5), ("a", 1000, 6), ("a", None, 7), ("b", 5, 0), (None, 1, 0), (None, 200, 2)]
    assert kept == Counter([*expect, *(("hot", s, s) for s in range(0, 3600, 120))])
    assert derived.distinct_messages(frame.limit(0), "n", 120).count() == 0


def test_batch_and_stream_forms_drop_the_same_repeats(spark, tmp_path):
    rows = [(f"m{k % 7}", T0 + timedelta(seconds=k), k) for k in range(60)]
    frame = spark.createDataFrame(rows, "message_id string, at timestamp, n int")
    stream = _stream(spark, frame, f"{tmp_path}/in", 1)
    query = (
        jobs.distinct_messages(stream).writeStream.format("memory").queryName("kept_forms")
        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    streamed = sorted(r.message_id for r in spark.table("kept_forms").collect())
    assert streamed == sorted(r.message_id for r in derived.distinct_messages(frame, "n").collect())


def test_rounds_of_distinct_messages_shrink_where_paths_meet(spark, monkeypatch):
    draw = random.Random(3)
    times = sorted(draw.sample(range(100_000), 3000))
    sizes, write = [], derived.kept_on_disk

    def counted(frame):
        found = write(frame)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(derived, "kept_on_disk", counted)
    frame = spark.createDataFrame(list(enumerate(times)), "n long, s long").select("n", F.lit("a").alias("message_id"), F.timestamp_seconds("s").alias("at"))
    got = sorted(r.n for r in derived.distinct_messages(frame, "n", 500).collect())
    want, free = [], 0
    for n, at in enumerate(times):
        if at >= free:
            want, free = [*want, n], at + 500
    assert got == want and len(want) > 128
    assert sum(sizes) < 7 * len(times)

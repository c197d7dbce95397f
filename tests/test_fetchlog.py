import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagemill.operators import blobs, derived, fetchlog, metrics, redirects

T0 = datetime(2024, 5, 1)


def test_media_type_sniffs_only_known_spellings(spark):
    rows = [
        (1, "%PDF-1.4 x", "text/html"), (2, " \n<!doctype html><p>", "text/plain"),
        (3, "<HTML>", "Text/Plain ; charset=x"), (4, "<html lang=en>", None), (5, "hello", " "),
        (6, " " * 600 + "<html>", "a/b"),
    ]
    frame = spark.createDataFrame(rows, "id int, body string, content_type string")
    found = {r.id: r.media_type for r in fetchlog.effective_media_type(frame).collect()}
    assert found == {
        1: "application/pdf", 2: "text/html", 3: "text/plain", 4: "text/html",
        5: "application/octet-stream", 6: "a/b",
    }


def test_outcome_order_and_limits(spark):
    rows = [
        (1, 503, 2, "gzip", 1, 1, 0), (2, 503, 3, "gzip", 1, 1, 0), (3, 404, 1, "odd", 1, 1, 0),
        (4, 200, 1, " GZIP ", 10, 10, 0), (5, 200, 1, "odd", 99, 99, 0), (6, 200, 1, "br", 11, 1, 0),
        (7, 200, 1, None, 10, 21, 0), (8, 200, 1, "", 10, 20, 11), (9, 304, 1, "", 0, 0, 0),
        (10, 307, 1, "", 0, 0, 0),
    ]
    frame = spark.createDataFrame(
        rows,
        "fetch_id int, http_status int, attempts int, content_encoding string, wire_bytes long, "
        "decoded_bytes long, declared_bytes long",
    )
    found = fetchlog.fetch_outcome(frame, max_wire_bytes=10, max_decoded_bytes=20)
    assert {r.fetch_id: (r.outcome, r.failure) for r in found.collect()} == {
        1: ("retry", None), 2: ("failed", "remote_status"), 3: ("failed", "remote_status"),
        4: ("success", None), 5: ("failed", "unsupported_encoding"),
        6: ("failed", "wire_body_too_large"), 7: ("failed", "decoded_body_too_large"),
        8: ("failed", "declared_body_too_large"), 9: ("not_modified", None), 10: ("redirect", None),
    }


def test_failure_classes_never_show_an_address(spark):
    frame = spark.createDataFrame(
        [("address_policy", "http://10.0.0.1/"), ("dns", "h"), ("dns", "h"), (None, "h")],
        "failure string, url string",
    )
    found = metrics.fetch_failures(frame)
    assert found.columns == ["failure_class", "n"]
    assert {r.failure_class: r.n for r in found.collect()} == {"policy_denied": 1, "dns": 2}


def test_retry_delay_equals_wrapping_arithmetic(spark):
    now = datetime(1994, 11, 6, 8, 49, 30)
    rows = [(i, i % 9, 7 * i + 1, None) for i in range(60)]
    rows += [
        (100, 0, 7, "2"), (101, 0, 7, "Sun, 06 Nov 1994 08:49:37 GMT"),
        (102, 0, 7, "Sunday, 06-Nov-94 08:49:37 GMT"), (103, 0, 7, "Sun Nov  6 08:49:37 1994"),
        (104, 0, 7, "Sun, 06 Nov 1994 08:00:00 GMT"), (105, 0, 7, "soon"),
    ]
    frame = spark.createDataFrame(
        [(*row, now) for row in rows],
        "id int, retry_index int, attempts long, retry_after string, now timestamp",
    )
    found = {r.id: r.delay_ms for r in fetchlog.retry_delay(frame).collect()}

    def jitter(index, seed):
        mixed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
        return mixed % (100 * 2 ** min(index, 6) + 1)

    for i, index, seed, _ in rows[:60]:
        assert found[i] == jitter(index, seed)
    assert [found[i] for i in (100, 101, 102, 103)] == [2000, 7000, 7000, 7000]
    assert found[104] == found[105] == jitter(0, 7)


def test_attempts_share_one_deadline(spark):
    rows = [(1, 1, 20_000, 0), (1, 2, 9_000, 500), (2, 1, 25_000, 0), (2, 2, 5_000, 100),
            (2, 3, 10, 0), (3, 1, 1, 0), (3, 2, 1, 0), (3, 3, 1, 0), (3, 4, 1, 0)]
    frame = spark.createDataFrame(rows, "fetch_id int, attempt int, duration_ms long, delay_ms long")
    found = {(r.fetch_id, r.attempt): r.status for r in fetchlog.retry_schedule(frame).collect()}
    assert found[(1, 2)] == "sent" and found[(2, 2)] == "timeout_total"
    assert found[(2, 3)] == "not_sent" and found[(3, 4)] == "not_sent"


def test_concurrency_equals_brute_force_with_a_hot_host(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        host = "hot" if i % 3 else f"h{i % 7}"
        start = T0 + timedelta(microseconds=rng.choice((0, 10, 999_999, rng.randrange(9 * 10**9))))
        rows.append((i, host, start, rng.choice((0.0, 0.5, 30.0, 4000.0))))
    frame = spark.createDataFrame(rows, "fetch_id int, host string, fetched_at timestamp, duration_s double")
    found = {r.fetch_id: r for r in fetchlog.concurrency_audit(frame, 8, 64).collect()}
    digest = {i: hashlib.sha256(str(i).encode()).hexdigest() for i, *_ in rows}
    for i, host, start, _ in rows:
        open_now = [
            r for r in rows
            if (r[2] < start or (r[2] == start and digest[r[0]] < digest[i]))
            and r[2] + timedelta(seconds=r[3]) > start
        ]
        same = sum(r[1] == host for r in open_now)
        assert (found[i].in_flight_host, found[i].in_flight_all) == (same, len(open_now))
        assert found[i].overloaded == (same >= 8 or len(open_now) >= 64)


def test_revalidation_needs_a_verified_earlier_body(spark):
    pages = spark.createDataFrame([(1, "body one"), (2, "body two")], "page_id int, html string")
    stored = blobs.stored_blobs(pages)
    one = stored.where("stored_bytes = 8").orderBy("digest_hex").collect()
    digest = one[0].digest_hex
    good = ("web-extract", "sha256", digest, "text/html", 8)
    short = ("web-extract", "sha256", digest, "text/html", 7)
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [
        (1, "u", at(1), 200, "e1", "m1", *good), (2, "u", at(2), 304, None, "m2", *good),
        (3, "v", at(1), 304, "e3", None, *good), (4, "w", at(1), 200, "e4", None, *short),
        (5, "w", at(90), 304, None, None, *good), (6, "u", at(200), 304, "e6", None, *good),
    ]
    frame = spark.createDataFrame(
        rows,
        "fetch_id int, url string, fetched_at timestamp, http_status int, etag string, "
        "last_modified string, owner_service string, digest_algorithm string, digest_hex string, "
        "media_type string, length_bytes long",
    )
    found = {r.fetch_id: r for r in fetchlog.revalidate(frame, stored).collect()}
    assert set(found) == {2, 3, 5, 6}
    assert (found[2].outcome, found[2].etag, found[2].last_modified) == ("revalidated", "e1", "m2")
    assert (found[2].wire_bytes, found[2].decoded_bytes) == (0, 8)
    assert found[3].outcome == "cache_integrity" and found[5].outcome == "cache_integrity"
    assert (found[6].prior_fetch_id, found[6].etag) == (1, "e6")


def test_blob_checks_run_in_order(spark):
    pages = spark.createDataFrame([(1, "abc")], "page_id int, html string")
    digest = blobs.stored_blobs(pages).first().digest_hex
    rows = [
        (1, "web-extract", "sha256", digest, "text/html", 3),
        (2, "someone", "md5", digest, "text/html", 3), (3, "web-extract", "md5", digest, "text/html", 3),
        (4, "web-extract", "sha256", digest, "no media type", 3),
        (5, "web-extract", "sha256", "0" * 64, "text/html", 3),
        (6, "web-extract", "sha256", digest, "text/html", 4),
    ]
    refs = spark.createDataFrame(
        rows,
        "id int, owner_service string, digest_algorithm string, digest_hex string, "
        "media_type string, length_bytes long",
    )
    found = {r.id: r.verification for r in blobs.verify_blobs(refs, blobs.stored_blobs(pages)).collect()}
    assert found == {
        1: "ok", 2: "wrong_owner", 3: "unsupported_algorithm", 4: "mismatch", 5: "missing",
        6: "mismatch",
    }


def test_redirect_outcomes(spark):
    rows = [(i, i + 1, True, False) for i in range(1, 13)] + [
        (13, None, False, False), (20, 21, True, False), (21, 20, True, False),
        (30, None, True, False), (40, 41, True, True), (50, 99, True, False),
    ]
    hops = spark.createDataFrame(
        rows, "url_id long, next_id long, is_redirect boolean, target_blocked boolean"
    )
    found = {r.start_id: (r.outcome, r.hops) for r in redirects.redirect_chains(hops).collect()}
    assert found[3] == ("final", 10) and found[2] == ("redirect_limit", 10)
    assert found[13] == ("final", 0) and found[20] == ("redirect_loop", 1)
    assert found[30] == ("redirect_location", 0) and found[40] == ("policy", 0)
    assert found[50] == ("unfetched", 1)


def test_histogram_is_cumulative(spark):
    frame = spark.createDataFrame([(0.005,), (0.3,), (31.0,), (0.0051,)], "duration_s double")
    found = {r.le: r.n for r in metrics.duration_histogram(frame).collect()}
    assert found["0.005"] == 1 and found["0.01"] == 2 and found["0.5"] == 3
    assert found["30"] == 3 and found["+Inf"] == 4 and len(found) == 12


def test_evidence_keeps_only_allowed_headers(spark):
    frame = spark.range(1).select(
        F.create_map(
            F.lit("ETag"), F.lit("x"), F.lit("COOKIE"), F.lit("y"), F.lit("cache-control"), F.lit("z")
        ).alias("headers")
    )
    assert fetchlog.project_safe_evidence(frame).first().headers == {"ETag": "x", "cache-control": "z"}


def test_redirect_hops_are_no_retries(spark):
    log = spark.createDataFrame(
        [(1, 503, 4, 3), (2, 503, 4, 0), (3, 503, 3, None)],
        "fetch_id int, http_status int, attempts int, redirects int",
    ).selectExpr("*", "'' as content_encoding", "1L as wire_bytes", "1L as decoded_bytes")
    found = {r["fetch_id"]: r["outcome"] for r in fetchlog.fetch_outcome(log).collect()}
    assert found == {1: "retry", 2: "failed", 3: "failed"}


def test_delays_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            rows = spark.sql(
                "select 1L as attempts, 0 as retry_index, retry_after, timestamp_seconds(784111717) as now "
                "from values ('Sun, 06 Nov 1994 08:49:37 GMT'), ('Sunday, 06-Nov-94 08:49:37 GMT'), "
                "('Sun Nov  6 08:49:37 1994'), ('00000000000000000060') as t(retry_after)"
            )
            delays = [r["delay_ms"] for r in fetchlog.retry_delay(rows).collect()]
            assert delays == [60_000] * 4, name
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_fetches_of_one_instant_count_those_before_them(spark):
    log = spark.range(3).selectExpr(
        "id as fetch_id", "'h' as host", "timestamp'2026-01-01 00:00:00' as fetched_at", "1.0D as duration_s"
    )
    found = fetchlog.concurrency_audit(log, host_limit=1).collect()
    assert sorted(r["in_flight_host"] for r in found) == [0, 1, 2]
    assert sum(r["overloaded"] for r in found) == 2


def test_audit_keeps_fetches_without_host_or_start(spark):
    log = spark.sql(
        "select * from values (1, cast(null as string), timestamp'2026-01-01 00:00:00', 10.0D), "
        "(2, null, timestamp'2026-01-01 00:00:05', 1.0D), (3, '', timestamp'2026-01-01 00:00:06', 1.0D), "
        "(4, 'a', null, 1.0D), (5, 'a', timestamp'2026-01-01 00:00:07', 1.0D) "
        "as t(fetch_id, host, fetched_at, duration_s)"
    )
    found = {r["fetch_id"]: (r["in_flight_host"], r["in_flight_all"]) for r in fetchlog.concurrency_audit(log).collect()}
    assert found == {1: (0, 0), 2: (1, 1), 3: (0, 1), 4: (None, None), 5: (0, 1)}


def test_sketched_percentiles_stay_within_their_rank_error(spark):
    n, accuracy = 60_000, 200
    log = spark.range(n).selectExpr(
        "if(id % 3 = 0, 'hot', concat('h', id % 7)) as host", "timestamp_seconds(id) as at", "id as observation_id",
        "'semantic' as strategy", "cast(id % 1001 as int) as score", "(id * 7919) % 1000003 as duration_ms",
        "false as escalated", "cast(null as string) as failure_class",
    )
    rows = {r.host: r for r in derived.host_strategy(log, accuracy=accuracy).collect()}
    values = {}
    for r in log.select("host", "duration_ms").collect():
        values.setdefault(r.host, []).append(r.duration_ms)
    for host, mine in values.items():
        for share, found in ((0.5, rows[host].p50_ms), (0.95, rows[host].p95_ms)):
            rank = sum(v <= found for v in mine) / len(mine)
            assert abs(rank - share) <= 1 / accuracy + 2 / len(mine)


def test_captures_and_answers_without_a_key_keep_their_row(spark):
    captures = spark.createDataFrame(
        [(None, 1, 10, "a"), (None, 2, 20, "a"), ("s", 3, 10, "a"), ("s", 4, None, "a"), ("", 5, 30, "a")],
        "source_id string, capture_id int, second int, digest string",
    ).selectExpr("source_id", "capture_id", "timestamp_seconds(second) as at", "digest")
    found = {r.capture_id: r.unchanged for r in derived.unchanged_content(captures).collect()}
    assert found == {1: False, 2: True, 3: False, 4: False, 5: False}
    columns = "fetch_id long, url string, second long, http_status int, etag string, last_modified string, owner_service string, digest_algorithm string, digest_hex string, media_type string, length_bytes long"
    rows = [(1, None, 5, 304), (2, "u", None, 304), (3, "u", 9, 304), (4, None, 1, 200)]
    log = spark.createDataFrame([(*r, None, None, "web-extract", "sha256", "0" * 64, "text/html", 3) for r in rows], columns)
    stored = spark.createDataFrame([("0" * 64, 3)], "digest_hex string, stored_bytes long")
    out = fetchlog.revalidate(log.selectExpr("*", "timestamp_seconds(second) as fetched_at"), stored).collect()
    assert {r.fetch_id: r.outcome for r in out} == {1: "cache_integrity", 2: "cache_integrity", 3: "cache_integrity"}

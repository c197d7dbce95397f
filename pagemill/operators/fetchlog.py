"""Audits over a fetch log: media types, encodings, outcomes, retries, revalidation, admission."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.carry import LATEST, SUM, before_each_instant
from pagemill.functions.text import ascii_lower
from pagemill.operators.blobs import verify_blobs

_HTML_PREFIX = r"^[ \t\n\f\r]*(?:<!DOCTYPE html|<!doctype html|<html)"


def effective_media_type(responses: DataFrame) -> DataFrame:
    """Add ``media_type`` from the first bytes of ``body`` and the declared ``content_type``.

    Only the exact spellings that the sniffer knows count as HTML.
    """
    head = F.decode(
        F.substring(F.col("body").cast("binary"), 1, rules.SNIFF_BYTES), "ISO-8859-1"
    )
    declared = ascii_lower(F.trim(F.substring_index("content_type", ";", 1)))
    return responses.withColumn(
        "media_type",
        F.when(head.startswith("%PDF-"), "application/pdf")
        .when(head.rlike(_HTML_PREFIX), "text/html")
        .otherwise(F.coalesce(F.nullif(declared, F.lit("")), F.lit("application/octet-stream"))),
    )


def require_html(fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(HTML fetches, rejected fetches with error class ``unsupported_media``)."""
    is_html = F.col("media_type") == "text/html"
    rejected = fetches.where(~is_html).withColumns(
        {"error_class": F.lit("unsupported_media"), "retryable": F.lit(False)}
    )
    return fetches.where(is_html), rejected


def encoding_of(content_encoding: Column) -> Column:
    value = ascii_lower(F.trim(F.coalesce(content_encoding, F.lit(""))))
    return F.when(value.isin("", "identity"), "identity").when(
        value.isin(*rules.CONTENT_ENCODINGS), value
    )


def classify_encoding(responses: DataFrame) -> DataFrame:
    """Add ``encoding`` and ``failure`` (unsupported_encoding when it is not known)."""
    encoding = encoding_of(F.col("content_encoding"))
    return responses.withColumns(
        {"encoding": encoding, "failure": F.when(encoding.isNull(), "unsupported_encoding")}
    )


def project_safe_evidence(responses: DataFrame) -> DataFrame:
    """Keep only allow-listed response headers; cookies and credentials never pass."""
    return responses.withColumn(
        "headers", F.map_filter("headers", lambda k, v: F.lower(k).isin(*rules.EVIDENCE_HEADERS))
    )


def fetch_outcome(
    log: DataFrame,
    max_wire_bytes: int = rules.MAX_WIRE_BYTES,
    max_decoded_bytes: int = rules.MAX_DECODED_BYTES,
    max_retries: int = rules.MAX_RETRIES,
) -> DataFrame:
    """Add ``outcome`` and ``failure`` to each logged response.

    Status decides first (retry, redirect, revalidation, refusal); then the declared length, the
    encoding, the bytes on the wire, the decoded bytes and a malformed stream, in that order.
    ``declared_bytes``, ``malformed``, ``retries`` and ``redirects`` are optional columns. Redirect
    hops are attempts but no retries: without ``retries`` they are taken from the attempts.
    """
    status = F.col("http_status")
    declared = F.col("declared_bytes") if "declared_bytes" in log.columns else F.lit(0)
    malformed = F.col("malformed") if "malformed" in log.columns else F.lit(False)
    redirects = F.coalesce("redirects", F.lit(0)) if "redirects" in log.columns else F.lit(0)
    retries = F.col("attempts") - 1 - redirects
    if "retries" in log.columns:
        retries = F.coalesce("retries", retries)
    outcome = (
        F.when(status.isin(*rules.TRANSIENT_STATUSES) & (retries < max_retries), "retry")
        .when(status.isin(*rules.REDIRECT_STATUSES), "redirect")
        .when(status == 304, "not_modified")
    )
    failure = F.when(outcome.isNull(), F.when(~status.between(200, 299), "remote_status")
        .when(declared > max_wire_bytes, "declared_body_too_large")
        .when(encoding_of(F.col("content_encoding")).isNull(), "unsupported_encoding")
        .when(F.col("wire_bytes") > max_wire_bytes, "wire_body_too_large")
        .when(F.col("decoded_bytes") > max_decoded_bytes, "decoded_body_too_large")
        .when(malformed, "malformed_encoding"))
    return log.withColumns(
        {
            "outcome": F.coalesce(
                outcome, F.when(failure.isNotNull(), "failed").otherwise("success")
            ),
            "failure": failure,
        }
    )


def _http_date(value: Column) -> Column:
    """The three date forms of HTTP, read in UTC whatever the session's zone; the weekday is
    dropped because its pattern is not portable."""
    bare = F.regexp_replace(value, "^[A-Za-z]+,? +", "")
    # Two-digit years from 70 on belong to the last century.
    short = r"^(\d{2}-[A-Za-z]{3}-)"
    full = F.regexp_replace(
        F.regexp_replace(bare, short + r"([7-9]\d) ", "$119$2 "), short + r"(\d{2}) ", "$120$2 "
    )

    def read(text: Column, form: str) -> Column:
        return F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{form} xx"))

    return F.coalesce(
        read(bare, "dd MMM yyyy HH:mm:ss 'GMT'"),
        read(full, "dd-MMM-yyyy HH:mm:ss 'GMT'"),
        read(F.regexp_replace(bare, " +", " "), "MMM d HH:mm:ss yyyy"),
    )


def retry_delay(attempts: DataFrame) -> DataFrame:
    """Add ``delay_ms`` from (retry_index, attempts, retry_after, now).

    The jitter is a 64-bit wrapping product, computed exactly as a decimal modulo 2^64. Seconds of
    any number of digits count; a delay beyond a long is the greatest long.
    """
    ceiling = F.lit(100) * F.pow(F.lit(2), F.least("retry_index", F.lit(6))).cast("bigint")
    mixed = F.expr(
        f"pmod(cast(attempts as decimal(18,0)) * {rules.JITTER_MULTIPLIER}BD"
        f" + {rules.JITTER_INCREMENT}BD, 18446744073709551616BD)"
    )
    jitter = F.expr("pmod(mixed_, cast(ceiling_ + 1 as decimal(20,0)))").cast("bigint")
    value = F.trim("retry_after")
    longest = F.lit(2**63 - 1)
    seconds = F.when(
        value.rlike("^[+]?[0-9]+$"),
        F.coalesce(F.try_multiply(value.try_cast("bigint"), F.lit(1000)), longest),
    )
    target = F.unix_millis(_http_date(value)) - F.unix_millis(F.col("now").cast("timestamp"))
    minimum = F.coalesce(seconds, F.greatest(target, F.lit(0)))
    return (
        attempts.withColumns({"mixed_": mixed, "ceiling_": ceiling})
        .withColumn("delay_ms", F.greatest(jitter, minimum))
        .drop("mixed_", "ceiling_")
    )


def retry_schedule(
    attempts: DataFrame,
    budget_seconds: float = rules.TOTAL_BUDGET_SECONDS,
    max_retries: int = rules.MAX_RETRIES,
) -> DataFrame:
    """(fetch_id, attempt, ..., elapsed_ms, status) with one deadline for all attempts.

    Input has (fetch_id, attempt, duration_ms, delay_ms); the delay precedes its attempt. A fetch
    has at most retries + 1 attempts, so its window group is a handful of rows. Statuses:
    ``sent``; ``timeout_total`` for the attempt that overruns the deadline; ``not_sent`` after it or
    beyond the retry limit.
    """
    order = Window.partitionBy("fetch_id").orderBy("attempt")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    budget = int(budget_seconds * 1000)
    spent = F.col("duration_ms") + F.col("delay_ms")
    timed = attempts.withColumns(
        {
            "elapsed_ms": F.sum(spent).over(upto),
            "before_ms": F.coalesce(F.sum(spent).over(earlier), F.lit(0)),
        }
    )
    status = (
        F.when((F.col("attempt") > max_retries + 1) | (F.col("before_ms") > budget), "not_sent")
        .when(F.col("elapsed_ms") > budget, "timeout_total")
        .otherwise("sent")
    )
    return timed.withColumn("status", status).drop("before_ms")


def attempts_per_fetch(attempts: DataFrame) -> DataFrame:
    """A10: transport attempts used by each fetch."""
    return attempts.groupBy("fetch_id").agg(F.count("*").alias("attempts"))


def _first_of_instant(spans: DataFrame, by: list[str], name: str) -> DataFrame:
    """Add ``name``: the lasting fetches of one group and instant that come before the row in digest order.

    The first digits of the digest split an instant; counts of the splits give the offset of each, so a
    moment in which a third of all fetches start is spread over 256 groups.
    """
    part = [*by, "split"]
    own = Window.partitionBy(*part).orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = spans.groupBy(*part).agg(F.sum("lasting").alias("n"))
    offsets = counts.select(*part, F.sum("n").over(earlier).alias("_offset")).where(F.col("_offset") > 0)
    ranked = spans.withColumn("_own", F.sum("lasting").over(own)).join(offsets, part, "left")
    total = F.coalesce(F.col("_own"), F.lit(0)) + F.coalesce(F.col("_offset"), F.lit(0))
    return ranked.withColumn(name, total).drop("_own", "_offset")


def concurrency_audit(
    log: DataFrame,
    host_limit: int = rules.HOST_CONCURRENCY,
    global_limit: int = rules.GLOBAL_CONCURRENCY,
) -> DataFrame:
    """(fetch_id, host, in_flight_host, in_flight_all, overloaded) per logged fetch.

    A fetch is in flight from its start until its start plus duration. The gate admits one fetch at a
    time, so of fetches that start at the same instant each counts those before it; a log does not tell
    their order, and the order of the digests of their ids is taken. Fetches without a host share one; a fetch without a start or a
    duration stays, counted by no other. Both counts are running sums over instants (see
    ``functions.carry``), so neither the busiest host nor the whole log meets in one task.
    """
    start = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    spans = log.select(
        "fetch_id", "host", F.concat_ws("", F.lit("="), "host").alias("key"),
        F.col("host").isNull().alias("none"), start.alias("start"),
        (start + F.round(F.col("duration_s") * 1_000_000).cast("bigint")).alias("stop"),
        F.sha2(F.col("fetch_id").cast("string"), 256).alias("digest"),
    )
    lasting = (F.col("stop") > F.col("start")).cast("int")
    nothing = F.lit(0)
    edges = spans.select(
        "key", "none",
        F.inline(
            F.array(
                F.struct(F.col("start").alias("at"), lasting.alias("opened"), nothing.alias("closed")),
                F.struct(F.col("stop").alias("at"), nothing.alias("opened"), lasting.alias("closed")),
            )
        ),
    )
    measures = {"opened": F.col("opened"), "closed": F.col("closed")}
    # A fetch that ends at the instant another one starts has left.
    waiting = F.col("opened_before") - F.col("closed_before") - F.col("closed")
    per_host = before_each_instant(edges, ["key", "none"], "at", measures, SUM).select(
        "key", "none", F.col("at").alias("start"), waiting.alias("in_flight_host")
    )
    overall = before_each_instant(edges, [], "at", measures, SUM).select(
        F.col("at").alias("start"), waiting.alias("in_flight_all")
    )
    spans = spans.withColumns(
        {"lasting": F.coalesce(lasting, F.lit(0)), "split": F.substring("digest", 1, 2)}
    )
    spans = _first_of_instant(spans, ["start"], "beside_all")
    spans = _first_of_instant(spans, ["key", "none", "start"], "beside_host")
    return (
        spans.join(per_host, ["key", "none", "start"], "left")
        .join(overall, "start", "left")
        .withColumn("in_flight_host", F.col("in_flight_host") + F.col("beside_host"))
        .withColumn("in_flight_all", F.col("in_flight_all") + F.col("beside_all"))
        .select(
            "fetch_id", "host", "in_flight_host", "in_flight_all",
            (
                (F.col("in_flight_host") >= host_limit) | (F.col("in_flight_all") >= global_limit)
            ).alias("overloaded"),
        )
    )


def revalidate(fetches: DataFrame, stored: DataFrame) -> DataFrame:
    """Resolve each 304 against the latest earlier 200 of its URL.

    ``fetches`` has (fetch_id, url, fetched_at, http_status, etag, last_modified, owner_service,
    digest_algorithm, digest_hex, media_type, length_bytes), the reference fields being those of the
    artifact a 200 stored. The reference is verified against ``stored`` blobs; the 304 then reuses
    its media type and length with no bytes on the wire, its validators falling back to the earlier
    ones. Without a verified artifact the outcome is ``cache_integrity``, and so it is for a 304
    without a URL or a time, which nothing can be earlier than.
    """
    reference = [
        "etag", "last_modified", "owner_service", "digest_algorithm", "digest_hex", "media_type",
        "length_bytes",
    ]
    timed = fetches.withColumn("at", F.unix_micros(F.col("fetched_at").cast("timestamp")))
    success = F.when(F.col("http_status") == 200, F.struct("at", "fetch_id", *reference))
    earlier = before_each_instant(timed, ["url"], "at", {"prior": success}, LATEST)
    waiting = timed.where(F.col("http_status") == 304).select(
        "fetch_id", "url", "at", "etag", "last_modified"
    )
    # Rows that cannot match get spread-out keys in place of null ones.
    waiting = waiting.withColumn("url", F.coalesce("url", F.concat(F.lit("-"), F.col("fetch_id").cast("string"))))
    found = waiting.join(earlier.select("url", "at", "prior_before"), ["url", "at"], "left").select(
        "fetch_id",
        F.col("prior_before.fetch_id").alias("prior_fetch_id"),
        F.coalesce("etag", "prior_before.etag").alias("etag"),
        F.coalesce("last_modified", "prior_before.last_modified").alias("last_modified"),
        *(F.col(f"prior_before.{name}").alias(name) for name in reference[2:]),
    )
    verified = verify_blobs(found, stored)
    usable = F.col("prior_fetch_id").isNotNull() & (F.col("verification") == "ok")

    def if_usable(name: str) -> Column:
        return F.when(usable, F.col(name)).alias(name)

    return verified.select(
        "fetch_id",
        "prior_fetch_id",
        F.when(usable, "revalidated").otherwise("cache_integrity").alias("outcome"),
        if_usable("etag"),
        if_usable("last_modified"),
        if_usable("media_type"),
        F.when(usable, F.lit(0).cast("bigint")).alias("wire_bytes"),
        F.when(usable, F.col("length_bytes")).alias("decoded_bytes"),
    )

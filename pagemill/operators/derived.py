"""Views and features derived from documents, decisions and their history."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.carry import EARLIEST, LATEST, before_each_instant
from pagemill.functions.plan import kept_on_disk

# Words whose blocks mark a page as a gate rather than an article.
GATE_MARKERS = ("sign in", "log in", "cookies", "subscribe", "consent")


def host_strategy(observations: DataFrame, ttl_hours: int = 24, accuracy: int | None = None) -> DataFrame:
    """One row per host: preferred strategy, success and escalation rates per mille, median
    quality, p50/p95 latency in ms, last failure class and expiry.

    Input: (host, at, observation_id, strategy, score, duration_ms, escalated, failure_class).
    Exact percentiles keep one counter per distinct value of a host. Scores are at most 1001 values;
    latencies are as many as the log holds, which is little where they are whole milliseconds of fetches
    with a deadline. For any other log give ``accuracy``: percentiles then come from mergeable sketches
    of about that many entries per host, and their rank is off by at most 1/accuracy of the rows. Both
    combine before the shuffle, so a host with a third of all rows is no special case.
    """
    ok = F.col("failure_class").isNull()

    def quantile(value: Column | str, share: float) -> Column:
        return F.percentile(value, share) if accuracy is None else F.percentile_approx(value, share, accuracy).cast("double")

    totals = observations.groupBy("host").agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("successes"),
        F.count_if("escalated").alias("escalations"),
        quantile(F.when(ok, F.col("score")), 0.5).alias("median_quality"),
        quantile("duration_ms", 0.5).alias("p50_ms"),
        quantile("duration_ms", 0.95).alias("p95_ms"),
        F.max(F.when(~ok, F.struct("at", "observation_id", "failure_class")))["failure_class"].alias(
            "last_failure_class"
        ),
        (F.max("at") + F.make_dt_interval(hours=F.lit(ttl_hours))).alias("expires_at"),
    )
    votes = (
        observations.where(ok).groupBy("host", "strategy").agg(F.count("*").alias("votes"))
        .groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "strategy"))["strategy"]
                             .alias("preferred_strategy"))
    )
    per_mille = lambda part: F.expr(f"{part} * 1000 div n").cast("bigint")
    return totals.join(votes, "host", "left").select(
        "host", "preferred_strategy", per_mille("successes").alias("success_rate"),
        per_mille("escalations").alias("escalation_rate"), "median_quality", "p50_ms", "p95_ms",
        "last_failure_class", "expires_at",
    )


def unchanged_content(captures: DataFrame) -> DataFrame:
    """(source_id, capture_id, unchanged): whether a capture equals the source's previous one.

    Input: (source_id, capture_id, at, digest). The previous digest is a running "latest" over
    instants, so a source captured very often is not one window group. Captures without a source
    share one; a capture without a time has no previous one and is no other's.
    """
    timed = captures.withColumns(
        {
            "micros": F.unix_micros(F.col("at").cast("timestamp")),
            "key": F.coalesce(F.col("source_id").cast("string"), F.lit("")),
            "none": F.col("source_id").isNull(),
        }
    )
    seen = F.struct("micros", "capture_id", "digest")
    key = ["key", "none", "micros"]
    earlier = before_each_instant(timed, key[:2], "micros", {"seen": seen}, LATEST)
    earlier = earlier.select(*key, F.col("seen_before.digest").alias("previous"))
    return timed.join(earlier, key, "left").select(
        "source_id", "capture_id",
        F.coalesce(F.col("digest") == F.col("previous"), F.lit(False)).alias("unchanged"),
    )


def plain_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")


def markdown(blocks: Column) -> Column:
    line = lambda b: F.when(
        b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])
    ).otherwise(b["text"])
    return F.array_join(F.transform(blocks, line), "\n\n")


def bounded_context(blocks: Column, max_bytes: int) -> Column:
    """The longest run of leading whole blocks that fits ``max_bytes``, joined by newlines."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(state: Column, block: Column) -> Column:
        joined = F.when(state["text"] == "", block["text"]).otherwise(
            F.concat(state["text"], F.lit("\n"), block["text"])
        )
        fits = ~state["full"] & (F.octet_length(joined) <= max_bytes)
        return F.struct(
            F.when(fits, joined).otherwise(state["text"]).alias("text"), (~fits).alias("full")
        )

    return F.aggregate(blocks, start, step, lambda state: state["text"])


def derived_views(documents: DataFrame, max_bytes: int = 2000) -> DataFrame:
    """(page_id, plain_text, markdown, context)."""
    blocks = F.col("blocks")
    return documents.select(
        "page_id",
        plain_text(blocks).alias("plain_text"),
        markdown(blocks).alias("markdown"),
        bounded_context(blocks, max_bytes).alias("context"),
    )


def block_citations(documents: DataFrame) -> DataFrame:
    """One citable row per block: digest prefix and index."""
    return documents.select(
        "page_id", F.substring("content_digest", 1, 12).alias("short"),
        F.posexplode("blocks").alias("block_index", "b"),
    ).select(
        "page_id", "block_index",
        F.concat_ws("#", "short", F.col("block_index").cast("string")).alias("citation"),
        F.col("b.text").alias("text"),
    )


def escalation_flags(decisions: DataFrame) -> DataFrame:
    """(page_id, reason): empty_shell, low_score, or null when static extraction sufficed."""
    longest = F.array_max(F.transform("candidates", lambda c: c["metrics"]["text_characters"]))
    return decisions.select(
        "page_id",
        F.when(longest == 0, "empty_shell")
        .when(F.col("winner").isNull(), "low_score")
        .alias("reason"),
    )


def page_features(documents: DataFrame) -> DataFrame:
    """P5: (page_id, n_blocks, duplicate_share, text_share, gate_markers), shares per mille of the blocks
    and of the source's bytes; a narrow job."""
    texts = F.transform("blocks", lambda b: b["text"])
    gate = F.filter(
        "texts",
        lambda t: F.lower(t).rlike("|".join(GATE_MARKERS)),
    )
    return (
        documents.select(
            "page_id", F.col("source.length_bytes").alias("length_bytes"), texts.alias("texts"),
            F.aggregate(
                "blocks", F.lit(0).cast("bigint"), lambda n, b: n + F.octet_length(b["text"])
            ).alias("text_bytes"),
        )
        .select(
            "page_id",
            F.size("texts").alias("n_blocks"),
            F.expr("(size(texts) - size(array_distinct(texts))) * 1000 div size(texts)").alias(
                "duplicate_share"
            ),
            F.expr("text_bytes * 1000 div length_bytes").alias("text_share"),
            F.size(gate).alias("gate_markers"),
        )
    )


def shadow_comparison(left: DataFrame, right: DataFrame, redone: DataFrame | None = None) -> DataFrame:
    """(page_id, verdict, score_delta) of two extraction versions of the same pages.

    Verdicts: equal, changed, only_left, only_right. Inputs have (page_id, score, content_digest).
    Where ``redone`` is given, its distinct page_id are the pages that ``right`` was extracted from anew;
    all others have in it what ``left`` has.
    """
    a = left.select("page_id", F.col("score").alias("a_score"), F.col("content_digest").alias("a"))
    b = right.select("page_id", F.col("score").alias("b_score"), F.col("content_digest").alias("b"))
    verdict = (
        F.when(F.col("b").isNull(), "only_left")
        .when(F.col("a").isNull(), "only_right")
        .when(F.col("a") == F.col("b"), "equal")
        .otherwise("changed")
    )
    both = a.join(b, "page_id", "full_outer")
    if redone is not None:
        both = both.join(redone.select("page_id", F.lit(True).alias("again")), "page_id", "left").select(
            "page_id", "a", "a_score",
            *(F.when(F.col("again"), F.col(right_)).otherwise(F.col(left_)).alias(right_) for left_, right_ in (("a", "b"), ("a_score", "b_score"))),
        )
    return both.select(
        "page_id", verdict.alias("verdict"), (F.col("b_score") - F.col("a_score")).alias("score_delta")
    )


def distinct_messages(messages: DataFrame, order: str, window_seconds: int = rules.DUPLICATE_SECONDS) -> DataFrame:
    """X2 over a whole table: messages with their repeats dropped, row by row in time.

    A repeat of ``message_id`` is dropped until ``window_seconds`` after the message that was kept
    before it; the next one is kept and opens the next window. Of one id's messages at one instant the
    first by ``order`` counts. Messages without an id share one; a message without a time is kept.

    Each instant of an id has one link: to the first instant at least a window later, found by running
    minima over instants (see ``functions.carry``). The kept instants are those on the path of links
    from an id's first one. The path is walked by doubling, so rounds grow with the logarithm of the
    longest path and no task holds an id's history. Links of 1, 2, 4, ... steps are made only from
    instants that links of half their steps reach, and from first ones: paths flow together, so these
    become fewer in each round. Walking back, each length adds the instants half way between those already
    kept. Each round is written; one number a round reaches the driver.
    """
    keyed = messages.withColumns(
        {
            "_key": F.coalesce(F.col("message_id").cast("string"), F.lit("")),
            "_none": F.col("message_id").isNull(),
            "_at": F.unix_micros(F.col("at").cast("timestamp")),
        }
    )
    key = ["_key", "_none"]
    instants = keyed.where(F.col("_at").isNotNull()).groupBy(*key, "_at").agg(F.min(order).alias("_first"))
    instants = kept_on_disk(instants)
    window = F.lit(window_seconds * 1_000_000).cast("bigint")
    # A probe just before the end of an instant's window looks for the next instant after it.
    none = F.lit(None).cast("bigint")
    probes = instants.select(*key, (F.col("_at") + window - 1).alias("_at"), none.alias("seen"), F.col("_at").alias("own"))
    both = instants.select(*key, "_at", F.col("_at").alias("seen"), none.alias("own")).unionByName(probes)
    measures = {"seen": F.col("seen"), "own": F.col("own")}
    later = before_each_instant(both, key, "_at", measures, EARLIEST, descending=True)
    links = later.where(F.col("seen_before").isNotNull() & F.col("own").isNotNull()).select(
        *key, F.col("own").alias("_at"), F.col("seen_before").alias("_next")
    )
    kept = kept_on_disk(instants.groupBy(*key).agg(F.min("_at").alias("_at")))
    lengths = []
    links = kept_on_disk(links)
    while links.count():
        lengths.append(links)
        ends = links.select(*key, F.col("_next").alias("_at")).unionByName(kept)
        inner = kept_on_disk(links.join(ends, [*key, "_at"], "left_semi"))
        onward = inner.withColumnRenamed("_next", "_mid").join(
            inner.select(*key, F.col("_at").alias("_mid"), "_next"), [*key, "_mid"]
        )
        links = kept_on_disk(onward.select(*key, "_at", "_next"))
    for links in reversed(lengths):
        reached = kept.join(links, [*key, "_at"]).select(*key, F.col("_next").alias("_at"))
        kept = kept_on_disk(kept.unionByName(reached))
    firsts = instants.join(kept, [*key, "_at"], "left_semi").select(*key, "_at", F.col("_first").alias(order))
    timed = keyed.join(firsts, [*key, "_at", order], "left_semi").select(*messages.columns)
    return timed.unionByName(messages.where(F.col("at").isNull()))


def retained(
    messages: DataFrame,
    now: Column,
    max_age_hours: int = rules.RETENTION_HOURS,
    max_messages: int = rules.RETENTION_MESSAGES,
    max_bytes: int = rules.RETENTION_BYTES,
) -> DataFrame:
    """Messages an event stream keeps: young enough, and the newest within count and bytes.

    Input: (message_id, at, bytes). Newest first, ties by id; the first message that does not fit
    ends the kept run. Running totals come from instants (see ``functions.carry``); only the one
    instant at which the limit falls is ranked row by row, and never more than ``max_messages`` of
    its rows.
    """
    young = messages.where(
        F.col("at") >= now - F.make_dt_interval(hours=F.lit(max_age_hours))
    ).withColumn("micros", F.unix_micros(F.col("at").cast("timestamp")))
    measures = {"n": F.lit(1), "size": F.col("bytes")}
    totals = before_each_instant(young, [], "micros", measures, descending=True)
    totals = totals.select(
        "micros", "n_before", "size_before",
        (
            (F.col("n_before") + F.col("n") <= max_messages)
            & (F.col("size_before") + F.col("size") <= max_bytes)
        ).alias("whole"),
        ((F.col("n_before") < max_messages) & (F.col("size_before") < max_bytes)).alias("open"),
    )
    joined = young.join(totals.where("open"), "micros")
    inside = joined.where("whole").select(*messages.columns)
    # At most one instant is open without fitting whole.
    order = Window.partitionBy("micros").orderBy("message_id")
    edge = joined.where(~F.col("whole")).withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= max_messages
    )
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("bytes").over(running)).where(
        (F.col("n_before") + F.col("place") <= max_messages)
        & (F.col("size_before") + F.col("upto") <= max_bytes)
    )
    return inside.unionByName(edge.select(*messages.columns))

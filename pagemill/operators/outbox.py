"""The outbox: due rows, publication results, backoff and dead letters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules

MAX_PASS = 1000

def due_outbox(outbox: DataFrame, now: Column, limit: int | None = rules.OUTBOX_BATCH) -> DataFrame:
    """Unpublished live rows whose time has come and whose lease is free.

    With a limit, the oldest rows of one pass; Spark keeps only that many per task. A pass holds 1 to
    1000 rows; another limit is an error. With none, all due rows in no order, for a sink that takes a
    whole table at once.
    """
    if limit is not None and not 1 <= limit <= MAX_PASS:
        raise ValueError(f"a pass holds 1 to {MAX_PASS} rows, not {limit}")
    due = outbox.where(
        F.col("published_at").isNull()
        & F.col("dead_lettered_at").isNull()
        & (F.col("next_attempt_at") <= now)
        & (F.col("claimed_until").isNull() | (F.col("claimed_until") <= now))
    )
    if limit is None:
        return due
    return due.orderBy("next_attempt_at", "enqueued_at", "outbox_id").limit(limit)


def backoff_seconds(attempts: Column) -> Column:
    """Seconds until the next attempt, from the attempts made before this failure."""
    return F.least(
        F.lit(rules.MAX_BACKOFF_SECONDS),
        F.pow(F.lit(2), F.least(attempts, F.lit(20))).cast("int"),
    )


def safe_error(error: Column) -> Column:
    """Error text without line breaks, first 512 characters."""
    return F.substring(F.translate(error, "\r\n", ""), 1, 512)


def _after_failure(now: Column, error: Column) -> dict[str, Column]:
    attempts = F.col("attempts")
    return {
        "next_attempt_at": now + F.make_dt_interval(secs=backoff_seconds(attempts)),
        "dead_lettered_at": F.when(attempts + 1 >= rules.MAX_OUTBOX_ATTEMPTS, now),
        "last_error": safe_error(error),
        "claimed_until": F.lit(None).cast("timestamp"),
        "claimed_by": F.lit(None).cast("string"),
        "attempts": attempts + 1,
    }


def outbox_backoff(failed: DataFrame, now: Column) -> DataFrame:
    """Failed rows after their failure: one more attempt, later retry, or a dead letter."""
    return failed.withColumns(_after_failure(now, F.col("last_error")))


def _after(now: Column) -> dict[str, Column]:
    """Columns that a pass changes, for rows with its result in ``_told``."""
    published = F.col("_told.published")
    nothing = F.lit(None)
    closed = {"published_at": now, "claimed_until": nothing, "claimed_by": nothing, "last_error": nothing}
    failed = _after_failure(now, F.col("_told.error"))
    return {
        name: F.when(published, closed.get(name, F.col(name)))
        .when(~published, failed.get(name, F.col(name)))
        .otherwise(F.col(name))
        for name in {**closed, **failed}
    }


def _told(results: DataFrame) -> DataFrame:
    return results.select("outbox_id", F.struct("published", "error").alias("_told"))


def apply_results(outbox: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Outbox after a pass: published rows are closed, failed ones backed off, others unchanged.

    ``results`` has (outbox_id, published, error) for the rows of the pass. One join; each column
    then takes its value by the result.
    """
    joined = outbox.join(_told(results), "outbox_id", "left")
    return joined.withColumns(_after(now)).select(*outbox.columns)


def changed_rows(due: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The rows of a pass alone, as they are after it."""
    return due.join(_told(results), "outbox_id").withColumns(_after(now)).select(*due.columns)


def current_rows(outbox: DataFrame, changes: DataFrame) -> DataFrame:
    """The outbox after all passes: for each row the change of the last pass, else the row itself."""
    rest = [c for c in outbox.columns if c != "outbox_id"]
    both = outbox.withColumn("pass_id", F.lit(None).cast("bigint")).unionByName(changes)
    newest = F.max_by(F.struct(*rest), F.coalesce("pass_id", F.lit(-1))).alias("newest")
    return both.groupBy("outbox_id").agg(newest).select("outbox_id", "newest.*").select(*outbox.columns)


def outbox_report(results: DataFrame) -> DataFrame:
    """Claimed, published, failed and dead-lettered rows of a pass.

    ``results`` has (attempts, published) per claimed row, attempts as they were before the pass.
    """
    failed = ~F.col("published")
    return results.agg(
        F.count("*").alias("claimed"),
        F.count_if(F.col("published")).alias("published"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & (F.col("attempts") + 1 >= rules.MAX_OUTBOX_ATTEMPTS)).alias(
            "dead_lettered"
        ),
    )

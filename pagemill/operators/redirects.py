"""Redirect chains over a table of recorded hops."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.plan import kept_on_disk

_PATH = "array<string>"


def _compose(walks: DataFrame, steps: DataFrame) -> DataFrame:
    """Walks (start_id, at, path, outcome) carried on by ``steps`` (at, more, ends).

    A walk that has ended looks for a key of its own, so ended walks stay spread out and match nothing.
    """
    live = F.col("outcome").isNull()
    wanted = F.when(live, F.col("at")).otherwise(F.concat(F.lit("ended "), F.col("start_id").cast("string")))
    joined = walks.withColumn("wanted", wanted).join(steps.withColumnRenamed("at", "wanted"), "wanted", "left")
    ends = F.when(F.col("more").isNull(), "unfetched").otherwise(F.col("ends"))
    path = F.when(live, F.concat("path", F.coalesce("more", F.array().cast(_PATH)))).otherwise(F.col("path"))
    return joined.select("start_id", path.alias("path"), F.when(live, ends).otherwise(F.col("outcome")).alias("outcome")).select(
        "start_id", F.coalesce(F.try_element_at("path", F.lit(-1)), F.col("start_id").cast("string")).alias("at"), "path", "outcome"
    )


def _doubled(steps: DataFrame) -> DataFrame:
    """Twice as many moves per step."""
    walks = steps.select(
        F.col("at").alias("start_id"), F.coalesce(F.try_element_at("more", F.lit(-1)), F.col("at")).alias("at"),
        F.col("more").alias("path"), F.col("ends").alias("outcome"),
    )
    doubled = _compose(walks, steps)
    # Both sides of the next join read it, so it is computed once.
    return kept_on_disk(doubled.select(F.col("start_id").alias("at"), F.col("path").alias("more"), F.col("outcome").alias("ends")))


def _first_return(places: Column) -> Column:
    """Position of the first place that stands earlier in the array, or null."""
    found = F.filter(
        F.sequence(F.lit(1), F.size(places) - 1),
        lambda k: F.array_position(places, F.element_at(places, k + 1)) <= k,
    )
    return F.when(F.size(places) > 1, F.try_element_at(found, F.lit(1)))


def redirect_chains(hops: DataFrame, max_redirects: int = rules.MAX_REDIRECTS) -> DataFrame:
    """(start_id, outcome, hops, final_id) for every URL of ``hops``.

    ``hops`` has one row per URL: (url_id, next_id) and optionally ``is_redirect`` (default: next_id
    is present) and ``target_blocked`` (the target violates address policy). Outcomes: final,
    redirect_limit, redirect_location, policy, redirect_loop, or unfetched when the log lacks the
    target.

    Chains advance by doubling: steps of 1, 2, 4 and 8 moves, each made by joining the one before with
    itself, compose to the ten moves allowed, so the default takes five joins. Ended chains match
    nothing. A loop is a place that returns among the at most eleven a chain has seen. Many chains may
    wait at one popular target; that side is an ordinary skewed join input, which adaptive execution
    splits, and the other side has one row per URL.
    """
    redirects = F.col("is_redirect") if "is_redirect" in hops.columns else F.col("next_id").isNotNull()
    blocked = F.col("target_blocked") if "target_blocked" in hops.columns else F.lit(False)
    here, target = F.col("url_id").cast("string"), F.col("next_id").cast("string")
    ends = (
        F.when(~redirects, "final")
        .when(target.isNull(), "redirect_location")
        .when(blocked, "policy")
    )
    single = hops.select(
        here.alias("at"),
        F.when(ends.isNull(), F.array(target)).otherwise(F.array().cast(_PATH)).alias("more"),
        ends.alias("ends"),
    )
    walks, steps, left = None, single, max_redirects
    tables = []
    while left:
        tables.append((left % 2, steps))
        left //= 2
        if left:
            steps = _doubled(steps)
    for used, steps in reversed(tables):
        if used and walks is None:
            # The longest step already starts at every URL.
            walks = steps.select(
                F.col("at").alias("start_id"),
                F.coalesce(F.try_element_at("more", F.lit(-1)), F.col("at")).alias("at"),
                F.col("more").alias("path"), F.col("ends").alias("outcome"),
            )
        elif used:
            walks = _compose(walks, steps)
    if walks is None:
        walks = hops.select(here.alias("start_id"), here.alias("at"), F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("outcome"))
    # After the last move only the place itself counts: whether it is fetched, and final.
    last = single.select("at", F.array().cast(_PATH).alias("more"), F.when(F.col("ends") == "final", "final").otherwise("redirect_limit").alias("ends"))
    places = F.concat(F.array("start_id"), F.col("path"))
    returned = _first_return(places)
    chains = _compose(walks, last).withColumn("returned", returned)
    looped = F.col("returned").isNotNull() & (F.col("returned") <= max_redirects)
    # Ids keep their type: the walks carry them as text.
    return chains.select(
        F.col("start_id").cast(hops.schema["url_id"].dataType).alias("start_id"),
        F.when(looped, "redirect_loop").otherwise(F.col("outcome")).alias("outcome"),
        F.when(looped, F.col("returned") - 1).otherwise(F.size("path")).alias("hops"),
        F.when(looped, F.element_at(places, F.col("returned"))).otherwise(F.col("at")).alias("final_id"),
    )

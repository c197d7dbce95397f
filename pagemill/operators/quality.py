"""Integer quality scores, acceptance and the choice of one winner per page.

The three decisions of a page are elements of one array, so scoring and selection need neither a
shuffle nor a window. ``select_winner`` does the same for candidate tables that arrive as rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.text import ascii_lower
from pagemill.functions.plan import once
from pagemill.operators.candidates import page_candidates
from pagemill.operators.tokens import refusal


def _floor_div(value: Column, divisor: Column) -> Column:
    """Integer quotient of two non-negative integers."""
    return ((value - value % divisor) / divisor).cast("int")


def _component(value: Column, full: int, weight: int) -> Column:
    return _floor_div(F.least(value, F.lit(full)) * weight, F.lit(full))


def _share(total: Column, excluded: Column, weight: int) -> Column:
    kept = total - F.least(excluded, total)
    return F.when(total == 0, 0).otherwise(
        _floor_div(kept * weight, F.greatest(total, F.lit(1)))
    )


def metrics(
    text: Column, paragraphs: Column, links: Column, boilerplate: Column, agrees: Column
) -> Column:
    """The seven quality components as a struct."""
    return F.struct(
        text.cast("int").alias("text_characters"),
        paragraphs.cast("int").alias("paragraph_count"),
        _component(text, 300, 300).alias("text_volume"),
        _component(paragraphs, 4, 200).alias("paragraph_distribution"),
        _share(text, links, 200).alias("non_link_share"),
        _share(text, boilerplate, 200).alias("non_boilerplate_share"),
        F.when(agrees, 100).otherwise(0).alias("title_agreement"),
    )


def total_score(components: Column) -> Column:
    return (
        components["text_volume"]
        + components["paragraph_distribution"]
        + components["non_link_share"]
        + components["non_boilerplate_share"]
        + components["title_agreement"]
    )


def is_accepted(text: Column, score: Column) -> Column:
    return (text >= rules.MIN_TEXT_BYTES) & (score >= rules.MIN_SCORE)


def decision_reasons(text: Column, score: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(is_accepted(text, score), F.lit("accepted")),
            F.when(text < rules.MIN_TEXT_BYTES, F.lit("too_short")),
            F.when(score < rules.MIN_SCORE, F.lit("below_threshold")),
        )
    )


def _heading_agrees(blocks: Column, title: Column) -> Column:
    wanted = ascii_lower(title)
    return F.coalesce(
        F.exists(
            blocks, lambda b: (b["kind"] == "heading") & (ascii_lower(b["text"]) == wanted)
        ),
        F.lit(False),
    )


def candidate_blocks(candidate: Column, blocks: Column) -> Column:
    size = candidate["block_to"] - candidate["block_from"]
    return F.slice(blocks, (candidate["block_from"] + 1).cast("int"), size.cast("int"))


def decide(shared: DataFrame) -> DataFrame:
    """Replace ``candidates`` of the page-level row by scored decisions, one marked selected."""
    blocks, title = F.col("blocks"), F.col("title")

    def measured(candidate: Column) -> Column:
        own = candidate_blocks(candidate, blocks)
        paragraphs = F.size(F.filter(own, lambda b: b["kind"] == "paragraph"))
        return F.struct(
            candidate["strategy"].alias("strategy"),
            candidate["priority"].alias("priority"),
            candidate["block_from"].alias("block_from"),
            candidate["block_to"].alias("block_to"),
            metrics(
                candidate["text"], paragraphs, candidate["links"], candidate["boilerplate"],
                _heading_agrees(own, title),
            ).alias("metrics"),
        )

    def scored(candidate: Column) -> Column:
        score = total_score(candidate["metrics"])
        text = candidate["metrics"]["text_characters"]
        return F.struct(
            candidate["strategy"].alias("strategy"),
            candidate["priority"].alias("priority"),
            candidate["block_from"].alias("block_from"),
            candidate["block_to"].alias("block_to"),
            candidate["metrics"].alias("metrics"),
            score.alias("score"),
            is_accepted(text, score).alias("accepted"),
            decision_reasons(text, score).alias("reasons"),
        )

    best = F.array_max(
        F.transform(
            F.filter("candidates", lambda c: c["accepted"]),
            lambda c: F.struct(c["score"].alias("score"), (-c["priority"]).alias("order")),
        )
    )
    decisions = once(
        shared.withColumn("candidates", F.transform("candidates", measured)),
        ["page_id", "title", "language", "recovery", "blocks", "source"],
        [F.transform("candidates", scored).alias("candidates")],
    )
    return decisions.withColumn("winner", -best["order"])


def page_decisions(pages: DataFrame, **limits) -> DataFrame:
    """(page_id, title, language, recovery, blocks, source, candidates, winner); winner null if rejected."""
    return decide(page_candidates(pages, **limits))


def refused_pages(pages: DataFrame, **limits) -> DataFrame:
    """(page_id, outcome, error_class) of the pages that are not parsed; a narrow job.

    A page without an id is ``missing_id``: nothing could name its document.
    """
    why = F.when(F.col("page_id").isNull(), "missing_id").otherwise(refusal(F.col("html"), **limits))
    refused = pages.select("page_id", why.alias("outcome")).where(F.col("outcome").isNotNull())
    return refused.withColumn("error_class", F.lit("parse"))


def decided_pages(decisions: DataFrame) -> DataFrame:
    """(page_id, outcome, error_class) of the parsed pages: ``document`` or ``low_quality``."""
    lost = F.col("winner").isNull()
    return decisions.select(
        "page_id",
        F.when(lost, "low_quality").otherwise("document").alias("outcome"),
        F.when(lost, "quality").alias("error_class"),
    )


def page_outcomes(pages: DataFrame, **limits) -> DataFrame:
    """(page_id, outcome, error_class): exactly one row per page that came in."""
    refused = refused_pages(pages, **limits)
    return decided_pages(page_decisions(pages, **limits)).unionByName(refused)


def candidate_rows(decisions: DataFrame) -> DataFrame:
    """E11 to E14 as rows: three decisions per page in strategy order, at most one selected."""
    return decisions.select(
        "page_id", "winner", F.explode("candidates").alias("c")
    ).select(
        "page_id",
        "c.strategy",
        F.lit(rules.EVALUATOR_VERSION).alias("extractor_version"),
        "c.priority",
        "c.metrics",
        "c.score",
        "c.accepted",
        "c.reasons",
        F.coalesce(F.col("c.priority") == F.col("winner"), F.lit(False)).alias("selected"),
    )


def low_quality(decisions: DataFrame) -> DataFrame:
    """The three unselected decisions of every parsed page without an accepted candidate; pages
    over a limit have no decisions and stand in ``page_outcomes``."""
    return candidate_rows(decisions.where(F.col("winner").isNull())).withColumn(
        "error_class", F.lit("quality")
    )


def select_winner(candidates: DataFrame) -> DataFrame:
    """Mark one accepted row per page: highest score, ties to the lowest ``priority``.

    A page has one row per strategy, so each window group is a handful of rows.
    """
    ranked = Window.partitionBy("page_id").orderBy(
        F.col("accepted").desc(), F.col("score").desc(), "priority"
    )
    return candidates.withColumn(
        "selected", F.col("accepted") & (F.row_number().over(ranked) == 1)
    )

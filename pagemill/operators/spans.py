"""Element spans: where each block, container, boilerplate region and link starts and ends.

Everything here is windows over token rows that already sit in one partition per page, so the job
adds sorts but no exchange. Frames are running frames only; "the next closer" is read from a
descending window, which keeps the work linear in the number of tokens.

Recovery rules (a subset of the HTML standard):

* containers and boilerplate pair by name and depth; unmatched end tags are ignored and unclosed
  elements end with the enclosing one, or at the end of the page;
* a paragraph ends at any start or end tag that closes paragraphs, or with its container;
* a heading ends at any heading tag of its level of nesting, or with its container; a paragraph
  does not close a heading, so both hold the nested text;
* a link ends at any link tag of its level of nesting, or with its container;
* ``body`` starts at its tag or at the first content and ends with the page.

Formatting elements that a browser would re-open in later blocks are counted as written.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.operators.tokens import explode_tokens, language_of, token_kind, token_name, token_text

_STRUCTURAL = rules.CONTAINERS + rules.BOILERPLATE
_BLOCKS = rules.HEADINGS + ("p",)
TRACKED = _STRUCTURAL + _BLOCKS + ("a",)


def _before(partition: list, order: Column | list) -> Window:
    order = order if isinstance(order, list) else [order]
    return (
        Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )


def _upto(partition: list, order: Column | list) -> Window:
    order = order if isinstance(order, list) else [order]
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def counted_tags(arrays: DataFrame) -> DataFrame:
    """Tag rows that matter for spans, each with running element counts and page totals."""
    token = F.col("token")
    typed = explode_tokens(arrays).withColumn("kind", token_kind(token)).withColumn(
        "name", F.when(F.col("kind").isin("start", "raw", "end"), token_name(token))
    )
    started = F.col("kind").isin("start", "raw")
    counted = started & ~F.col("name").isin("html", "head", "body")
    text = token_text(token, F.col("kind"))
    rows = typed.select(
        "page_id", "pos", "kind", "name",
        F.when(counted, 1).otherwise(0).alias("is_element"),
        F.when(F.col("name") == "title", F.nullif(text, F.lit(""))).alias("title"),
        F.when(started & (F.col("name") == "html"), language_of(token)).alias("language"),
        F.coalesce(F.octet_length(text), F.lit(0)).alias("text_bytes"),
    )
    content = (
        (started & (F.col("name") == "body"))
        | (started & ~F.col("name").isin("html", "head", *rules.HEAD_ONLY))
        | ((F.col("kind") == "text") & (F.col("text_bytes") > 0))
    )
    page = Window.partitionBy("page_id")
    earlier = _before(["page_id"], F.col("pos"))
    # Each text node adds its bytes and one joining space; a span's text is a difference less one.
    joined = F.when(F.col("text_bytes") > 0, F.col("text_bytes") + 1).otherwise(0)
    rows = rows.select(
        "*",
        F.coalesce(F.sum("is_element").over(earlier), F.lit(0)).alias("elements"),
        F.coalesce(F.sum(joined).over(earlier), F.lit(0)).alias("bytes"),
        F.sum("is_element").over(page).alias("all_elements"),
        F.sum(joined).over(page).alias("all_bytes"),
        F.min(F.when(content, F.col("pos"))).over(page).alias("body_pos"),
    )
    relevant = (
        (started & F.col("name").isin(*TRACKED, "title", "html"))
        | (started & F.col("name").isin(*rules.P_CLOSING_STARTS))
        | (
            (F.col("kind") == "end")
            & F.col("name").isin(*_STRUCTURAL, *rules.HEADINGS, *rules.P_CLOSING_ENDS, "a")
        )
        | (F.col("pos") == F.col("body_pos"))
    )
    return rows.where(relevant).drop("is_element", "text_bytes")


def _pair_by_name(tags: DataFrame) -> DataFrame:
    """Add ``match``: the partner tag of a structural start or end, null when it has none."""
    structural = F.col("name").isin(*_STRUCTURAL) & F.col("kind").isin("start", "end")
    delta = F.when(structural, F.when(F.col("kind") == "start", 1).otherwise(-1)).otherwise(0)
    key = F.when(structural, F.col("name"))
    tags = tags.withColumns({"pair_name": key, "delta": delta})
    running = tags.withColumn(
        "sum_to", F.sum("delta").over(_upto(["page_id", "pair_name"], F.col("pos")))
    ).withColumn(
        "low", F.min("sum_to").over(_before(["page_id", "pair_name"], F.col("pos")))
    )
    # Depth before this tag, never below zero: unmatched end tags do not count.
    depth = F.col("sum_to") - F.col("delta") - F.least(F.coalesce(F.col("low"), F.lit(0)), F.lit(0))
    level = F.when(structural, depth + F.when(F.col("kind") == "start", 1).otherwise(0))
    leveled = running.withColumn("pair_level", level)
    same = Window.partitionBy("page_id", "pair_name", "pair_level").orderBy("pos")
    here = F.struct("kind", "pos", "elements", "bytes")
    following, previous = F.lead(here).over(same), F.lag(here).over(same)
    match = F.when(
        structural & (F.col("pair_level") > 0),
        F.when((F.col("kind") == "start") & (following["kind"] == "end"), following).when(
            (F.col("kind") == "end") & (previous["kind"] == "start"), previous
        ),
    )
    return leveled.withColumn("match", match).drop("delta", "sum_to", "low", "pair_level")


def closed_tags(arrays: DataFrame) -> DataFrame:
    """Start tags of interest with the position and element count at which each one ends.

    Also carries the page facts found on the way: ``title``, ``language`` and ``body_pos`` rows.
    """
    tags = _pair_by_name(counted_tags(arrays))
    matched = F.col("match").isNotNull()
    start, end = F.col("kind") == "start", F.col("kind") == "end"
    step = F.when(matched & start, 1).when(matched & end, -1).otherwise(0)
    nested = tags.withColumns({"matched": matched, "step": step}).withColumn(
        "depth_to", F.sum("step").over(_upto(["page_id"], F.col("pos")))
    )
    # A start tag and the tags beside it share a level; an end tag has the level it closes.
    nested = nested.withColumn("level", F.col("depth_to") - F.when(F.col("step") == 1, 1)
                               .when(F.col("step") == -1, -1).otherwise(0))
    after = _before(["page_id", "level"], F.col("pos").desc())
    at = F.struct("pos", "elements", "bytes")

    def next_where(condition: Column) -> Column:
        return F.last(F.when(condition, at), ignorenulls=True).over(after)

    name = F.col("name")
    started = F.col("kind").isin("start", "raw")
    leaving = F.col("matched") & end
    ends = nested.withColumns(
        {
            "p_end": next_where(
                leaving
                | (started & name.isin(*rules.P_CLOSING_STARTS))
                | (end & name.isin(*rules.P_CLOSING_ENDS))
            ),
            "h_end": next_where(leaving | name.isin(*rules.HEADINGS)),
            "a_end": next_where(leaving | (name == "a")),
            "outer_end": next_where(leaving),
        }
    )
    own_end = (
        F.when(name == "p", F.col("p_end"))
        .when(name.isin(*rules.HEADINGS), F.col("h_end"))
        .when(name == "a", F.col("a_end"))
        .when(
            F.col("matched"),
            F.struct(
                F.col("match.pos").alias("pos"),
                F.col("match.elements").alias("elements"),
                F.col("match.bytes").alias("bytes"),
            ),
        )
        .otherwise(F.col("outer_end"))
    )
    keep = (start & name.isin(*TRACKED)) | (
        F.col("title").isNotNull() | F.col("language").isNotNull()
        | (F.col("pos") == F.col("body_pos"))
    )
    # Well nested pages close every container at the level where it was opened.
    page = Window.partitionBy("page_id")
    dangling = F.max(
        name.isin(*_STRUCTURAL) & F.col("kind").isin("start", "end") & ~F.col("matched")
    ).over(page)
    opened = F.crc32(F.concat_ws(" ", name, F.col("level") + 1).cast("binary"))
    closed = F.crc32(F.concat_ws(" ", name, F.col("level")).cast("binary"))
    balance = F.sum(F.when(F.col("step") == 1, opened).when(F.col("step") == -1, -closed)).over(page)
    return (
        ends.withColumns(
            {"end": own_end, "recovery": dangling | (F.coalesce(balance, F.lit(0)) != 0)}
        )
        .where(keep)
        .select(
            "page_id", "pos", "kind", "name", "level", "title", "language", "recovery", "body_pos",
            "elements", "bytes",
            F.col("end.pos").alias("end_pos"),
            F.coalesce("end.elements", "all_elements").alias("end_elements"),
            F.coalesce("end.bytes", "all_bytes").alias("end_bytes"),
            "all_elements",
        )
    )


def element_spans(arrays: DataFrame) -> DataFrame:
    """(page_id, name, start, end, depth, recovery); ``end`` is null when the page ends first.

    ``depth`` counts enclosing tracked elements. ``recovery`` marks pages whose containers are not
    well nested; their spans follow the rules above instead of a browser's full recovery.
    """
    closed = closed_tags(arrays)
    name, start = F.col("name"), F.col("kind") == "start"
    own = start & name.isin(*TRACKED)
    parts = F.array_compact(
        F.array(
            F.when(own, F.struct(name.alias("name"), F.col("pos").alias("start"),
                                 F.col("end_pos").alias("end"))),
            F.when(
                F.col("pos") == F.col("body_pos"),
                F.struct(F.lit("body").alias("name"), F.col("pos").alias("start"),
                         F.lit(None).cast("int").alias("end")),
            ),
        )
    )
    return closed.select(
        "page_id", F.inline(parts), F.col("level").alias("depth"),
        "recovery",
    )

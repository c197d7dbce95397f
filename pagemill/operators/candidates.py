"""Candidate content roots of a page and the page-level row every later decision reads.

Containment never becomes a join. A container's text, link and boilerplate sizes are differences of
running sums at its start and its end, so the cost is one more sort inside the page's partition
whatever the nesting looks like. The page-level row then holds everything that E5 and E8 to E17
need, and those stay narrow expressions over it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.plan import once
from pagemill.operators.spans import closed_tags
from pagemill.operators.tokens import own_tokens, source_of, token_arrays, token_text

_PAGE_END = 1 << 40  # sorts after every token of a page
_ROOT = -(1 << 41)  # sorts before every token of a page
BLOCK_TYPE = "struct<kind:string,level:int,text:string>"


def _events(closed: DataFrame) -> DataFrame:
    """One row where an element starts and, for regions, one where it ends, in page order."""
    name = F.col("name")
    own_start = F.col("kind") == "start"
    is_block = own_start & name.isin("p", *rules.HEADINGS)
    is_region = own_start & name.isin(*rules.CONTAINERS, *rules.BOILERPLATE)
    size = F.greatest(F.col("end_bytes") - F.col("bytes") - 1, F.lit(0))
    start = F.col("pos").cast("bigint") * 2
    end = F.coalesce(F.col("end_pos").cast("bigint") * 2, F.lit(_PAGE_END))

    def event(at: Column, side: str, label: Column, key: Column, elements: Column) -> Column:
        return F.struct(
            at.alias("at"), F.lit(side).alias("side"), label.alias("label"), key.alias("key"),
            elements.alias("elements"), size.alias("size"),
        )

    inside = F.col("end_elements") - F.col("elements")
    # The body sorts just before the token that opens it, so ties still prefer inner containers.
    body_key = F.col("body_pos").cast("bigint") * 2 - 1
    in_body = F.col("all_elements") - F.col("elements") + 1
    body = F.col("pos") == F.col("body_pos")
    # The root holds the whole page: all elements, and html, head and body, which exist unwritten too.
    in_root, root_key = F.col("all_elements") + 3, F.lit(_ROOT).cast("bigint")
    parts = F.array_compact(
        F.array(
            F.when(own_start & name.isin("p", "a", *rules.HEADINGS, *rules.CONTAINERS,
                                         *rules.BOILERPLATE),
                   event(start, "start", name, start, inside)),
            F.when(is_region, event(end, "end", name, start, inside)),
            F.when(body, event(root_key, "start", F.lit("html"), root_key, in_root)),
            F.when(body, event(F.lit(_PAGE_END + 1), "end", F.lit("html"), root_key, in_root)),
            F.when(body, event(body_key, "start", F.lit("body"), body_key, in_body)),
            F.when(body, event(F.lit(_PAGE_END), "end", F.lit("body"), body_key, in_body)),
            F.when(F.col("title").isNotNull() | F.col("language").isNotNull(),
                   event(start, "meta", F.lit("meta"), F.lit(-1) - start, F.lit(0).cast("bigint"))),
        )
    )
    rows = closed.select(
        "page_id", "pos", "end_pos", "title", "language", "recovery", F.inline(parts)
    )
    label, opening = F.col("label"), F.col("side") == "start"
    block = opening & label.isin("p", *rules.HEADINGS) & (F.col("size") > 0)
    order = Window.partitionBy("page_id").orderBy("at", F.col("key").desc(), "side")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    guard = F.when(
        label.isin(*rules.BOILERPLATE), F.when(opening, 1).when(F.col("side") == "end", -1)
    )
    block_size = F.when(block, F.col("size")).otherwise(0)
    return (
        rows.withColumn("is_block", block)
        .withColumn("guards", F.coalesce(F.sum(guard).over(running), F.lit(0)))
        .withColumns(
            {
                "n_blocks": F.sum(F.col("is_block").cast("int")).over(running),
                "text": F.sum(block_size).over(running),
                "guarded": F.sum(block_size * F.col("guards")).over(running),
                "links": F.coalesce(
                    F.sum(F.when(opening & (label == "a"), F.col("size"))).over(running), F.lit(0)
                ),
            }
        )
    )


def _elements(closed: DataFrame) -> DataFrame:
    """One row per element: blocks with their span, regions with their sizes, page facts."""
    opening, ending = F.col("side") != "end", F.col("side") == "end"

    def at_start(column: str) -> Column:
        return F.max(F.when(opening, F.col(column)))

    def over_span(column: str) -> Column:
        return F.max(F.when(ending, F.col(column))) - at_start(column)

    return _events(closed).groupBy("page_id", "key").agg(
        F.first("label").alias("name"),
        F.first("pos").alias("pos"),
        F.first("end_pos").alias("end_pos"),
        F.first("title").alias("title"),
        F.first("language").alias("language"),
        F.first("recovery").alias("recovery"),
        F.bool_or("is_block").alias("is_block"),
        F.first("elements").alias("elements"),
        at_start("n_blocks").alias("block_from"),
        F.max(F.when(ending, F.col("n_blocks"))).alias("block_to"),
        over_span("text").alias("text"),
        over_span("links").alias("links"),
        (over_span("guarded") - at_start("guards") * over_span("text")).alias("boilerplate"),
    )


def container_stats(pages: DataFrame) -> DataFrame:
    """(page_id, root, name, n_blocks, text, links, boilerplate, elements) per container."""
    return (
        _elements(closed_tags(token_arrays(pages)))
        .where(F.col("name").isin(*rules.CONTAINERS, "body", "html"))
        .select(
            "page_id", F.col("key").alias("root"), "name",
            (F.col("block_to") - F.col("block_from")).alias("n_blocks"),
            "text", "links", "boilerplate", "elements",
        )
    )


def page_plans(arrays: DataFrame) -> DataFrame:
    """(page_id, title, language, recovery, spans, candidates): one row per page with any token.

    ``spans`` are the non-empty blocks in page order; each candidate is a range of that array plus
    its sizes, in the fixed order semantic, readability, density.
    """
    name = F.col("name")
    root = name.isin(*rules.CONTAINERS, "body", "html")
    net = F.greatest(
        F.greatest(F.col("text") - F.col("links"), F.lit(0)) - F.col("boilerplate"), F.lit(0)
    )
    rank = F.when(name == "article", 0).when(name == "main", 1)
    has_blocks = F.col("block_to") > F.col("block_from")
    sizes = ["block_from", "block_to", "text", "links", "boilerplate"]
    span = F.struct(
        "key",
        F.when(name == "p", F.lit("paragraph")).otherwise(F.lit("heading")).alias("kind"),
        F.when(name != "p", F.substring(name, 2, 1).cast("int")).alias("level"),
        "pos",
        "end_pos",
    )
    chosen = (
        _elements(closed_tags(arrays))
        .withColumns({"rank": rank, "net": net})
        .withColumn("scaled", F.expr("net * 1000 div greatest(elements, 1L)"))
        .groupBy("page_id")
        .agg(
            F.min(F.when(F.col("title").isNotNull(), F.struct("pos", "title")))["title"].alias(
                "title"
            ),
            F.min(F.when(F.col("language").isNotNull(), F.struct("pos", "language")))[
                "language"
            ].alias("language"),
            F.bool_or("recovery").alias("recovery"),
            F.array_sort(F.collect_list(F.when(F.col("is_block"), span))).alias("spans"),
            F.min(F.when(F.col("rank").isNotNull() & has_blocks, F.struct("rank", "key", *sizes)))
            .alias("semantic"),
            # The maximum of (score, place) hands ties to the last root in page order.
            F.max(F.when(root, F.struct("net", "key", *sizes))).alias("readability"),
            F.max(F.when(root, F.struct("scaled", "key", *sizes))).alias("density"),
        )
    )
    candidates = [
        F.struct(
            F.lit(priority).alias("priority"),
            F.lit(strategy).alias("strategy"),
            *(F.coalesce(F.col(strategy)[size], F.lit(0)).alias(size) for size in sizes),
        )
        for priority, strategy in enumerate(rules.STRATEGIES)
    ]
    return chosen.select(
        "page_id", "title", "language", "recovery", "spans", F.array(*candidates).alias("candidates")
    )


def _span_text(span: Column, tokens: Column) -> Column:
    size = F.coalesce(span["end_pos"], F.size(tokens)) - span["pos"] - 1
    inner = F.slice(tokens, span["pos"] + 2, F.greatest(size, F.lit(0)))
    words = F.filter(F.transform(inner, lambda token: token_text(token)), lambda text: text != "")
    return F.array_join(words, " ")


def page_candidates(
    pages: DataFrame,
    max_input_bytes: int = rules.MAX_INPUT_BYTES,
    partitioned: bool = False,
    max_dom_nodes: int = rules.MAX_DOM_NODES,
) -> DataFrame:
    """(page_id, title, language, recovery, blocks, candidates, source): the shared page-level row.

    Both sides of the join read the same exchange of token arrays, so pages are read, cut, hashed and
    shuffled once; text travels only on the side that does not sort. ``source`` is the digest and
    length of the page's bytes.
    """
    arrays = token_arrays(pages, max_input_bytes, partitioned, max_dom_nodes, with_source=True)
    tokens = own_tokens(F.col("tokens"))
    plans = page_plans(arrays.withColumn("tokens", tokens))
    empty = [
        F.struct(
            F.lit(priority).alias("priority"),
            F.lit(strategy).alias("strategy"),
            *(
                F.lit(0).cast("bigint").alias(size)
                for size in ("block_from", "block_to", "text", "links", "boilerplate")
            ),
        )
        for priority, strategy in enumerate(rules.STRATEGIES)
    ]
    block = lambda span: F.struct(
        span["kind"].alias("kind"),
        span["level"].alias("level"),
        _span_text(span, F.col("own")).alias("text"),
    )
    texts = arrays.select("page_id", tokens.alias("own"), source_of(F.col("tokens")).alias("source"))
    return once(
        texts.join(plans, "page_id", "left"),
        ["page_id"],
        [
            F.col("title"),
            F.col("language"),
            F.coalesce("recovery", F.lit(False)).alias("recovery"),
            F.coalesce(
                F.transform("spans", block), F.array().cast(f"array<{BLOCK_TYPE}>")
            ).alias("blocks"),
            F.coalesce("candidates", F.array(*empty)).alias("candidates"),
            F.col("source"),
        ],
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """E5: (page_id, block_pos, kind, level, text) in page order; nested blocks both count."""
    return page_candidates(pages).select(
        "page_id", F.posexplode("blocks").alias("block_pos", "block")
    ).select("page_id", "block_pos", "block.*")


def page_metadata(pages: DataFrame, **limits) -> DataFrame:
    """(page_id, title, language, recovery) per page; no block text is built or exchanged twice."""
    arrays = token_arrays(pages, **limits)
    facts = page_plans(arrays).select("page_id", "title", "language", "recovery")
    return arrays.select("page_id").join(facts, "page_id", "left").select(
        "page_id", "title", "language", F.coalesce("recovery", F.lit(False)).alias("recovery")
    )

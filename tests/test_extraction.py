import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import quality
from pagemill.operators.candidates import container_stats, page_blocks
from pagemill.operators.derived import page_features
from pagemill.operators.documents import (
    blobs_of, build_documents, canonical_documents, provenance, source_blobs, with_provenance,
)
from pagemill.operators.quality import (
    candidate_rows, low_quality, page_decisions, select_winner,
)
from pagemill.plans.fixtures import table
from pagemill.sources.documents import write_documents
from pagemill.sources.pages import write_bucketed

LONG_A = "Keepers of the harbour note wind, swell and the ships that pass before dawn each day. "
LONG_B = "Their ledgers agree with the tide tables and show how quickly a storm can arrive here. "
CASES = {
    # name: (html, selected strategy or None, lowest score, highest score)
    "article": (
        "<html><head><title>Harbour Log</title></head><body><article><h1>Harbour Log</h1><p>"
        + "b" * 121 + "</p></article></body></html>", "semantic", 682, 682,
    ),
    "chrome": (
        "<title>Tide Tables</title><nav><p><a href=/>Start page and settings</a></p></nav><div>"
        f"<h1>Tide Tables</h1><p>{LONG_A}</p><p>{LONG_B}</p></div><div><h2>More</h2><p>{LONG_B}{LONG_A}"
        f"</p><p>{LONG_A}{LONG_B}</p></div><footer><p>Imprint and terms</p></footer>",
        "readability", 900, 1000,
    ),
    "unclosed": (
        f"<title>Lost Tags</title><body><div><h1>Lost Tags<p>{LONG_A}{LONG_A}<p>{LONG_B}",
        "readability", 800, 800,
    ),
    "login": (
        "<title>Sign in</title><main><h1>Sign in</h1><p>Please accept our cookies.</p></main>",
        None, 0, 0,
    ),
    "open title": (f"<title>Oops<body><article><p>{LONG_A * 3}</p></article>", None, 0, 0),
    "main": (f"<main><p>{LONG_A * 2}</p></main>", "semantic", 600, 700),
    "empty": ("", None, 0, 0),
}


@pytest.fixture(scope="module")
def decisions(spark):
    rows = [(i, name, case[0]) for i, (name, case) in enumerate(CASES.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return page_decisions(pages).cache()


def _rows(decisions, name):
    page = list(CASES).index(name)
    rows = candidate_rows(decisions).where(F.col("page_id") == page).orderBy("priority").collect()
    assert [r.strategy for r in rows] == ["semantic", "readability", "density"]
    return rows


@pytest.mark.parametrize("name", list(CASES))
def test_each_case_keeps_its_winner_and_score(decisions, name):
    _, strategy, low, high = CASES[name]
    chosen = [r for r in _rows(decisions, name) if r.selected]
    if strategy is None:
        assert chosen == []
    else:
        assert [r.strategy for r in chosen] == [strategy]
        assert low <= chosen[0].score <= high


def test_exact_components(decisions):
    for row in _rows(decisions, "article"):
        assert tuple(row.metrics) == (132, 1, 132, 50, 200, 200, 100)
        assert row.reasons == ["accepted"]


def test_rejected_pages_keep_three_unselected_decisions(decisions):
    rows = low_quality(decisions).collect()
    assert len(rows) == 9 and not any(r.selected for r in rows)
    assert all("too_short" in r.reasons and r.error_class == "quality" for r in rows)


def _one(spark, html):
    return page_decisions(spark.createDataFrame([(1, html)], "page_id long, html string"))


def test_nested_boilerplate_counts_repeatedly_and_links_outside_blocks_count(spark):
    html = "<div><footer><aside><p>abcd</p></aside></footer><a>xy z</a><p>hello</p></div>"
    row = container_stats(
        spark.createDataFrame([(1, html)], "page_id long, html string")
    ).where("name = 'div'").first()
    assert (row.text, row.links, row.boilerplate, row.elements) == (9, 4, 8, 6)


def test_text_nodes_join_with_spaces_and_sizes_are_bytes(spark):
    html = "<p>foo<b>bar</b> é</p><p> <br> </p><h2> </h2>"
    rows = page_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [(r.kind, r.text) for r in rows] == [("paragraph", "foo bar é")]
    stats = container_stats(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert stats.text == len("foo bar é".encode())


def test_minimum_text_is_counted_in_bytes(spark):
    short = candidate_rows(_one(spark, f"<article><p>{'é' * 59}a</p></article>")).first()
    enough = candidate_rows(_one(spark, f"<article><p>{'é' * 60}</p></article>")).first()
    assert not short.accepted and enough.accepted


def test_title_agreement_ignores_ascii_case_only(spark):
    def agreement(title, heading):
        html = f"<title>{title}</title><article><h1>{heading}</h1><p>x</p></article>"
        return candidate_rows(_one(spark, html)).first().metrics.title_agreement

    assert agreement("Port News", "pORT nEWS") == 100
    assert agreement("Élan", "élan") == 0


def test_ties_go_to_the_first_strategy_among_accepted(spark):
    rows = [
        (1, "semantic", 0, 700, True), (1, "readability", 1, 700, True),
        (2, "semantic", 0, 900, False), (2, "density", 2, 400, True),
        (3, "semantic", 0, 300, False), (3, "density", 2, 300, False),
    ]
    frame = spark.createDataFrame(
        rows, "page_id long, strategy string, priority int, score int, accepted boolean"
    )
    chosen = {(r.page_id, r.strategy) for r in select_winner(frame).where("selected").collect()}
    assert chosen == {(1, "semantic"), (2, "density")}


def test_document_digest_covers_blocks_not_title(spark):
    body = f"<article><p>{LONG_A * 2}</p></article>"
    pages = spark.createDataFrame(
        [(1, f"<title>A</title>{body}"), (2, f"<title>B</title>{body}")],
        "page_id long, html string",
    )
    docs = build_documents(pages)
    one, two = docs.orderBy("page_id").collect()
    assert one.content_digest == two.content_digest and (one.title, two.title) == ("A", "B")
    bodies = canonical_documents(docs).orderBy("page_id").collect()
    assert bodies[0].digest != bodies[1].digest and len(bodies[0].prefix) == 2
    rows = provenance(docs).collect()
    assert len(rows) == 2 and {r.block_index for r in rows} == {0}
    nested = with_provenance(docs).first()
    assert len(nested.provenance) == len(nested.blocks)
    # The digest in the page row is that of the page's bytes.
    stored = {r.page_id: (r.digest_hex, r.length_bytes) for r in source_blobs(pages).collect()}
    decisions = page_decisions(pages)
    assert {r.page_id: (r.digest_hex, r.length_bytes) for r in blobs_of(decisions).collect()} == stored
    assert {r.page_id: r.blob_digest for r in rows} == {k: v[0] for k, v in stored.items()}


def test_provenance_and_features_read_the_pages_once(spark, sf):
    for job in (provenance, page_features):
        found = job(build_documents(table(spark, sf, "pages")))
        assert found.count() > 0
        frame = found.groupBy().count()
        frame.collect()
        final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_same_result_under_any_partitioning(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(map(str, build_documents(pages).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        many = sorted(map(str, build_documents(pages.repartition(7)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == many


def test_extraction_shuffles_pages_once(spark, sf):
    frame = build_documents(spark.read.parquet(f"{sf}/pages.parquet"))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line]
    shuffles = [line for line in exchanges if "ReusedExchange" not in line]
    assert len(shuffles) == 1 and "ReusedExchange" in plan
    assert "Python" not in plan


# --- Brute force over random well-formed pages ----------------------------------------------
NAMES = ("div", "section", "article", "main", "aside", "footer", "form", "header", "nav")


def _random_tree(rng, depth):
    """(name, children) trees; leaves are p, h2, a with words, or bare text."""
    children = []
    for _ in range(rng.randint(0, 4)):
        if depth < 4 and rng.random() < 0.5:
            children.append((rng.choice(NAMES), _random_tree(rng, depth + 1)))
        else:
            leaf = rng.choice(("p", "h2", "a", "text"))
            children.append((leaf, "w" * rng.randint(0, 9)))
    return children


def _render(children):
    out = []
    for name, content in children:
        if name == "text":
            out.append(content)
        elif isinstance(content, str):
            out.append(f"<{name}>{content}</{name}>")
        else:
            out.append(f"<{name}>{_render(content)}</{name}>")
    return "".join(out)


def _blocks(children):
    total = []
    for name, content in children:
        if name in ("p", "h2") and content:
            total.append(len(content))
        elif not isinstance(content, str):
            total += _blocks(content)
    return total


def _links(children):
    return sum(
        len(c) if n == "a" else (_links(c) if not isinstance(c, str) else 0) for n, c in children
    )


def _guarded(children):
    total = 0
    for name, content in children:
        if not isinstance(content, str):
            if name in ("aside", "footer", "form", "header", "nav"):
                total += sum(_blocks(content))
            total += _guarded(content)
    return total


def _elements(children):
    return sum(
        0 if n == "text" else 1 + (0 if isinstance(c, str) else _elements(c)) for n, c in children
    )


def _expected(children, found):
    for name, content in children:
        if not isinstance(content, str):
            if name in ("div", "section", "article", "main"):
                blocks = _blocks(content)
                found.append((name, len(blocks), sum(blocks), _links(content), _guarded(content),
                              1 + _elements(content)))
            _expected(content, found)
    return found


def test_container_sizes_equal_a_tree_walk(spark):
    rng = random.Random(7)
    trees = [_random_tree(rng, 0) for _ in range(60)]
    pages = spark.createDataFrame(
        [(i, f"<body>{_render(t)}</body>") for i, t in enumerate(trees)], "page_id long, html string"
    )
    rows = container_stats(pages).where("name not in ('body', 'html')").collect()
    found = {}
    for r in rows:
        found.setdefault(r.page_id, []).append(
            (r.name, r.n_blocks, r.text, r.links, r.boilerplate, r.elements)
        )
    for i, tree in enumerate(trees):
        assert sorted(found.get(i, [])) == sorted(_expected(tree, [])), _render(tree)


def test_every_page_has_one_outcome(spark):
    long = "<p>" + "Words enough to fill a paragraph of some length. " * 20 + "</p>"
    pages = spark.createDataFrame(
        [
            (1, f"<html><body><article>{long * 4}</article></body></html>"),
            (2, "<p>short</p>"), (3, None), (4, ""), (5, "x" * 9000), (6, "<b></b>" * 60), (None, "<p>x</p>"),
        ],
        "page_id int, html string",
    )
    found = quality.page_outcomes(pages, max_input_bytes=8000, max_dom_nodes=50).collect()
    assert sorted((r["page_id"] or 0, r["outcome"], r["error_class"]) for r in found) == [
        (0, "missing_id", "parse"), (1, "document", None), (2, "low_quality", "quality"),
        (3, "missing_body", "parse"), (4, "low_quality", "quality"),
        (5, "resource_limit", "parse"), (6, "resource_limit", "parse"),
    ]


def test_equal_documents_are_stored_once_over_all_writes(spark, tmp_path):
    long = "<p>" + "Words enough to fill a paragraph of some length. " * 20 + "</p>"
    pages = spark.createDataFrame(
        [(k, f"<html><body><article>{long * 4}<p>{k % 3}</p></article></body></html>") for k in range(6)],
        "page_id int, html string",
    )
    built = build_documents(pages)
    write_documents(built.where("page_id < 2"), str(tmp_path / "store"))
    write_documents(built, str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert (stored.count(), stored.select("digest").distinct().count()) == (3, 3)


def test_the_root_holds_the_whole_page(spark):
    html = "<html><head><title>t</title></head><body><div><p>abc</p></div><a>x</a></body></html>"
    bare = "<p>abc</p>"
    pages = spark.createDataFrame([(1, html), (2, bare)], "page_id long, html string")
    rows = {(r.page_id, r.name): r for r in container_stats(pages).collect()}
    root = rows[1, "html"]
    assert (root.n_blocks, root.text, root.links, root.elements) == (1, 3, 1, 7)
    assert (rows[1, "body"].elements, rows[2, "html"].elements, rows[2, "body"].elements) == (4, 4, 2)


def test_bucketed_pages_are_extracted_without_an_exchange(spark, sf, tmp_path):
    """Pages that stand bucketed on page_id need no shuffle, of text or of anything else."""
    pages = table(spark, sf, "pages")
    stored = write_bucketed(pages, "bucketed_pages", 4, f"{tmp_path}/pages")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = build_documents(stored, partitioned=True)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, found.collect())) == sorted(map(str, build_documents(pages).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.sql("drop table bucketed_pages")

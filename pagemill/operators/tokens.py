"""Tokens: one regular-expression pass over each page, shared by every later job.

``token_arrays`` is the only shuffle of the extraction path. The expression that cuts a page into
tokens runs before it, so what moves is one compact array row per page, hashed on ``page_id``. All
later windows and joins ask for that same clustering and therefore stay inside their partition.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.text import collapse_whitespace, decode_references

# Attribute part of a tag: a quoted value may hold '>', a bare value may not. Every quantifier is
# possessive, so the match neither backtracks nor recurses however long the tag is.
_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+"""
_RAW = "|".join(rules.RAW_TEXT)
TOKEN_RX = (
    r"(?is)("
    r"<!--(?:-?>|.*?(?:-->|--!>|\z))"
    rf"|<({_RAW})(?=[\s/>]){_ATTRS}>.*?(?=</\2[\s/>]|\z)"
    rf"|</?[a-z][^\s/>]*+{_ATTRS}>"
    r"|<[!?][^>]*+(?:>|\z)"
    r"|</(?:[^a-z>][^>]*+)?(?:>|\z)"
    r"|(?:[^<]++|<(?![a-z/!?]))++"
    r")|</?[a-z].*+"
)
_RAW_CONTENT_RX = rf"(?is)^<[^\s/>]++{_ATTRS}>(.*)$"
_DECODED_RAW_RX = rf"(?i)^<(?:{'|'.join(rules.DECODED_RAW_TEXT)})[\s/>]"
_LANG_RX = r"""(?is)\slang\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_LANGUAGE_TAG_RX = r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"


def token_kind(token: Column) -> Column:
    """start, end, raw (start tag plus its raw text), comment, doctype, ignored or text."""
    tag = F.when(
        token.rlike(rf"(?i)^<(?:{_RAW})[\s/>]"), F.lit("raw")
    ).otherwise(F.lit("start"))
    return (
        F.when(~token.startswith("<"), F.when(token == "", F.lit("ignored")).otherwise(F.lit("text")))
        .when(token.rlike("^<[a-zA-Z]"), tag)
        .when(token.rlike("^</[a-zA-Z]"), F.lit("end"))
        .when(token.rlike("(?i)^<!doctype"), F.lit("doctype"))
        .when(token == "</>", F.lit("ignored"))
        .when(token == "</", F.lit("text"))
        .when(token.rlike("^<[!?/]"), F.lit("comment"))
        .otherwise(F.lit("text"))
    )


def token_name(token: Column) -> Column:
    """Lowercase tag name of a start, raw or end token."""
    return F.lower(F.regexp_extract(token, r"^</?([^\s/>]+)", 1))


def raw_content(token: Column) -> Column:
    return F.regexp_extract(token, _RAW_CONTENT_RX, 1)


def token_text(token: Column, kind: Column | None = None) -> Column:
    """Normalized text of a text or raw token, null for tags, empty for blanks."""
    kind = token_kind(token) if kind is None else kind
    decodes = token.contains("&") & ((kind == "text") | token.rlike(_DECODED_RAW_RX))
    source = F.when(kind == "text", token).when(kind == "raw", raw_content(token))
    return collapse_whitespace(F.when(decodes, decode_references(source)).otherwise(source))


def node_count(tokens: Column) -> Column:
    """Nodes of a page: the document, its elements (html, head and body exist even when unwritten),
    text, comments and the doctype."""
    nodes = F.filter(
        tokens, lambda t: token_kind(t).isin("start", "raw", "text", "comment", "doctype")
    )
    raw = F.filter(
        tokens, lambda t: t.rlike(rf"(?i)^<(?:{_RAW})[\s/>]") & (raw_content(t) != "")
    )

    def unwritten(name: str) -> Column:
        return F.when(F.exists(tokens, lambda t: t.rlike(rf"(?i)^<{name}[\s/>]")), 0).otherwise(1)

    return F.size(nodes) + F.size(raw) + unwritten("html") + unwritten("head") + unwritten("body") + 1


def refusal(
    html: Column,
    max_input_bytes: int = rules.MAX_INPUT_BYTES,
    max_dom_nodes: int = rules.MAX_DOM_NODES,
) -> Column:
    """Why a page is not parsed: ``missing_body``, ``resource_limit``, or null if it is.

    Every node but the four implied ones takes a byte at least, so nodes are counted only where the
    bytes allow too many.
    """
    size = F.octet_length(html)
    tokens = F.regexp_extract_all(html, F.lit(TOKEN_RX), F.lit(1))
    return (
        F.when(html.isNull(), "missing_body")
        .when(size > max_input_bytes, "resource_limit")
        .when(size + 4 <= max_dom_nodes, F.lit(None).cast("string"))
        .when(node_count(tokens) > max_dom_nodes, "resource_limit")
    )


def token_arrays(
    pages: DataFrame,
    max_input_bytes: int = rules.MAX_INPUT_BYTES,
    partitioned: bool = False,
    max_dom_nodes: int = rules.MAX_DOM_NODES,
    with_source: bool = False,
) -> DataFrame:
    """(page_id, tokens) hashed on page_id; pages over a limit are refused (see ``refusal``).

    ``partitioned=True`` says the input already is clustered on ``page_id`` (a bucketed table); then
    no shuffle is added. ``with_source`` adds digest and length of the page's bytes as one more element
    at the end, for ``own_tokens`` and ``source_of``: an element travels with the array, where a column
    that one of the two readers does not need would give them different exchanges.
    """
    html = F.col("html")
    tokens = F.regexp_extract_all(html, F.lit(TOKEN_RX), F.lit(1))
    if with_source:
        tokens = F.array_append(tokens, F.concat_ws(":", F.sha2(html, 256), F.octet_length(html)))
    # The key test is what a join on page_id would infer; stating it here keeps the two readers of
    # this exchange identical, so that it runs once.
    arrays = pages.where(
        F.col("page_id").isNotNull() & refusal(html, max_input_bytes, max_dom_nodes).isNull()
    ).select("page_id", tokens.alias("tokens"))
    return arrays if partitioned else arrays.repartition("page_id")


def own_tokens(tokens: Column) -> Column:
    """The tokens of an array that ends with its source."""
    return F.slice(tokens, F.lit(1), F.size(tokens) - 1)


def source_of(tokens: Column) -> Column:
    """Digest and length of the page's bytes, from an array that ends with them."""
    last = F.element_at(tokens, -1)
    return F.struct(
        F.substring_index(last, ":", 1).alias("digest_hex"),
        F.substring_index(last, ":", -1).cast("bigint").alias("length_bytes"),
    )


def explode_tokens(arrays: DataFrame) -> DataFrame:
    """(page_id, pos, token) in page order; a narrow step that keeps the clustering."""
    # The outer form keeps Catalyst from inferring size(tokens) > 0, which it would push below the
    # shuffle and thereby run the token expression twice.
    return arrays.select("page_id", F.posexplode_outer("tokens").alias("pos", "token")).where(
        F.col("token") != ""
    )


def tokenize(pages: DataFrame, max_input_bytes: int = rules.MAX_INPUT_BYTES) -> DataFrame:
    """(page_id, pos, kind, name, attrs, text), one row per token and no shuffle."""
    token = F.col("token")
    arrays = token_arrays(pages, max_input_bytes, partitioned=True)
    rows = explode_tokens(arrays).withColumn("kind", token_kind(token))
    kind = F.col("kind")
    tag = kind.isin("start", "end", "raw")
    attrs = F.trim(F.regexp_extract(token, rf"(?is)^</?[a-z][^\s/>]*+({_ATTRS})>", 1))
    return rows.select(
        "page_id",
        "pos",
        "kind",
        F.when(tag, token_name(token)).alias("name"),
        F.when(kind.isin("start", "raw"), attrs).alias("attrs"),
        token_text(token, kind).alias("text"),
    )


def language_of(token: Column) -> Column:
    """Language attribute of an html tag when it has the shape of a language tag, else null."""
    value = F.concat(*(F.regexp_extract(token, _LANG_RX, i) for i in (1, 2, 3)))
    return F.when(value.rlike(_LANGUAGE_TAG_RX), value)


def enforce_limits(
    pages: DataFrame,
    max_input_bytes: int = rules.MAX_INPUT_BYTES,
    max_dom_nodes: int = rules.MAX_DOM_NODES,
) -> DataFrame:
    """(page_id, n_nodes, parse_failure); the failure is missing_body, resource_limit or null.

    Bytes are tested before a page is cut into tokens. A narrow job.
    """
    fits = F.octet_length("html") <= max_input_bytes
    tokens = F.when(fits, F.regexp_extract_all("html", F.lit(TOKEN_RX), F.lit(1)))
    count = node_count(F.col("tokens"))
    return (
        pages.select("page_id", tokens.alias("tokens"), F.col("html").isNull().alias("absent"))
        .select("page_id", "absent", F.when(F.col("tokens").isNotNull(), count).alias("n_nodes"))
        .select(
            "page_id", "n_nodes",
            F.when(F.col("absent"), "missing_body")
            .when(F.coalesce(F.col("n_nodes") > max_dom_nodes, F.lit(True)), "resource_limit")
            .alias("parse_failure"),
        )
    )

"""URL identity: canonical form, reject reason, fingerprint and source route.

All of it is expressions on one row. Patterns follow the URL standard for the http and https
schemes; host names outside ASCII take their ASCII form (see ``functions.hosts``).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.hosts import ascii_host
from pagemill.functions.net import address_hex_sql, hex_to_v6_sql

_TRACKING = ", ".join(f"'{key}'" for key in rules.TRACKING_KEYS)
# Characters that the URL standard escapes in a path and in a query (backslashes doubled for SQL).
_PATH_ESCAPES = r"[^!-~]|[\\x22#<>?`{}]"
_QUERY_ESCAPES = r"[^!-~]|[\\x22#<>\\x27]"


def _escaped(text: str, pattern: str) -> str:
    """Percent-encode the characters of ``text`` that match ``pattern``; usually none do."""
    return (
        f"case when {text} rlike '{pattern}' then array_join(transform(split({text}, ''), c -> "
        f"case when c = ' ' then '%20' when c rlike '{pattern}' then url_encode(c) else c end), '')"
        f" else {text} end"
    )


def _resolved_path(path: str) -> str:
    """Resolve '.' and '..' segments (also percent-encoded dots); most paths have none."""
    dot = "(?i)(?:[.]|%2e)"
    one, two = f"^{dot}$", f"^{dot}(?:[.]|%2e)$"
    last_is_dot = f"element_at(split({path}, '/'), -1) rlike '{one}|{two}'"
    folded = (
        f"aggregate(slice(split({path}, '/'), 2, size(split({path}, '/'))), cast(array() as array<string>), (acc, s) -> "
        f"case when s rlike '{two}' then slice(acc, 1, greatest(size(acc) - 1, 0)) "
        f"when s rlike '{one}' then acc else concat(acc, array(s)) end)"
    )
    return (
        f"case when {path} rlike '(?i)/(?:[.]|%2e)' then concat('/', array_join({folded}, '/'), "
        f"case when {last_is_dot} and size({folded}) > 0 then '/' else '' end) else {path} end"
    )


def canonicalize_urls(
    urls: DataFrame, max_url_bytes: int = rules.MAX_URL_BYTES, column: str = "url"
) -> DataFrame:
    """Add original, normalized, host, path, query, fingerprint and reject_reason.

    The parts of a rejected URL are null. Reasons are tested in a fixed order, first match wins; an
    absent URL has no host.
    """
    ports = ", ".join(str(port) for port in rules.ALLOWED_PORTS)
    split = urls.withColumn("original", F.col(column)).withColumn(
        "_clean",
        F.regexp_replace(
            F.regexp_replace("original", r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", ""
        ),
    )
    # scheme, then any run of slashes, then authority, path, query; the fragment is dropped.
    pieces = r"(?s)^(?:[^:]*):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(#.*)?$"
    parts = split.withColumns(
        {
            "_scheme": F.lower(F.regexp_extract("_clean", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)),
            "_authority": F.regexp_extract("_clean", pieces, 1),
            "_rawpath": F.translate(F.regexp_extract("_clean", pieces, 2), "\\", "/"),
            "_rawquery": F.regexp_extract("_clean", pieces, 3),
        }
    ).withColumns(
        {
            "_userinfo": F.regexp_extract("_authority", r"^(.*)@", 1),
            "_hostport": F.regexp_extract("_authority", r"(?:^|@)([^@]*)$", 1),
        }
    ).withColumns(
        {
            "_rawhost": F.regexp_extract("_hostport", r"^(\[[^\]]*\]|[^:]*)(?::(.*))?$", 1),
            "_rawport": F.regexp_extract("_hostport", r"^(\[[^\]]*\]|[^:]*)(?::(.*))?$", 2),
        }
    ).withColumn(
        "_unicode_host",
        F.expr(
            "lower(case when instr(_rawhost, '%') > 0 then try_url_decode(replace(_rawhost, '+', '%2B'))"
            " else _rawhost end)"
        ),
    )
    # A one-row generator, so that no filter above repeats the whole host mapping.
    mapped = ascii_host(F.col("_unicode_host"))
    parts = parts.select("*", F.inline(F.array(F.struct(mapped.alias("_host")))))
    number = "(?:0x[0-9a-f]*|[0-9]+)"
    labels = "split(regexp_replace(_host, '[.]$', ''), '[.]')"
    value = (
        "case when x rlike '^0x[0-9a-f]*$' then cast(conv(concat('0', substr(x, 3)), 16, 10) as decimal(20)) "
        "when x rlike '^0[0-7]*$' then cast(conv(x, 8, 10) as decimal(20)) "
        "when x rlike '^[1-9][0-9]{0,17}$' then cast(x as decimal(20)) end"
    )
    host = parts.withColumn(
        "_numeric", F.expr(f"_host rlike '(^|[.]){number}[.]?$'")
    ).withColumn("_labels", F.expr(f"case when _numeric then transform({labels}, x -> {value}) end"))
    valid_v4 = (
        "size(_labels) <= 4 and forall(_labels, x -> x is not null) and "
        "forall(slice(_labels, 1, size(_labels) - 1), x -> x <= 255) and "
        "element_at(_labels, -1) < cast(pow(256, 5 - size(_labels)) as decimal(20))"
    )
    v6_digits = address_hex_sql("case when _host like '[%]' then substr(_host, 2, length(_host) - 2) end")
    checked = host.withColumns(
        {
            "_is_v6": F.expr("_host like '[%'"),
            "_v6": F.expr(f"case when _host like '[%' then {v6_digits} end"),
            "_port": F.expr(
                "case when _rawport rlike '^0*[0-9]{1,5}$' then cast(_rawport as decimal(38)) end"
            ),
        }
    ).withColumn(
        "_invalid",
        F.expr(
            "_scheme = '' or ((_scheme in ('http', 'https')) and (coalesce(_host, '') = ''"
            " or (_rawport <> '' and (_port is null or _port > 65535))"
            r" or (not _is_v6 and _host rlike '[\\x00-\\x20#/:<>?@\\x5b-\\x5e|%\\x7f]')"
            " or (_is_v6 and _v6 is null)"
            f" or (_numeric and not _is_v6 and not coalesce({valid_v4}, false))))"
        ),
    )
    effective = "coalesce(_port, case when _scheme = 'http' then 80 else 443 end)"
    ambiguous = (
        "_numeric and not _is_v6 and not (lower(_rawhost) rlike "
        "'^(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}$')"
    )
    reason = F.expr(
        f"case when octet_length(original) > {max_url_bytes} then 'too_long'"
        " when original is null or instr(original, '://') = 0 then 'missing_host'"
        " when _invalid then 'invalid'"
        " when _scheme not in ('http', 'https') then 'unsupported_scheme'"
        " when _host = '' then 'missing_host'"
        " when _userinfo not in ('', ':') then 'user_information'"
        " when _port = 0 then 'port_zero'"
        f" when {effective} not in ({ports}) then 'port_denied'"
        f" when {ambiguous} then 'ambiguous_numeric_host' end"
    )
    kept = (
        "array_join(filter(split(_rawquery, '&'), p -> "
        f"coalesce(try_url_decode(substring_index(p, '=', 1)), '') not in ({_TRACKING})), '&')"
    )
    escaped = checked.withColumns(
        {
            "reject_reason": reason,
            "_path": F.expr(_escaped("_rawpath", _PATH_ESCAPES)),
            "_query": F.expr(_escaped(f"({kept})", _QUERY_ESCAPES)),
        }
    )
    canonical_host = (
        f"case when _is_v6 then concat('[', {hex_to_v6_sql('_v6')}, ']') else _host end"
    )
    return (
        escaped.withColumns(
            {
                "host": F.expr(f"case when reject_reason is null then {canonical_host} end"),
                "path": F.expr(
                    "case when reject_reason is null then case when _path = '' then '/' else "
                    f"{_resolved_path('_path')} end end"
                ),
                "query": F.expr("case when reject_reason is null then nullif(_query, '') end"),
            }
        )
        .withColumn(
            "normalized",
            F.expr(
                "case when reject_reason is null then concat(_scheme, '://', host, case when _port is"
                " null or _port = case when _scheme = 'http' then 80 else 443 end then '' else"
                " concat(':', cast(_port as string)) end, path, coalesce(concat('?', query), '')) end"
            ),
        )
        .withColumn("fingerprint", F.sha2("normalized", 256))
        .select(
            *urls.columns, *(["original"] if "original" not in urls.columns else []), "normalized",
            "host", "path", "query", "fingerprint", "reject_reason",
        )
    )


def classify_sources(urls: DataFrame) -> DataFrame:
    """Add ``route`` to canonical URLs: owner by exact host or dot suffix, then PDF, then web.

    The rules are ten fixed hosts, so the ordered match is one CASE rather than a join.
    """
    host = F.col("host")
    (base, name), *rest = rules.HOST_ROUTES
    owner = F.when((host == base) | host.endswith(f".{base}"), name)
    for base, name in rest:
        owner = owner.when((host == base) | host.endswith(f".{base}"), name)
    route = owner.when(F.lower("path").endswith(".pdf"), rules.PDF_ROUTE).otherwise(
        rules.DEFAULT_ROUTE
    )
    return urls.withColumn("route", F.when(host.isNotNull(), route))


def dedupe_by_fingerprint(urls: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per (fingerprint, original) with the first page that showed it and how often.

    Every original spelling is kept as its own row, not in a per-fingerprint array, so a page that a
    third of all URLs point at stays spread over its spellings. ``is_representative`` marks the
    spelling of the first page of each fingerprint.
    """
    spellings = (
        urls.where(F.col("fingerprint").isNotNull())
        .groupBy("fingerprint", "original")
        .agg(F.min(key).alias("first_page"), F.count("*").alias("n_pages"))
    )
    return spellings


def fingerprint_groups(urls: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per fingerprint: representative original, first page, pages and spellings."""
    return (
        dedupe_by_fingerprint(urls, key)
        .groupBy("fingerprint")
        .agg(
            F.min_by("original", "first_page").alias("original"),
            F.min("first_page").alias("first_page"),
            F.sum("n_pages").alias("n_pages"),
            F.count("*").alias("n_originals"),
        )
    )

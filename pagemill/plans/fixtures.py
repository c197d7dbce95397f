"""Inputs that the registered queries derive from the given tables.

Each is SQL that reads the same in Spark and DuckDB apart from two functions, so a query and its
check start from the same rows. {sha} and {nbytes} stand for SHA-256 hex and byte length.
"""

from pyspark.sql import DataFrame, SparkSession

from pagemill.sources.pages import scan_pages

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FIXTURES = {
    "capture_commands": """
        select event_id as delivery_id, event_id - event_id % 2 as command_id,
               user_id % 10 as owner_id, ts as received_at,
               case when event_type = 'error' then 'content.capture.wrong.v1'
                    else 'content.capture.requested.v1' end as command_type,
               (event_id - event_id % 2) % (select count(*) + 5 from pages) as page_id
        from events""",
    "fetch_log": """
        select event_id as fetch_id, (event_id * 7) % (select greatest(count(*), 1) from pages) as page_id,
               concat('h', cast(user_id % 20 as string)) as host, ts as fetched_at,
               case event_type when 'error' then 503 when 'view' then 304 when 'signup' then 302
                    when 'click' then 404 else 200 end as http_status,
               value / 100.0 as duration_s,
               cast(floor(value * 100000) as bigint) as wire_bytes,
               cast(floor(value * 300000) as bigint) as decoded_bytes,
               1 + event_id % 3 as attempts,
               case event_id % 5 when 0 then 'gzip' when 1 then 'br' when 2 then 'zstd'
                    when 3 then 'compress' else 'identity' end as content_encoding,
               case event_id % 4 when 0 then 'Text/HTML; charset=utf-8' when 1 then 'application/pdf'
                    when 2 then '' else 'application/json' end as content_type
        from events""",
    "dns_answers": """
        select concat('h', cast(user_id as string)) as host, event_id as ordinal,
               concat_ws('.', cast((event_id * 37) % 256 as string),
                         cast((event_id * 11) % 256 as string),
                         cast((event_id * 5) % 256 as string),
                         cast((event_id * 3) % 256 as string)) as address
        from events""",
    "blob_refs": """
        select page_id,
               case when page_id % 11 = 0 then 'other-service' else 'web-extract' end as owner_service,
               case when page_id % 13 = 0 then 'md5' else 'sha256' end as digest_algorithm,
               case when page_id % 7 = 0 then {sha}(concat(html, 'x')) else {sha}(html) end
                   as digest_hex,
               'text/html' as media_type,
               case when page_id % 5 = 0 then {nbytes}(html) + 1 else {nbytes}(html) end
                   as length_bytes
        from pages""",
    "redirect_hops": """
        select page_id as url_id,
               case when page_id between 100 and 119 then page_id + 1
                    when page_id in (201, 202) then page_id + 1
                    when page_id = 203 then 201
                    when page_id % 5 = 0 then null
                    else page_id - 1 end as next_id
        from pages""",
    "runs": """
        select o_orderkey as run_id, o_custkey % 50 as owner_id, o_orderkey % (select greatest(count(*), 1) from pages) as page_id,
               case o_orderstatus when 'F' then 'succeeded' when 'O' then 'queued'
                    else 'running' end as status,
               o_orderdate as queued_at,
               case when o_orderstatus = 'P' and o_orderkey % 3 = 1
                        then timestamp '1990-01-01 00:00:00'
                    when o_orderstatus = 'P' and o_orderkey % 3 = 2
                        then timestamp '2100-01-01 00:00:00' end as claimed_until
        from orders""",
    "outbox": """
        select o_orderkey as outbox_id, o_orderkey * 10 as message_id,
               case when o_orderkey % 2 = 0 then 'evt.content.document.extracted.v1'
                    else 'evt.platform.operation.reported.v1' end as subject,
               o_orderkey % 13 as attempts, o_orderdate as enqueued_at,
               o_orderdate as next_attempt_at, o_orderstatus = 'F' as published,
               o_orderkey % 13 = 12 as dead_lettered,
               concat('line one', chr(10), 'line two of order ', cast(o_orderkey as string))
                   as last_error
        from orders""",
    # Responses with bodies that exercise the sniffer.
    "responses": """
        select page_id, url,
               case page_id % 5 when 0 then html when 1 then concat('%PDF-1.7 ', url)
                    when 2 then concat('  ', replace(html, '<!DOCTYPE html>', '<!DocType html>'))
                    when 3 then concat(chr(10), html) else url end as body,
               case page_id % 3 when 0 then 'Text/HTML; charset=utf-8' when 1 then ''
                    else 'application/JSON' end as content_type
        from pages""",
    # Completion calls of runs: up to seven per run, in shipping order.
    "completions": """
        select l_orderkey as run_id, l_shipdate as finished_at, l_linenumber as attempt,
               case when l_returnflag = 'R' then 'failed' else 'succeeded' end as result,
               case when l_returnflag = 'R' then 'fetch' end as error_class
        from lineitem""",
    # JSON deliveries: a wrong subject, a wrong type, a bad instant, a foreign tenant, a file URL and
    # broken JSON beside valid ones with an unknown member.
    "command_json": """
        select event_id as delivery_id,
               case when event_id % 17 = 3 then 'cmd.other.v1'
                    else 'cmd.content.capture.requested.v1' end as subject,
               concat('{{"command_id":"00000000-0000-7000-8000-',
                      lpad(cast(event_id - event_id % 2 as string), 12, '0'),
                      '","command_type":"',
                      case when event_type = 'error' then 'content.capture.wrong.v1'
                           else 'content.capture.requested.v1' end,
                      '","requested_at":"',
                      case when event_id % 19 = 4 then 'not-an-instant'
                           else '2026-08-21T10:00:00Z' end,
                      '","operation_id":"00000000-0000-7000-8001-',
                      lpad(cast(event_id as string), 12, '0'),
                      '","tenant_id":"',
                      case when event_id % 23 = 5 then 'admin' else 'user' end,
                      ':00000000-0000-7000-8002-', lpad(cast(user_id as string), 12, '0'),
                      '","correlation_id":"operation:', cast(event_id as string),
                      '","idempotency_key":"k', cast(event_id as string),
                      '","payload":{{"url":"',
                      case when event_id % 29 = 6 then 'file:///etc/hosts'
                           else concat('https://example.com/', cast(user_id as string)) end,
                      '"}},"future_member":true',
                      case when event_id % 31 = 7 then '' else '}}' end) as body,
               ts as received_at
        from events""",
}


def duckdb_sql(name: str) -> str:
    return FIXTURES[name].format(sha="sha256", nbytes="strlen")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "pages":
        return scan_pages(spark, sf_dir)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived input, with timestamp_ntz columns cast to timestamp (session zone UTC)."""
    sql = FIXTURES[name].replace("{sha}(", "sha2_(").replace("{nbytes}", "octet_length")
    sql = sql.replace("{{", "{").replace("}}", "}")
    sql = sql.replace("sha2_(concat(html, 'x'))", "sha2(concat(html, 'x'), 256)")
    sql = sql.replace("sha2_(html)", "sha2(html, 256)")
    text = sql.replace("{", "{{").replace("}", "}}")
    sources = [t for t in TABLES if f"from {t}" in " ".join(sql.split())]
    for source in sources:
        text = text.replace(f"from {source}", f"from {{{source}}}")
    frame = spark.sql(text, **{source: table(spark, sf_dir, source) for source in sources})
    return frame.select(
        *(
            frame[c].cast("timestamp").alias(c) if t == "timestamp_ntz" else frame[c]
            for c, t in frame.dtypes
        )
    )

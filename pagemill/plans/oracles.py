"""DuckDB SQL that gives the same rows as each registered query, by an independent route.

Page structure is checked by cutting the article with string functions instead of tokens and
windows; everything reads the whole tables.
"""

from pagemill.plans.fixtures import FIXTURES, duckdb_sql

_NOW = "timestamp '2000-01-01 00:00:00'"


def _with(*parts: str) -> str:
    """A WITH clause of fixtures (by name) and literal 'name as (...)' parts."""
    clauses = [
        f"{part}_f as ({duckdb_sql(part)})" if part in FIXTURES else part for part in parts
    ]
    return "with " + ",\n".join(clauses) + "\n"


def _decode(text: str) -> str:
    for entity, char in (
        ("&quot;", "'\"'"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&lt;", "'<'"),
        ("&gt;", "'>'"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'"),
    ):
        text = f"replace({text}, '{entity}', {char})"
    return text


def _words(text: str) -> str:
    return f"trim(regexp_replace({_decode(text)}, '\\s+', ' ', 'g'))"


def _no_tags(text: str) -> str:
    return _words(f"regexp_replace({text}, '<[^>]*>', ' ', 'g')")


# Pages without script and style content and with empty comments, then the article of each.
_CLEAN = """clean as (
  select page_id, html, regexp_replace(regexp_replace(regexp_replace(html,
           '<script[^>]*>.*?</script>', '<script></script>', 'gs'),
           '<style[^>]*>.*?</style>', '<style></style>', 'gs'), '<!--.*?-->', '<!---->', 'gs') as h
  from pages)"""
_ARTICLE = """article as (
  select page_id, h, split_part(split_part(h, '<article>', 2), '</article>', 1) as a from clean)"""
_PIECES = """pieces as (
  select page_id, unnest(l) as piece, generate_subscripts(l, 1) as place from (
    select page_id, string_split(replace(replace(a, '<h1>', chr(1) || 'H'), '<p>', chr(1) || 'P'),
                                 chr(1)) as l
    from article))"""
_BLOCKS = f"""blocks as (
  select page_id, cast(row_number() over (partition by page_id order by place) - 1 as int) as block_pos,
         case when piece[1] = 'H' then 'heading' else 'paragraph' end as kind,
         case when piece[1] = 'H' then 1 end as level, words as text
  from (select page_id, place, piece,
               {_no_tags("split_part(split_part(substr(piece, 2), '</p>', 1), '</h1>', 1)")} as words
        from pieces where place > 1)
  where words <> '')"""
_META = f"""meta as (
  select page_id,
         nullif({_words("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '') as title,
         nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') as language
  from pages)"""
_STARTS = "len(regexp_extract_all({0}, '<[a-zA-Z]'))"
_BODY = "split_part(h, '<body>', 2)"
_LINKS = (
    "coalesce(list_sum(list_transform(regexp_extract_all({0}, '<a [^>]*>([^<]*)</a>', 1), "
    f"lambda t: strlen({_words('t')}))), 0)"
)
_STATS = f"""stats as (
  select page_id, 'html' as name, -1 as place, n as n_blocks, bytes as text,
         {_LINKS.format(_BODY)} as links, 0 as boilerplate, {_STARTS.format('h')} as elements
  from article join sizes using (page_id)
  union all
  select page_id, 'body' as name, 0 as place, n as n_blocks, bytes as text,
         {_LINKS.format(_BODY)} as links, 0 as boilerplate, 1 + {_STARTS.format(_BODY)} as elements
  from article join sizes using (page_id)
  union all
  select page_id, 'div', 1, 0, 0, 0, 0, 1 from clean where h like '%<div class="ad">%'
  union all
  select page_id, 'article', 2, n, bytes, {_LINKS.format('a')}, 0, 1 + {_STARTS.format('a')}
  from article join sizes using (page_id))"""
_SIZES = """sizes as (
  select a.page_id, count(b.page_id) as n, coalesce(sum(strlen(b.text)), 0) as bytes,
         count(*) filter (where b.kind = 'paragraph') as paragraphs
  from article a left join blocks b using (page_id) group by 1)"""
_ROOTS = """roots as (
  select 'semantic' as strategy, 0 as priority, * from stats where name = 'article' and n_blocks > 0
  union all
  select * from (select 'readability', 1, * from stats qualify row_number() over (
    partition by page_id order by greatest(greatest(text - links, 0) - boilerplate, 0) desc,
    place desc) = 1)
  union all
  select * from (select 'density', 2, * from stats qualify row_number() over (
    partition by page_id order by greatest(greatest(text - links, 0) - boilerplate, 0) * 1000
      // elements desc, place desc) = 1))"""
_CANDIDATES = """candidates as (
  select p.page_id, s.strategy, s.priority, coalesce(r.n_blocks, 0) as n_blocks,
         coalesce(r.text, 0) as text, coalesce(r.links, 0) as links,
         coalesce(r.boilerplate, 0) as boilerplate
  from pages p cross join (values ('semantic', 0), ('readability', 1), ('density', 2))
         s(strategy, priority)
  left join roots r on r.page_id = p.page_id and r.strategy = s.strategy)"""
_SCORED = """scored as (
  select *, text_volume + paragraph_distribution + non_link_share + non_boilerplate_share
            + title_agreement as score
  from (select c.page_id, c.strategy, c.priority, c.text as text_characters,
          case when c.n_blocks > 0 then z.paragraphs else 0 end as paragraph_count,
          least(c.text, 300) * 300 // 300 as text_volume,
          least(case when c.n_blocks > 0 then z.paragraphs else 0 end, 4) * 200 // 4
            as paragraph_distribution,
          case when c.text = 0 then 0 else (c.text - least(c.links, c.text)) * 200 // c.text end
            as non_link_share,
          case when c.text = 0 then 0 else (c.text - least(c.boilerplate, c.text)) * 200 // c.text end
            as non_boilerplate_share,
          case when c.n_blocks > 0 and exists (select 1 from blocks b where b.page_id = c.page_id and
                 b.kind = 'heading' and
                 translate(b.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') =
                 translate(m.title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
               then 100 else 0 end as title_agreement
        from candidates c join sizes z using (page_id) join meta m using (page_id)))"""
_DECIDED = """decided as (
  select *, text_characters >= 120 and score >= 350 as accepted,
         case when text_characters >= 120 and score >= 350 then 'accepted'
              else concat_ws(',', case when text_characters < 120 then 'too_short' end,
                             case when score < 350 then 'below_threshold' end) end as reasons
  from scored)"""
_WINNERS = """winners as (
  select * from decided where accepted
  qualify row_number() over (partition by page_id order by score desc, priority) = 1)"""
_PAGE = (_CLEAN, _ARTICLE, _PIECES, _BLOCKS, _META, _SIZES, _STATS, _ROOTS, _CANDIDATES, _SCORED,
         _DECIDED, _WINNERS)
_BLOCK_JSON = """block_json as (
  select page_id, count(*) as n_blocks, string_agg(text, chr(10) || chr(10) order by block_pos) as plain,
         string_agg(case when kind = 'heading' then '# ' || text else text end, chr(10) || chr(10)
                    order by block_pos) as md,
         '[' || string_agg(case when kind = 'heading'
             then '{"kind":"heading","level":1,"text":' || cast(to_json(text) as varchar) || '}'
             else '{"kind":"paragraph","text":' || cast(to_json(text) as varchar) || '}' end,
           ',' order by block_pos) || ']' as body
  from blocks group by 1)"""
_DOCUMENTS = """documents_f as (
  select w.page_id, m.title, m.language, w.strategy, w.score, j.n_blocks,
         sha256(j.body) as content_digest, j.body, j.plain, j.md
  from winners w join meta m using (page_id) join block_json j using (page_id))"""
_DOCS = (*_PAGE, _BLOCK_JSON, _DOCUMENTS)

# Canonical URLs of plain http(s) page addresses.
_URLS = """urls_f as (
  select page_id, original, normalized, host, path, query, sha256(normalized) as fingerprint
  from (select *, concat(scheme, '://', host, path, case when query is null then '' else '?' || query end)
                 as normalized
    from (select page_id, url as original, lower(split_part(url, '://', 1)) as scheme,
            lower(split_part(regexp_replace(rest, '[/?#].*$', ''), ':', 1)) as host,
            case when split_part(split_part(rest, '#', 1), '?', 1) like '%/%'
                 then regexp_replace(split_part(split_part(rest, '#', 1), '?', 1), '^[^/]*', '')
                 else '/' end as path,
            nullif(array_to_string(list_filter(string_split(
              case when position('?' in split_part(rest, '#', 1)) > 0
                   then substr(split_part(rest, '#', 1), position('?' in split_part(rest, '#', 1)) + 1)
                   else '' end, '&'),
              lambda p: split_part(p, '=', 1) not in ('utm_source', 'utm_medium', 'utm_campaign',
                'utm_term', 'utm_content', 'gclid', 'fbclid')), '&'), '') as query
          from (select page_id, url, split_part(url, '://', 2) as rest from pages))))"""
_ADDRESS = """classified as (
  select host, ordinal, address, case
      when address = '0.0.0.0' then 'unspecified'
      when o1 = 127 then 'loopback'
      when address in ('169.254.169.254', '169.254.170.2') then 'metadata'
      when o1 = 10 or (o1 = 172 and o2 between 16 and 31) or (o1 = 192 and o2 = 168) then 'private'
      when o1 = 100 and o2 between 64 and 127 then 'shared'
      when o1 = 169 and o2 = 254 then 'link_local'
      when (o1 = 192 and o2 = 0 and o3 = 2) or (o1 = 198 and o2 = 51 and o3 = 100)
        or (o1 = 203 and o2 = 0 and o3 = 113) then 'documentation'
      when o1 = 198 and o2 in (18, 19) then 'benchmarking'
      when o1 between 224 and 239 then 'multicast'
      when o1 = 0 or o1 >= 240 or (o1 = 192 and o2 = 0 and o3 = 0)
        or (o1 = 192 and o2 = 88 and o3 = 99) then 'reserved' end as blocked_class,
    '00000000000000000000ffff' || printf('%02x%02x%02x%02x', o1, o2, o3, o4) as address_hex
  from (select host, ordinal, address, cast(split_part(address, '.', 1) as int) as o1,
               cast(split_part(address, '.', 2) as int) as o2,
               cast(split_part(address, '.', 3) as int) as o3,
               cast(split_part(address, '.', 4) as int) as o4 from dns_answers_f))"""
_MEDIA = """media as (
  select page_id, case
      when body like '\\%PDF-%' escape '\\' then 'application/pdf'
      when regexp_matches(ltrim(body, ' ' || chr(10)), '^(<!DOCTYPE html|<!doctype html|<html)') then 'text/html'
      when split_part(content_type, ';', 1) = '' then 'application/octet-stream'
      else lower(trim(split_part(content_type, ';', 1))) end as media_type
  from responses_f)"""
_OUTCOME = """outcome as (
  select *, case when outcome <> 'failed' then null when http_status = 404 then 'remote_status'
                 when http_status = 503 then 'remote_status' else 'unsupported_encoding' end as failure
  from (select *, case
      when http_status = 503 then case when attempts <= 2 then 'retry' else 'failed' end
      when http_status = 302 then 'redirect' when http_status = 304 then 'not_modified'
      when http_status = 404 then 'failed'
      when content_encoding = 'compress' then 'failed'
      when wire_bytes > 26214400 then 'failed' when decoded_bytes > 52428800 then 'failed'
      else 'success' end as outcome from fetch_log_f))"""
_OUTCOME = _OUTCOME.replace(
    "else 'unsupported_encoding' end as failure",
    "when content_encoding = 'compress' then 'unsupported_encoding' "
    "when wire_bytes > 26214400 then 'wire_body_too_large' else 'decoded_body_too_large' end as failure",
)
_OUTBOX = """ob as (
  select outbox_id, message_id, subject, attempts, enqueued_at, next_attempt_at, last_error,
         case when published then enqueued_at end as published_at,
         case when dead_lettered then enqueued_at end as dead_lettered_at,
         case when outbox_id % 5 = 0 then enqueued_at + interval 2000 day end as claimed_until
  from outbox_f)"""
_DUE_OUTBOX = f"""due as (
  select * from ob where published_at is null and dead_lettered_at is null
    and next_attempt_at <= {_NOW} and (claimed_until is null or claimed_until <= {_NOW})
  order by next_attempt_at, enqueued_at, outbox_id limit 1000)"""
_DUE_RUNS = f"""due as (
  select * from runs_f where status = 'queued'
     or (status = 'running' and (claimed_until is null or claimed_until <= {_NOW}))
  order by queued_at, run_id limit {{limit}})"""
_ATTEMPTS = """attempts_f as (
  select fetch_id, attempt, cast(floor(duration_s * 25000) as bigint) * attempt as duration_ms,
         (attempt - 1) * 100 as delay_ms
  from (select fetch_id, duration_s, unnest(generate_series(1, attempts)) as attempt from fetch_log_f))"""
_DELIVERIES = """deliveries as (
  select c.delivery_id, c.command_id, c.owner_id, c.received_at, c.command_type, u.original,
         u.normalized, u.host
  from capture_commands_f c join urls_f u using (page_id))"""
_PAGELESS = """pageless as (
  select delivery_id, command_id from capture_commands_f
  where command_type = 'content.capture.requested.v1' and page_id not in (select page_id from pages))"""
_APPLIED = """applied as (
  select * from deliveries where command_type = 'content.capture.requested.v1'
  qualify row_number() over (partition by command_id order by received_at, delivery_id) = 1)"""
_PROCESSED = """processed as (
  select *, case when error_class is null then 'succeeded' else 'failed' end as status,
         coalesce(error_class = 'fetch' and run_id % 7 = 0, false) as retryable
  from (select r.run_id, r.owner_id, r.page_id, r.queued_at, case
          when run_id % 7 = 0 or run_id % 11 = 0 then 'fetch'
          when run_id % 5 = 0 then 'unsupported_media' when run_id % 13 = 0 then 'artifact'
          when run_id % 17 = 0 then 'parse'
          when w.page_id is null or r.page_id % 6 = 0 then 'quality' end as error_class
        from runs_f r join pages p using (page_id) left join winners w using (page_id)
        where r.status = 'running'))"""
_MESSAGES = """messages as (
  select event_id as message_id, ts as sent_at, cast(floor(value * 100) as bigint) as bytes from events)"""


def _facts(scope: str) -> str:
    return _with("runs", *_DOCS, _PROCESSED) + f"""
          , n as (select page_id, string_agg(strategy || ':' || score || ':' || selected, ' ' order by strategy) as words
            from (select d.page_id, d.strategy, case when d.page_id % 6 = 0 then 0 else cast(d.score as int) end as score,
                         w.page_id is not null and d.page_id % 6 <> 0 as selected
                  from decided d left join winners w on w.page_id = d.page_id and w.strategy = d.strategy)
            group by 1)
          select run_id, retryable,
            case when kept then 'https://example.com/' || page_id || ':200:fresh' else '' end as fetches,
            case when kept then case when status = 'succeeded' then 'document_ir ' else '' end
              || 'raw_source:' || sha256(html) || ':' || strlen(html) else '' end as artifacts,
            case when kept then n.words else '' end as candidates,
            case when status = 'succeeded' then 'evt.content.document.extracted.v1:' || content_digest || ' ' else '' end
              || 'evt.platform.operation.reported.v1:' || status as outbox
          from (select *, status = 'succeeded' or error_class = 'quality' as kept from processed where {scope})
          join pages using (page_id) left join n using (page_id) left join documents_f using (page_id)"""


def _violations() -> dict[str, str]:
    def rule(name: str, rule_name: str, key: str, source: str, broken: str) -> str:
        return (
            f"select '{name}' as table_name, '{rule_name}' as rule, cast({key} as varchar) as key, "
            f"cast(1 as bigint) as n from {source} where not coalesce({broken}, true)"
        )

    def unique(name: str, rule_name: str, key: str, source: str) -> str:
        return (
            f"select '{name}', '{rule_name}', {key}, count(*) from {source} group by {key} "
            "having count(*) > 1"
        )

    claim = "(claimed_until is null) = (claimed_by is null)"
    runs = """rr as (
      select run_id, status, claimed_until, case when claimed_until is not null then 'worker-1' end
               as claimed_by,
             case when run_id % 4 > 0 and status <> 'queued' then queued_at end as started_at,
             case when status = 'succeeded' then queued_at end as completed_at,
             run_id - run_id % 2 as command_id from runs_f)"""
    artifacts = """aa as (
      select *, page_id // 2 as run_id,
             case when page_id % 4 = 0 then 'thumbnail' else 'raw_source' end as kind
      from blob_refs_f)"""
    inbox = """ii as (
      select command_id, command_type, repeat('p', cast(delivery_id % 70 as int)) as producer,
             case when delivery_id % 3 > 0 then received_at end as applied_at,
             case when delivery_id % 5 > 0 then 'applied' when delivery_id % 7 = 0 then 'lost' end
               as outcome
      from capture_commands_f)"""
    sources = """ss as (
      select page_id as source_id, page_id % 3 as owner_id, original, path,
             case when page_id % 6 = 0 then '' else normalized end as canonical,
             repeat(host, case when page_id % 8 = 0 then 20 else 1 end) as host from urls_f)"""
    decisions = """cc as (
      select page_id || '-' || strategy as id, page_id // 2 as run_id, strategy, score / 900.0 as score,
             case when w.page_id is not null then true else false end as selected
      from decided d left join (select page_id, strategy as ws from winners) w
        on w.page_id = d.page_id and w.ws = d.strategy)""".replace(
        "select page_id ||", "select d.page_id ||").replace("d.page_id || '-' || strategy as id, page_id // 2",
        "d.page_id || '-' || strategy as id, d.page_id // 2")
    return {
        "violations_outbox": _with("outbox", _OUTBOX) + " union all ".join([
            rule("outbox", "error_text", "outbox_id", "ob", "position(chr(10) in last_error) = 0"),
            rule("outbox", "published_and_dead", "outbox_id", "ob",
                 "not (published_at is not null and dead_lettered_at is not null)"),
        ]),
        "violations_runs": _with("runs", runs) + " union all ".join([
            rule("runs", "times_against_status", "run_id", "rr",
                 "(started_at is not null) = (status in ('running', 'succeeded', 'failed')) and "
                 "(completed_at is not null) = (status in ('succeeded', 'failed'))"),
            rule("runs", "claim_has_both_parts", "run_id", "rr", claim),
            unique("runs", "one_row_per_command", "cast(command_id as varchar)", "rr"),
        ]),
        "violations_fetches": _with("fetch_log") + " union all ".join([
            rule("fetches", "http_status_range", "fetch_id", "fetch_log_f",
                 "http_status + 100 between 100 and 599"),
            rule("fetches", "byte_counts", "fetch_id", "fetch_log_f",
                 "wire_bytes - 100000 >= 0 and decoded_bytes >= 0"),
            rule("fetches", "attempt_count", "fetch_id", "fetch_log_f", "attempts - 1 > 0"),
            rule("fetches", "cache_outcome_name", "fetch_id", "fetch_log_f", "fetch_id % 3 <> 0"),
            unique("fetches", "one_fetch_per_run", "cast(page_id as varchar)", "fetch_log_f"),
        ]),
        "violations_artifacts": _with("blob_refs", artifacts) + " union all ".join([
            rule("artifacts", "artifact_kind", "page_id", "aa", "kind = 'raw_source'"),
            rule("artifacts", "artifact_owner", "page_id", "aa", "owner_service = 'web-extract'"),
            rule("artifacts", "digest_form", "page_id", "aa", "digest_algorithm = 'sha256'"),
            unique("artifacts", "one_artifact_per_kind", "run_id || '|' || kind", "aa"),
        ]),
        "violations_candidates": _with(*_PAGE, decisions) + " union all ".join([
            rule("candidates", "score_range", "id", "cc", "score between 0.0 and 1.0"),
            unique("candidates", "one_decision_per_strategy", "run_id || '|' || strategy || '|quality_v1'",
                   "cc"),
            unique("candidates", "one_winner_per_run", "cast(run_id as varchar)",
                   "(select * from cc where selected)"),
        ]),
        "violations_inbox": _with("capture_commands", inbox) + " union all ".join([
            rule("inbox", "wrong_command_type", "command_id", "ii",
                 "command_type = 'content.capture.requested.v1'"),
            rule("inbox", "producer_length", "command_id", "ii",
                 "length(producer) between 1 and 64"),
            rule("inbox", "outcome_without_time", "command_id", "ii",
                 "(outcome is not null) = (applied_at is not null)"),
            rule("inbox", "outcome_name", "command_id", "ii", "outcome <> 'lost'"),
            unique("inbox", "one_row_per_command", "cast(command_id as varchar)", "ii"),
        ]),
        "violations_sources": _with(_URLS, sources) + " union all ".join([
            rule("sources", "url_lengths", "source_id", "ss",
                 "length(original) between 1 and 8192 and length(path) between 1 and 8192 and "
                 "length(canonical) between 1 and 8192"),
            rule("sources", "host_length", "source_id", "ss", "length(host) between 1 and 253"),
            unique("sources", "one_source_per_owner_url", "owner_id || '|' || path", "ss"),
        ]),
    }


def oracle_sql() -> dict[str, str]:
    sql = {
        # Sources and sinks
        "scan_pages": "select page_id, url, cast(strlen(html) as bigint) as html_bytes from pages",
        "scan_facts": _with("runs") + (
            "select cast(run_id as varchar) as run_id, cast(owner_id as varchar) as owner_id, "
            "cast(page_id as varchar) as source_id, status, cast(null as varchar) as document_id, "
            "epoch_us(queued_at) as queued_us from runs_f"
        ),
        "read_commands": """
          select event_id as delivery_id,
            case when bad_json then null else printf('00000000-0000-7000-8000-%012d', event_id - event_id % 2) end
              as command_id,
            case when bad_json then null when event_id % 23 = 5 then lower(substr(tenant, 6, 36))
                 else printf('00000000-0000-7000-8002-%012d', user_id) end as owner_id,
            case when bad_json then null when event_id % 29 = 6 then 'file:///etc/hosts'
                 else 'https://example.com/' || user_id end as url,
            case when event_id % 17 = 3 then 'invalid_subject'
                 when bad_json or event_id % 19 = 4 or event_id % 23 = 5 then 'malformed'
                 when event_type = 'error' then 'invalid_command_type'
                 when event_id % 29 = 6 then 'invalid_url_scheme' end as reject_reason
          from (select *, event_id % 31 = 7 as bad_json,
                  printf('admin:00000000-0000-7000-8002-%012d', user_id) as tenant from events)""",
        "write_documents": _with(*_DOCS) + """
          , bodies as (select page_id, '{"blocks":' || body || ',"content_digest":"' || content_digest ||
              '"' || coalesce(',"language":' || cast(to_json(language) as varchar), '') ||
              ',"strategy":"' || strategy || '"' ||
              coalesce(',"title":' || cast(to_json(title) as varchar), '') || '}' as body
            from documents_f)
          select min(page_id) as page_id, substr(sha256(body), 1, 2) as prefix,
                 'document-json-v1' as layout, sha256(body) as digest from bodies group by body""",
        "upsert_facts": _with("completions") + """
          select run_id, arg_min(run_id || '-' || attempt, rank) as fetch_id,
                 arg_max(result, rank) as result, arg_max(attempt, rank) as attempt,
                 epoch_us(arg_max(finished_at, rank)) as at_us
          from (select *, row_number() over (order by attempt > 3, finished_at, attempt,
                  run_id || '-' || attempt, result) as rank from completions_f)
          group by run_id""",
        "upsert_sources": _with("capture_commands", _URLS, _DELIVERIES, _APPLIED.replace(
            "where command_type = 'content.capture.requested.v1'", "")) + """
          select sha256('source|' || owner_id || '|' || normalized) as source_id, owner_id,
                 arg_min(original, rank) as original_url, normalized as normalized_url,
                 normalized as canonical_url, any_value(host) as host,
                 'generic_web' as classification, epoch_us(min(received_at)) as created_us
          from (select *, row_number() over (order by received_at, delivery_id) as rank from applied)
          group by owner_id, normalized""",
        "publish_events": _with("outbox", _OUTBOX, _DUE_OUTBOX.replace(" limit 1000", ""))
        + "select message_id, subject, '{}' as payload from due",
        # URLs and policy
        "canonicalize_urls": _with(_URLS)
        + "select page_id, original, normalized, host, path, query, fingerprint from urls_f",
        "reject_urls": """
          select page_id, case page_id % 12 when 0 then 'too_long' when 1 then 'missing_host'
            when 2 then 'invalid' when 3 then 'unsupported_scheme' when 4 then 'user_information'
            when 5 then 'port_zero' when 6 then 'port_denied' when 7 then 'ambiguous_numeric_host'
            when 8 then 'ambiguous_numeric_host' when 9 then 'invalid' end as reject_reason
          from pages""",
        "strip_tracking": """
          with q as (select page_id, split_part(split_part(url, '#', 1), '?', 1) as base,
              case page_id % 6 when 1 then 'a=1&&b=2' when 2 then 'keep=1'
                when 3 then 'UTM_SOURCE=x' when 5 then 'z' end as query from pages)
          select page_id, query, lower(split_part(base, '://', 1)) || '://' ||
                 split_part(base, '://', 2) || case when split_part(base, '://', 2) like '%/%' then ''
                 else '/' end || coalesce('?' || query, '') as normalized from q""",
        "ambiguous_hosts": """
          select page_id, case when page_id % 6 = 4 then '10.0.0.' || (page_id % 250) end as host,
                 case when page_id % 6 < 4 then 'ambiguous_numeric_host'
                      when page_id % 6 = 5 then 'invalid' end as reject_reason
          from pages""",
        "classify_sources": """
          select page_id, case page_id % 14 when 0 then 'github.com' when 1 then 'api.github.com'
              when 2 then 'x.com' when 3 then 'mobile.twitter.com' when 4 then 'www.instagram.com'
              when 5 then 'www.threads.net' when 6 then 'old.reddit.com' when 7 then 'redd.it'
              when 8 then 'news.ycombinator.com' when 9 then 'youtu.be'
              when 10 then 'github.com.example.test' when 11 then 'notreddit.com'
              when 12 then 'files.example.com' else lower(split_part(url, '/', 3)) end as host,
            case page_id % 14 when 0 then 'github' when 1 then 'github' when 2 then 'x'
              when 3 then 'x' when 4 then 'instagram' when 5 then 'threads' when 6 then 'reddit'
              when 7 then 'reddit' when 8 then 'hacker_news' when 9 then 'youtube'
              when 12 then 'pdf' else 'generic_web' end as route
          from pages""",
        "dedupe_by_fingerprint": _with(_URLS) + """
          select fingerprint, original, min(page_id) as first_page, count(*) as n_pages
          from urls_f group by 1, 2""",
        "fingerprint_groups": _with(_URLS) + """
          select fingerprint, arg_min(original, page_id) as original, min(page_id) as first_page,
                 count(*) as n_pages, count(distinct original) as n_originals
          from urls_f group by 1""",
        "classify_addresses": _with("dns_answers", _ADDRESS)
        + "select host, ordinal, address, blocked_class from classified",
        "resolve_policy": _with("dns_answers", _ADDRESS) + """
          select host as lookup_id,
                 case when count(blocked_class) > 0 then 'policy' else 'allow' end as outcome,
                 arg_min(blocked_class, ordinal) filter (where blocked_class is not null)
                   as blocked_class
          from classified group by host
          union all
          select 's' || s_suppkey, case when s_suppkey % 2 = 0 then 'dns' else 'empty' end, null
          from supplier""",
        "effective_media_type": _with("responses", _MEDIA) + "select page_id, media_type from media",
        "require_html": _with("responses", _MEDIA) + """
          select page_id, case when media_type <> 'text/html' then 'unsupported_media' end
            as error_class from media""",
        "classify_encoding": _with("fetch_log") + """
          select fetch_id, case when content_encoding <> 'compress' then content_encoding end as encoding,
                 case when content_encoding = 'compress' then 'unsupported_encoding' end as failure
          from fetch_log_f""",
        "project_safe_evidence": _with("fetch_log") + """
          select fetch_id, 'Content-Type,ETag,content-encoding' as names, 'e' || fetch_id as etag
          from fetch_log_f""",
        # Extraction
        "tokenize": _with(_CLEAN) + f"""
          , t as (select *, regexp_replace(h, '(?s)<title>.*?</title>', '<title></title>') as g from clean),
          k as (select page_id,
              {_STARTS.format('g')} - len(regexp_extract_all(g, '<(script|style|title)[ >]')) as s,
              len(regexp_extract_all(g, '<(script|style|title)[ >]')) as r,
              len(regexp_extract_all(g, '</[a-zA-Z]')) as e, len(regexp_extract_all(g, '<!--')) as c,
              len(regexp_extract_all(g, '<!(DOCTYPE|doctype)')) as d,
              len(list_filter(regexp_extract_all(g, '>([^<]+)', 1), lambda x: trim(x) <> '')) as x
            from t)
          select page_id, unnest(['start', 'raw', 'end', 'comment', 'doctype', 'text']) as kind,
                 unnest([s, r, e, c, d, x]) as n from k
          qualify n > 0""".replace("from k\n          qualify n > 0", "from k"),
        "element_spans": _with(_CLEAN) + """
          , n as (select page_id, h, unnest(['a', 'p', 'h1', 'article', 'nav', 'footer', 'div', 'body'])
                    as name from clean)
          select page_id, name, n, case when name = 'body' then 1
                 when name in ('p', 'h1', 'a') then 0 else n - c end as n_open
          from (select page_id, name, len(regexp_extract_all(h, '<' || name || '[ >]')) as n,
                       len(regexp_extract_all(h, '</' || name || '>')) as c from n)
          where n > 0""",
        "enforce_limits": _with(_CLEAN) + f"""
          , t as (select *, regexp_replace(h, '(?s)<title>.*?</title>', '<title>x</title>') as g from clean),
          k as (select page_id, strlen(html) as size, 1 + {_STARTS.format('g')}
              + len(regexp_extract_all(g, '<!')) + len(regexp_extract_all(g, '>([^<]+)', 1))
              + len(regexp_extract_all(html, '<(script|style)[^>]*>[^<]')) as nodes from t)
          select page_id, case when size <= 8000 and page_id % 19 <> 7 then nodes end as n_nodes,
                 case when page_id % 19 = 7 then 'missing_body'
                      when size > 8000 or nodes > 80 then 'resource_limit' end as parse_failure from k""",
        "page_outcomes": _with(*_PAGE) + f"""
          , t as (select *, regexp_replace(h, '(?s)<title>.*?</title>', '<title>x</title>') as g from clean),
          k as (select page_id, strlen(html) as size, 1 + {_STARTS.format('g')}
              + len(regexp_extract_all(g, '<!')) + len(regexp_extract_all(g, '>([^<]+)', 1))
              + len(regexp_extract_all(html, '<(script|style)[^>]*>[^<]')) as nodes from t),
          o as (select page_id, case when page_id % 19 = 7 then 'missing_body'
                when size > 8000 or nodes > 80 then 'resource_limit'
                when page_id in (select page_id from winners) then 'document' else 'low_quality' end as outcome
              from k)
          select page_id, outcome, case outcome when 'resource_limit' then 'parse' when 'missing_body' then 'parse'
              when 'low_quality' then 'quality' end as error_class from o""",
        "page_metadata": _with(_META) + "select page_id, title, language from meta",
        "blocks": _with(_CLEAN, _ARTICLE, _PIECES, _BLOCKS)
        + "select page_id, block_pos, kind, level, text from blocks",
        "containers": _with(_CLEAN) + """
          select page_id, name, len(regexp_extract_all(h, '<' || name || '[ >]')) as n
          from (select page_id, h, unnest(['article', 'div', 'body', 'html']) as name from clean)
          where len(regexp_extract_all(h, '<' || name || '[ >]')) > 0""",
        "container_stats": _with(*_PAGE) + """
          select page_id, name, n_blocks, cast(text as bigint) as text, cast(links as bigint) as links,
                 boilerplate, elements from stats""",
        "candidates": _with(*_PAGE) + """
          select page_id, strategy, n_blocks, cast(text as bigint) as text,
                 cast(links as bigint) as links, boilerplate from candidates""",
        "score_candidates": _with(*_PAGE) + """
          select page_id, strategy, cast(text_characters as int) as text_characters,
            cast(paragraph_count as int) as paragraph_count, cast(text_volume as int) as text_volume,
            cast(paragraph_distribution as int) as paragraph_distribution,
            cast(non_link_share as int) as non_link_share,
            cast(non_boilerplate_share as int) as non_boilerplate_share, title_agreement,
            cast(score as int) as score from scored""",
        "accept_candidates": _with(*_PAGE) + """
          select page_id, strategy, 'quality_v1' as extractor_version, accepted, reasons from decided""",
        "select_winner": _with(*_PAGE) + """
          select d.page_id, d.strategy, cast(d.score as int) as score, w.page_id is not null as selected
          from decided d left join winners w on w.page_id = d.page_id and w.strategy = d.strategy""",
        "low_quality": _with(*_PAGE) + """
          select page_id, strategy, 'quality' as error_class, reasons from decided
          where page_id not in (select page_id from winners)""",
        "build_documents": _with(*_DOCS) + """
          select page_id, title, language, strategy, cast(score as int) as score,
                 cast(n_blocks as int) as n_blocks, content_digest from documents_f""",
        "provenance": _with(*_PAGE) + """
          select b.page_id, b.block_pos as block_index, w.strategy, sha256(p.html) as blob_digest
          from winners w join blocks b using (page_id) join pages p using (page_id)""",
        "source_blobs": """
          select page_id, 'web-extract' as owner_service, 'sha256' as digest_algorithm,
                 sha256(html) as digest_hex, 'text/html' as media_type,
                 cast(strlen(html) as bigint) as length_bytes from pages""",
        # Joins
        "work_list": _with("runs", _URLS, _DUE_RUNS.format(limit=500)) + """
          select d.run_id, d.page_id as source_id, u.normalized as normalized_url,
                 epoch_us(d.queued_at) as queued_us
          from due d join urls_f u using (page_id)""",
        "claim": _with("runs", _DUE_RUNS.format(limit=500)) + f"""
          select r.run_id, case when d.run_id is not null then 'running' else r.status end as status,
            epoch_us(case when r.status <> 'queued' then r.queued_at
                          when d.run_id is not null then {_NOW} end) as started_us,
            case when d.run_id is not null then 'worker-2'
                 when r.claimed_until is not null then 'worker-1' end as claimed_by,
            epoch_us(case when d.run_id is not null then {_NOW} + interval 60 second
                          else r.claimed_until end) as claimed_us
          from runs_f r left join due d using (run_id)""",
        "owner_scope": _with("runs") + """
          select l.l_orderkey as run_id, l.l_suppkey % 50 as owner_id, l.l_linenumber as line,
                 case when r.run_id is null then 'owner_mismatch' end as error
          from lineitem l left join runs_f r on r.run_id = l.l_orderkey and r.owner_id = l.l_suppkey % 50""",
        "verify_blobs": _with("blob_refs") + """
          select page_id, case when page_id % 11 = 0 then 'wrong_owner'
            when page_id % 13 = 0 then 'unsupported_algorithm' when page_id % 7 = 0 then 'missing'
            when page_id % 5 = 0 then 'mismatch' else 'ok' end as verification from blob_refs_f""",
        "revalidate": _with("fetch_log", "blob_refs") + """
          , f as (select l.fetch_id, l.page_id, l.fetched_at, l.http_status,
              case when l.fetch_id % 3 > 0 then 'e' || l.fetch_id end as etag,
              case when l.fetch_id % 2 > 0 then 'm' || l.fetch_id end as last_modified,
              b.media_type, cast(b.length_bytes as bigint) as length_bytes,
              case when l.page_id % 11 = 0 or l.page_id % 13 = 0 or l.page_id % 7 = 0
                     or l.page_id % 5 = 0 then 'bad' else 'ok' end as verification
            from fetch_log_f l join blob_refs_f b using (page_id)),
          p as (select n.fetch_id, n.etag, n.last_modified, o.fetch_id as prior_fetch_id,
              o.etag as p_etag, o.last_modified as p_modified, o.media_type, o.length_bytes,
              coalesce(o.verification = 'ok', false) as usable
            from (select * replace (case when fetch_id % 21 = 5 then null else page_id end as page_id)
                  from f where http_status = 304) n
            asof left join (select * from f where http_status = 200 and fetch_id % 21 <> 5) o
              on n.page_id = o.page_id and n.fetched_at > o.fetched_at)
          select fetch_id, prior_fetch_id,
                 case when usable then 'revalidated' else 'cache_integrity' end as outcome,
                 case when usable then coalesce(etag, p_etag) end as etag,
                 case when usable then coalesce(last_modified, p_modified) end as last_modified,
                 case when usable then media_type end as media_type,
                 case when usable then cast(0 as bigint) end as wire_bytes,
                 case when usable then length_bytes end as decoded_bytes from p""",
        "address_ranges": _with("dns_answers", _ADDRESS) + """
          select blocked_class, count(*) as n, min(address_hex) as low, max(address_hex) as high
          from classified group by 1""",
        "dangling_references": """
          with c as (select 'artifacts_run' as reference, s_suppkey * 2 as key from supplier
              where s_suppkey * 2 not in (select o_orderkey from orders)
            union all select 'candidates_run', p_partkey from part
              where p_partkey not in (select o_orderkey from orders)
            union all select 'candidates_artifact', p_partkey from part
              where p_partkey % 4 > 0 and p_partkey not in (select s_suppkey * 3 from supplier)
            union all select 'runs_command', o_orderkey from orders
              where o_orderkey not in (select event_id from events)
            union all select 'runs_source', o_custkey from orders
              where o_custkey not in (select c_custkey + 5 from customer)
            union all select 'fetches_run', l_orderkey + l_linenumber from lineitem
              where l_orderkey + l_linenumber not in (select o_orderkey from orders)
            union all select 'outbox_command', o_orderkey * 2 from orders
              where o_orderkey * 2 not in (select event_id from events))
          select reference, cast(key as varchar) as key, count(*) as n from c group by 1, 2""",
        "corpus_report": _with(*_PAGE) + """
          , e as (select cast(page_id + 5 as varchar) as case_name,
                    case when page_id % 10 <> 0 then 'semantic' end as strategy from pages),
          d as (select cast(page_id as varchar) as case_name, strategy, score from winners)
          select coalesce(e.case_name, d.case_name) as case_name,
            case when e.case_name is null then 'unexpected' when d.case_name is null then 'missing'
              when d.strategy is distinct from e.strategy then 'wrong_strategy'
              when d.score not between 850 and 1000 then 'score_out_of_range' else 'ok' end as verdict
          from e full outer join d using (case_name)""",
        "redirect_chains": _with("redirect_hops") .replace("with ", "with recursive ", 1) + """
          , walk as (
            select url_id as start_id, url_id as here, [url_id] as visited, 0 as hops,
                   cast(null as varchar) as outcome from redirect_hops_f
            union all
            select w.start_id, case when o.o is null then n.next_id else w.here end,
                   case when o.o is null then list_append(w.visited, n.next_id) else w.visited end,
                   case when o.o is null then w.hops + 1 else w.hops end, o.o
            from walk w left join redirect_hops_f n on n.url_id = w.here
            cross join lateral (select case when n.url_id is null then 'unfetched'
                when n.next_id is null then 'final' when w.hops = 10 then 'redirect_limit'
                when list_contains(w.visited, n.next_id) then 'redirect_loop' end as o) o
            where w.outcome is null)
          select start_id, outcome, cast(hops as bigint) as hops, cast(here as varchar) as final_id
          from walk where outcome is not null""",
        # Aggregations
        "command_outcomes": _with("capture_commands") + """
          , o as (select command_id, command_type <> 'content.capture.requested.v1' as wrong
                  from capture_commands_f)
          select 'applied' as outcome, count(distinct command_id) as n from o where not wrong
          union all select 'duplicate', count(*) - count(distinct command_id) from o where not wrong
          union all select 'rejected', count(*) from o where wrong""",
        "run_outcome_counts": _with("runs", *_PAGE, _PROCESSED) + """
          select status, error_class as last_error_class, count(*) as n from processed group by 1, 2""",
        "fetch_totals": _with("fetch_log", _OUTCOME) + """
          , d as (select case when outcome = 'success' then 'fresh' else 'revalidated' end as cache_outcome,
                    wire_bytes, decoded_bytes from outcome where outcome in ('success', 'not_modified'))
          select cache_outcome, count(*) as n, 'wire' as representation,
                 cast(sum(wire_bytes) as bigint) as bytes from d group by 1
          union all select cache_outcome, count(*), 'decoded', cast(sum(decoded_bytes) as bigint)
          from d group by 1""",
        "duration_histogram": _with("fetch_log") + """
          select label as le, (select count(*) from fetch_log_f where duration_s <= bound) as n
          from (values ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05),
            ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1', 1.0), ('2.5', 2.5), ('10', 10.0),
            ('30', 30.0), ('+Inf', 1e300)) b(label, bound)""",
        "fetch_failures": _with("fetch_log", _OUTCOME) + """
          select case when failure like '%too_large' then 'resource_limit' else 'transport' end
                   as failure_class, count(*) as n
          from outcome where failure is not null group by 1""",
        "outbox_report": _with("outbox") + """
          select count(*) as claimed, count(*) filter (where outbox_id % 3 > 0) as published,
                 count(*) filter (where outbox_id % 3 = 0) as failed,
                 count(*) filter (where outbox_id % 3 = 0 and attempts + 1 >= 12) as dead_lettered
          from outbox_f where not published""",
        "run_counts": _with(*_PAGE) + """
          select d.page_id, count(*) as candidates, count(w.page_id) as selected, count(d.score) as scored
          from decided d left join winners w on w.page_id = d.page_id and w.strategy = d.strategy
          group by 1""",
        "validate_candidate_sets": _with(*_PAGE) + """
          select p.page_id, case when (w.page_id is not null) = (p.page_id % 9 <> 0) then 'ok'
                                 else 'invalid_run_state' end as state
          from pages p left join winners w using (page_id)""",
        "content_dedup": """
          select sha256(text) as digest_hex, cast(strlen(text) as bigint) as length_bytes,
                 count(*) as n_observations, min(doc_id) as first_key from documents group by text""",
        "attempts_per_fetch": _with("fetch_log") + "select fetch_id, attempts from fetch_log_f",
        # Windows, sorts, limits
        "mark_duplicates": _with("capture_commands") + """
          select delivery_id, command_id, case when row_number() over (partition by command_id
            order by received_at, delivery_id) = 1 then 'applied' else 'duplicate' end as outcome
          from capture_commands_f""",
        "first_deliveries": _with("capture_commands") + """
          select min(delivery_id) as delivery_id, command_id from capture_commands_f group by 2""",
        "retry_schedule": _with("fetch_log", _ATTEMPTS) + """
          , r as (select fetch_id, attempt, sum(duration_ms + delay_ms) over w as elapsed_ms,
                    duration_ms + delay_ms as own from attempts_f
                  window w as (partition by fetch_id order by attempt))
          select fetch_id, attempt, cast(elapsed_ms as bigint) as elapsed_ms,
            case when elapsed_ms - own > 30000 then 'not_sent' when elapsed_ms > 30000
                 then 'timeout_total' else 'sent' end as status from r""",
        "concurrency_audit": _with("fetch_log") + """
          , s as (select fetch_id, host, epoch_us(date_trunc('minute', fetched_at)) as start,
                    epoch_us(date_trunc('minute', fetched_at))
                      + cast(round(duration_s * 2000 * 1000000) as bigint) as stop,
                    sha256(cast(fetch_id as varchar)) as digest
                  from fetch_log_f),
          h as (select a.fetch_id, count(b.fetch_id) as n from s a left join s b
                  on b.host = a.host and b.stop > a.start
                  and (b.start < a.start or (b.start = a.start and b.digest < a.digest)) group by 1),
          g as (select a.fetch_id, count(b.fetch_id) as n from s a left join s b
                  on b.stop > a.start
                  and (b.start < a.start or (b.start = a.start and b.digest < a.digest)) group by 1)
          select s.fetch_id, s.host, h.n as in_flight_host, g.n as in_flight_all,
                 h.n >= 2 or g.n >= 6 as overloaded
          from s join h using (fetch_id) join g using (fetch_id)""",
        "due_runs": _with("runs", _DUE_RUNS.format(limit=200))
        + "select run_id, status, epoch_us(queued_at) as queued_us from due",
        "due_outbox": _with("outbox", _OUTBOX, _DUE_OUTBOX)
        + "select outbox_id, message_id, epoch_us(next_attempt_at) as next_us from due",
        # Ledger
        "terminal_events": _with("runs", *_DOCS, _PROCESSED) + """
          select run_id as command_id, 'evt.content.document.extracted.v1' as subject,
                 sha256('message|' || run_id || '|evt.content.document.extracted.v1|document') as message_id,
                 content_digest as detail
          from processed join documents_f using (page_id) where status = 'succeeded'
          union all
          select run_id, 'evt.platform.operation.reported.v1',
                 sha256('message|' || run_id || '|evt.platform.operation.reported.v1|' || status), status
          from processed""",
        "commands_without_runs": _with("capture_commands") + """
          select distinct command_id from capture_commands_f
          where command_id not in (select o_orderkey * 3 from orders)""",
        "runs_without_end": _with("runs", "completions") + """
          select run_id from runs_f where status in ('succeeded', 'failed') and run_id not in
            (select run_id from completions_f)""",
        "intake_runs": _with("capture_commands", _URLS, _DELIVERIES, _APPLIED) + """
          select sha256('run|' || command_id) as run_id, command_id, owner_id,
                 sha256('source|' || owner_id || '|' || normalized) as source_id, 'queued' as status,
                 'ssrf-v1' as policy_version, 'url-v1' as normalizer_version,
                 'html-v1' as parser_version, sha256('document|' || command_id) as document_id,
                 epoch_us(received_at) as queued_us
          from applied""",
        "intake_rejects": _with("capture_commands", _PAGELESS) + """
          select delivery_id, command_id, 'missing_host' as reject_reason from pageless""",
        "distinct_messages": """
          with recursive m as (
            select case when event_id % 11 <> 3 then concat_ws('-', user_id % 5, event_type) end as message_id,
                   ts, event_id from events),
          i as (select coalesce(message_id, '') as k, message_id is null as none, ts, min(event_id) as event_id
                from m group by all),
          kept as (
            select k, none, min(ts) as ts from i group by all
            union all
            select i.k, i.none, min(i.ts) from kept join i
              on i.k = kept.k and i.none = kept.none and i.ts >= kept.ts + interval 7200 second
            group by i.k, i.none)
          select i.event_id, case when not none then k end as message_id, epoch_us(ts) as at_us
          from kept join i using (k, none, ts)""",
        "intake_inbox": _with("capture_commands", _URLS, _DELIVERIES, _APPLIED) + """
          select command_id, 'cmd.content.capture.requested.v1' as subject, 'applied' as outcome,
                 epoch_us(received_at) as received_us from applied""",
        "terminal_state": _with("runs", "completions") + """
          , c as (select run_id, arg_min(result, rank) as first_result,
              arg_min(coalesce(error_class, ''), rank) as first_error, arg_min(finished_at, rank) as first_at,
              count(*) filter (where result = 'succeeded') as good,
              count(*) filter (where result = 'failed') as bad
            from (select *, row_number() over (order by finished_at, attempt, result desc) as rank
                  from completions_f) group by 1),
          j as (select r.run_id, r.status as status_before, c.*, r.status = 'running'
                  and c.run_id is not null as applies,
                  case when r.status = 'running' and c.run_id is not null then first_result
                       else r.status end as status
                from runs_f r left join c on c.run_id = r.run_id),
          k as (select *, coalesce(good, 0) - case when applies and first_result = 'succeeded'
                  then 1 else 0 end as more_good,
                  coalesce(bad, 0) - case when applies and first_result = 'failed' then 1 else 0 end
                    as more_bad from j)
          select run_id, status_before, status,
            case when applies then nullif(first_error, '') end as last_error_class,
            case when applies then epoch_us(first_at) end as completed_us,
            cast(applies as bigint) as applied,
            more_bad + case when status = 'succeeded' then more_good else 0 end as duplicates,
            case when status <> 'succeeded' then more_good else 0 end as invalid_state from k""",
        "run_states": _with("runs", "completions") + f"""
          , e as (select run_id, queued_at as seen_at, 'queued' as event from runs_f
            union all select run_id, finished_at, case when attempt <= 3 then 'claimed' else result end
            from completions_f),
          s as (select run_id, min(seen_at) filter (where event = 'queued') as queued,
              min(seen_at) filter (where event = 'claimed') as started,
              max(seen_at) filter (where event = 'claimed') as last_claim,
              count(*) filter (where event = 'claimed') as deliveries
            from e where seen_at <= {_NOW} group by 1),
          f as (select run_id, min(seen_at) as ended,
              min(lpad(epoch_us(seen_at)::varchar, 20, '0') || event) as first_end
            from e join s using (run_id)
            where event in ('succeeded', 'failed') and seen_at between started and {_NOW} group by 1),
          t as (select s.*, ended, first_end, ended is not null as done from s left join f using (run_id))
          select run_id, case when done then case when first_end like '%failed' then 'failed'
              else 'succeeded' end when started is not null then 'running' else 'queued' end as status,
            epoch_us(queued) as queued_us, epoch_us(started) as started_us,
            case when done then epoch_us(ended) end as completed_us, deliveries,
            not done and not coalesce(last_claim + interval 30 day > {_NOW}, false)
              and deliveries < 12 as eligible from t""",
        "complete_runs": _facts("status = 'succeeded'"),
        "reject_runs": _facts("error_class = 'quality'"),
        "fail_runs": _facts("error_class <> 'quality'"),
        "fetch_outcome": _with("fetch_log", _OUTCOME)
        + "select fetch_id, outcome, failure from outcome",
        "retry_delay": _with("fetch_log") + """
          , d as (select fetch_id, (fetch_id::hugeint * 6364136223846793005::hugeint
                + 1442695040888963407::hugeint) % 18446744073709551616::hugeint
                % (100 * (2 ** least(fetch_id % 9, 6))::hugeint + 1) as jitter,
              case fetch_id % 4 when 0 then (fetch_id % 7) * 1000
                   when 1 then greatest((fetch_id % 90 - 30) * 1000, 0) end as minimum
            from fetch_log_f)
          select fetch_id, cast(greatest(jitter, coalesce(minimum, 0)) as bigint) as delay_ms from d""",
        "outbox_backoff": _with("outbox") + f"""
          select outbox_id, attempts + 1 as attempts,
                 epoch_us({_NOW} + to_seconds(least(300, cast(2 ** least(attempts, 20) as bigint))))
                   as next_us,
                 case when attempts + 1 >= 12 then epoch_us({_NOW}) end as dead_us,
                 left(replace(replace(last_error, chr(13), ''), chr(10), ''), 512) as last_error
          from outbox_f""",
        "envelope": _with("capture_commands", _URLS, _DELIVERIES, _APPLIED) + """
          select sha256('message|' || command_id || '|evt.platform.operation.reported.v1|queued')
                   as message_id, command_id,
            '{"aggregate_id":"operation:' || command_id || '","causation_id":"command:' || command_id
            || '","correlation_id":"operation:' || command_id || '","event_id":"' ||
            sha256('event|' || command_id || '|platform.operation.reported.v1|queued') ||
            '","event_type":"platform.operation.reported.v1","occurred_at":"' ||
            strftime(received_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","payload":{"operation_id":"' ||
            command_id || '","status":"queued"},"producer":"web-extract","schema_version":1,"tenant_id":"user:'
            || owner_id || '"}' as payload
          from applied""",
        # Retention, outbox pass
        "retained": _with(_MESSAGES) + """
          , r as (select message_id, row_number() over w as n, sum(bytes) over w as size from messages
                  where sent_at >= timestamp '2024-01-31 00:00:00' - interval 400 hour
                  window w as (order by sent_at desc, message_id))
          select message_id from r where n <= 4000 and size <= 15000000""",
        "outbox_pass": _with("outbox", _OUTBOX, _DUE_OUTBOX) + f"""
          select o.outbox_id, case when failed then o.attempts + 1 else o.attempts end as attempts,
            epoch_us(case when done then {_NOW} else o.published_at end) as published_us,
            epoch_us(case when failed then {_NOW} + to_seconds(least(300,
              cast(2 ** least(o.attempts, 20) as bigint))) else o.next_attempt_at end) as next_us,
            epoch_us(case when failed and o.attempts + 1 >= 12 then {_NOW}
                          when failed then null else o.dead_lettered_at end) as dead_us
          from (select ob.*, due.outbox_id is not null and ob.outbox_id % 3 > 0 as done,
                       due.outbox_id is not null and ob.outbox_id % 3 = 0 as failed
                from ob left join due using (outbox_id)) o""",
        # Derived
        "host_strategy": _with("fetch_log", _OUTCOME) + """
          , o as (select host, fetched_at as seen_at, fetch_id, case fetch_id % 3 when 0 then 'semantic'
              when 1 then 'readability' else 'density' end as strategy, fetch_id * 37 % 1001 as score,
              cast(floor(duration_s * 1000) as bigint) as ms, fetch_id % 4 = 0 as escalated, failure
            from outcome),
          v as (select host, strategy from (select host, strategy, count(*) as c from o
              where failure is null group by 1, 2)
            qualify row_number() over (partition by host order by c desc, strategy) = 1)
          select host, v.strategy as preferred_strategy,
            count(*) filter (where failure is null) * 1000 // count(*) as success_rate,
            count(*) filter (where escalated) * 1000 // count(*) as escalation_rate,
            quantile_cont(score, 0.5) filter (where failure is null) as median_quality,
            quantile_cont(ms, 0.5) as p50_ms, quantile_cont(ms, 0.95) as p95_ms,
            arg_max(failure, fetch_id) filter (where failure is not null) as last_failure_class,
            epoch_us(max(seen_at) + interval 24 hour) as expires_us
          from o left join v using (host) group by host, v.strategy""",
        "unchanged_content": """
          with c as (select case when doc_id % 9 <> 4 then source end as source_id, doc_id as capture_id, doc_id // 3 as slot,
              case when doc_id % 4 = 0 then sha256(text) else cast(doc_id & 8 as varchar) end as digest
            from documents),
          p as (select source_id, slot, arg_max(digest, capture_id) as digest from c group by 1, 2),
          q as (select source_id, slot, lag(digest) over (partition by source_id order by slot) as previous
                from p)
          select source_id, capture_id, coalesce(digest = previous, false) as unchanged
          from c join q on c.source_id is not distinct from q.source_id and c.slot = q.slot""".replace(
            "select source_id, capture_id, coalesce(digest = previous", "select c.source_id, capture_id, coalesce(digest = previous"),
        "derived_views": _with(*_DOCS) + """
          , s as (select page_id, block_pos, text, sum(strlen(text) + 1) over (partition by page_id
                    order by block_pos) - 1 as upto from blocks),
          x as (select page_id, string_agg(text, chr(10) order by block_pos) as context from (
              select *, max(upto > 2000) over (partition by page_id order by block_pos) as full_ from s)
            where not full_ group by 1)
          select page_id, sha256(plain) as plain, sha256(md) as md, coalesce(context, '') as context
          from documents_f left join x using (page_id)""",
        "block_citations": _with(*_DOCS) + """
          select d.page_id, b.block_pos as block_index,
                 substr(content_digest, 1, 12) || '#' || b.block_pos as citation, b.text
          from documents_f d join blocks b using (page_id)""",
        "escalation_flags": _with(*_PAGE) + """
          select p.page_id, case when z.bytes = 0 then 'empty_shell'
            when w.page_id is null then 'low_score' end as reason
          from pages p join sizes z using (page_id) left join winners w using (page_id)""",
        "page_features": _with(*_DOCS) + """
          select d.page_id, cast(count(*) as int) as n_blocks,
                 (count(*) - count(distinct b.text)) * 1000 // count(*) as duplicate_share,
                 cast(sum(strlen(b.text)) * 1000 // any_value(strlen(p.html)) as bigint) as text_share,
                 cast(count(*) filter (where regexp_matches(lower(b.text),
                   'sign in|log in|cookies|subscribe|consent')) as int) as gate_markers
          from documents_f d join blocks b using (page_id) join pages p using (page_id) group by 1""",
        "shadow_comparison": _with(*_DOCS) + """
          , s as (select d.page_id, d.score, z.bytes, z.paragraphs from documents_f d join sizes z
                  using (page_id))
          select page_id, case when page_id % 4 = 0 then case when h like '%</p></article>%'
                   then 'changed' else 'equal' end when page_id % 7 = 0 then 'only_left'
                   else 'equal' end as verdict,
            case when page_id % 4 = 0 and h like '%</p></article>%'
                   then cast(least(300, bytes + 2) - least(300, bytes) as int)
                 when page_id % 4 <> 0 and page_id % 7 = 0 then null else 0 end as score_delta
          from s join clean using (page_id)""",
    }
    for strategy in ("semantic", "readability", "density"):
        sql[f"candidate_{strategy}"] = sql["candidates"] + f" where strategy = '{strategy}'"
    sql.update(_violations())
    return sql

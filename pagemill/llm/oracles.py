"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from pagemill.llm import lexical, linededup, mixing, quality
from pagemill.llm.chat import PART
from pagemill.llm.text import LOWER, UPPER

SPACES = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"


def _mix() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
with sized as (
  select doc_id, source is null as none, coalesce(source, '') as source,
    len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::bigint as size,
    len(list_distinct(string_split(coalesce(text, ''), chr(10))))::double / len(string_split(coalesce(text, ''), chr(10)))::double as quality,
    (('0x' || substr(sha256('{mixing.SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::ubigint::double + 1.0) / {float(2**52 + 1)!r}::double as u
  from documents),
keyed as (select *, -ln(u) / quality as key from sized),
groups as (select none, source, sum(size)::bigint as source_size from keyed group by all),
weighed as (
  select *, list_value({weights})[(row_number() over (order by none, encode(source)) - 1) % {len(mixing.WEIGHTS)} + 1]::bigint as weight,
    {mixing.CAP} * source_size as lim from groups),
levels as (
  select *, ({mixing.SHARE}::double * (sum(source_size) over ())::double - coalesce(sum(lim) over w, 0)::double)
    / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as lev,
    row_number() over (order by lim::double / weight, none, encode(source)) as place
  from weighed window w as (order by lim::double / weight, none, encode(source) rows between unbounded preceding and 1 preceding)),
water as (select min_by(lev, place) as water from levels where lev * weight <= lim),
plan as (
  select none, source, source_size, least(lim::double, coalesce(water * weight, lim::double)) as target from levels, water),
split as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from plan),
runs as (
  select k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
    sum(k.size) over (partition by k.none, k.source order by k.key, k.doc_id) as run
  from keyed k join split p on k.none = p.none and k.source = p.source)
select doc_id, size, source_size, target,
  ((epochs + case when rest > 0 and run - size / 2.0 <= rest then 1 else 0 end) * size)::bigint as taken
from runs
"""


def _lines() -> str:
    return rf"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from docs),
keyed as (select *, regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '^{SPACES}+|{SPACES}+$', '', 'g') as key from lines),
frequent as (
  select key from keyed where length(key) >= {linededup.MIN_CHARS}
  group by key having count(distinct doc_id) >= {linededup.MIN_DOCUMENTS})
select doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (f.key is null), '')) as kept_sha256
from keyed left join frequent f using (key) group by doc_id
"""


def _chats() -> str:
    return f"""
with turns as (
  select distinct conv_id, coalesce(turn, -1)::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations),
hashed as (
  select conv_id, turn, string_agg(md5(concat_ws('|', turn, role, text)), ',' order by role, text) as h from turns group by all),
prefixes as (
  select conv_id, md5(string_agg(h, ';') over (partition by conv_id order by turn)) as f,
    turn = max(turn) over (partition by conv_id) as whole
  from hashed),
ends as (select f, min(conv_id) as conv_id, count(*) as n_logged from prefixes where whole group by f),
kept as (select conv_id, n_logged from ends where f not in (select f from prefixes where not whole))
select conv_id, floor(turn / {PART}.0)::bigint as part, count(*)::bigint as n_turns, n_logged,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by turn, role, text) as chat
from turns join kept using (conv_id) group by conv_id, part, n_logged
"""


def _quality() -> str:
    def listed(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    lists = " ".join(f"when '{lang}' then {listed(words)}" for lang, words in quality.COMMON.items())
    def divergence(p: str, q: str) -> str:
        part = "case when x[{0}] > 0 then x[{0}] * log2(2.0 * x[{0}] / (x[1] + x[2])) else 0.0 end"
        return f"list_sum(list_transform(list_zip({p}, {q}), lambda x: ({part.format(1)} + {part.format(2)}) / 2))"

    n = len(quality.COMMON["en"]) + 1
    counts = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": SPACES, "other": r"[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", "wide": r"[^\x00-\x7F]"}
    chars = ", ".join(f"len(regexp_extract_all(t, '{counts[c]}'))" for c in quality.CLASSES)
    return rf"""
with docs as (
  select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORDS}') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
counted as (
  select *, len(words)::bigint as n_words, [{chars}] as chars,
    list_transform(case lang {lists} end, lambda w: len(list_filter(words, lambda x: x = w))) as hits from docs),
binned as (select *, list_append(hits, n_words - list_sum(hits)) as bins from counted),
refs as (
  select lang, list_transform([{", ".join(f"sum(chars[{k + 1}])" for k in range(6))}], lambda x: x / sum(length(t))) as ref_chars,
    list_transform([{", ".join(f"sum(bins[{k + 1}])" for k in range(n))}], lambda x: x / sum(n_words)) as ref_words
  from binned where bins is not null and n_words >= {quality.REFERENCE_WORDS} group by lang),
shares as (
  select b.*, r.ref_chars, r.ref_words, list_transform(chars, lambda x: x / length(t)) as p_chars, list_transform(bins, lambda x: x / n_words) as p_words
  from binned b left join refs r using (lang)),
far as (
  select *, sqrt(greatest(0.0, {divergence("p_chars", "ref_chars")})) as char_distance, sqrt(greatest(0.0, {divergence("p_words", "ref_words")})) as word_distance
  from shares),
windows as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
  from (select doc_id, words, unnest(range(1, n_words - 1)) as i from counted where n_words >= 4)),
twice as (select * from (select *, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
covered as (select doc_id, count(distinct j)::bigint as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from twice) group by doc_id),
based as (
  select f.*, coalesce(c.n, 0) as n_repeat_words,
    (n_words < {quality.MIN_WORDS} or 100 * coalesce(c.n, 0) > {quality.MAX_REPEAT_PERCENT} * n_words) as base_failed
  from far f left join covered c using (doc_id))
select doc_id, n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and not coalesce((length(t) >= {quality.CHAR_GUARD} and char_distance > {quality.CHAR_LIMIT})
    or (n_words >= {quality.WORD_GUARD} and word_distance > {quality.WORD_LIMIT}), false)) as kept
from based
"""


def _search() -> str:
    terms = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with terms as (select doc_id, unnest({terms}) as term from documents),
counts as (select doc_id, term, count(*) as tf from terms group by all),
sizes as (select doc_id, sum(tf)::bigint as n from counts group by all),
whole as (select count(*) as n_all, sum(n)::bigint as n_terms from sizes),
weights as (
  select term, floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)))::bigint as w from counts, whole group by term, n_all),
asked as (
  select item_id, term, count(*) as times from (select item_id, unnest({terms}) as term from benchmark) group by all),
scored as (
  select item_id, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - {lexical.SHARE} + ({lexical.SHARE} * n * n_all) // n_terms))))::bigint as score
  from asked join weights using (term) join counts using (term) join sizes using (doc_id), whole group by all),
placed as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
  from scored where score > 0)
select * from placed where rank <= {lexical.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": _mix(), "op4_lines": _lines(), "op9_chats": _chats(), "op10_quality": _quality(), "op11_search": _search()}

"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from telemill.llm.quality_rules import LineRules

_R = LineRules()
_INK = "length(translate({}, e' \\t\\n\\x0b\\x0c\\r', ''))"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(x: str, pattern: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, {_lit(pattern)}, '', 'g')))"


OP4 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), s as (
  select conv_id, count(*) as n_turns,
    string_agg(role || e'\n' || text || e'\n', '' order by turn, role, text) as turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
    sum(12 + length(regexp_replace(replace(replace(role, '%', '%25'), e'\n', '%0A'), '<(!*)\|', '<!\1|', 'g')) + 1
      + length(regexp_replace(text, '<(!*)\|', '<!\1|', 'g')) + 11) as formatted_chars
  from c group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  formatted_chars::bigint as formatted_chars
from s
"""

_N = "(length(b) - length(replace(b, ' ', '')) + 1)"
OP10 = rf"""
with d as (select row_number() over () as uid, doc_id, coalesce(text, '') as body from documents),
lines as (select uid, unnest(string_split(body, e'\n')) as l from d),
bare as (select uid, l, trim(l, e' \t\n\x0b\x0c\r') as b from lines),
bad as (
  select uid, l, b <> '' and (
    (not contains({_lit(_R.terminal + _R.other_terminal)}, right(b, 1)) and not regexp_matches(b, {_lit(_R.sentence_end)}) and not regexp_matches(b, {_lit(_R.other_sentence_end)})
      and {_count("b", r"[\p{Thai}\p{Lao}]")} <= {_count("b", _R.cased)})
    or (not regexp_matches(b, '\p{{Ll}}') and {_N} >= 3 and {_count("b", r"\p{Lo}")} - {_count("b", "[ªº]")} <= {_count("b", r"\p{Lu}")})
    or ({_N} <= {_R.boilerplate_words} and regexp_matches(b, {_lit(_R.boilerplate)}))
    or {_count("b", _R.separators)} >= greatest(2, {_N} * {_R.max_separator_share})
    or {_count("b", _R.symbols)} > {_N} * {_R.max_symbols_per_word}
    or (length(b) - length(replace(b, '!!', ''))) / 2 > {_N} * {_R.max_shouts_per_word}
  ) as is_bad from bare
),
per_line as (
  select uid, sum(case when is_bad then 0 else length(l) end) as good, sum(length(l)) as total, count(*) filter (not is_bad) as n_good,
    count(*) filter ({_INK.format("l")} > 0) - count(distinct l) filter ({_INK.format("l")} > 0) as n_dup_lines
  from bad group by uid
),
w as (select uid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as ws from d),
win as (select uid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select uid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
rep as (select uid, i from (select uid, i, count(*) over (partition by uid, g) as c from win) where c > 1),
cov as (select uid, count(distinct p) as n_repeat_words from (select uid, unnest([i, i + 1, i + 2]) as p from rep) group by uid),
base as (
  select d.uid, doc_id, len(ws)::bigint as n_words, {_INK.format("body")}::bigint as word_chars, {_count("body", _R.symbols)}::bigint as n_symbols,
    n_dup_lines::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, good, total, n_good
  from d join w using (uid) join per_line using (uid) left join cov using (uid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and (case when total = 0 or n_good = 0 then 1.0 else 1 - good::double / total end) <= {_R.max_lost_share} as kept
from base
"""

OP8 = r"""
with d as (select row_number() over () as uid, doc_id, coalesce(text, '') as body from documents),
dw as (select uid, doc_id, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from d),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
it as (select distinct item_id, least(10, len(ws)) as size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as g
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from iw where len(ws) > 0 and item_id is not null)),
sizes as (select distinct size from it),
dg as (select uid, size, i, array_to_string(ws[i:i + size - 1], ' ') as g
  from (select uid, ws, size, unnest(range(1, len(ws) - size + 2)) as i from dw, sizes where len(ws) >= size)),
hit as (select uid, i, dg.size, item_id from dg join it on dg.size = it.size and dg.g = it.g),
cov as (select uid, count(distinct p) as n_hit from (select uid, unnest(range(i, i + size)) as p from hit) group by uid),
its as (select uid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct uid, item_id from hit) group by uid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from dw left join cov using (uid) left join its using (uid)
"""

OP6 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as shared from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * shared >= 80 * (p.n + q.n - shared)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as v, doc_id as u from d union select r.v, e.y from r join e on e.x = r.u),
m as (select v, min(u) as component_id from r group by v)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from d left join n using (doc_id) join m on m.v = doc_id
"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP5 = rf"""
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, strlen(body) as payload_bytes, sha1(body) as hex from p),
b as (select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
  substr('{_DIGITS}', 1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint) >> (5 * (3 - i % 4))) & 31)::int, 1)), '') as payload_digest from h),
f as (select payload_digest, min(page_id) as first from b group by 1)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from b join f using (payload_digest)
"""

OP11 = r"""
with d as (select row_number() over () as uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select uid, doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) as g from (select uid, doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d where len(ws) >= 50)),
f as (select g, min(doc_id) as first from win group by g),
gone as (select distinct uid, unnest(range(i, i + 50)) as p from (select uid, i from win join f using (g) where doc_id > first)),
marks as (select uid, list(p) as ps from gone group by uid),
k as (select uid, list(ws[p] order by p) as kept from (select uid, ws, unnest(range(1, len(ws) + 1)) as p from d) x where not exists (select 1 from gone where gone.uid = x.uid and gone.p = x.p) group by uid)
select doc_id, len(ws)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256
from d left join marks using (uid) left join k using (uid)
"""

ORACLES: dict[str, str] = {"op11_substring_dedup": OP11, "op5_warc": OP5, "op6_near_dedup": OP6, "op8_decontamination": OP8, "op4_chat_format": OP4, "op10_quality_rules": OP10}

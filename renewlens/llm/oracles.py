"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = "[^\\x20\\x09-\\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
with d as (
  select doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w from documents),
b as (
  select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w
  from benchmark),
g as (
  select distinct item, least(len(w), 13) as size, array_to_string(w[i:i + 12], ' ') as gram
  from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)),
s as (select distinct size from g),
p as (
  select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as gram
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, s where len(w) >= size)),
m as (select doc_id, p.size, i, item from p join g on p.gram = g.gram and p.size = g.size),
h as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + size)) as k from m) group by doc_id),
t as (
  select doc_id, count(distinct item) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""

_NORMAL = (
    "trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', "
    r"'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"
)

QUALITY = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, coalesce('=' || source, '') as host,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
g as (
  select doc_id, i, w[i:i + 2] as gram from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)),
r as (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g),
rep as (
  select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 3)) as k from r where n > 1) group by doc_id),
l as (
  select doc_id, host, i, l, len(regexp_extract_all(l, '{_WORD}')) as nw, {_NORMAL} as line
  from (select doc_id, host, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) as i from d)),
dup as (select doc_id, count(*) - count(distinct l) as n from l where nw > 0 group by doc_id),
c as (
  select host, line, min(doc_id) as first from l where nw > 0 group by host, line having count(distinct doc_id) > 20),
k as (
  select l.doc_id, coalesce(string_agg(l, chr(10) order by i) filter (where c.line is null or l.doc_id = first), '') as left_text,
    coalesce(sum(nw) filter (where c.line is not null and l.doc_id <> first), 0) as lost
  from l left join c on l.host = c.host and l.line = c.line and nw > 0 group by l.doc_id),
f as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, lost::bigint as lost, left_text
  from d left join rep using (doc_id) left join dup using (doc_id) left join k using (doc_id)),
z as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words - lost >= n_words * 0.30::double as kept, n_words - lost as words_left,
  sha256(left_text) as left_sha256
from z
"""

LINE_CHUNKS = r"""
with d as (select doc_id, coalesce(text, '') as text, text is null as none, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, i, ls[i] as line, len(ls) as n from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint % 2147483647 as h from l),
e as (
  select *, i = n or (i >= 2 and (coalesce(lag(h) over (partition by doc_id order by i), 0) * 1000003 + h) % 2147483647 % 3 = 0) as ends
  from h),
k as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from e),
c as (select doc_id, k, min(i) as pos, count(*) as m, string_agg(line, chr(10) order by i) as chunk from k group by doc_id, k),
r as (
  select *, row_number() over (partition by chunk order by doc_id, pos) as nth from c
  where m >= 2 and regexp_matches(chunk, '[^\x20\x09-\x0D]')),
o as (
  select c.doc_id, c.pos, c.m, c.chunk, coalesce(r.nth, 1) > 1 as gone from c left join r using (doc_id, k)),
s as (
  select doc_id, sum(m) as n_lines, count(*) as n_chunks, coalesce(sum(m) filter (gone), 0) as n_removed_lines,
    coalesce(string_agg(chunk, chr(10) order by pos) filter (not gone), '') as kept from o group by doc_id)
select doc_id, (case when none then 0 else n_lines end)::bigint as n_lines, (case when none then 0 else n_chunks end)::bigint as n_chunks,
  n_removed_lines::bigint as n_removed_lines, sha256(kept) as kept_sha256
from d join s using (doc_id)
"""

NEAR_DUPLICATES = rf"""
with recursive d as (select doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (
  select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (
  select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
r as (select a as node, b as other from e union select r.node, e.b from r join e on r.other = e.a),
m as (select node, min(other) as low from r group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) as kept
from d left join n using (doc_id) left join m on m.node = d.doc_id
"""

SUBSTRINGS = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
g as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as gram
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
m as (select gram, min(doc_id) as low from g group by gram),
c as (
  select distinct doc_id, unnest(range(i, i + 13)) as k from (select g.doc_id, i from g join m on g.gram = m.gram where low < g.doc_id)),
n as (select doc_id, count(*) as n, list(k) as ks from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(case when n is null then w else list_filter(w, lambda x, j: not list_contains(ks, j)) end, ' ')) as kept_sha256
from d left join n using (doc_id)
"""

ARCHIVES = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (
  select page_id, html, strlen(html) as size, list_aggregate(list_transform(range(1, 41), lambda i:
    lpad(bin(strpos('0123456789abcdef', substr(sha1(html), i, 1)) - 1), 4, '0')), 'string_agg', '') as bits,
    max(page_id) over (partition by html) as newest from p)
select page_id, size::bigint as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
      + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int
      + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id is not distinct from newest then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from newest then null else newest end as refers_to
from q
"""

SPELLING = r"""
with recursive d as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run
  from documents where text is not null),
p as (select id, run, count(*) as n from d group by id, run),
c as (
  select run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(1, 2 * strlen(id || ':' || run) + 1, 2),
      lambda i: ('0x' || substr(hex(encode(id || ':' || run)), i::int, 2))::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) as h
  from p),
w as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
    else run end as word, n from c),
v as (select word, sum(n)::bigint as n from w where length(word) >= 5 group by word having sum(n) >= 3),
e as (
  select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b
  from (select word, n, unnest(range(1, length(word) + 1))::int as i from v)),
l as (
  select x.word, x.n, y.word as near, y.n as near_n from e x join e y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union select e.word, e.n, v.word, v.n from e join v on v.word = e.a || e.b
  union select v.word, v.n, e.word, e.n from e join v on v.word = e.a || e.b),
r as (select *, row_number() over (partition by word order by near_n desc, near) as k, count(*) over (partition by word) as m from l),
f as (
  select v.word, v.n, coalesce(m, 0) as n_near, case when near_n >= 2 * v.n then near end as form,
    case when near_n >= 2 * v.n then near_n end as form_n
  from v left join r on r.word = v.word and r.k = 1),
s as (
  select word, word as root, form from f
  union all select s.word, f.word, f.form from s join f on f.word = s.form)
select f.word, f.form, s.root, f.n, f.n_near::bigint as n_near, f.form_n
from f join s on s.word = f.word where s.form is null
"""

ORACLES = {
    "op11_spelling_variants": SPELLING,
    "op1_substring_dedup": SUBSTRINGS,
    "op7_archives": ARCHIVES,
    "op4_near_duplicates": NEAR_DUPLICATES,
    "op5_quality_rules": QUALITY,
    "op5_host_lines": QUALITY,
    "op9_decontaminate": DECONTAMINATE,
    "op10_line_chunks": LINE_CHUNKS,
}

"""SQL of the queries that SQL can express, by plainer methods than the operators use."""

from __future__ import annotations

_RE = r"[^\x20\x09-\x0D]+"

#: CRC-32 of UTF-8 bytes, from the table that its rule generates.
_CRC = r"""
crc_table as (select list(list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) order by n) as t
  from range(256) r(n)),
crcs as (select rid, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as crc from docs, crc_table)
"""

_MIXING = f"""
with recursive sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_RE}')), 0) as size,
  md5('17|' || coalesce(doc_id::varchar, '')) as m from documents),
drawn as (select doc_id, source, size, substr(m, 9, 20) as draw, ('0x' || substr(m, 1, 8))::bigint % 128 as bucket from sized),
src as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from drawn group by source),
wsrc as (select *, (place - 1) % 3 + 1 as w, 3 * source_size as cap, sum(source_size) over () as total from src),
ranked as (select *, row_number() over (order by cap / w, place) as turn from wsrc),
splits as (select k, (select any_value(total) - coalesce(sum(cap) filter (turn < k), 0) from ranked) / (select sum(w) filter (turn >= k) from ranked) as level
  from (select unnest(range(1, (select count(*) from ranked) + 1)) as k)),
chosen as (select min(k) as k from splits join ranked on turn = k where cap / w > level),
common as (select level from splits where k = (select k from chosen)),
tgt as (select *, case when turn >= (select k from chosen) then (select level from common) * w else cap end::double as target from ranked),
blk as (select greatest(1, least(4096, floor(min(target) filter (target > 0) / (100 * 128))))::bigint as block from tgt),
seats as (select (select any_value(total) from tgt) as total, block, round((select any_value(total) from tgt) / block)::bigint as n from blk),
quot as (select place, k, target / (2 * k + 1) as q from tgt, seats s, unnest(range((ceil(s.n * target / s.total) + 50)::bigint)) u(k) where target > 0),
won as (select place, count(*) as quota from (select place, row_number() over (order by q desc, place, k) as r from quot) where r <= (select n from seats) group by place),
lines as (select source, bucket, sum(size)::bigint as line from drawn group by all),
share as (select l.*, t.place, t.source_size, t.target, coalesce(w.quota, 0) as quota from lines l join tgt t on l.source is not distinct from t.source
  left join won w on w.place = t.place),
quot2 as (select place, bucket, quota, k, line / (2 * k + 1) as q from share, unnest(range((ceil(quota * line / source_size) + 140)::bigint)) u(k) where line > 0),
won2 as (select place, bucket, count(*) as seats from (select place, bucket, quota, row_number() over (partition by place order by q desc, bucket, k) as r from quot2)
  where r <= quota group by all),
words as (select s.*, least(coalesce(w.seats, 0) * (select block from seats), 3 * line) as wanted from share s left join won2 w using (place, bucket)),
laid as (select d.*, coalesce(sum(size) over (partition by source, bucket order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead from drawn d)
select doc_id, size::bigint as size, source_size, target,
  (case when line = 0 then 0 else (wanted // line) * size + greatest(0, least(size, wanted % line - ahead)) end)::bigint as taken,
  (select block from seats) as block_words
from laid d join words w on d.source is not distinct from w.source and d.bucket = w.bucket
"""

_SHARDING = f"""
with docs as (select doc_id, text, row_number() over () as rid from documents), {_CRC},
sized as (select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size, crc from docs join crcs using (rid)),
placed as (select *, coalesce(sum(size) over (order by doc_id nulls first, crc, size rows between unbounded preceding and 1 preceding), 0) as ahead,
  sum(size) over () as whole, row_number() over (order by doc_id nulls first, crc, size) as n from sized),
cut as (select *, least(39, ((2 * ahead + size) * 40) // (2 * whole)) as shard from placed)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard::int as shard,
  (row_number() over (partition by shard order by n) - 1)::bigint as slot, null::int as grown_shard from cut
"""

_CHAT = r"""
with m as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
e as (select *, length(regexp_replace(replace(role, '\', '\b'), '<(/?turn>|(?:image|audio|document):)', '..\1', 'g')) + 
  length(regexp_replace(replace(text, '\', '\b'), '<(/?turn>|(?:image|audio|document):)', '..\1', 'g')) + length('<turn></turn>') + 2 as n from m),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as told,
  coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '') as loss, sum(n)::bigint as formatted_chars from e group by conv_id)
select conv_id, n_turns, sha256(told) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""

_LINES = f"""
with raw as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents),
worded as (select *, len(regexp_extract_all(line, '{_RE}')) as words from raw where regexp_matches(line, '{_RE}')),
lines as (select *, row_number() over (partition by doc_id order by line_no) as pos from worded),
pair as (select a.doc_id as d1, b.doc_id as d2, b.pos - a.pos as diagonal, b.pos as p, b.words from lines a join lines b
  on a.line = b.line and (a.doc_id < b.doc_id or (a.doc_id = b.doc_id and a.pos < b.pos))),
stretch as (select *, p - row_number() over (partition by d1, d2, diagonal order by p) as island from pair),
later as (select d2, min(p) as i, max(p) as j from stretch group by d1, d2, diagonal, island having sum(words) >= 50),
gone as (select distinct l.* from lines l join later on l.doc_id = d2 and l.pos between i and j),
runs as (select *, pos - row_number() over (partition by doc_id order by pos) as run from gone)
select doc_id, min(line_no)::int as first_line, max(line_no)::int as last_line, count(*) as n_lines, sum(words)::bigint as n_words from runs group by doc_id, run
"""

_NEAR = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_RE}') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
  else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
freq as (select s, count(*) as df from s group by 1),
pref as (select doc_id, s, n from (select doc_id, s, n, row_number() over (partition by doc_id order by df, s) as r from s join freq using (s) join n using (doc_id))
  where r <= n - ceil(0.8 * n) + 1),
cand as (select distinct a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb from pref a join pref b on a.s = b.s and a.doc_id < b.doc_id
  and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
common as (select a, b, na, nb, count(*) as k from cand join s x on x.doc_id = a join s y on y.doc_id = b and y.s = x.s group by all),
link as (select a, b from common where 100 * k >= 80 * (na + nb - k)),
edges as (select a, b from link union select b, a from link),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
root as (select a, min(b) as b from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) as component_id, d.doc_id <= coalesce(b, d.doc_id) as kept
from documents d left join n using (doc_id) left join root r on r.a = d.doc_id
"""

_LEAKS = f"""
with iw as (select item_id, regexp_extract_all(lower(text), '{_RE}') as w from benchmark),
ig as (select item_id, len(w) as m, unnest(range(len(w) - 4)) as o, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g from iw where len(w) >= 5),
idf as (select g, ln(1 + (select count(distinct item_id) from ig) / count(distinct item_id)) as idf from ig group by g),
dw as (select doc_id, regexp_extract_all(lower(text), '{_RE}') as w from documents),
dg as (select doc_id, len(w) as n, unnest(range(len(w) - 4)) as p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g from dw where len(w) >= 5),
met as (select distinct doc_id, item_id, m, n from dg join ig using (g)),
win as (select doc_id, item_id, m, unnest(range(greatest(n - m, 0) + 1)) as st from met),
wg as (select doc_id, item_id, st, m, g, count(*) as tf from win join dg using (doc_id) where p between st and st + m - 5 group by all),
ww as (select wg.*, tf * coalesce(idf, ln(1 + (select count(distinct item_id) from ig)::double)) as x from wg left join idf using (g)),
iv as (select item_id, g, count(*) * any_value(idf) as v from ig join idf using (g) group by all),
tot as (select item_id, sum(v) as v from iv group by 1),
sim as (select ww.doc_id, ww.item_id, st, ww.m, sum(least(x, coalesce(iv.v, 0))) as low, sum(x) as x, any_value(tot.v) as v from ww
  left join iv on iv.item_id = ww.item_id and iv.g = ww.g join tot on tot.item_id = ww.item_id group by all),
good as (select *, round(low / (x + v - low), 9) as similarity from sim)
select doc_id, item_id, st::int as start, m::int as n_words, similarity from good where similarity >= 0.8
qualify row_number() over (partition by doc_id, item_id order by similarity desc, st) = 1
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": _MIXING,
    "op2_line_dedup": _LINES,
    "op4_neardup": _NEAR,
    "op6_sharding": _SHARDING,
    "op7_chat": _CHAT,
    "op9_decontamination": _LEAKS,
}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: A-Z in lower case and nothing else.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
),
shingles as (
    select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as s
    from words, unnest(range(1, greatest(len(w), 2))) u(i) where len(w) > 0
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
overlap as (
    select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
),
links as (
    select a, b from overlap join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b)
select d.doc_id, coalesce(s.n, 0) as n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) as component_id,
    least(d.doc_id, coalesce(r.m, d.doc_id)) = d.doc_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join (select a, min(b) as m from reach group by a) r on r.a = d.doc_id
"""

#: The removed lines of each document; the text that is left is hashed.
LINES = """
with split as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as parts from documents),
occ as (
    select doc_id, i - 1 as line, parts[i] as body, string_split(parts[i], ' ') as w
    from split, unnest(range(1, len(parts) + 1)) u(i)
),
named as (select doc_id, line, w, body as name from occ where trim(body, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
firsts as (select name, any_value(w) as w, min((doc_id, line)) as first from named group by name),
long_ as (select name, w, first, len(w) as n from firsts where len(w) >= 4),
gone as (select name, first, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') as rest from long_, unnest(range(1, n + 1)) u(i)),
replaced as (select name from (select name, first, min(first) over (partition by rest, i) as m from gone) where first > m),
deleted as (select g.name from gone g join long_ l on l.name = g.rest and g.first > l.first),
inserted as (select l.name from long_ l join gone g on l.name = g.rest and l.first > g.first),
near as (select name from replaced union select name from deleted union select name from inserted),
removed as (
    select n.doc_id, n.line from named n join firsts f on f.name = n.name
    where (n.doc_id, n.line) <> f.first or n.name in (select name from near)
),
left_ as (
    select o.doc_id, string_agg(o.body, chr(10) order by o.line) as text
    from occ o left join removed r on r.doc_id = o.doc_id and r.line = o.line where r.line is null group by o.doc_id
),
counts as (select doc_id, count(*) as n from removed group by doc_id)
select s.doc_id, len(parts)::bigint as n_lines, coalesce(c.n, 0) as n_removed, sha256(coalesce(l.text, '')) as kept_sha256
from split s left join counts c on c.doc_id = s.doc_id left join left_ l on l.doc_id = s.doc_id
"""


def _words(table: str, key: str) -> str:
    return f"select {key} as id, list_filter(regexp_split_to_array({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from {table}"


WINDOWS = f"""
with d as ({_words("documents", "doc_id")}), b as ({_words("benchmark", "item_id")}),
bw as (
    select distinct id as item, least(10, len(w)) as size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
    from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(i) where len(w) > 0
),
sizes as (select distinct size from bw),
dw as (
    select id as doc, i, size, array_to_string(w[i:i + size - 1], ' ') as win from d, sizes, unnest(range(1, len(w) - size + 2)) u(i) where len(w) >= size
),
hits as (select doc, i, dw.size, item from dw join bw on dw.size = bw.size and dw.win = bw.win),
hit_words as (select distinct doc, unnest(range(i, i + size)) as at from hits),
n_hit as (select doc, count(*) as n from hit_words group by doc),
items as (select doc, count(*) as n, sha256(string_agg(item, ',' order by item)) as h from (select distinct doc, item::varchar as item from hits) group by doc)
select d.id as doc_id, len(d.w)::bigint as n_words, coalesce(n_hit.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
    coalesce(items.h, sha256('')) as items_sha256, coalesce(n_hit.n, 0) > 0 as contaminated
from d left join n_hit on n_hit.doc = d.id left join items on items.doc = d.id
"""

#: The 256 remainders of crc32 by their rule (eight halvings, with the polynomial 0xEDB88320 where a 1 falls out), and the checksum
#: of each distinct word over its bytes.
RESAMPLING = f"""
with d as ({_words("documents", "doc_id")}), b as ({_words("benchmark", "item_id")}),
remainders as (
    select list(list_reduce(range(0, 8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n::bigint) order by n) as r
    from range(0, 256) x(n)
),
vocabulary as (select distinct unnest(w) as t from d union select distinct unnest(w) from b),
bytes as (select t, list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), (2 * i + 1)::int, 2))::bigint) as o from vocabulary),
hashed as (
    select t, xor(list_reduce(o, lambda c, x: xor(c // 256, r[(xor(c, x) % 256) + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket from bytes, remainders
),
of_docs as (select bucket, count(*) as s from (select unnest(w) as t from d) join hashed using (t) group by bucket),
of_items as (select bucket, count(*) as s from (select unnest(w) as t from b) join hashed using (t) group by bucket),
sums as (select (select coalesce(sum(s), 0) from of_docs)::double as s, (select coalesce(sum(s), 0) from of_items)::double as t),
gains as (
    select o.bucket, floor(1000 * ln((coalesce(i.s, 0) + 1) * (sums.s + 10000) / ((o.s + 1) * (sums.t + 10000))))::bigint as gain
    from of_docs o left join of_items i on i.bucket = o.bucket, sums
),
weighed as (select id, sum(gain)::bigint as weight from (select id, unnest(w) as t from d) join hashed using (t) join gains using (bucket) group by id),
scored as (
    select d.id as doc_id, len(d.w)::bigint as n_features, coalesce(g.weight, 0) as weight,
        coalesce(g.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from d left join weighed g on g.id = d.id
),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from placed
"""

PRODUCTS = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
pairs as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
placed as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from placed where rank <= 5
"""

RANKING = f"""
with d as ({_words("documents", "doc_id")}), b as ({_words("benchmark", "item_id")}),
s as (select count(*)::bigint as n, sum(len(w))::bigint as l from d where len(w) > 0),
asked as (select id as item_id, t, count(*) as c from (select id, unnest(w) as t from b) group by id, t),
held as (select id as doc_id, n, t, count(*)::bigint as tf from (select id, len(w)::bigint as n, unnest(w) as t from d) where t in (select t from asked) group by id, n, t),
weights as (select t, floor(1000 * ln((2 * s.n + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from held, s group by t, s.n),
sums as (
    select item_id, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * held.n * s.n) // s.l))))::bigint as score
    from held join asked using (t) join weights using (t), s group by item_id, doc_id
),
placed as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from sums where score > 0)
select item_id, rank::int as rank, doc_id, score from placed where rank <= 10
"""

ORACLES: dict[str, str] = {"op2_near_duplicates": NEAR, "op3_line_dedup": LINES, "op7_decontaminate": WINDOWS, "op11_resampling": RESAMPLING, "op12_top_products": PRODUCTS, "op13_ranked_search": RANKING}

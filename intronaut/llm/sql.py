"""DuckDB SQL for the operations that SQL can express."""

from string import ascii_lowercase, ascii_uppercase

OP9 = rf"""
with dw as (
  select row_number() over () as r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
iw as (
  select cast(item_id as varchar) as item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark where item_id is not null),
windows as (
  select distinct item, list_slice(w, i, i + least(len(w), 13) - 1) as words
  from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct len(words) as n from windows),
spots as (
  select r, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n),
hits as (
  select spots.r, spots.i, spots.n, windows.item
  from spots join dw using (r) join windows on windows.words = list_slice(dw.w, spots.i, spots.i + spots.n - 1)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
found as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from dw left join covered using (r) left join found using (r)
"""

OP6 = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighted as (
  select source, source_size, [5.0::double, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, source_size * 3.0::double as cap from sources),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (o rows between current row and unbounded following) as level
  from weighted window o as (order by cap / weight, source nulls last)),
final as (select arg_min(level, cap / weight) as level from levels where cap > level * weight),
goals as (
  select source, source_size,
         case when cap > levels.level * weight and final.level is not null then weight * final.level else cap end as target,
         cast(cast('0x' || substr(md5('mix:' || coalesce(source, chr(0) || 'null')), 1, 12) as bigint) as double) / 281474976710656.0::double as o
  from levels, final),
ranked as (select *, row_number() over (partition by source order by size, doc_id nulls last) - 1 as k from sized),
crossed as (
  select doc_id, size, source_size, target,
         case when source_size > 0 then target / source_size else 0.0 end as rate, o, k
  from ranked join goals on ranked.source is not distinct from goals.source)
select doc_id, size, source_size, target,
       cast(least(greatest(floor(o + rate * (k + 1)) - floor(o + rate * k), 0), 3) as bigint) * size as taken
from crossed
"""

OP7 = """
with hashed as (
  select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
digits as (
  select page_id, payload_bytes, payload,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((((instr('0123456789abcdef', h[1 + (5 * i) // 4]) - 1) * 16
           + (instr('0123456789abcdef', h[2 + (5 * i) // 4]) - 1)) >> (3 - (5 * i) % 4)) & 31 as int), 1)), 'string_agg', '') as payload_digest
  from hashed),
firsts as (select *, min(page_id) over (partition by payload) as first from digits)
select page_id, payload_bytes, payload_digest,
       case when first is not null and first is distinct from page_id then 'revisit' else 'response' end as record_type,
       case when first is distinct from page_id then first end as refers_to
from firsts
"""

OP10 = r"""
with parsed as (
  select row_number() over () as r, page_id, url, date '2024-01-01' + cast(page_id % 366 as int) as fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as segments
  from pages),
picked as (
  select pattern, md5(pattern) as m from (
    select host as pattern from parsed where host <> '' union select host || '/' || segments[1] from parsed where host <> '' and len(segments) > 0)
  where instr('0123', md5(pattern)[1]) > 0),
days as (
  select pattern, cast('0x' || m[2:3] as int) as start, cast('0x' || m[4:5] as int) as life, cast('0x' || m[6] as int) as kind from picked),
entries as (
  select pattern, 'add' as action, date '2024-01-01' + start as dated from days
  union all select pattern, 'remove', date '2024-01-01' + start + life + 1 from days where kind < 8
  union all select pattern, 'add', date '2024-01-01' + start + life + 31 from days where kind < 4),
intervals as (
  select pattern, dated as since, until from (
    select pattern, action, dated, lead(dated) over (partition by pattern order by dated) as until from entries)
  where action = 'add'),
keys as (
  select r, fetched_at, unnest(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: array_to_string(list_slice(labels, i, len(labels)), '.')),
    case when len(labels) > 0 then list_transform(range(1, len(segments) + 1), lambda i: array_to_string(labels, '.') || '/' || array_to_string(list_slice(segments, 1, i), '/')) else [] end)) as key
  from (select *, list_filter(string_split(host, '.'), lambda x: x <> '') as labels from parsed)),
best as (
  select r, arg_max(struct_pack(pattern := key, since := since), struct_pack(n := length(key), pattern := key)) as b
  from keys join intervals on key = pattern and fetched_at >= since and (until is null or fetched_at < until) group by r)
select page_id, url, fetched_at, b is not null as blocked, b.pattern as pattern, b.since as since
from parsed left join best using (r)
"""

_COMPONENTS = """
reach(node, other) as (select u, v from links union select r.node, l.v from reach r join links l on l.u = r.other),
least as (select node, least(node, min(other)) as component from reach group by node)"""

OP1 = """
with recursive typed as (select row_number() over () as r, vec_id, label, cast(embedding as double[]) as v from embeddings),
good as (
  select * from typed where vec_id is not null and label is not null and len(v) > 0
    and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links(u, v) as (
  select a.r, b.r from good a join good b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(node, other) as (select u, v from links union select q.node, l.v from reach q join links l on l.u = q.other),
least as (select node, least(min(own.vec_id), min(far.vec_id)) as component from reach join typed own on own.r = node join typed far on far.r = other group by node),
degree as (select u, count(*) as n from links group by u)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, coalesce(component, vec_id) as component_id, vec_id = coalesce(component, vec_id) as kept
from typed left join degree on u = r left join least on node = r
"""

OP3 = r"""
with d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (
  select r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as h from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
again as (select r, i from windows where h in (select h from windows group by h having count(*) > 1)),
covered as (select distinct r, p from (select r, unnest(range(i, i + 35)) as p from again)),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (
  select words.r, count(covered.p) as n_removed, string_agg(word, ' ' order by words.p) filter (covered.p is null) as text
  from words left join covered on covered.r = words.r and covered.p = words.p group by words.r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (r)
"""

OP5 = rf"""
with recursive d as (
  select row_number() over () as r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
shingles as (
  select distinct r, doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) as s
  from (select r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
sizes as (select r, count(*) as n from shingles group by r),
shared as (select a.r as x, b.r as y, any_value(a.doc_id) as u, any_value(b.doc_id) as v, count(*) as c from shingles a join shingles b on a.s = b.s and a.r <> b.r and a.doc_id <> b.doc_id group by a.r, b.r),
links(u, v) as (select distinct u, v from shared join sizes p on p.r = x join sizes q on q.r = y where 100 * c >= 80 * (p.n + q.n - c)),{_COMPONENTS}
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(component, doc_id) as component_id, coalesce(component, doc_id) = doc_id as kept
from d left join sizes using (r) left join least on node = doc_id
"""

OP11 = rf"""
with crc as (
  select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), n)) as bits),
words as (
  select r, doc_id, unnest(w) as word
  from (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents)),
aims as (
  select unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as word from benchmark),
hashed as (
  select word, xor(list_reduce(list_transform(range(1, cast(length(h) as bigint), 2), lambda i: cast('0x' || h[i:i + 1] as bigint)), lambda c, b: xor(c >> 8, bits[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 as bucket
  from (select word, hex(encode(word)) as h from (select word from words union select word from aims)), crc),
s as (select bucket, count(*) as s from words join hashed using (word) group by bucket),
t as (select bucket, count(*) as t from aims join hashed using (word) group by bucket),
gain as (
  select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from words) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from aims) + 10000)::double))) as bigint) as gain
  from (select distinct bucket from hashed) left join s using (bucket) left join t using (bucket)),
sums as (select r, count(*) as n_features, sum(gain) as weight from words join hashed using (word) join gain using (bucket) group by r),
scored as (
  select d.r, d.doc_id, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || cast(d.doc_id as varchar)), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double))) as bigint) as score
  from (select row_number() over () as r, doc_id from documents) d left join sums using (r)),
ranked as (
  select r, row_number() over (order by score desc, doc_id, n_features desc, weight) as k, count(*) over () as n
  from scored where n_features >= 20 and score is not null)
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when k <= 10 * n // 100 then cast(k as bigint) end as rank
from scored left join ranked using (r)
"""


def _op12() -> str:
    from intronaut.llm.secret_scan import ALLOW, BEFORE, CLASSES, PATTERNS

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = [*((p.kind, p.pattern, p.group, p.least) for p in PATTERNS), *((c.kind, c.pattern, 0, c.window) for c in CLASSES)]
    spots = " union all ".join(
        f"select r, {k} as kind, unnest(regexp_extract_all(text, {quoted(p)})) as m, unnest(list_slice(string_split_regex(text, {quoted(p)}), 1, -2)) as g, generate_subscripts(regexp_extract_all(text, {quoted(p)}), 1) as i from d where regexp_matches(text, {quoted(p)})"
        for k, (_, p, _, _) in enumerate(kinds)
    )
    base = " or ".join(f"(kind = {k} and length(regexp_extract(m, {quoted(p)}, {g})) >= {n})" for k, (_, p, g, n) in enumerate(kinds[: len(PATTERNS)]))
    allowed = " or ".join(f"regexp_matches(right(g, {BEFORE}) || m, {quoted(p)})" for p in ALLOW)
    windows = " union all ".join(
        f"select r, kind, start, i, list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: {c.terms}[1 + length(w) - length(replace(w, c, ''))])) <= {c.limit} as hot, {c.window} as width"
        f" from (select r, kind, start, i, substr(m, i + 1, {c.window}) as w from (select r, kind, start, m, unnest(range(0, length(m) - {c.window} + 1)) as i from candidates where kind = {len(PATTERNS) + k}))"
        for k, c in enumerate(CLASSES)
    )
    name = "[" + ", ".join(quoted(k) for k, *_ in kinds) + "]"
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
spots as ({spots}),
placed as (select *, cast(sum(length(g) + length(m)) over (partition by r, kind order by i) as bigint) - length(m) as start from spots),
candidates as (select * from placed where kind >= {len(PATTERNS)} and not ({allowed})),
hot as (select r, kind, start, start + i as low, start + i + width as high from ({windows}) where hot),
islands as (select *, sum(fresh) over (partition by r, kind, start order by low) as island from (
  select *, case when low > lag(high) over (partition by r, kind, start order by low) then 1 else 0 end as fresh from hot)),
spans as (
  select r, kind, start as low, start + length(m) as high from placed where {base}
  union all select r, kind, min(low), max(high) from islands group by r, kind, start, island),
named as (select *, {name}[1 + kind] || ':' || low || ':' || high as label from spans),
per as (
  select r, count_if(kind = 0) as n_assign, count_if(kind = 1) as n_access, count_if(kind = 2) as n_hex,
         string_agg(label, ',' order by low, kind, high) as spans, string_agg(label, ',' order by low, kind, high) filter (kind < {len(PATTERNS)}) as base
  from named group by r)
select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per using (r)
"""


OP12 = _op12()

OP13 = """
with typed as (
  select row_number() over () as r, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, cast(embedding as double[]) as x from embeddings),
good as (
  select r, vec_id, label, list_transform(x, lambda v: cast(floor(256 * v) as bigint)) as q from typed
  where vec_id is not null and label is not null and x is not null and len(list_filter(x, lambda v: v is null or isnan(v) or isinf(v))) = 0),
scores as (
  select a.r as anchor, a.vec_id as anchor_id, b.r as other, b.vec_id as other_id, a.label = b.label as same,
         coalesce(cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint), 0) as score
  from good a join good b on a.vec_id % 50 = 0 and a.r <> b.r and len(a.q) = len(b.q)),
positives as (
  select anchor, anchor_id, other as positive, other_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor order by score desc, other_id, other) <= 5),
found as (
  select anchor_id, positive_id, other_id as negative_id, positive_score, score as negative_score,
         row_number() over (partition by anchor, positive order by score desc, other_id, other) as rank
  from positives join scores using (anchor, anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from found where rank <= 3
"""

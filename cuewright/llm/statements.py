"""What DuckDB can state of the training-data queries' contracts, over the same tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

BASE_EDITED = """select doc_id, n as n_chars, sha256(left(t, n - n // 3) || left(after, n // 3)) as edited_sha256
from (select doc_id, t, length(t) as n, coalesce(lead(t) over w, first_value(t) over (order by doc_id desc)) as after
  from (select doc_id, coalesce(text, '') as t from documents) window w as (order by doc_id desc))"""

BASE_QUALITY = rf"""with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{_WORD}') as w from d),
l as (select doc_id, sum(c - 1)::bigint as n from (select doc_id, line, count(*) as c from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '{_WORD}') group by 1, 2) group by 1),
x as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w)),
r as (select doc_id, count(distinct i + k) as n from (select doc_id, i, count(*) over (partition by doc_id, x) as c from x), range(8) t(k) where c > 1 group by 1)
select doc_id, n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
coalesce(l.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, n_words < 20 or 100 * coalesce(r.n, 0) > 30 * n_words as base_failed
from (select *, len(w)::bigint as n_words from w) left join l using (doc_id) left join r using (doc_id)"""

# A source's target is the lesser of twice its size and its weight times one common factor.
BASE_MIXING = rf"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as n, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by 1),
c as (select *, sum(n) over () as total, sum(w) over () as weights, coalesce(sum(2 * n) over b, 0) as filled, coalesce(sum(w) over b, 0) as gone, 2.0 * n / w as most
  from s window b as (order by 2.0 * n / w, w rows between unbounded preceding and 1 preceding)),
f as (select arg_min((1.5 * total - filled) / (weights - gone), most) as f from c where (1.5 * total - filled) / (weights - gone) <= most)
select doc_id, size, n as source_size, round(least(2.0 * n, w * coalesce(f, 1e30)), 6) as target from d join s on d.source is not distinct from s.source, f"""

BASE_SECRETS = r"""select doc_id,
len(list_filter(regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6))::bigint as n_assign,
len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint as n_access,
len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint as n_hex from (select doc_id, coalesce(text, '') as t from documents)"""

BASE_SUFFIXES = """with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
w as (select doc_id, i, md5(b[i:i + 399]) as h from (select doc_id, b, unnest(range(1, octet_length(b) - 398)) as i from d)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) as c from w) where c > 1),
g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 400 then 0 else 1 end as opens from r),
m as (select doc_id, min(i) as a, max(i) + 400 as z from (select *, sum(opens) over (partition by doc_id order by i) as run from g) group by doc_id, run),
k as (select doc_id, coalesce(lag(z) over w, 1) as a, a as z from m window w as (partition by doc_id order by a) union all
  select doc_id, coalesce(max(m.z), 1), octet_length(any_value(b)) + 1 from d left join m using (doc_id) group by 1),
e as (select doc_id, sha256(unhex(string_agg(case when k.z > k.a then hex(b[k.a:k.z - 1]) else '' end, '' order by k.a))) as kept_sha256 from k join d using (doc_id) group by 1)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(c, 0)::bigint as n_spans, kept_sha256
from d join e using (doc_id) left join (select doc_id, sum(z - a) as n, count(*) as c from m group by 1) using (doc_id)"""

FIM = """with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as x from documents),
u as (select *, case when ends_with(t, chr(10)) or t = '' then p[:len(p) - 1] else p end as p_ from (select *, string_split(t, chr(10)) as p from d)),
l as (select doc_id, t, list_transform(range(1, len(p_) + 1), lambda i: p_[i] || case when i < len(p) then chr(10) else '' end) as l, len(p_)::bigint as n,
  list_transform(range(4), lambda k: ('0x' || substr(x, (8 * k + 1)::int, 8))::bigint) as h from u),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form from l),
o as (select *, array_to_string(l[:a], '') as pre, array_to_string(l[a + 1:b], '') as mid, array_to_string(l[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
sha256(t) as restored_sha256 from o"""

LINES = """with l as (select doc_id, unnest(p) as line, generate_subscripts(p, 1) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
g as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select doc_id, i, line, first is not null and doc_id <> first as gone from k left join g using (key))
select doc_id, count(*) as n_lines, count_if(gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from j group by doc_id"""

# A decimal's CRC-32, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint), lambda r, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::bigint[],
  lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end, xor(r, b)), 4294967295::bigint), 4294967295::bigint)"""

TRIE = f"""with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, {_CRC} % 6 as h from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as part, i, role, text from c join t on t.conv_id = c.base and i <= h union all select conv_id, 1, i, role, text from c join t using (conv_id) where i > h),
s as (select c.conv_id, list(md5(role || chr(0) || text) order by part, i) filter (i is not null) as p, list(length(text) order by part, i) filter (i is not null) as n from c left join r using (conv_id) group by 1),
q as (select conv_id, coalesce(p, []) as p, coalesce(n, []) as n from s),
m as (select conv_id, d, p[:d] as k, len(p) = d as ends, case when d > 0 then n[d] else 0 end as chars from (select *, unnest(range(0, len(p) + 1)) as d from q)),
g as (select d, k, min(conv_id) as least, count(*) as n, any_value(chars) as chars, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from m group by d, k),
u as (select g.*, p.least as parent from g left join g p on p.d = g.d - 1 and p.k = g.k[:p.d]),
w as (select d, k, count(*) as n from (select d - 1 as d, k[:d - 1] as k from g where d > 0) group by 1, 2),
x as (select g.d, g.k, count_if(w.n is null) as leaves, sum((b.n - 1) * b.chars)::bigint as saved from g join g b on b.d >= g.d and b.k[:g.d] = g.k left join w on w.d = b.d and w.k = b.k group by 1, 2)
select least as conv_id, u.d::bigint as depth, parent as parent_conv_id, u.n as n_convs, coalesce(w.n, 0)::bigint as n_children, leaves::bigint as n_leaves, saved as saved_tokens, ends_sha256
from u left join w on w.d = u.d and w.k = u.k join x on x.d = u.d and x.k = u.k"""

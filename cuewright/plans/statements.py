"""Statements in DuckDB's dialect for operators that follow an order: recursions and folds over lists.

Each is written for itself, from the operator's rules, with other means than the engine uses: frames one by
one instead of streaks, folds of lists instead of windows.
"""

from __future__ import annotations

from cuewright.functions import text as X
from cuewright.operators import layout
from cuewright.operators.segment import Limits

# Fixed value: Unicode's white space, for the dialect's expressions.
WS = r"\x{9}-\x{D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sub(text: str, inside: str, negate: bool = False) -> str:
    """``text`` without the characters inside a class, or without all others."""
    inside = inside.replace("'", "''")
    return f"regexp_replace({text}, '[{'^' * negate}{inside}]', '', 'g')"


def utrim(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def strip(text: str) -> str:
    return sub(text, X.PUNCT + WS)


def capped_sql(frames: str, limits: Limits) -> str:
    """Segments under a cap. A row of the recursion is a source after one more of its speech frames: the
    open segment's start, its last speech frame, the segments that are over."""
    cap = limits.max_seg or 1 << 60
    least = max(1, limits.min_speech)
    return f"""with recursive f as {frames},
n as (select source_id, max(frame_idx) + 1 as n from f group by 1),
s as (select source_id, frame_idx as i, row_number() over (partition by source_id order by frame_idx) as k from f where prob >= {limits.threshold}),
t(source_id, k, a, l, o) as (
  select source_id, 1::bigint, i, i, [{{'s': -1::bigint, 'e': -1::bigint}}] from s where k = 1
  union all
  select source_id, k, case when cuts then i + 1 else b end, i,
    o || case when anew and l + 1 - a >= {least} then [{{'s': a, 'e': l + 1}}] else [] end || case when cuts then [{{'s': b, 'e': i + 1}}] else [] end
  from (select *, not gone and i >= b + {cap} as cuts from (select *, case when anew then i else a end as b from (
    select *, gone and i > l + {limits.merge_gap} as anew from (
      select t.source_id, s.k, s.i, t.a, t.l, t.o, least(l + {limits.min_silence}, greatest(l + 1, a + {cap})) < s.i as gone
      from t join s on s.source_id = t.source_id and s.k = t.k + 1))))),
z as (select source_id, n, a, l, o, case when least(l + {limits.min_silence}, greatest(l + 1, a + {cap})) >= n then n else l + 1 end as e
  from (select *, row_number() over (partition by source_id order by k desc) as back from t) join n using (source_id) where back = 1),
w as (select source_id, n, unnest(o || case when e - a >= {least} then [{{'s': a, 'e': e}}] else [] end) as x from z)
select source_id, greatest(x.s - {limits.pad}, 0) as start_frame, least(x.e + {limits.pad}, n) as end_frame from w where x.s >= 0"""


def collapse_ctes(name: str, given: str) -> str:
    """Common tables that end in ``name(id, r)``: the texts of ``given(id, s)`` without echoes. All units at all
    places are listed, the smallest of each place that repeats often enough is kept, and a recursion goes
    from one echo to the next."""
    return f"""{name}_c as materialized (select id, s, length(s) as m, regexp_extract_all(s, '(?s).') as h from (select distinct id, s from {given})),
{name}_i as materialized (select id, i, l from (select id, h, m, unnest(range(1, m)) as i from {name}_c), range(1, 129) t(l)
  where i + 2 * l - 1 <= m and h[i] = h[i + l] and h[i + l - 1] = h[i + 2 * l - 1]),
{name}_u as materialized (select id, any_value(s) as s, any_value(m) as m, i, min(l) as l from {name}_i join {name}_c using (id)
  where substr(s, i, l) = substr(s, i + l, l) and (l > 2 or (i + 3 * l - 1 <= m and substr(s, i, l) = substr(s, i + 2 * l, l))) group by id, i),
{name}_k as materialized (select id, i, l, substr(s, i, l) as u, list_max(list_filter(range(2, (m - i + 1) // l + 1), lambda k: substr(s, i, k * l) = repeat(substr(s, i, l), k))) as k from {name}_u),
{name}_j(id, pos, o) as (select id, 1::bigint, '' from {name}_c union all
  select id, x.i + x.k * x.l, o || substr(s, pos, x.i - pos) || repeat(x.u, case when x.l > 2 then 1 else 2 end)
  from (select j.id, j.pos, j.o, c.s, min_by({{'i': k.i, 'k': k.k, 'l': k.l, 'u': k.u}}, k.i) as x
    from {name}_j j join {name}_k k on k.id = j.id and k.i >= j.pos join {name}_c c on c.id = j.id group by 1, 2, 3, 4)),
{name} as materialized (select id, o || substr(s, pos) as r from (select id, max(pos) as pos, arg_max(o, pos) as o from {name}_j group by 1) join {name}_c using (id))"""


def segments_ctes(utterances: str) -> str:
    """Common tables that end in ``judged(source_id, seq, start_ms, end_ms, lang, verdict, text, collapsed)``.
    ``utterances`` has ``lang`` and the text behind the tag."""
    return f"""ut as (select *, {utrim('text')} as body, source_id || ':' || seq as id from {utterances}),
{collapse_ctes('sc', '(select id, body as s from ut)')},
sv as (select ut.*, r, {strip('r')} as z, greatest(end_ms - start_ms, 0) / 1000.0 as secs from ut join sc using (id)),
judged as materialized (select source_id, seq, start_ms, end_ms, lang, v as verdict, case when v = 'process' then r else body end as text,
  v = 'process' and body <> r as collapsed
  from (select *, case when z = '' then 'empty' when lower(lang) = 'none' and (secs < 2.0 or length(z) < 4) then 'fragment' else 'process' end as v from sv))"""


def _even(text: str, parts: str) -> str:
    return (
        f"list_filter(list_transform(range(least({parts}, greatest(length({text}), 1))), lambda k: "
        + utrim(f"substr({text}, length({text}) * k // least({parts}, greatest(length({text}), 1)) + 1, length({text}) * (k + 1) // least({parts}, greatest(length({text}), 1)) - length({text}) * k // least({parts}, greatest(length({text}), 1)))")
        + "), lambda e: e <> '')"
    )


def split_ctes(name: str, given: str, keys: str = "source_id, seq", secs: float = layout.MAX_SECS, chars: int = layout.MAX_CHARS) -> str:
    """Common tables that end in ``name(keys, piece, start_ms, end_ms, text)``: ``given(keys, start_ms, end_ms, text)``
    with long cues split. Groups and shares are folds of lists of structs."""
    over = lambda s, n: f"({s} > {secs} or {n} > {chars})"
    forced = lambda t, s: _even(t, f"least(greatest(2, ceil({s} / {secs})::bigint, ceil(length({t}) / {chars}.0)::bigint), greatest(1, ceil(length({t}) / {layout.MIN_PIECE}.0)::bigint))")
    share = lambda x: f"({x}::double / n * secs)"
    return f"""{name}_f as (select *, replace(text, chr(10), ' ') as flat, greatest(end_ms - start_ms, 0) / 1000.0::double as secs from {given}),
{name}_p as (select *, length(flat) as n, case when {utrim('flat')} <> '' and {over('secs', 'length(flat)')} then regexp_extract_all(flat, '[^{layout.STOPS}]*[{layout.STOPS}]|[^{layout.STOPS}]+') end as pieces from {name}_f),
{name}_r as (select *, list_reduce(list_prepend({{'g': []::varchar[], 'c': ''}}, list_transform(pieces, lambda p: {{'g': []::varchar[], 'c': p}})), lambda a, x:
  case when a.c <> '' and {over(share('(length(a.c) + length(x.c))'), 'length(a.c) + length(x.c)')} then {{'g': list_append(a.g, a.c), 'c': {utrim('x.c')}}} else {{'g': a.g, 'c': {utrim('a.c || x.c')}}} end) as z from {name}_p),
{name}_g as (select *, case when pieces is null then [] when len(pieces) < 2 then {forced('flat', 'secs')} else flatten(list_transform(list_filter(list_append(z.g, z.c), lambda e: e <> ''), lambda g:
  case when length(g) > 1 and {over(share('length(g)'), 'length(g)')} then {forced('g', share('length(g)'))} else [g] end)) end as found from {name}_r),
{name}_d as (select *, list_reduce(list_prepend({{'at': start_ms, 'n': 0::bigint, 'o': []::struct(s bigint, e bigint, t varchar)[]}}, list_transform(found, lambda g: {{'at': 0::bigint, 'n': length(g)::bigint, 'o': [{{'s': 0::bigint, 'e': 0::bigint, 't': g}}]}})), lambda a, x:
  {{'at': greatest(case when len(a.o) + 1 = len(found) then end_ms else start_ms + greatest(0, end_ms - start_ms) * (a.n + x.n) // list_sum(list_transform(found, lambda q: length(q))) end, a.at + 1)::bigint, 'n': a.n + x.n,
  'o': list_append(a.o, {{'s': a.at, 'e': greatest(case when len(a.o) + 1 = len(found) then end_ms else start_ms + greatest(0, end_ms - start_ms) * (a.n + x.n) // list_sum(list_transform(found, lambda q: length(q))) end, a.at + 1)::bigint, 't': x.o[1].t}})}}) as w from {name}_g),
{name} as materialized (select {keys}, unnest(range(len(l))) as piece, unnest(l).s as start_ms, unnest(l).e as end_ms, unnest(l).t as text
  from (select *, case when len(found) > 1 then w.o else [{{'s': start_ms, 'e': end_ms, 't': text}}] end as l from {name}_d))"""


def verdict_ctes(name: str, given: str) -> str:
    """Common tables that end in ``name``: ``given(source_id, seq, piece, ...)`` with ``verdict``, cue by cue with the
    last kept cue's text as the state."""
    own = f"(select *, {strip('text')} as s, row_number() over (partition by source_id order by seq, piece) as k from {given})"
    filler = lambda x: f"regexp_matches({x}, '^[{X.FILLERS}]+$')"
    judge = f"case when q.s = '' then 'empty' when b is null then 'keep' when q.s = b then 'duplicate' when {filler('b')} and {filler('q.s')} then 'filler_repeat' else 'keep' end"
    return f"""{name}_q as materialized {own},
{collapse_ctes(name + '_b', f"(select s as id, s from {name}_q)")},
{name}_o as materialized (select q.*, {strip('r')} as base from {name}_q q join {name}_b on {name}_b.id = q.s),
{name}_t(source_id, k, b, verdict) as (select source_id, 0::bigint, null::varchar, '' from {name}_q group by 1 union all
  select source_id, k, case when v = 'keep' then base else b end, v from (select q.source_id, q.k, t.b, q.base, {judge} as v from {name}_t t join {name}_o q on q.source_id = t.source_id and q.k = t.k + 1)),
{name} as materialized (select q.* exclude (s, k), verdict from {name}_q q join {name}_t t on t.source_id = q.source_id and t.k = q.k)"""


def wrap_ctes(name: str, given: str, width: int = layout.MAX_WIDTH) -> str:
    """Common tables that end in ``name(id, wrapped)`` of ``given(id, t)``: each row of the recursion takes a line
    from the rest of a paragraph."""
    columns = lambda x: f"(length({x}) + length({sub(x, X.WIDE, True)}))"
    fits = f"case when octet_length(encode(substr(rest, 1, {width}))) = {width} then {width} else list_max(list_filter(range(1, {width} + 1), lambda k: {columns('substr(rest, 1, k)')} <= {width})) end"
    cut = f"coalesce(list_max(list_filter(range(1, fits), lambda k: strpos('{layout.BREAKS}', substr(rest, k, 1)) > 0)), fits)"
    return f"""{name}_a as (select id, unnest(range(len(x))) as j, unnest(x) as para from (select id, string_split(t, chr(10)) as x from {given} where t is not null)),
{name}_w(id, j, k, rest, line) as (select id, j, 0, para, '' from {name}_a union all
  select id, j, k + 1, regexp_replace(substr(rest, cut + 1), '^[{WS}]+', ''), regexp_replace(substr(rest, 1, cut), '[{WS}]+$', '')
  from (select *, case when {columns('rest')} <= {width} then length(rest) else {cut} end as cut from (select *, {fits} as fits from {name}_w where rest <> ''))),
{name} as (select g.id, case when g.t is not null then coalesce(l, '') end as wrapped from {given} g left join (select id, string_agg(line, chr(10) order by j, k) as l from {name}_w where line <> '' group by 1) x using (id))"""


def twister_ctes(name: str, seed: int, draws: str) -> str:
    """``name(position, draw)``: the first ``draws`` numbers of Python's generator under a seed below 2**32, by the definition of
    MT19937: seeding by an array of one word, twists of 624 words, tempering, 53 bits of two words. Recursive."""
    mask = 4294967295
    mixed = lambda x, factor: f"xor({x}, {x} >> 30) * {factor}"
    twist = lambda u, v, w: f"xor({w}, xor((({u} & 2147483648) | ({v} & 2147483647)) >> 1, case when {v} & 1 = 1 then 2567483615 else 0 end))"
    return f"""mt_a as (select list_reduce(list_concat([[19650218::bigint]], list_transform(range(1, 624), lambda i: [i])), lambda a, b: list_append(a, ({mixed('a[-1]', 1812433253)} + b[1]) & {mask})) as m),
mt_b as (select list_reduce(list_transform(m, lambda x: [x]), lambda a, b: list_append(a, (xor(b[1], {mixed('a[-1]', 1664525)}) + {seed}) & {mask})) as m from mt_a),
mt_c as (select list_concat([m[624], (xor(m[2], {mixed('m[624]', 1664525)}) + {seed}) & {mask}], m[3:]) as m from mt_b),
mt_d as (select m, list_reduce(list_concat([[m[2]]], list_transform(range(3, 625), lambda i: [m[i], i - 1])), lambda a, b: list_append(a, (xor(b[1], {mixed('a[-1]', 1566083941)}) - b[2]) & {mask})) as q from mt_c),
mt_s as (select 0 as k, list_concat([2147483648::bigint, (xor(m[2], {mixed('q[623]', 1566083941)}) - 1) & {mask}], q[2:]) as m from mt_d
  union all select k + 1, x || y || list_transform(range(455, 624), lambda i: {twist('m[i]', 'm[i + 1]', 'y[i - 454]')}) || [{twist('m[624]', 'x[1]', 'y[170]')}]
  from (select *, list_transform(range(228, 455), lambda i: {twist('m[i]', 'm[i + 1]', 'x[i - 227]')}) as y
    from (select *, list_transform(range(1, 228), lambda i: {twist('m[i]', 'm[i + 1]', 'm[i + 397]')}) as x from mt_s)) where k * 312 < {draws}),
mt_w as (select (k - 1) * 624 + i - 1 as i, m[i] as y from (select *, unnest(range(1, 625)) as i from mt_s where k > 0)),
mt_t as (select i, xor(y, (y << 15) & 4022730752) as y from (select i, xor(y, (y << 7) & 2636928640) as y from (select i, xor(y, y >> 11) as y from mt_w))),
{name} as (select i // 2 as position, (sum(case when i % 2 = 0 then (w >> 5) * 67108864 else w >> 6 end))::double / 9007199254740992.0 as draw from (select i, xor(y, y >> 18) as w from mt_t) group by 1)"""

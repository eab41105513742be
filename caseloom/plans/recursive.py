"""Recursive SQL of queries whose operators walk in order: chunks, bins, greedy acceptance, limits and pairs."""

from __future__ import annotations

from ..functions import text as T
from .chunks import WINDOWS
from .mentions import MENTIONS
from .metrics import LOG
from .smart import DOCS, STRIP, packed_sql

_SKIP = "length(regexp_extract(substr(text, {0} + 1), '^\\s*'))"
_STOP = "case when {0} + 1000 >= length(text) then length(text) when instr(reverse(substr(text, {0} + 1, 1000)), ' ') between 1 and 999 then {0} + 1000 - instr(reverse(substr(text, {0} + 1, 1000)), ' ') else {0} + 1000 end"
_CUT = f"substr(text, b + 1, {_STOP.format('b')} - b)"

FIXED = f"""with recursive {DOCS}, f as (select doc_id, text, {_SKIP.format('0')} as b from d union all select doc_id, text, n + {_SKIP.format('n')} from (select doc_id, text, greatest({_STOP.format('b')}, b + 1) as n from f where b < length(text)) where n < length(text))
select doc_id, (row_number() over (partition by doc_id order by b) - 1)::int as chunk, b::int as start, ({_STOP.format('b')})::int as stop, {STRIP.format(_CUT)} as content from f where b < length(text)"""

PARAGRAPHS = rf"""with recursive {DOCS}, p as (select doc_id, text, k, list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0) as e, len(s) as n from (select doc_id, text, s, w, unnest(range(1, len(s) + 1)) as k from (select doc_id, text, string_split_regex(text, '\n\s*\n') as s, regexp_extract_all(text, '\n\s*\n') as w from d))),
q as (select *, lead(e) over (partition by doc_id order by k) as following from p),
g as (select doc_id, text, k, e, 0::double as b, following is null or following > 1000 as closed from q where k = 1 union all select q.doc_id, q.text, q.k, q.e, case when g.closed then g.e else g.b end, q.following is null or q.following - case when g.closed then g.e else g.b end > 1000 from g join q on q.doc_id = g.doc_id and q.k = g.k + 1)
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk, b::int as start, e::int as stop, {STRIP.format('substr(text, b::bigint + 1, (e - b)::bigint)')} as content from g where closed and {STRIP.format('substr(text, b::bigint + 1, (e - b)::bigint)')} <> ''"""

BINS = f"with recursive {WINDOWS}, tb as (select doc_id as key, chunk + 1 as i, length(content) // 4 as n, false as must, false as inside, start, stop from w), {packed_sql('tb', 0, 1000)} select key as doc_id, (i - 1)::int as chunk, start, stop, chunk::int as bin from (select tb.key, tb.i, tb.start, tb.stop, tb_g.chunk from tb join tb_g using (key, i))"

_ABBR = "[" + ", ".join(f"'{x}'" for x in T.LEGAL_ABBREVIATIONS) + "]"
_LEGAL = " or ".join(f"regexp_matches(text, '{p}')" for p in T.LEGAL_ENTITY)
GROUPS = rf"""with {MENTIONS}, a as (select *, regexp_replace(trim(regexp_replace(lower(text), '[\t\n\x0b\f\r ]+', ' ', 'g')), '''s\b', '', 'g') as t, {_LEGAL} as legal from m),
b as (select * exclude (t), case when list_contains({list(T.STOP_WORDS)}, string_split(t, ' ')[1]) and not legal then array_to_string(string_split(t, ' ')[2:], ' ') else t end as t from a),
c as (select *, array_to_string(list_transform(string_split(t, ' '), lambda x: case when len(list_filter({_ABBR}, lambda y: contains(lower(x), y))) > 0 then x else regexp_replace(x, '[^0-9A-Za-z_\t\n\x0b\f\r \-]', '', 'g') end), ' ') as normal from b),
g as (select *, entity_type || '::' || regexp_replace(replace(replace(normal, 'u.s.', 'united states'), 'us ', 'united states '), '^the ', '') as group_key from c)
select doc_id, group_key, any_value(entity_type) as entity_type, arg_max(text, (confidence, -start, -rank)) as text, max(confidence) as confidence, count(*) as occurrence_count, min(start) as first_start, array_to_string(list_sort(list_distinct(list(start))), ',') as positions from g group by 1, 2"""

CASCADE = f"""with recursive {MENTIONS}, o as (select *, row_number() over (partition by doc_id order by case source when 'regex' then 1 when 'model' then 2 when 'few_shot' then 3 else 4 end, confidence desc, start, stop, rank) as k from m),
g as (select doc_id, k, true as free, [{{'a': start, 'b': stop}}] as taken from o where k = 1 union all
select o.doc_id, o.k, x.free, case when x.free then list_append(g.taken, {{'a': o.start, 'b': o.stop}}) else g.taken end from g join o on o.doc_id = g.doc_id and o.k = g.k + 1, lateral (select len(list_filter(g.taken, lambda t: (t.a <= o.start and o.start < t.b) or (t.a < o.stop and o.stop <= t.b))) = 0 as free) x)
select doc_id, name, entity_type, source, rank, start, stop, text, round(confidence, 8) as confidence from o join g using (doc_id, k) where free"""

CIRCUIT = f"""with recursive {LOG}, o as (select event_id, user_id, success, ts, row_number() over (partition by user_id order by ts, event_id) as k from log),
s as (select user_id, k, event_id, success, 'closed' as state, case when success then 0 else 1 end as bad, case when success then 1 else 0 end as good, null::timestamp as opened, 'closed' as after from o where k = 1 union all
select o.user_id, o.k, o.event_id, o.success, z.state, z.bad, z.good, z.opened, z.after from s join o on o.user_id = s.user_id and o.k = s.k + 1,
lateral (select case when s.after = 'open' and epoch(o.ts) - epoch(s.opened) >= 86400 then 'half_open' else s.after end as state) x,
lateral (select case when s.after = 'open' and x.state = 'half_open' then 0 else s.good end as good) y,
lateral (select x.state, case when x.state = 'open' then s.bad when o.success then 0 when x.state = 'half_open' or s.bad + 1 >= 2 then 0 else s.bad + 1 end as bad, case when x.state <> 'open' and o.success then y.good + 1 else y.good end as good,
  case when x.state <> 'open' and not o.success and (x.state = 'half_open' or s.bad + 1 >= 2) then o.ts else s.opened end as opened,
  case when x.state = 'open' then 'open' when o.success and x.state = 'half_open' and y.good + 1 >= 2 then 'closed' when not o.success and (x.state = 'half_open' or s.bad + 1 >= 2) then 'open' else x.state end as after) z)
select user_id, event_id, success, state, state <> 'open' as allowed from s"""

DELAYS = f"""with recursive {LOG}, o as (select user_id, event_id, k, case when n >= 3 then mean end as mean from (select user_id, event_id, row_number() over v as k, avg(ms) over w as mean, count(*) over w as n from log window v as (partition by user_id order by ts, event_id), w as (partition by user_id order by ts, event_id rows between 9 preceding and current row))),
s as (select user_id, event_id, k, 0::double as delay from o where k = 1 union all select o.user_id, o.event_id, o.k, case when o.mean is null then s.delay when o.mean > 2500 then least(5000, s.delay + (o.mean - 2500) * 0.1::double) else greatest(0, s.delay - (2500 - o.mean) * 0.1::double / 2) end from s join o on o.user_id = s.user_id and o.k = s.k + 1)
select user_id, event_id, round(delay, 6) as delay_ms from s"""

PAIRS = f"""with {LOG}, a as (select user_id, event_type, ts, event_id from log where event_type in ('signup', 'purchase')), p as (select *, lag(event_type) over w as before, lag(ts) over w as since from a window w as (partition by user_id order by ts))
select user_id as id, count(*) as n, round(avg(epoch_us(ts) // 1000 - epoch_us(since) // 1000), 3) as mean_ms from p where event_type = 'purchase' and before = 'signup' group by 1"""

SQL = {"chunk_fixed": FIXED, "chunk_paragraphs": PARAGRAPHS, "chunk_bins": BINS, "entity_groups": GROUPS, "fusion_cascade": CASCADE, "limit_circuit": CIRCUIT, "limit_delays": DELAYS, "stream_pairs": PAIRS}

"""Chunks by structure, with recursive SQL that packs pieces in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import smart
from .documents import _keyword_case
from .registry import query, table


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def spans_sql(pattern: str, source: str = "documents", key: str = "doc_id") -> str:
    """(key, i, start, stop, text, gap) of a pattern's matches."""
    return f"""select {key}, i, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))::int as start,
    (list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))))::int as stop, w[i] as text, p[i + 1] as after
    from (select {key}, w, p, unnest(range(1, len(w) + 1)) as i from (select {key}, regexp_extract_all(text, '{q(pattern)}') as w, string_split_regex(text, '{q(pattern)}') as p from {source}))"""


def packed_sql(name: str, least: int = smart.LEAST, most: int = smart.MOST) -> str:
    """CTE {name}_g: pieces {name} (key, i, n, must, inside) with the number of their chunk."""
    new = f"((p.must and g.size > {least}) or (g.size + p.n > {most} and not p.inside))"
    return f"""{name}_g as (select key, i, n as size, 0 as chunk from {name} where i = 1 union all
    select p.key, p.i, case when {new} then p.n else g.size + p.n end, g.chunk + case when {new} then 1 else 0 end from {name}_g g join {name} p on p.key = g.key and p.i = g.i + 1)"""


DOCS = "d as (select doc_id, text, lower(text) as low from documents where length(text) > 0)"
PARAGRAPHS = rf"""pp as (select doc_id as key, i, s[i] as t, (length(s[i]) + case when i < len(s) then 2 else 0 end) as n, false as must, false as inside from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split_regex(text, '{smart.PARAGRAPH}') as s from d))),
{packed_sql("pp")}, pa as (select *, sum(n) over (partition by key order by i) - n as pos from pp),
paragraphs as (select key as doc_id, chunk, min(pos)::int as start, (min(pos) + length(string_agg(t, chr(10) || chr(10) order by i)))::int as stop, string_agg(t, chr(10) || chr(10) order by i) as content, 'paragraph' as kind from pa join pp_g using (key, i) group by 1, 2)"""
SENTENCES = rf"""sr as ({spans_sql(r"[^.!?]+[.!?]*\s*", "d")}), ss as (select doc_id, start + length(regexp_extract(text, '^\s*')) as start, {STRIP.format("text")} as t from sr),
sp as (select doc_id as key, row_number() over (partition by doc_id order by start) as i, t, length(t) as n, false as must, false as inside, start from ss where t <> ''), {packed_sql("sp")},
sentences as (select key as doc_id, chunk, min(start)::int as start, (min(start) + length(string_agg(t, ' ' order by i)))::int as stop, string_agg(t, ' ' order by i) as content, 'sentence' as kind from sp join sp_g using (key, i) group by 1, 2)"""
SECTIONS = rf"""xr as ({spans_sql(smart.SECTION, "d")}), xs as (select doc_id, i, start, (start + length(text || after))::int as stop, {STRIP.format("text || after")} as t from xr),
xp as (select doc_id || ':' || i as key, j as i, s[j] as t, length(s[j]) as n, false as must, false as inside from (select doc_id, i, s, unnest(range(1, len(s) + 1)) as j from (select doc_id, i, string_split_regex(t, '{smart.PARAGRAPH}') as s from xs where length(t) > {smart.MOST}))), {packed_sql("xp")},
xc as (select key, chunk, string_agg(t, chr(10) || chr(10) order by i) as content from xp join xp_g using (key, i) group by 1, 2),
xd as (select *, (sum(length(content) + 2) over (partition by key order by chunk) - length(content) - 2)::int as pos from xc),
xe as (select doc_id, i, 0 as sub, start, stop, t as content, 'section' as kind from xs where length(t) <= {smart.MOST} union all select doc_id, i, xd.chunk, start + pos, (start + pos + length(content))::int, content, 'section_part' from xs join xd on xd.key = doc_id || ':' || i),
sections as (select doc_id, row_number() over (partition by doc_id order by i, sub) - 1 as chunk, start, stop, content, kind from xe union all select * from paragraphs where doc_id not in (select doc_id from xr))"""
PROTECTED = f"pr as (select doc_id, start, stop, text from ({spans_sql(smart.CITATION, 'd')}) union all select doc_id, start, stop, text from ({spans_sql(smart.QUOTE, 'd')}))"
LEGAL = rf"""lr as (select doc_id, i, s[i] as l, s[i] || case when i < len(s) then chr(10) else '' end as t from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split(text, chr(10)) as s from d))),
la as (select *, length(t) as n, (sum(length(t)) over (partition by doc_id order by i) - length(t))::int as pos from lr), lb as (select doc_id, start, stop from pr),
li as (select distinct la.doc_id, i from la join lb on la.doc_id = lb.doc_id and lb.start <= pos and pos < lb.stop),
lp as (select la.doc_id as key, la.i, t, n, regexp_matches(l, '{q(smart.SECTION)}') as must, li.i is not null as inside, pos from la left join li on la.doc_id = li.doc_id and la.i = li.i), {packed_sql("lp")},
legal as (select key as doc_id, chunk, min(pos)::int as start, (min(pos) + length(string_agg(t, '' order by i)))::int as stop, string_agg(t, '' order by i) as content, 'legal_section' as kind from lp join lp_g using (key, i) group by 1, 2)"""


def _count_sql(words) -> str:
    return f"len(list_filter(t, lambda x: x in ({', '.join(repr(w) for w in words)})))"


COMPLEXITY = rf"""ct as (select doc_id, regexp_extract_all(low, '{q(smart.TOKEN)}') as t, len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*\s*'), lambda x: trim(x) <> '')) as s, len(regexp_extract_all(text, '{q(smart.CITATION)}')) as c from d),
cc as (select doc_id, len(t) as n, s, c, ({_count_sql(smart.HARD_WORDS)} * 3 + {_count_sql(smart.MIDDLING_WORDS)} * 2 + {_count_sql(smart.EASY_WORDS)}) / (len(t) * 3) as h from ct),
complexity as (select doc_id, case when n = 0 then 0 else least(1, case when s > 0 then (h + least(n / s / 50, 1)) / 2 else h end * 0.6 + least(c / (n / 100) / 5, 1) * 0.4) end as x from cc)"""
STRATEGY = f"""kinds as ({_keyword_case("lower(substr(text, 1, 5000))")}), strategies as (select doc_id, case when document_type in ('contract', 'statute') then 'section' when document_type = 'opinion' then 'legal' when document_type = 'brief' then 'paragraph' when x > 0.7 then 'legal' when x > 0.4 then 'paragraph' else 'sentence' end as how from kinds join complexity using (doc_id))"""
_OUT = "doc_id, chunk, start, stop, kind, md5(content) as content"


def _told(df):
    return df.select("doc_id", "chunk", "start", "stop", "kind", F.md5("content").alias("content"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query(f"with recursive {DOCS}, {PARAGRAPHS} select {_OUT} from paragraphs")
def chunk_by_paragraph(spark, d):
    return _told(smart.chunked(_docs(spark, d), "paragraph"))


@query(f"with recursive {DOCS}, {SENTENCES} select {_OUT} from sentences")
def chunk_by_sentence(spark, d):
    return _told(smart.chunked(_docs(spark, d), "sentence"))


@query(f"with recursive {DOCS}, {PARAGRAPHS}, {SECTIONS} select {_OUT} from sections")
def chunk_by_section(spark, d):
    return _told(smart.chunked(_docs(spark, d), "section"))


@query(f"with recursive {DOCS}, {PROTECTED}, {LEGAL} select {_OUT} from legal")
def chunk_legal(spark, d):
    return _told(smart.chunked(_docs(spark, d), "legal"))


@query(f"with {DOCS}, {PROTECTED}, r as (select *, max(stop) over (partition by doc_id order by start, stop rows between unbounded preceding and 1 preceding) as reach from pr), g as (select *, sum(case when start <= reach then 0 else 1 end) over (partition by doc_id order by start, stop rows unbounded preceding) as k from r) select doc_id, min(start) as start, max(stop) as stop from g group by doc_id, k")
def protected_spans(spark, d):
    """Citations and quotes that a chunk shouldn't cut, those that touch as one."""
    return smart.merged_spans(_docs(spark, d))


@query(f"with {DOCS}, {COMPLEXITY} select doc_id, round(x, 6)::double as complexity from complexity")
def text_complexity(spark, d):
    return _docs(spark, d).filter(F.length("text") > 0).select("doc_id", F.round(smart.complexity(F.col("text")), 6).alias("complexity"))


@query(f"with recursive {DOCS}, {COMPLEXITY}, {STRATEGY}, {PARAGRAPHS}, {SENTENCES}, {SECTIONS}, {PROTECTED}, {LEGAL}, every as (select *, 'section' as how from sections union all select *, 'legal' from legal union all select *, 'paragraph' from paragraphs union all select *, 'sentence' from sentences) select {_OUT} from every join strategies using (doc_id, how)")
def chunk_adaptive(spark, d):
    return _told(smart.chunked(_docs(spark, d)))


_LATER = "length(regexp_extract(substr(text, {0} + 1), '^\\S*'))"
_EARLIER = "greatest(length(regexp_replace(substr(text, 1, {0} + 1), '\\S+\\z', '')) - 1, 0)"


@query(f"""with recursive {DOCS}, {PROTECTED}, {LEGAL}, n as (select l.*, text, lead(chunk) over (partition by doc_id order by chunk) is null as last from legal l join d using (doc_id)),
o as (select doc_id, chunk, text, (case when chunk = 0 then start else {_EARLIER.format(f'greatest(start - {smart.OVERLAP}, 0)')} end)::int as start, (case when last then stop else least(stop + {smart.OVERLAP}, length(text)) + {_LATER.format(f'least(stop + {smart.OVERLAP}, length(text))')} end)::int as stop, kind from n)
select doc_id, chunk, start, stop, kind, md5({STRIP.format('substr(text, start + 1, stop - start)')}) as content from o""")
def chunk_document(spark, d):
    """A strategy's chunks, extended into their neighbours up to white space."""
    return _told(smart.chunked(_docs(spark, d), "legal", overlap=smart.OVERLAP))


@query(f"""with {DOCS}, {PROTECTED}, z as (select doc_id, text, length(text) as n, greatest(100, least(floor(length(text) * 0.8::double), 900))::int as size from d where length(text) > 3000), c as (select *, ceil(n / size)::int as k, unnest(range(0, ceil(n / size)::bigint)) as chunk from z),
o as (select doc_id, text, chunk, (case when chunk = 0 then 0 else {_EARLIER.format('greatest(0, chunk * size - 60)')} end)::int as start, (case when chunk = k - 1 then n else least(n, (chunk + 1) * size + 60) + {_LATER.format('least(n, (chunk + 1) * size + 60)')} end)::int as stop from c),
r as (select *, max(stop) over (partition by doc_id order by start, stop rows between unbounded preceding and 1 preceding) as reach from pr), g as (select *, sum(case when start <= reach then 0 else 1 end) over (partition by doc_id order by start, stop rows unbounded preceding) as k from r), m as (select doc_id, min(start) as a, max(stop) as b from g group by doc_id, k),
s as (select distinct o.doc_id, chunk from o join m on o.doc_id = m.doc_id and ((a < o.start and o.start < b) or (a < o.stop and o.stop < b)))
select doc_id, chunk::int as chunk, start, stop, md5({STRIP.format('substr(text, start + 1, stop - start)')}) as content, s.doc_id is not null as splits from o left join s using (doc_id, chunk) where {STRIP.format('substr(text, start + 1, stop - start)')} <> ''""")
def chunk_smart(spark, d):
    """Large texts (here: over 3000 characters) in even, overlapping chunks, with whether they cut a citation or a quote."""
    return smart.smart(_docs(spark, d), 3000, 100, 900, 60).withColumn("content", F.md5("content"))

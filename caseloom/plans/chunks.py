"""Windows, pages, boundaries and candidates of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spans import spans
from ..operators import chunking
from .registry import query, table

WINDOWS = "w as (select doc_id, k::int as chunk, (k * 400)::int as start, least(k * 400 + 500, length(text))::int as stop, substr(text, k * 400 + 1, 500) as content from (select doc_id, text, unnest(range(0, (case when length(text) <= 500 then 0 else ceil((length(text) - 500) / 400.0) end)::bigint + 1)) as k from documents where length(text) > 0))"


def windows(spark, d):
    return chunking.windows(table(spark, d, "documents"), 500, 100)


@query(f"with {WINDOWS} select doc_id, chunk, start, stop, md5(content) as content from w")
def chunk_windows(spark, d):
    return windows(spark, d).withColumn("content", F.md5("content"))


@query(f"with {WINDOWS} select doc_id, count(*) as n, round(avg(length(content)), 6) as mean, min(length(content)) as least, max(length(content)) as most, sum(length(content))::bigint as total from w group by 1")
def chunk_statistics(spark, d):
    return chunking.statistics(windows(spark, d), ["doc_id"]).withColumn("mean", F.round("mean", 6))


@query(rf"with {WINDOWS} select doc_id, chunk, round(least(1.0, case when length(trim(content)) < 50 then 0.5 else 1.0 end::double * case when regexp_matches(trim(content), '[.!?]\z') then 1.0 else 0.8 end::double * case when regexp_matches(content, '[.!?]\s') then 1.1 else 1.0 end::double), 6)::double as quality, case when length(content) / 400 between 0.8 and 1.2 then 1.0 when length(content) / 400 between 0.5 and 1.5 then 0.7 when length(content) / 400 between 0.3 and 2.0 then 0.4 else 0.1 end::double as size_score from w")
def chunk_quality(spark, d):
    return windows(spark, d).select("doc_id", "chunk", F.round(chunking.quality(F.col("content")), 6).alias("quality"), chunking.size_score(F.length("content"), 400).alias("size_score"))


@query(rf"""with {WINDOWS}, s as (select doc_id, chunk, list_filter(string_split_regex(content, '[.!?]+\s*'), lambda x: trim(x) <> '') as s from w),
p as (select doc_id, chunk, len(s) as n, list_transform(range(1, len(s)), lambda i: [list_distinct(list_filter(string_split_regex(lower(s[i]), '\s+'), lambda x: x <> '')), list_distinct(list_filter(string_split_regex(lower(s[i + 1]), '\s+'), lambda x: x <> ''))]) as p from s)
select doc_id, chunk, round(case when n < 2 then 1 else list_avg(list_transform(p, lambda q: case when len(q[1]) = 0 or len(q[2]) = 0 then 0 else len(list_intersect(q[1], q[2])) / len(list_distinct(list_concat(q[1], q[2]))) end)) end, 6)::double as coherence from p""")
def chunk_coherence(spark, d):
    return windows(spark, d).select("doc_id", "chunk", F.round(chunking.coherence(F.col("content")), 6).alias("coherence"))


@query(f"with {WINDOWS} select doc_id, chunk, below_min_size, exceeds_max_size from (select *, length(content) < 100 as below_min_size, length(content) > 1.2 * 400 as exceeds_max_size, row_number() over (partition by doc_id order by chunk) as r from w where trim(content) <> '') where r <= 100")
def chunk_checked(spark, d):
    return chunking.checked(windows(spark, d), 100, 400).select("doc_id", "chunk", "below_min_size", "exceeds_max_size")


@query("with l as (select doc_id, i as chunk, s[i] as content from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split(text, chr(10)) as s from documents))) select doc_id, chunk, md5(content) as content from (select *, row_number() over (partition by doc_id, lower(trim(content)) order by chunk) as r from l) where r = 1")
def chunk_distinct(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk", "content")).withColumn("chunk", F.col("chunk") + 1)
    return chunking.distinct(lines).withColumn("content", F.md5("content"))


@query(f"with {WINDOWS} select doc_id, chunk, md5(coalesce(right(lag(content) over v, 50), '') || content || coalesce(left(lead(content) over v, 50), '')) as content from w window v as (partition by doc_id order by chunk)")
def chunk_extended(spark, d):
    return chunking.extended(windows(spark, d), 50).select("doc_id", "chunk", F.md5("content").alias("content"))


def _bounds_sql(kind: str, pattern: str, strength: float) -> str:
    return f"select doc_id, '{kind}' as kind, {strength}::double as strength, (list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))))::int as position from (select doc_id, w, p, unnest(range(1, len(w) + 1)) as i from (select doc_id, regexp_extract_all(text, '{pattern}') as w, string_split_regex(text, '{pattern}') as p from documents))"


_KINDS = {"paragraph": (r"\n\s*\n", 0.7), "line": (r"\n", 0.5), "sentence": (r"[.!?]+\s+", 0.4)}


@query("with documents as (select doc_id, replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) as text from main.documents), b as (" + " union all ".join(_bounds_sql(k, p, s) for k, (p, s) in _KINDS.items()) + ") select doc_id, position, max(strength) as strength, arg_max(kind, strength) as kind from b group by 1, 2")
def text_boundaries(spark, d):
    """Boundaries of texts whose sentences stand as paragraphs."""
    docs = table(spark, d, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n \n")))
    return chunking.boundaries(docs, _KINDS)


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def _headers_sql(p: str) -> str:
    """Pages that begin at the second and later matches; null if fewer than two are long enough."""
    whole, parts = f"regexp_extract_all(text, '(?i){p}')", f"string_split_regex(text, '(?i){p}')"
    each = f"list_transform(range(1, len({whole}) + 1), lambda i: {_strip(f'case when i = 1 then {parts}[1] else chr(0)[1:0] end || {whole}[i] || {parts}[i + 1]')})"
    kept = f"list_filter({each}, lambda t: len(regexp_extract_all(t, '\\S+')) > {chunking.PAGE_LEAST})"
    return f"case when len({whole}) > 1 and len({kept}) > 1 then {kept} end"


def pages_sql(low: int, high: int, source: str = "documents", key: str = "doc_id") -> str:
    """(key, page, content)"""
    breaks = " ".join(f"when regexp_matches(text, '(?i){p}') then string_split_regex(text, '(?i){p}')" for p in chunking.PAGE_BREAKS)
    size = f"least({high}, greatest({low}, len(w) // greatest(1, len(w) // {high})))"
    by_words = f"list_transform(range(0, ceil(len(w) / {size})::bigint), lambda i: array_to_string(w[i * {size} + 1:i * {size} + {size}], ' '))"
    headed = "coalesce(" + ", ".join(map(_headers_sql, chunking.PAGE_HEADERS)) + f", {by_words})"
    return rf"""select {key}, page::int as page, content from (select {key}, i as page, {_strip("p[i]")} as content from (select {key}, p, unnest(range(1, len(p) + 1)) as i from
    (select {key}, case {breaks} else {headed} end as p from (select {key}, text, regexp_extract_all(text, '\S+') as w from {source} where regexp_matches(text, '\S'))))) where content <> ''"""


@query(f"select doc_id, page, length(content) as chars, md5(content) as content from ({pages_sql(*chunking.PAGE_WORDS)})")
def page_split(spark, d):
    return chunking.pages(table(spark, d, "documents")).select("doc_id", "page", F.length("content").alias("chars"), F.md5("content").alias("content"))


#: Texts with page breaks and headers of each kind, made of the documents' own.
_BROKEN_SQL = r"""(select doc_id, case doc_id % 7 when 0 then text || chr(12) || text when 1 then text || chr(10) || ' page  ' || doc_id || chr(10) || text when 2 then text || chr(10) || '- 4 -' || chr(10) || lang when 3 then text || chr(10) || '17' || chr(10) || chr(10) || text
when 4 then text || chr(10) || 'CASE NO. 12 ' || text || chr(10) || ' Case Number: 13 ' || text when 5 then text || chr(10) || 'Order granting ' || text || chr(10) || 'State of Utah ' || text || chr(10) || 'ORDER ' || text else text || ' Page 3 ' || text end as text from documents)"""


def _broken(spark, d):
    t, n = F.col("text"), F.lit("\n")
    put = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    kinds = (put(t, "\f", t), put(t, n, " page  ", F.col("doc_id").cast("string"), n, t), put(t, n, "- 4 -", n, F.col("lang")), put(t, n, "17", n, n, t), put(t, n, "CASE NO. 12 ", t, n, " Case Number: 13 ", t), put(t, n, "Order granting ", t, n, "State of Utah ", t, n, "ORDER ", t), put(t, " Page 3 ", t))
    out = F.when(F.col("doc_id") % 7 == 0, kinds[0])
    for k, x in enumerate(kinds[1:], 1):
        out = out.when(F.col("doc_id") % 7 == k, x)
    return table(spark, d, "documents").select("doc_id", out.alias("text"))


@query(f"select doc_id, page, length(content) as chars, md5(content) as content from ({pages_sql(*chunking.PAGE_WORDS, _BROKEN_SQL)})")
def page_split_breaks(spark, d):
    """Every kind of page break and header."""
    return chunking.pages(_broken(spark, d)).select("doc_id", "page", F.length("content").alias("chars"), F.md5("content").alias("content"))


@query(f"with q as ({pages_sql(300, 300)}) select doc_id, page, md5(coalesce(lag(content, 2) over v || chr(10) || chr(10), '') || coalesce(lag(content) over v, '')) as context from q window v as (partition by doc_id order by page)")
def page_context(spark, d):
    return chunking.with_previous_pages(chunking.pages(table(spark, d, "documents"), (300, 300)), 2).select("doc_id", "page", F.md5("context").alias("context"))


@query(f"with q as ({pages_sql(*chunking.PAGE_WORDS)}) select doc_id, (page - 1) // 3 as batch, min(page) as first, count(*) as pages, md5(string_agg('=== PAGE ' || page || ' ===' || chr(10) || content, chr(10) || chr(10) order by page)) as content from q group by 1, 2")
def page_combined(spark, d):
    """The pages of a batch as one text, each under a line with its number."""
    pages = chunking.pages(table(spark, d, "documents")).withColumn("batch", F.floor((F.col("page") - 1) / 3))
    return chunking.combined(pages, "batch").select("doc_id", "batch", "first", "pages", F.md5("content").alias("content"))


@query(f"with q as ({pages_sql(*chunking.PAGE_WORDS)}), p as (select *, (page - 1) // 3 as batch, len(regexp_extract_all(content, '\\S+')) as words from q), b as (select doc_id, batch, count(*) as pages, sum(words)::bigint as words, sum(length(content))::bigint as chars from p group by 1, 2) select doc_id, count(*) as batches, sum(pages)::bigint as pages, round(avg(pages), 6) as mean_pages, round(avg(words), 6) as mean_words, max(chars) as most_chars from b group by 1")
def page_batch_statistics(spark, d):
    p = chunking.pages(table(spark, d, "documents")).select("doc_id", F.floor((F.col("page") - 1) / 3).alias("batch"), F.size(F.regexp_extract_all("content", F.lit(r"\S+"), F.lit(0))).alias("words"), F.length("content").alias("chars"))
    b = p.groupBy("doc_id", "batch").agg(F.count("*").alias("pages"), F.sum("words").alias("words"), F.sum("chars").alias("chars"))
    return b.groupBy("doc_id").agg(F.count("*").alias("batches"), F.sum("pages").alias("pages"), F.round(F.avg("pages"), 6).alias("mean_pages"), F.round(F.avg("words"), 6).alias("mean_words"), F.max("chars").alias("most_chars"))


def _spans_sql(pattern: str) -> str:
    return f"select doc_id, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))::int as start, w[i] as text from (select doc_id, w, p, unnest(range(1, len(w) + 1)) as i from (select doc_id, regexp_extract_all(text, '{pattern}') as w, string_split_regex(text, '{pattern}') as p from documents))"


_CAPS = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,4}"
_QUOTED = r'"[^"\n]{3,50}"'
_SCORE = "round(least(1.0, 0.6 + case when len(string_split(text, ' ')) between 2 and 3 then 0.2 when len(string_split(text, ' ')) > 3 then 0.1 else 0 end - case when length(text) < 8 then 0.1 else 0 end), 6)::double"


@query(f"select doc_id, start, text, {_SCORE} as confidence from ({_spans_sql(_CAPS)})")
def candidates_capitalized(spark, d):
    n = F.size(F.split("text", " "))
    rows = table(spark, d, "documents").select("doc_id", F.explode(spans(F.col("text"), _CAPS)).alias("m")).select("doc_id", "m.start", "m.text")
    return rows.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.6 + F.when(n.between(2, 3), 0.2).when(n > 3, 0.1).otherwise(0.0) - F.when(F.length("text") < 8, 0.1).otherwise(0.0)), 6))


@query(f"""select doc_id, start, text, length(text) >= 4 and length(regexp_replace(text, '[A-Za-z0-9\\s]', '', 'g')) <= 0.3 * length(text) and len(string_split(trim(text), ' ')) <= 6 as valid from ({_spans_sql(_QUOTED)})""")
def candidates_quoted(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(spans(F.col("text"), _QUOTED)).alias("m")).select("doc_id", "m.start", "m.text")
    special = F.length(F.regexp_replace("text", r"[A-Za-z0-9\s]", ""))
    return rows.withColumn("valid", (F.length("text") >= 4) & (special <= 0.3 * F.length("text")) & (F.size(F.split(F.trim("text"), " ")) <= 6))


@query()
def chunk_fixed(spark, d):
    return chunking.fixed_chunks(table(spark, d, "documents"))


@query()
def chunk_boundary(spark, d):
    return chunking.boundary_chunks(table(spark, d, "documents"), 2000, 200, 400, 100)


@query()
def chunk_paragraphs(spark, d):
    return chunking.packed_paragraphs(table(spark, d, "documents"))


@query()
def chunk_bins(spark, d):
    return chunking.token_bins(windows(spark, d), 1000).drop("content")

"""Mentions on documents: scan, context, conflicts, fusion and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import text as T
from ..functions.spans import window
from ..operators import matching, resolving
from .registry import query, table


def _conf(n: str, p: C.Pattern) -> str:
    more = C.TYPE_BOOSTS.get(p.entity_type, 1.0) * (1.02 if any(x in p.name for x in C.NAME_BOOSTS) else 1.0)
    return f"least(1.0::double, greatest(0.5::double, {p.confidence}::double * (case when {n} < 3 then 0.85 when {n} < 10 then 0.95 when {n} < 25 then 1.0 else 1.02 end)::double * {more}::double))"


def _scan(p: C.Pattern, rank: int) -> str:
    q = p.pattern.replace("'", "''")
    return f"""select doc_id, '{p.name}' as name, '{p.entity_type}' as entity_type, '{p.source}' as source, {rank} as rank, (a + s)::int as start, (a + s + length(w[i]))::int as stop, w[i] as text, {_conf('length(w[i])', p)} as confidence
      from (select doc_id, w, i, list_sum(list_transform(p[1:i], lambda x: length(x))) as a, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) as s from
      (select doc_id, w, p, unnest(range(1, len(w) + 1)) as i from (select doc_id, regexp_extract_all(text, '{q}') as w, string_split_regex(text, '{q}') as p from documents)))"""


MENTIONS = "raw as (" + " union all ".join(_scan(p, n) for n, p in enumerate(C.GENERIC)) + "), m as (select * from raw where confidence >= 0.7)"


def found(spark, d):
    """All sure mentions of all documents."""
    return matching.mentions(table(spark, d, "documents"), most=None)


_OUT = "doc_id, name, entity_type, source, rank, start, stop, text, round(confidence, 8) as confidence"


def _told(df):
    return df.select("doc_id", "name", "entity_type", "source", "rank", "start", "stop", "text", F.round("confidence", 8).alias("confidence"))


@query(f"with {MENTIONS} select {_OUT} from m")
def mention_scan(spark, d):
    return _told(found(spark, d))


@query(f"with {MENTIONS} select {_OUT} from (select *, row_number() over (partition by doc_id, rank order by start) as k from m) where k <= 1000")
def mention_scan_limited(spark, d):
    """At most 1000 matches of each pattern in a text, as a service limits them."""
    return _told(matching.mentions(table(spark, d, "documents"), most=matching.MOST))


@query(rf"with {MENTIONS} select m.doc_id, rank, start, trim(regexp_replace(substr(d.text, greatest(start - 100, 0) + 1, stop + 100 - greatest(start - 100, 0)), '[\t\n\x0b\f\r ]+', ' ', 'g')) as context, substr(d.text, greatest(start - 50, 0) + 1, start - greatest(start - 50, 0)) as before, substr(d.text, stop + 1, 50) as after from m join documents d using (doc_id)")
def mention_context(spark, d):
    docs = table(spark, d, "documents")
    out = matching.with_context(found(spark, d), docs).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    start, stop = F.col("start"), F.col("stop")
    return out.select("doc_id", "rank", "start", "context", window(F.col("t"), start, start, 50, 0).alias("before"), window(F.col("t"), stop, stop, 0, 50).alias("after"))


@query(f"with {MENTIONS} select entity_type, count(*) as n, count(distinct doc_id) as docs, count(distinct name) as names, round(avg(confidence), 12) as mean, round(min(confidence), 8) as least, round(max(confidence), 8) as most, sum(case when confidence >= 0.9 then 1 else 0 end)::bigint as high, sum(case when confidence >= 0.7 and confidence < 0.9 then 1 else 0 end)::bigint as medium from m group by 1")
def mention_counts(spark, d):
    c = F.col("confidence")
    return found(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("name").alias("names"), F.round(F.avg(c), 12).alias("mean"), F.round(F.min(c), 8).alias("least"), F.round(F.max(c), 8).alias("most"), F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"))


_ISLAND = "i as (select *, sum(case when least(stop, ps) > greatest(start, pb) and pt = entity_type then 0 else 1 end) over (partition by doc_id order by start, stop, rank) as island from (select *, lag(stop) over w as ps, lag(start) over w as pb, lag(entity_type) over w as pt from m window w as (partition by doc_id order by start, stop, rank)))"
_PRIORITY = "case " + " ".join(f"when contains(lower(name), '{k}') then {v}" for k, v in C.PRIORITIES) + " else 50 end"


@query(f"with {MENTIONS}, {_ISLAND} select {_OUT} from (select *, row_number() over (partition by doc_id, island order by confidence desc, start, stop, rank) as r from i) where r = 1")
def conflict_resolve(spark, d):
    return _told(resolving.resolve_conflicts(found(spark, d)))


@query(f"with {MENTIONS}, {_ISLAND} select {_OUT} from (select *, row_number() over (partition by doc_id, island order by {_PRIORITY} desc, start, stop, rank) as r from i) where r = 1")
def conflict_resolve_priority(spark, d):
    return _told(resolving.resolve_conflicts(found(spark, d), "pattern_priority"))


@query(f"with {MENTIONS}, {_ISLAND} select {_OUT} from (select *, row_number() over (partition by doc_id, island order by confidence desc, start, stop, rank) as r, count(*) over (partition by doc_id, island) as n from i) where r = 1 and (n = 1 or confidence >= 0.8)")
def conflict_resolve_merge(spark, d):
    return _told(resolving.resolve_conflicts(found(spark, d), "merge"))


_REACH = "o as (select *, sum(case when start < reach then 0 else 1 end) over (partition by doc_id order by start, stop, rank) as island from (select *, max(stop) over (partition by doc_id order by start, stop, rank rows between unbounded preceding and 1 preceding) as reach from m)), f as (select *, row_number() over (partition by doc_id, island order by confidence desc, start, stop, rank) as r, min(source) over (partition by doc_id, island) <> max(source) over (partition by doc_id, island) as several from o)"


@query(f"with {MENTIONS}, {_REACH} select doc_id, name, entity_type, case when several then 'fusion' else source end as source, rank, start, stop, text, round(case when several then least(0.99::double, confidence * 1.1::double) else confidence end, 8) as confidence from f where r = 1")
def fusion_weighted(spark, d):
    return _told(resolving.fuse(found(spark, d)))


@query(f"with {MENTIONS}, {_REACH} select doc_id, name, entity_type, 'fusion' as source, rank, start, stop, text, round(confidence, 8) as confidence from f where r = 1 and several")
def fusion_intersection(spark, d):
    return _told(resolving.fuse(found(spark, d), "intersection"))


@query(f"with {MENTIONS} select {_OUT} from (select *, row_number() over (partition by doc_id, entity_type, text, start, stop order by rank) as r from m) where r = 1")
def fusion_union(spark, d):
    return _told(resolving.fuse(found(spark, d), "union"))


@query()
def fusion_cascade(spark, d):
    return _told(resolving.fuse(found(spark, d), "cascade"))


_KEYS = {
    "waves": ("lower(trim(text)), entity_type", "rank, start", "true"),
    "text": ("lower(trim(text))", "rank, start", "trim(text) <> ''"),
    "typed_text": ("lower(trim(text)), lower(entity_type)", "rank, start", "trim(text) <> ''"),
    "overlap": ("lower(trim(text)), start // 10", "confidence desc, rank, start", "true"),
    "exact": ("entity_type, text, start", "confidence desc, rank", "true"),
    "position": ("start // 10, stop // 10", "rank, start", "true"),
}
for _how, (_k, _o, _f) in _KEYS.items():
    query(f"with {MENTIONS} select {_OUT} from (select *, row_number() over (partition by doc_id, {_k} order by {_o}) as r from m where {_f}) where r = 1", f"dedup_{_how}")(lambda spark, d, _how=_how: _told(resolving.dedup(found(spark, d), _how)))


@query(f"with {MENTIONS}, a as (select * from m where source = 'model'), b as (select * from m where source = 'regex') select {_OUT} from a union all select {_OUT.replace('round(confidence, 8)', 'round(confidence * 0.8::double, 8)')} from b where not exists (select 1 from a where a.doc_id = b.doc_id and a.text = b.text and a.start = b.start and a.stop = b.stop)")
def merge_strategies(spark, d):
    m = found(spark, d)
    return _told(resolving.merge_regex_and_model(m.filter("source = 'regex'"), m.filter("source = 'model'")))


@query(f"with {MENTIONS}, p as (select *, rank % 8 + 1 as pass from m) select {_OUT}, pass from p where confidence >= case when pass <= 3 then 0.3 when pass <= 5 then 0.5 else 0.7 end and confidence >= 0.55")
def strategy_filters(spark, d):
    p = found(spark, d).withColumn("pass", F.col("rank") % 8 + 1)
    kept = resolving.strategy_filter(resolving.strategy_filter(p, "multipass"), "ai_enhanced")
    return kept.select("doc_id", "name", "entity_type", "source", "rank", "start", "stop", "text", F.round("confidence", 8).alias("confidence"), "pass")


@query(f"with {MENTIONS} select entity_type, n, rank, text, k from (select entity_type, lower(trim(text)) as text, count(*) as n, min(rank) as rank, row_number() over (partition by entity_type order by count(*) desc, lower(trim(text))) as k from m group by 1, 2) where k <= 10")
def top_mentions(spark, d):
    from pyspark.sql import Window

    counted = found(spark, d).groupBy("entity_type", T.key(F.col("text")).alias("text")).agg(F.count("*").alias("n"), F.min("rank").alias("rank"))
    return counted.withColumn("k", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("n"), "text"))).filter("k <= 10")


@query(f"with {MENTIONS} select doc_id, entity_type, lower(trim(text)) as key, substr(md5(entity_type || ':' || lower(trim(text))), 1, 16) as entity_id, count(*) as n, min(start) as first_start, round(max(confidence), 8) as confidence, round(least(1.0, max(confidence) + case when count(distinct start // 1000) > 1 then 0.10 else 0 end + case when count(*) > 3 then 0.05 else 0 end), 8)::double as merged from m group by 1, 2, 3")
def entity_occurrences(spark, d):
    m = found(spark, d).withColumn("key", T.key(F.col("text")))
    c = F.max("confidence")
    return m.groupBy("doc_id", "entity_type", "key").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.round(c, 8).alias("confidence"), F.round(F.least(F.lit(1.0), c + F.when(F.countDistinct(F.floor(F.col("start") / 1000)) > 1, 0.10).otherwise(0.0) + F.when(F.count("*") > 3, 0.05).otherwise(0.0)), 8).alias("merged")).withColumn("entity_id", T.entity_id(F.col("entity_type"), F.col("key")))


@query()
def entity_groups(spark, d):
    out = resolving.occurrences(found(spark, d))
    return out.withColumn("positions", F.array_join("positions", ","))


# --- the catalog itself ---

_ROWS = ", ".join(f"('{p.name}', {p.confidence}, '{p.entity_type}', '{p.source}', '{p.jurisdiction}', '{p.court_level}', '{p.pattern_type}', {list(p.examples)}::varchar[], {list(p.dependencies)}::varchar[], '{p.description}', {n})" for n, p in enumerate(C.GENERIC))
CATALOG = f"c as (select name, confidence::double as confidence, entity_type, source, jurisdiction, court_level, pattern_type, examples, dependencies, description, rank from (values {_ROWS}) t(name, confidence, entity_type, source, jurisdiction, court_level, pattern_type, examples, dependencies, description, rank))"


@query(f"with {CATALOG} select name, {_PRIORITY} as priority, confidence, rank from c where confidence >= 0.7 and jurisdiction in ('federal', 'all') and court_level in ('supreme', '')")
def catalog_applicable(spark, d):
    return C.applicable(C.frame(spark), "federal", "supreme").select("name", "priority", "confidence", "rank")


@query(f"with {CATALOG} select entity_type, count(*) as patterns, round(avg(confidence), 3) as mean, count(distinct source) as sources, string_agg(distinct jurisdiction, ',' order by jurisdiction) as jurisdictions, min(name) as first_name from c group by 1")
def catalog_types(spark, d):
    return C.frame(spark).groupBy("entity_type").agg(F.count("*").alias("patterns"), F.round(F.avg("confidence"), 3).alias("mean"), F.countDistinct("source").alias("sources"), F.array_join(F.sort_array(F.collect_set("jurisdiction")), ",").alias("jurisdictions"), F.min("name").alias("first_name"))


@query(f"with {CATALOG} select count(*) as patterns, count(distinct pattern_type) as groups, count(distinct entity_type) as types, count_if(confidence < 0.5)::bigint as b0, count_if(confidence >= 0.5 and confidence < 0.7)::bigint as b5, count_if(confidence >= 0.7 and confidence < 0.8)::bigint as b7, count_if(confidence >= 0.8 and confidence < 0.9)::bigint as b8, count_if(confidence >= 0.9)::bigint as b9, count_if(len(dependencies) > 0)::bigint as with_dependencies from c")
def catalog_statistics(spark, d):
    c = F.col("confidence")
    return C.frame(spark).agg(F.count("*").alias("patterns"), F.countDistinct("pattern_type").alias("groups"), F.countDistinct("entity_type").alias("types"), F.count_if(c < 0.5).alias("b0"), F.count_if((c >= 0.5) & (c < 0.7)).alias("b5"), F.count_if((c >= 0.7) & (c < 0.8)).alias("b7"), F.count_if((c >= 0.8) & (c < 0.9)).alias("b8"), F.count_if(c >= 0.9).alias("b9"), F.count_if(F.size("dependencies") > 0).alias("with_dependencies"))


@query(f"with {CATALOG}, x as (select name, unnest(dependencies) as dep from c) select name, dep as missing from x where dep not in (select name from c)")
def catalog_missing_dependencies(spark, d):
    c = C.frame(spark)
    return c.select("name", F.explode("dependencies").alias("missing")).join(c.select(F.col("name").alias("missing")), "missing", "left_anti").select("name", "missing")


@query(f"with {CATALOG}, x as (select entity_type, rank, unnest(examples) as example from c) select entity_type, example, min(rank) as rank from x group by 1, 2")
def catalog_examples(spark, d):
    return C.frame(spark).select("entity_type", "rank", F.explode("examples").alias("example")).groupBy("entity_type", "example").agg(F.min("rank").alias("rank"))


@query(f"with {CATALOG} select name, entity_type, confidence from c where (contains(lower(name), 'license') or contains(lower(description), 'license') or len(list_filter(examples, lambda x: contains(lower(x), 'license'))) > 0) and confidence >= 0.7")
def catalog_search(spark, d):
    hit = lambda x: F.contains(F.lower(x), F.lit("license"))
    return C.frame(spark).filter((hit(F.col("name")) | hit(F.col("description")) | F.exists("examples", hit)) & (F.col("confidence") >= 0.7)).select("name", "entity_type", "confidence")


@query(f"with {CATALOG}, t as (select distinct entity_type from (values ('PARTY'), ('COURT'), ('DATE'), ('STATUTE_CITATION'), ('MONEY')) v(entity_type)) select entity_type from t where entity_type not in (select entity_type from c)")
def catalog_unpatterned(spark, d):
    types = spark.createDataFrame([(x,) for x in ("PARTY", "COURT", "DATE", "STATUTE_CITATION", "MONEY")], "entity_type string")
    return types.join(C.frame(spark), "entity_type", "left_anti")


@query(f"with {CATALOG} select name, case when contains(lower(name), 'citation') then 'citation' when contains(lower(name), 'justice') or contains(lower(name), 'judge') then 'judge' when contains(lower(name), 'court') then 'court' when contains(lower(name), 'procedural') then 'procedural' when contains(lower(name), 'constitutional') then 'constitutional' else 'general' end as name_class, {_PRIORITY} as priority from c")
def catalog_classes(spark, d):
    return C.frame(spark).select("name", C.name_class(F.col("name")).alias("name_class"), C.priority(F.col("name")).alias("priority"))

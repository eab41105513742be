"""Whole extractions by strategy, waves, chunks and pages, with relations by indicators; models plug in as scorers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import spans
from ..operators import chunking, matching, relations, resolving
from .candidates import _LEGAL, _docs
from .chunks import pages_sql
from .documents import _PLAIN, EDGE, _route_sql
from .mentions import _ISLAND, _PRIORITY, _REACH, MENTIONS, found
from .pipelines import extract
from .registry import query, table
from .relations import _NEAR
from .smart import spans_sql

# --- strategies ---

_USABLE = f"m0 as (select m.* from m join documents using (doc_id) where {EDGE.replace('text', 'documents.text')} is null)"
_UNION = "fu as (select * exclude (r) from (select *, row_number() over (partition by doc_id, entity_type, text, start, stop order by rank) as r from m0) where r = 1)"
_REACHED = _REACH.replace(" from m)", " from m0)")
_WEIGHTED = f"{_REACHED}, fu as (select doc_id, name, entity_type, case when several then 'fusion' else source end as source, rank, start, stop, text, case when several then least(0.99::double, confidence * 1.1::double) else confidence end as confidence from f where r = 1)"
_BOTH = f"{_REACHED}, fu as (select doc_id, name, entity_type, 'fusion' as source, rank, start, stop, text, confidence from f where r = 1 and several)"
_ISLANDS = _ISLAND.replace(" from m window", " from fu window")
_RULES = {
    "highest_confidence": "(select *, row_number() over (partition by doc_id, island order by confidence desc, start, stop, rank) as r from i) where r = 1",
    "pattern_priority": f"(select *, row_number() over (partition by doc_id, island order by {_PRIORITY} desc, start, stop, rank) as r from i) where r = 1",
    "merge": "(select *, row_number() over (partition by doc_id, island order by confidence desc, start, stop, rank) as r, count(*) over (partition by doc_id, island) as n from i) where r = 1 and (n = 1 or confidence >= 0.8)",
}


def _extract_sql(fusion: str, rule: str, floor: float) -> str:
    """CTE ff: the mentions that a strategy keeps."""
    return f"{MENTIONS}, {_USABLE}, {fusion}, {_ISLANDS}, ff as (select * from {_RULES[rule]} and confidence >= {floor})"


_STRATEGIES = {"regex": (_UNION, "pattern_priority", 0.0), "multipass": (_UNION, "highest_confidence", 0.7), "ai_enhanced": (_WEIGHTED, "merge", 0.55), "intersection": (_BOTH, "highest_confidence", 0.0)}
for _name, _parts in _STRATEGIES.items():
    query(f"with {_extract_sql(*_parts)} select doc_id, entity_type, count(*) as n, round(avg(confidence), 9) as mean, min(start) as first from ff group by 1, 2", f"extract_{_name}")(
        lambda spark, d, _name=_name: extract(table(spark, d, "documents").select("doc_id", "text"), _name)["mentions"].groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("mean"), F.min("start").alias("first")))

UNIFIED_SQL = f"""with {_extract_sql(_WEIGHTED, 'highest_confidence', 0.6)}, mm as (select doc_id, count(*) as mentions, round(avg(confidence), 9) as mean from ff group by 1), ee as (select doc_id, count(distinct (lower(trim(text)), entity_type)) as entities from ff group by 1),
{_NEAR.replace("from m a join m b", "from ff a join ff b")}, rr as (select doc_id, count(*) as relations from p where greatest(0.5, 1 - distance / 200) >= 0.6 group by 1),
routed as ({_route_sql(_PLAIN)} select doc_id, strategy from c)
select doc_id, strategy, coalesce(mentions, 0) as mentions, coalesce(entities, 0) as entities, coalesce(relations, 0) as relations, mean from routed left join mm using (doc_id) left join ee using (doc_id) left join rr using (doc_id)"""


# --- waves and passes ---

_WAVES = "wv as (select *, case when rank <= 3 then 1 when rank <= 6 then 2 else 3 end as wave from m), fw as (select *, min(wave) over (partition by doc_id, entity_type, lower(trim(text))) as first_wave from wv), kept as (select * exclude (r) from (select *, row_number() over (partition by doc_id, entity_type, lower(trim(text)) order by wave, rank, start) as r from wv) where r = 1)"


def waves(spark, d, to: int = 3):
    """Mentions of the first waves of patterns; what an earlier wave found, a later one doesn't add."""
    wave = F.when(F.col("rank") <= 3, 1).when(F.col("rank") <= 6, 2).otherwise(3)
    rows = found(spark, d).withColumn("wave", wave).filter(F.col("wave") <= to)
    w = Window.partitionBy("doc_id", "entity_type", T.key(F.col("text"))).orderBy("wave", "rank", "start")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


@query(f"with {MENTIONS}, {_WAVES} select doc_id, count(*) as entities, count_if(wave = 1)::bigint as wave1, count_if(wave = 2)::bigint as wave2, count_if(wave = 3)::bigint as wave3 from kept group by 1")
def extract_three_wave(spark, d):
    n = lambda k: F.count_if(F.col("wave") == k).alias(f"wave{k}")
    return waves(spark, d).groupBy("doc_id").agg(F.count("*").alias("entities"), n(1), n(2), n(3))


_FOUR = f"{_NEAR.replace('from m a join m b', 'from kept a join kept b')}"


@query(f"with {MENTIONS}, {_WAVES}, {_FOUR}, e as (select doc_id, a_rank, b_rank, coalesce(r.relation, s.relation, 'RELATED_TO') as relation from p left join rules r on r.x = a_type and r.y = b_type left join rules s on s.x = b_type and s.y = a_type where greatest(0.5, 1 - distance / 200) >= 0.6) select doc_id, relation, count(*) as n from e group by 1, 2")
def extract_four_wave(spark, d):
    """The relations that a fourth wave draws between the entities of the first three."""
    rows = waves(spark, d).select("doc_id", "rank", "start", "stop", "entity_type")
    return relations.proximity(rows).filter("confidence >= 0.6").groupBy("doc_id", "relation").agg(F.count("*").alias("n"))


@query(f"with {MENTIONS}, {_WAVES} select doc_id, count(*) as entities, round(avg(confidence), 9) as mean from kept where wave = 1 group by 1")
def extract_single_pass(spark, d):
    return waves(spark, d, 1).groupBy("doc_id").agg(F.count("*").alias("entities"), F.round(F.avg("confidence"), 9).alias("mean"))


@query(f"with {MENTIONS}, p as (select *, rank % 8 + 1 as pass from m), q as (select * from p where confidence >= case when pass <= 3 then 0.3 when pass <= 5 then 0.5 else 0.7 end), g as (select doc_id, entity_type, lower(trim(text)) as key, min(pass) as pass, max(confidence) as confidence, count(distinct pass) as passes from q group by 1, 2, 3) select doc_id, pass, count(*) as n, sum(passes)::bigint as seen, round(avg(confidence), 9) as mean from g group by 1, 2")
def extract_passes(spark, d):
    """Eight passes side by side, each with its threshold, then one list: the pass that found each entity first."""
    p = resolving.strategy_filter(found(spark, d).withColumn("pass", F.col("rank") % 8 + 1), "multipass")
    g = p.groupBy("doc_id", "entity_type", T.key(F.col("text")).alias("key")).agg(F.min("pass").alias("pass"), F.max("confidence").alias("confidence"), F.countDistinct("pass").alias("passes"))
    return g.groupBy("doc_id", "pass").agg(F.count("*").alias("n"), F.sum("passes").alias("seen"), F.round(F.avg("confidence"), 9).alias("mean"))


# --- chunks and pages ---

CHUNKED_SQL = f"""with documents as (select doc_id * 100000 + k as doc_id, substr(text, k * 1800 + 1, 2000) as text from (select doc_id, text, unnest(range(0, (case when length(text) <= 2000 then 0 else ceil((length(text) - 2000) / 1800.0) end)::bigint + 1)) as k from main.documents where length(text) > 0)), {MENTIONS},
v as (select doc_id // 100000 as doc_id, entity_type, rank, confidence, text, start + (doc_id % 100000) * 1800 as start, stop + (doc_id % 100000) * 1800 as stop from m), x as (select *, row_number() over (partition by doc_id, entity_type, text, start order by confidence desc, rank) as r from v) select doc_id, count(*) as n, min(start)::int as first, max(stop)::int as last from x where r = 1 group by 1"""


@query(f"""with pg as ({pages_sql(300, 300)}), ps as (select *, (sum(length(content) + 2) over (partition by doc_id order by page) - length(content) - 2) as pos from pg), documents as (select doc_id * 100000 + page as doc_id, content as text from ps), {MENTIONS},
s as (select ps.doc_id, ps.page, rank, entity_type, start + pos as start, stop + pos as stop from m join ps on m.doc_id = ps.doc_id * 100000 + ps.page) select doc_id, (page - 1) // 3 as batch, count(*) as n, count(distinct page) as pages, min(start)::int as first, max(stop)::int as last from s group by 1, 2""")
def extract_pages(spark, d):
    """Mentions of pages, in batches of three, at their places in the pages' joined text."""
    pages = chunking.pages(table(spark, d, "documents"), (300, 300))
    n = F.length("content") + 2
    pages = pages.withColumn("pos", F.sum(n).over(Window.partitionBy("doc_id").orderBy("page")) - n)
    keyed = pages.select(F.struct("doc_id", "page", "pos").alias("doc_id"), F.col("content").alias("text"))
    rows = matching.mentions(keyed, most=None).select("doc_id.*", "start", "stop")
    at = F.col("pos")
    return rows.groupBy("doc_id", F.floor((F.col("page") - 1) / 3).alias("batch")).agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.min(F.col("start") + at).cast("int").alias("first"), F.max(F.col("stop") + at).cast("int").alias("last"))


# --- relations by indicators ---

_INDICATOR = r"[^.!?]{0,80}(?:filed|held under|clear and convincing|License)[^.!?]{0,80}"
_INSIDE = f"sp as (select doc_id, i as span_id, start as s_start, stop as s_stop from ({spans_sql(_INDICATOR)})), ins as (select sp.doc_id, span_id, m.rank, m.entity_type, m.start, m.stop, m.text from sp join m on sp.doc_id = m.doc_id and m.start >= s_start and m.stop <= s_stop)"
_SUBJECT, _OBJECT = ("JUDGE", "PARTY"), ("COURT", "PARTY", "STATUTE_CITATION", "CASE_CITATION")


def _inside(spark, d):
    docs = _docs(spark, d)
    s = docs.select("doc_id", F.posexplode(spans(F.col("text"), _INDICATOR)).alias("i", "s")).select("doc_id", (F.col("i") + 1).alias("span_id"), "s.start", "s.stop")
    return relations.contained(s, matching.mentions(docs, most=None).select("doc_id", "rank", "entity_type", "start", "stop", "text"))


@query(f"with {_LEGAL}, {MENTIONS}, {_INSIDE} select doc_id, span_id, count(*) as n, count(distinct entity_type) as types, min(start) as first from ins group by 1, 2")
def relation_indicators(spark, d):
    """Mentions inside the spans of words that tell of a relation."""
    return _inside(spark, d).groupBy("doc_id", "span_id").agg(F.count("*").alias("n"), F.countDistinct("entity_type").alias("types"), F.min("start").alias("first"))


_FIRST = f"""su as (select doc_id, span_id, arg_min(struct_pack(start := start, stop := stop, rank := rank, text := text), (start, stop, rank, text)) filter (where entity_type in {_SUBJECT}) as s, arg_min(struct_pack(start := start, stop := stop, rank := rank, text := text), (start, stop, rank, text)) filter (where entity_type in {_OBJECT}) as o from ins group by 1, 2), fp as (select * from su where s is not null and o is not null and s <> o)"""


@query(f"with {_LEGAL}, {MENTIONS}, {_INSIDE}, {_FIRST} select doc_id, span_id, s.text as src, o.text as tgt, 'INDICATED' as relation, 0.8::double as confidence, false as reverse from fp union all select doc_id, span_id, o.text, s.text, 'INDICATED', round(0.8::double * 0.9, 6), true from fp")
def relation_first_pairs(spark, d):
    """The first subject and the first object of each span, and the way back at .9 of the confidence."""
    pairs = relations.first_pair(_inside(spark, d), list(_SUBJECT), list(_OBJECT))
    edges = pairs.select("doc_id", "span_id", F.col("subject.text").alias("src"), F.col("object.text").alias("tgt"), F.lit("INDICATED").alias("relation"), F.lit(0.8).alias("confidence"))
    return relations.with_reverse(edges).withColumn("confidence", F.round("confidence", 6))


@query(f"with {_LEGAL}, {MENTIONS}, {_INSIDE}, {_FIRST}, {_NEAR}, a as (select doc_id, 'pattern' as method, count(*) as n from fp group by 1 union all select doc_id, 'proximity', count(*) from p where greatest(0.5, 1 - distance / 200) >= 0.6 group by 1) select doc_id, method, n from a")
def relation_all(spark, d):
    """Relations by indicators and by proximity, those that are sure enough."""
    docs = _docs(spark, d)
    a = relations.first_pair(_inside(spark, d), list(_SUBJECT), list(_OBJECT)).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("pattern").alias("method"), "n")
    near = relations.proximity(matching.mentions(docs, most=None).select("doc_id", "rank", "entity_type", "start", "stop")).filter("confidence >= 0.6")
    return a.union(near.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("proximity"), "n"))


@query(f"with {MENTIONS}, {_NEAR}, e as (select doc_id, a_rank, b_rank, a_start, b_start, coalesce(r.relation, s.relation, 'RELATED_TO') as relation, round(greatest(0.5, 1 - distance / 200), 6)::double as confidence from p left join rules r on r.x = a_type and r.y = b_type left join rules s on s.x = b_type and s.y = a_type), k as (select *, row_number() over (partition by doc_id order by confidence desc, a_start, a_rank, b_start, b_rank) as k from e where confidence >= 0.7 and relation = 'RELATED_TO') select doc_id, a_rank, a_start, b_rank, b_start, confidence, k from k where k <= 10")
def relation_requested(spark, d):
    """The ten surest relations of a type that a request may have of a document."""
    e = relations.proximity(found(spark, d).select("doc_id", "rank", "start", "stop", "entity_type")).withColumn("confidence", F.round("confidence", 6))
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "a_start", "a_rank", "b_start", "b_rank")
    return e.filter("confidence >= 0.7 and relation = 'RELATED_TO'").withColumn("k", F.row_number().over(w)).filter("k <= 10").select("doc_id", "a_rank", "a_start", "b_rank", "b_start", "confidence", "k")


# --- attributes of merged entities ---


@query("""with t as (select c_custkey as id, case when c_custkey % 3 = 0 then null else c_mktsegment end as court, [c_name, 'N' || c_nationkey] as names, map_from_entries([('seg', c_mktsegment), ('bal', 'pos')]) as more from customer), s as (select s_suppkey as id, 'S' || s_nationkey as court, [s_name, 'N' || s_nationkey] as names, map_from_entries([('bal', 'neg'), ('sup', s_name)]) as more from supplier)
select t.id, coalesce(t.court, s.court) as court, array_to_string(list_sort(list_distinct(list_concat(t.names, s.names))), ',') as names, t.more['seg'] as seg, s.more['bal'] as bal, s.more['sup'] as sup, t.court is not null and t.court <> s.court as conflict from t join s using (id)""")
def attributes_merged(spark, d):
    """Attributes of two records of an entity: the target's where it has any, all names, and the source's additions over the target's."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    lit = F.lit
    target = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("court"), F.array("c_name", F.concat(lit("N"), "c_nationkey")).alias("names"), F.create_map(lit("seg"), F.col("c_mktsegment"), lit("bal"), lit("pos")).alias("more"))
    source = s.select(F.col("s_suppkey").alias("id"), F.concat(lit("S"), "s_nationkey").alias("court"), F.array("s_name", F.concat(lit("N"), "s_nationkey")).alias("names"), F.create_map(lit("bal"), lit("neg"), lit("sup"), F.col("s_name")).alias("more"))
    m = relations.merged_attributes(target, source)
    return m.select("id", "court", F.array_join("names", ",").alias("names"), F.col("more")["seg"].alias("seg"), F.col("more")["bal"].alias("bal"), F.col("more")["sup"].alias("sup"), "conflict")

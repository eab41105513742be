"""Scores of mentions and chunks, contexts, and catalogs of relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import context as X
from ..functions import scoring as S
from ..operators import chunking
from .chunks import WINDOWS, windows
from .mentions import MENTIONS, found
from .registry import query, table

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::varchar[]"


@query(f"with {MENTIONS}, s as (select *, ['multipass', 'ai_enhanced', 'unified', 'default'][rank % 4 + 1] as strategy, (start % 9)::int as pass from m) select doc_id, rank, start, strategy, pass, round(case when strategy = 'multipass' and pass > 0 then least(0.3::double + 0.1::double * pass, 0.95::double) when strategy = 'multipass' then greatest(confidence, 0.65) when strategy = 'ai_enhanced' then 0.3::double * 0.5 + 0.3::double * 0.9 + 0.4::double * confidence when strategy = 'unified' then greatest(confidence, 0.65) else greatest(confidence, 0.8) end, 8)::double as score from s")
def score_strategy(spark, d):
    m = found(spark, d).withColumns({"strategy": F.element_at(F.array(*map(F.lit, ("multipass", "ai_enhanced", "unified", "default"))), F.col("rank") % 4 + 1), "pass": F.col("start") % 9})
    return m.select("doc_id", "rank", "start", "strategy", "pass", F.round(S.strategy_confidence(F.col("strategy"), F.col("confidence"), F.col("pass"), F.lit(0.5), F.lit(0.9)), 8).alias("score"))


_PLACED = "least(1.0::double, c * case when start < length(t) * 0.1::double or stop > length(t) * 0.9::double then 0.95::double else 1 end * case when regexp_matches(substr(t, stop + 1, 1), '[.,;:!?]') then 1.05::double else 1 end)"


@query(f"with {MENTIONS}, j as (select m.doc_id, rank, start, stop, m.text, d.text as t, case when confidence = 0 then 0.8 else confidence end as c from m join documents d using (doc_id)) select doc_id, rank, start, round({_PLACED}, 8) as placed, round(least(1.0::double, case rank when 0 then 0.5::double else 0.8::double end * case when len(string_split_regex(trim(text), '\\s+')) = 1 then 0.9::double when len(string_split_regex(trim(text), '\\s+')) > 4 then 0.85::double else 1 end * case when regexp_matches(text, '[A-Z]') then 1 else 0.8::double end * case when lower(trim(text)) in ('the','this','that','and','court','section') then 0.5::double else 1 end), 8)::double as candidate from j")
def score_place(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))
    m = found(spark, d).join(docs, "doc_id")
    c = S.default_confidence(F.col("confidence"), F.col("source"))
    kind = F.when(F.col("rank") == 0, "capitalized").otherwise("court")
    return m.select("doc_id", "rank", "start", F.round(S.by_place(c, F.col("start"), F.col("stop"), F.col("t")), 8).alias("placed"), F.round(S.candidate_confidence(kind, F.col("text")), 8).alias("candidate"))


@query(rf"with w as (select conv_id, turn, text, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from conversations) select conv_id, turn, round(case when least(5, len(w) // 10) = 0 then 0.5 else least(1.0, len(list_filter(w, lambda x: list_contains({_LIST(S.LEGAL_WORDS)}, x))) / least(5, len(w) // 10)) end, 6)::double as density, round(0.5::double + least(0.3::double, 0.1::double * (turn % 5)) + 0.1::double, 6) as by_keywords from w")
def score_density(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(S.legal_density(F.col("text")), 6).alias("density"), F.round(S.context_confidence(F.col("turn") % 5), 6).alias("by_keywords"))


_COMPLETE = r"(1.0::double - case when regexp_matches(trim(content), '^[A-Z]') then 0 else 0.3::double end - case when regexp_matches(trim(content), '[.!?]\z') then 0 else 0.2::double end - case when length(trim(content)) < 50 then 0.2::double else 0 end)"
_SIZED = "case when length(content) / 400 between 0.8 and 1.2 then 1.0 when length(content) / 400 between 0.5 and 1.5 then 0.7 when length(content) / 400 between 0.3 and 2.0 then 0.4 else 0.1 end::double"


@query(f"with {WINDOWS}, {MENTIONS}, k as (select w.doc_id, w.chunk, any_value(w.content) as content, coalesce(sum(length(m.text)), 0) as e from w left join m on m.doc_id = w.doc_id and m.start >= w.start and m.stop <= w.stop group by 1, 2), z as (select *, case when e = 0 then 0.3 when e / length(content) < 0.05 then 0.6 when e / length(content) <= 0.3 then 1.0 when e / length(content) <= 0.5 then 0.7 else 0.4 end::double as dense from k) select doc_id, chunk, e::bigint as entity_chars, round(0.25::double * {_COMPLETE} + 0.25::double * 1.0 + 0.2::double * dense + 0.2::double * 0.5 + 0.1::double * {_SIZED}, 6) as score from z")
def score_chunks(spark, d):
    from ..operators.relations import contained

    w = windows(spark, d)
    inside = contained(w.withColumn("span_id", F.col("chunk")), found(spark, d)).groupBy("doc_id", F.col("span_id").alias("chunk")).agg(F.sum(F.length("text")).alias("e"))
    k = w.join(inside, ["doc_id", "chunk"], "left").withColumn("e", F.coalesce("e", F.lit(0)))
    score = S.chunk_score(S.completeness(F.col("content")), F.lit(1.0), S.density_score(F.col("e"), F.length("content")), F.lit(0.5), chunking.size_score(F.length("content"), 400))
    return k.select("doc_id", "chunk", F.col("e").alias("entity_chars"), F.round(score, 6).alias("score"))


_MAP = ", ".join(f"('{t}', '{p}', {_LIST(s)}, {_LIST(i)}, {_LIST(n)}, {_LIST(h)}, {b})" for t, p, s, i, n, h, b in X.MAPPINGS)
_MAPPED = f"x as (select * from (values {_MAP}) t(entity_type, primary_context, secondary, indicators, near, headers, boost))"


@query(f"with {_MAPPED} select doc_id, entity_type, score, k from (select *, row_number() over (partition by doc_id order by score desc, entity_type) as k from (select doc_id, entity_type, (len(list_filter(indicators, lambda w: contains(low, w))) + 0.5 * len(list_filter(near, lambda w: contains(low, w))) + 2.0 * len(list_filter(headers, lambda w: contains(low, w))))::double as score from (select doc_id, lower(text) as low from documents), x) where score > 0) where k <= 5")
def context_suggestions(spark, d):
    return X.suggestions(table(spark, d, "documents"), X.mappings(spark))


@query(f"with {_MAPPED} select entity_type, primary_context, boost::double as boost from x where primary_context = 'case_context' or list_contains(secondary, 'case_context')")
def context_types(spark, d):
    return X.in_context(X.mappings(spark), "case_context").select("entity_type", "primary_context", "boost")


_CATEGORY = "case " + " ".join(f"when {' or '.join(f'contains(upper(entity_type), {chr(39)}{p}{chr(39)})' for p in parts)} then '{n}'" for n, parts in X.CATEGORIES) + " else 'other' end"


@query(f"with {MENTIONS} select {_CATEGORY} as category, entity_type, count(*) as n from m group by 1, 2")
def mention_categories(spark, d):
    return found(spark, d).groupBy(X.category(F.col("entity_type")).alias("category"), "entity_type").agg(F.count("*").alias("n"))


@query(rf"with {MENTIONS}, s as (select doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*\s*') as w, string_split_regex(text, '[^.!?]+[.!?]*\s*') as p from documents), t as (select doc_id, w, list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)) as b from s), j as (select m.doc_id, m.rank, m.start, w, len(list_filter(b, lambda x: x <= m.start)) as pos from m join t using (doc_id)) select doc_id, rank, start, pos::int as sentence, md5(array_to_string(w[greatest(pos - 1, 1):pos + 1], '')) as win from j")
def context_sentences(spark, d):
    return X.sentence_windows(found(spark, d), table(spark, d, "documents")).select("doc_id", "rank", "start", "sentence", F.md5("window").alias("win"))


# --- relation catalog ---

RELATIONS = tuple((a, b, t, "litigation" if t in ("SUES", "REPRESENTS") else "structure", 0.9 if t == "SUES" else 0.8, t == "ASSOCIATED_WITH") for a, b, t in __import__("caseloom.operators.relations", fromlist=["TYPE_RULES"]).TYPE_RULES)
_REL = "r as (select source, target, relation, category, confidence::double as confidence, bidirectional from (values " + ", ".join(f"('{a}', '{b}', '{t}', '{c}', {f}, {str(x).lower()})" for a, b, t, c, f, x in RELATIONS) + ") t(source, target, relation, category, confidence, bidirectional))"


def relation_catalog(spark):
    return spark.createDataFrame(list(RELATIONS), "source string, target string, relation string, category string, confidence double, bidirectional boolean")


@query(f"with {_REL} select category, count(*) as n, string_agg(distinct relation, ',' order by relation) as types, count_if(bidirectional)::bigint as bidirectional, round(avg(confidence), 3) as mean from r group by 1")
def relation_catalog_categories(spark, d):
    return relation_catalog(spark).groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("types"), F.count_if("bidirectional").alias("bidirectional"), F.round(F.avg("confidence"), 3).alias("mean"))


@query(f"with {_REL}, s as (select source as entity, 1 as s, 0 as t from r union all select target, 0, 1 from r) select entity, sum(s)::bigint as as_source, sum(t)::bigint as as_target, row_number() over (order by count(*) desc, entity) as k from s group by 1 order by k limit 10")
def relation_catalog_top(spark, d):
    from pyspark.sql import Window

    from ..operators.relations import participation

    p = participation(relation_catalog(spark).select(F.col("source").alias("src"), F.col("target").alias("tgt")))
    ranked = p.withColumn("k", F.row_number().over(Window.orderBy(F.desc("total"), "id")))
    return ranked.filter("k <= 10").select(F.col("id").alias("entity"), "as_source", "as_target", "k")


@query(f"with {_REL} select source, target, relation from r where confidence >= 0.85 or bidirectional or (source in ('ATTORNEY', 'COURT') and target in ('CASE', 'DEFENDANT'))")
def relation_catalog_filter(spark, d):
    return relation_catalog(spark).filter((F.col("confidence") >= 0.85) | F.col("bidirectional") | (F.col("source").isin("ATTORNEY", "COURT") & F.col("target").isin("CASE", "DEFENDANT"))).select("source", "target", "relation")


@query("with a as (select count(*) as n, round(sum(n_chars) / 4) as t from documents) select 'total' as what, n::bigint as value from a union all select 'tokens', t::bigint from a union all select 'langs', count(distinct lang) from documents union all select 'sources', count(distinct source) from documents")
def store_statistics(spark, d):
    a = table(spark, d, "documents").agg(F.count("*").alias("total"), F.round(F.sum("n_chars") / 4).cast("long").alias("tokens"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"))
    return a.unpivot([], ["total", "tokens", "langs", "sources"], "what", "value")



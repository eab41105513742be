"""Search layers, kinds of boundaries, contexts of entities, and tables of choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import layers as L
from ..operators import similar
from .chunks import WINDOWS, windows
from .mentions import MENTIONS, found
from .metrics import LOG, log
from .registry import query, table

_CITE = r"regexp_replace(regexp_replace(regexp_replace(text, '(\d+)\s+USC\s+§?\s*(\d+)', '\1 U.S.C. § \2', 'g'), '(\d+)\s+CFR\s+§?\s*(\d+)', '\1 C.F.R. § \2', 'g'), '(?:Section|Sec\.?)\s+(\d+)', '§ \1', 'g')"


@query(rf"select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_CITE}, '\s+', ' ', 'g'), '[^0-9A-Za-z\x{{80}}-\x{{10FFFF}} .,;:!?()''\"$%/@&-]', '', 'g'), '([.,;:!?])[.,;:!?]+', '\1', 'g'), ' +', ' ', 'g'))) as cleaned from documents")
def layer_cleaned(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(L.cleaned(F.col("text"))).alias("cleaned"))


_SYN = "list_sort(list_distinct(list_concat(" + ", ".join(f"case when contains(low, '{k}') then {list(v)}::varchar[] else []::varchar[] end" for k, v in L.SYNONYMS.items()) + ")))"


@query(f"select conv_id, turn, array_to_string({_SYN}, ',') as synonyms, md5(concat_ws(' ', role, array_to_string({_SYN}, ' '), low)) as layer from (select conv_id, turn, role, lower(text) as low from conversations)")
def layer_search(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(L.synonyms(F.col("text")), ",").alias("synonyms"), F.md5(L.search_layer(F.col("text"), F.col("role"))).alias("layer"))


@query(r"select doc_id, trim(coalesce(regexp_extract(text, '(?m)^((?:[IVX]+\.|[A-Z]\.|\d+\.)\s+[^\n]{1,80}|[A-Z][A-Z ]{3,60})$', 1), '')) as section from documents")
def layer_section(spark, d):
    return table(spark, d, "documents").select("doc_id", L.section(F.col("text")).alias("section"))


@query(rf"with {WINDOWS}, n as (select doc_id, chunk, content, coalesce(lead(content) over (partition by doc_id order by chunk), '') as after from w) select doc_id, chunk, case when after = '' then 'document_end' when ends_with(content, chr(10) || chr(10)) or starts_with(after, chr(10) || chr(10)) then 'paragraph' when regexp_matches(content, '[.!?]\s*\z') then 'sentence' when regexp_matches(after, '\A\s*(?:[IVX]+\.|\d+\.)\s') then 'section' else 'word' end as kind from n")
def layer_boundaries(spark, d):
    after = F.coalesce(F.lead("content").over(Window.partitionBy("doc_id").orderBy("chunk")), F.lit(""))
    return windows(spark, d).withColumn("after", after).select("doc_id", "chunk", L.boundary_kind(F.col("content"), F.col("after")).alias("kind"))


@query(rf"with {MENTIONS} select doc_id, rank, start, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '\s*([.,§])\s*', '\1', 'g'), '(?i)section', '§', 'g'), '\s+', ' ', 'g'))) as key from m where name like '%citation%'")
def citation_keys(spark, d):
    return found(spark, d).filter("name like '%citation%'").select("doc_id", "rank", "start", L.citation_key(F.col("text")).alias("key"))


@query(f"with {MENTIONS} select a.doc_id, a.rank as e_rank, a.start as e_start, b.rank as c_rank, b.start as c_start, abs(a.start - b.start) as distance from m a join m b on a.doc_id = b.doc_id and a.name not like '%citation%' and b.name like '%citation%' and a.start // 1000 = b.start // 1000 and abs(a.start - b.start) < 200")
def entity_citations(spark, d):
    m = found(spark, d).withColumn("chunk", F.floor(F.col("start") / 1000))
    e = m.filter("name not like '%citation%'").select("doc_id", "chunk", F.col("rank").alias("e_rank"), F.col("start").alias("e_start"))
    c = m.filter("name like '%citation%'").select("doc_id", "chunk", F.col("rank").alias("c_rank"), F.col("start").alias("c_start"))
    return e.join(c, ["doc_id", "chunk"]).withColumn("distance", F.abs(F.col("e_start") - F.col("c_start"))).filter("distance < 200").drop("chunk")


@query(f"with {MENTIONS}, e as (select doc_id, entity_type, lower(trim(text)) as key, count(*) as occurrences, min(start) as first_start from m group by 1, 2, 3), o as (select doc_id, count(*) as others from e group by 1) select e.doc_id, entity_type, key, occurrences, others - 1 as others, trim(regexp_replace(substr(d.text, greatest(first_start - 40, 0) + 1, first_start + 40 - greatest(first_start - 40, 0)), '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g')) as context from e join o using (doc_id) join documents d using (doc_id) where occurrences > 1")
def entity_contexts(spark, d):
    from ..functions.spans import collapsed, window

    e = found(spark, d).groupBy("doc_id", "entity_type", F.lower(F.trim("text")).alias("key")).agg(F.count("*").alias("occurrences"), F.min("start").alias("first_start"))
    others = F.count("*").over(Window.partitionBy("doc_id")) - 1
    docs = table(spark, d, "documents").select("doc_id", "text")
    return e.withColumn("others", others).filter("occurrences > 1").join(docs, "doc_id").select("doc_id", "entity_type", "key", "occurrences", "others", collapsed(window(F.col("text"), F.col("first_start"), F.col("first_start"), 40, 40)).alias("context"))


@query(r"with b as (select item_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as w from benchmark), c as (select conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as w from conversations), s as (select conv_id, turn, item_id, len(list_intersect(c.w, b.w)) / len(list_distinct(list_concat(c.w, b.w))) as s from c, b where len(c.w) > 0 and len(b.w) > 0) select conv_id, turn, item_id, round(s, 6)::double as similarity from (select *, row_number() over (partition by conv_id, turn order by s desc, item_id) as k from s where s >= 0.05) where k = 1")
def phrase_types(spark, d):
    """The item most like each turn, by word sets."""
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    best = similar.most_alike(turns, table(spark, d, "benchmark").select(F.col("item_id").alias("other"), "text"), 0.05)
    return best.select("id.conv_id", "id.turn", F.col("other").alias("item_id"), F.round("similarity", 6).alias("similarity"))


@query(f"with {LOG} select event_id, user_id, round(ms, 6) as ms from (select *, row_number() over (order by ts desc, event_id desc) as k from log) where k <= 10")
def ops_latest(spark, d):
    return log(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "user_id", F.round("ms", 6).alias("ms"))


@query(f"with {LOG}, a as (select mode, avg(ms) as ms, (1 - count_if(success)::bigint / count(*)) * 100 as errors, sum(tokens) / greatest(epoch(max(ts)) - epoch(min(ts)), 1.0::double) as tps from log group by 1) select mode, array_to_string(list_filter([case when ms > 2000 then 'lower the batch size' when ms > 500 then 'raise the concurrency' end, case when errors > 5 then 'look at the failures' end, case when tps < 1 then 'keep the model busier' end], lambda x: x is not null), '; ') as advice from a")
def ops_recommendations(spark, d):
    span = F.greatest(F.max("ts").cast("double") - F.min("ts").cast("double"), F.lit(1.0))
    a = log(spark, d).groupBy("mode").agg(F.avg("ms").alias("ms"), ((1 - F.count_if("success") / F.count("*")) * 100).alias("errors"), (F.sum("tokens") / span).alias("tps"))
    return a.select("mode", F.array_join(L.recommendations({"ms": F.col("ms"), "errors": F.col("errors"), "tokens_per_second": F.col("tps")}), "; ").alias("advice"))


@query("select * from (values " + ", ".join(f"('strategy', '{k}', '{v}')" for k, v in L.DESCRIPTIONS.items()) + ", " + ", ".join(f"('pass', '{k}', '{v}')" for k, v in L.PASSES) + ", " + ", ".join(f"('label', '{k}', '{v}')" for k, v in L.LABELS.items()) + ", " + ", ".join(f"('generators', '{k}', '{' '.join(v)}')" for k, v in L.GENERATORS.items()) + ", ('threshold', 'very_small', '5000'), ('threshold', 'small', '50000'), ('threshold', 'medium', '150000')) t(kind, name, value)")
def choice_tables(spark, d):
    from ..operators import sizing

    rows = [("strategy", k, v) for k, v in L.DESCRIPTIONS.items()] + [("pass", str(k), v) for k, v in L.PASSES] + [("label", k, v) for k, v in L.LABELS.items()] + [("generators", k, " ".join(v)) for k, v in L.GENERATORS.items()]
    rows += [("threshold", k, str(v)) for k, v in (("very_small", sizing.VERY_SMALL), ("small", sizing.SMALL), ("medium", sizing.MEDIUM))]
    return spark.createDataFrame(rows, "kind string, name string, value string")

"""Results of extractions: selections, roll-ups, gaps, ratios, caches and stores, as a service reports them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, relations, resolving
from ..sources import stores as S
from .chunks import WINDOWS, windows
from .mentions import MENTIONS, found
from .metrics import LOG, log
from .registry import query, table
from .relations import EDGES, edges

_SPAN = "doc_id, rank, start, stop, text"
_CITED = "contains(lower(name), 'citation')"


def _cited():
    return F.contains(F.lower("name"), F.lit("citation"))


@query(f"with {MENTIONS} select {_SPAN} from m where entity_type = 'JUDGE' and not {_CITED}")
def result_entities_of_type(spark, d):
    return found(spark, d).filter((F.col("entity_type") == "JUDGE") & ~_cited()).select(*_SPAN.split(", "))


@query(f"with {MENTIONS} select {_SPAN} from m where entity_type = 'STATUTE_CITATION' and {_CITED}")
def result_citations_of_type(spark, d):
    return found(spark, d).filter((F.col("entity_type") == "STATUTE_CITATION") & _cited()).select(*_SPAN.split(", "))


_SURE = f"""with {MENTIONS}, {EDGES}, k as (select case when {_CITED} then 'citation' else 'entity' end as kind, entity_type as type, confidence from m union all select 'relationship', relation, confidence from e)
select kind, type, count(*) as n, round(min(confidence), 4) as least from k where confidence >= 0.8 group by 1, 2"""


@query(_SURE)
def result_high_confidence(spark, d):
    """Entities, citations and relationships of confidence .8 and more, each kind by itself."""
    kind = F.when(_cited(), "citation").otherwise("entity")
    items = found(spark, d).select(kind.alias("kind"), F.col("entity_type").alias("type"), "confidence")
    items = items.unionByName(edges(spark, d).select(F.lit("relationship").alias("kind"), F.col("relation").alias("type"), "confidence"))
    return items.filter("confidence >= 0.8").groupBy("kind", "type").agg(F.count("*").alias("n"), F.round(F.min("confidence"), 4).alias("least"))


@query(f"with {MENTIONS}, e as (select *, list_filter([case when source = 'model' then 'model' end, case when confidence > 0.9 then 'sure' end], lambda x: x is not null) as enhancements from m) select {_SPAN}, array_to_string(enhancements, ',') as enhancements from e where len(enhancements) > 0")
def result_enhanced(spark, d):
    """Mentions that a model found or made sure: those whose list of enhancements isn't empty."""
    marks = F.array_compact(F.array(F.when(F.col("source") == "model", "model"), F.when(F.col("confidence") > 0.9, "sure")))
    return found(spark, d).withColumn("enhancements", marks).filter(F.size("enhancements") > 0).select(*_SPAN.split(", "), F.array_join("enhancements", ",").alias("enhancements"))


@query(f"with {EDGES} select src, tgt, relation, round(confidence, 6) as confidence, o_orderkey, l_linenumber from e where relation = 'SUES' and confidence >= 0.98 and o_orderkey % 7 = 3")
def relation_filtered(spark, d):
    """Relationships of a type, sure enough, of some tests (here: orders)."""
    return edges(spark, d).filter((F.col("relation") == "SUES") & (F.col("confidence") >= 0.98) & (F.col("o_orderkey") % 7 == 3)).withColumn("confidence", F.round("confidence", 6))


@query(f"with {EDGES} select src, tgt, relation, round(confidence, 6) as confidence, o_orderkey, l_linenumber from (select *, row_number() over (partition by src, tgt, relation order by o_orderkey, l_linenumber, confidence) as r from e) where r = 1")
def relation_first(spark, d):
    """The first edge of each source, type and target."""
    w = Window.partitionBy("src", "relation", "tgt").orderBy("o_orderkey", "l_linenumber", "confidence")
    return edges(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r").withColumn("confidence", F.round("confidence", 6))


@query(f"with {MENTIONS} select doc_id, entity_type, count(*) as n, string_agg(start || ':' || rank, ',' order by start, rank) as places from m group by 1, 2")
def result_by_type(spark, d):
    """Each document's mentions by type, in order."""
    places = F.transform(F.sort_array(F.collect_list(F.struct("start", "rank"))), lambda x: F.concat_ws(":", x["start"], x["rank"]))
    return found(spark, d).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"), F.array_join(places, ",").alias("places"))


@query(f"with {MENTIONS}, g as (select doc_id, entity_type, lower(trim(text)) as key, count(*) as n from m group by 1, 2, 3) select doc_id, sum(n)::bigint as input, count(*) as output, (sum(n) - count(*))::bigint as duplicates, count(distinct key) as unique_groups from g group by 1")
def result_processing(spark, d):
    """What processing did to each document's mentions: how many came in, stayed and were duplicates."""
    g = found(spark, d).groupBy("doc_id", "entity_type", T.key(F.col("text")).alias("key")).agg(F.count("*").alias("n"))
    return g.groupBy("doc_id").agg(F.sum("n").alias("input"), F.count("*").alias("output"), (F.sum("n") - F.count("*")).alias("duplicates"), F.countDistinct("key").alias("unique_groups"))


_ACTIVE = f"with {MENTIONS}, a as (select doc_id, entity_type, lower(trim(text)) as key, count(*) as occurrences, max(confidence) as confidence from m group by 1, 2, 3)"


def _active(spark, d):
    return found(spark, d).groupBy("doc_id", "entity_type", T.key(F.col("text")).alias("key")).agg(F.count("*").alias("occurrences"), F.max("confidence").alias("confidence"))


@query(f"{_ACTIVE}, t as (select doc_id, entity_type, count(*) as n from a group by 1, 2), h as (select doc_id, string_agg(entity_type || '=' || n, ',' order by entity_type) as types from t group by 1) select doc_id, count(*) as entities, sum(occurrences)::bigint as occurrences, round(avg(confidence), 9) as mean, any_value(types) as types from a join h using (doc_id) group by 1")
def registry_statistics(spark, d):
    """Active entities of each document, their occurrences, mean confidence and types."""
    a = _active(spark, d)
    by_type = a.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"), F.sum("occurrences").alias("o"), F.sum("confidence").alias("c"))
    types = F.transform(F.sort_array(F.collect_list(F.struct("entity_type", "n"))), lambda x: F.concat_ws("=", x["entity_type"], x["n"]))
    return by_type.groupBy("doc_id").agg(F.sum("n").alias("entities"), F.sum("o").alias("occurrences"), F.round(F.sum("c") / F.sum("n"), 9).alias("mean"), F.array_join(types, ",").alias("types"))


@query(f"{_ACTIVE} select count(distinct doc_id) as documents, count(*) as entities, sum(occurrences)::bigint as occurrences, count(distinct (entity_type, key)) as across, round(count(*) / count(distinct doc_id), 6) as a_document from a")
def registry_global_statistics(spark, d):
    """Counters over all documents."""
    a = _active(spark, d)
    return a.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("entities"), F.sum("occurrences").alias("occurrences"), F.countDistinct("entity_type", "key").alias("across"), F.round(F.count("*") / F.countDistinct("doc_id"), 6).alias("a_document"))


@query(f"with {MENTIONS} select doc_id, round(coalesce(avg(coalesce(confidence, 0.5)) filter (where m.rank is not null), 0), 9) as confidence, count(m.rank) as n from documents left join m using (doc_id) group by 1")
def result_confidence(spark, d):
    """The mean confidence of each document's mentions, .5 for those without; 0 for documents without mentions."""
    own = found(spark, d).groupBy("doc_id").agg(F.avg(F.coalesce("confidence", F.lit(0.5))).alias("c"), F.count("*").alias("n"))
    return table(spark, d, "documents").select("doc_id").join(own, "doc_id", "left").select("doc_id", F.round(F.coalesce("c", F.lit(0.0)), 9).alias("confidence"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with {MENTIONS}, p as (select doc_id, start // 1000 as chunk, count(*) as n, count(distinct (entity_type, lower(trim(text)))) as kept from m group by 1, 2), t as (select doc_id, (length(text) // 4)::int as tokens from documents) select doc_id, count(chunk) as chunks, coalesce(max(n), 0) as most, any_value(tokens) as tokens, round(case when coalesce(sum(n), 0) = 0 then 1.0 else sum(kept) / sum(n) end, 6)::double as kept_ratio from t left join p using (doc_id) group by 1")
def result_chunked_ratio(spark, d):
    """Chunks with mentions of each document, its tokens, and the share of mentions that de-duplication in chunks keeps (1 for none)."""
    p = found(spark, d).groupBy("doc_id", F.floor(F.col("start") / 1000).alias("chunk")).agg(F.count("*").alias("n"), F.countDistinct("entity_type", T.key(F.col("text"))).alias("kept"))
    own = p.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("n").alias("most"), (F.sum("kept") / F.sum("n")).alias("r"))
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.length("text") / 4).cast("int").alias("tokens"))
    return docs.join(own, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("most", F.lit(0)).alias("most"), "tokens", F.round(F.coalesce("r", F.lit(1.0)), 6).alias("kept_ratio"))


@query(f"with {MENTIONS}, n as (select doc_id, count(*) as entities from m group by 1) select lang, round(avg(case when chars > 0 then tokens / chars end), 8) as tokens_a_char, round(avg(case when entities > 0 then tokens / entities end), 6) as tokens_an_entity, round(avg(case when entities > 0 then chars / entities end), 6) as chars_an_entity from (select lang, length(text) as chars, (length(text) // 4)::int as tokens, coalesce(entities, 0) as entities from documents left join n using (doc_id)) group by 1")
def result_token_efficiency(spark, d):
    """Means of tokens a character, tokens an entity and characters an entity, over documents where they exist."""
    n = found(spark, d).groupBy("doc_id").agg(F.count("*").alias("entities"))
    rows = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("chars"), F.floor(F.length("text") / 4).alias("tokens")).join(n, "doc_id", "left")
    per = lambda a, b: F.avg(F.when(F.col(b) > 0, F.col(a) / F.col(b)))
    return rows.groupBy("lang").agg(F.round(per("tokens", "chars"), 8).alias("tokens_a_char"), F.round(per("tokens", "entities"), 6).alias("tokens_an_entity"), F.round(per("chars", "entities"), 6).alias("chars_an_entity"))


_EXPECTED = ("PARTY", "COURT", "JUDGE", "DATE", "STATUTE_CITATION", "MONEY", "CASE_CITATION")


@query(f"with {MENTIONS}, d as (select count(*) as docs from documents), t as (select entity_type, count(distinct doc_id) as docs, avg(confidence) as c, count(distinct source) as sources from m group by 1), x as (select unnest({list(_EXPECTED)}) as entity_type) select entity_type, concat_ws(',', case when t.docs is null then 'missing' end, case when t.docs / d.docs < 0.5 then 'coverage' end, case when t.c < 0.75 then 'confidence' end, case when t.sources = 1 then 'single_strategy' end) as gaps from x left join t using (entity_type), d")
def type_gaps(spark, d):
    """What is wrong with each expected type: missing, in under half of the documents, unsure, or found by one strategy alone."""
    docs = table(spark, d, "documents").agg(F.count("*").alias("all"))
    own = found(spark, d).groupBy("entity_type").agg(F.countDistinct("doc_id").alias("docs"), F.avg("confidence").alias("c"), F.countDistinct("source").alias("sources"))
    wanted = spark.createDataFrame([(x,) for x in _EXPECTED], "entity_type string").join(own, "entity_type", "left").join(F.broadcast(docs))
    gaps = F.concat_ws(",", F.when(F.col("docs").isNull(), "missing"), F.when(F.col("docs") / F.col("all") < 0.5, "coverage"), F.when(F.col("c") < 0.75, "confidence"), F.when(F.col("sources") == 1, "single_strategy"))
    return wanted.select("entity_type", gaps.alias("gaps"))


@query(f"with {MENTIONS} select entity_type, count_if(source = 'regex')::bigint as regex, count_if(source = 'model')::bigint as model, count(*) as total from m group by rollup (entity_type)")
def type_strategy_matrix(spark, d):
    """Counts of types by strategy, and of all types (null)."""
    return found(spark, d).rollup("entity_type").agg(F.count_if(F.col("source") == "regex").alias("regex"), F.count_if(F.col("source") == "model").alias("model"), F.count("*").alias("total"))


# --- operations ---


@query(f"with {LOG} select user_id, round(sum(tokens) / 7, 6) as entities, round(case when sum(ms) <= 0 then 0 else count(*) / (sum(ms) / 1000) end, 6) as entities_per_second, round(case when sum(ms) <= 0 then 0 else sum(tokens) / (sum(ms) / 1000) end, 6) as tokens_per_second, round(avg(ms), 6) as wave_ms, sum(tokens)::bigint as wave_tokens from log group by 1")
def ops_performance(spark, d):
    """Rates of each test's waves: items and tokens a second (0 without time), mean latency, tokens."""
    seconds = F.sum("ms") / 1000
    rate = lambda x: F.round(F.when(F.sum("ms") <= 0, 0.0).otherwise(x / seconds), 6)
    return log(spark, d).groupBy("user_id").agg(F.round(F.sum("tokens") / 7, 6).alias("entities"), rate(F.count("*")).alias("entities_per_second"), rate(F.sum("tokens")).alias("tokens_per_second"), F.round(F.avg("ms"), 6).alias("wave_ms"), F.sum("tokens").alias("wave_tokens"))


@query(f"with {LOG}, l as (select *, user_id % 4 as gpu from log order by ts desc, event_id desc limit 100) select gpu, count(*) as n, round(avg(tokens), 6) as mean_load, max(tokens) as most_load, round(avg(ms), 6) as mean_ms, min(ms) as min_ms, max(ms) as max_ms from l group by 1")
def ops_gpu_summary(spark, d):
    """Loads and latencies by device over the last 100 samples."""
    last = log(spark, d).withColumn("gpu", F.col("user_id") % 4).orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return last.groupBy("gpu").agg(F.count("*").alias("n"), F.round(F.avg("tokens"), 6).alias("mean_load"), F.max("tokens").alias("most_load"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


@query(f"with {LOG}, o as (select user_id, ts, event_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as after, ms from log where event_type in ('signup', 'purchase')) select case when ms < 2500 then 'small' when ms < 7500 then 'medium' else 'large' end as tier, count(*) as depth from o where event_type = 'signup' and after is distinct from 'purchase' group by 1")
def ops_queue_depth(spark, d):
    """Requests by size that were started and not completed: the depth of each queue."""
    return _open_requests(spark, d).groupBy(F.when(F.col("ms") < 2500, "small").when(F.col("ms") < 7500, "medium").otherwise("large").alias("tier")).agg(F.count("*").alias("depth"))


def _open_requests(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    some = log(spark, d).filter(F.col("event_type").isin("signup", "purchase")).withColumn("after", F.lead("event_type").over(w))
    return some.filter((F.col("event_type") == "signup") & ~F.col("after").eqNullSafe("purchase"))


@query(f"with {LOG}, o as (select user_id, ts, event_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as after from log where event_type in ('signup', 'purchase')) select event_id, user_id, round(epoch((select max(ts) from log)) - epoch(ts), 3) as seconds from o where event_type = 'signup' and after is distinct from 'purchase'")
def ops_in_flight(spark, d):
    """Requests that were started and not completed, and for how long."""
    now = log(spark, d).agg(F.max("ts").alias("now"))
    return _open_requests(spark, d).join(F.broadcast(now)).select("event_id", "user_id", F.round(F.col("now").cast("double") - F.col("ts").cast("double"), 3).alias("seconds"))


@query(f"with {LOG}, a as (select * from log where not success or ms > 9000 order by ts desc, event_id desc limit 100), r as (select mode as service, case when success then 'warning' else 'error' end as level, event_id, row_number() over (partition by mode, success order by ts desc, event_id desc) as k from a) select service, level, count(*) as n, string_agg(case when k <= 5 then event_id::varchar end, ',' order by k) as last from r group by 1, 2")
def ops_alert_groups(spark, d):
    """The last 100 alerts by service and level: how many, and the last five."""
    last = log(spark, d).filter("not success or ms > 9000").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    level = F.when(F.col("success"), "warning").otherwise("error")
    newest = F.slice(F.sort_array(F.collect_list(F.struct("ts", "event_id")), asc=False), 1, 5)
    return last.groupBy(F.col("mode").alias("service"), level.alias("level")).agg(F.count("*").alias("n"), F.array_join(F.transform(newest, lambda x: x["event_id"].cast("string")), ",").alias("last"))


@query(f"with {LOG}, r as (select mode, success, lag(success) over (partition by user_id, mode order by ts, event_id) as before from log) select mode, count(*) as calls, round(count_if(success) / count(*), 6) as success_ratio, round(count_if(before = false) / count(*), 6) as retry_ratio, round(count_if(success and before = false) / count(*), 6) as fallback_ratio from r group by 1")
def ops_resilience(spark, d):
    """Shares of calls that succeeded, that followed a failure of the same caller, and that then succeeded."""
    before = F.coalesce(~F.lag("success").over(Window.partitionBy("user_id", "mode").orderBy("ts", "event_id")), F.lit(False))
    n = F.count("*")
    return log(spark, d).withColumn("again", before).groupBy("mode").agg(n.alias("calls"), F.round(F.count_if("success") / n, 6).alias("success_ratio"), F.round(F.count_if("again") / n, 6).alias("retry_ratio"), F.round(F.count_if(F.col("again") & F.col("success")) / n, 6).alias("fallback_ratio"))


@query(f"with {LOG} select event_id, strftime(ts, '%Y-%m-%d') as day from log where ts >= (select max(ts) from log) - interval 24 hour")
def ops_retained(spark, d):
    """The metrics that are kept: those of the last 24 hours."""
    from ..operators.metrics import trailing

    return trailing(log(spark, d), 24 * 60).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("select event_id, json_extract_string(props, '$.k')::double as k, value as value, event_type, len(json_keys(props::json)) as fields from events")
def ops_flattened(spark, d):
    """Nested test records as metric columns."""
    props = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", props["k"].cast("double").alias("k"), "value", "event_type", F.size(F.map_keys(props)).alias("fields"))


@query("select doc_id, (length(text) // 4)::int as prompt_tokens, least(4096, length(text) // 8)::int as completion_tokens, round((length(text) // 4) / 19000.0::double + least(4096, length(text) // 8) / 150.0::double, 6) as seconds from documents")
def doc_processing_time(spark, d):
    """Seconds that a model would take, by its rates of reading and writing tokens."""
    from ..operators.sizing import processing_seconds

    n = F.length("text")
    prompt, completion = F.floor(n / 4).cast("int"), F.least(F.lit(4096), F.floor(n / 8)).cast("int")
    return table(spark, d, "documents").select("doc_id", prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.round(processing_seconds(prompt, completion), 6).alias("seconds"))


# --- caches ---

_KEYED = "k as (select doc_id, substr(md5(coalesce(text, '')), 1, 16) || ':' || case when doc_id % 3 = 0 then 'hybrid' else 'regex' end || ':' || coalesce(lang, 'none') || ':' || substr(md5('{\"window\": 100}'), 1, 8) as key from documents)"


def _keyed(spark, d):
    from ..operators.limits import cache_key

    mode = F.when(F.col("doc_id") % 3 == 0, "hybrid").otherwise("regex")
    return table(spark, d, "documents").select("doc_id", cache_key(F.col("text"), mode, F.col("lang"), F.lit('{"window": 100}')).alias("key"))


@query(f"with {_KEYED} select doc_id, key from k")
def cache_keys(spark, d):
    return _keyed(spark, d)


@query(f"with {_KEYED} select doc_id, key from k where not contains(key, ':hybrid:')")
def cache_invalidated(spark, d):
    """What is left in a cache when all keys that hold a text are deleted."""
    return _keyed(spark, d).filter(~F.contains("key", F.lit(":hybrid:")))


@query(f"with {LOG}, r as (select user_id, mode, ts, lag(ts) over (partition by user_id, event_type order by ts, event_id) as p from log), h as (select mode, user_id, coalesce(epoch(ts) - epoch(p) <= 86400, false) as hit from r) select mode, count(*) as reads, count_if(hit)::bigint as hits, round(count_if(hit) / count(*), 6) as hit_rate, count(distinct user_id) as size from h group by 1")
def cache_metrics(spark, d):
    """Hits of a cache with a time to live, by strategy, and how many callers it holds."""
    from ..operators.limits import cache_reads

    reads = log(spark, d).select(F.struct("user_id", "event_type").alias("key"), "mode", "user_id", "ts", "event_id")
    return cache_reads(reads, 86_400.0).groupBy("mode").agg(F.count("*").alias("reads"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), 6).alias("hit_rate"), F.countDistinct("user_id").alias("size"))


# --- stores ---


@query(f"with {MENTIONS} select doc_id as document_id, substr(md5(entity_type || ':' || lower(trim(text))), 1, 16) as entity_id, entity_type, round(max(confidence), 8) as confidence from m where doc_id % 10 = 3 group by 1, 2, 3")
def store_document_entities(spark, d):
    """Stored entities of some documents (a selection by document_id is the operator)."""
    rows = S.entity_rows(found(spark, d).withColumnRenamed("doc_id", "document_id"))
    return rows.filter("document_id % 10 = 3").select("document_id", "entity_id", "entity_type", F.round("confidence", 8).alias("confidence"))


@query(rf"with {WINDOWS}, {MENTIONS}, c as (select doc_id, count(*) as chunks, sum(length(content))::bigint as chars from w group by 1), e as (select doc_id, count(distinct (entity_type, lower(trim(text)))) as entities from m group by 1) select doc_id as document_id, chunks, chars, coalesce(entities, 0) as entities from c left join e using (doc_id)")
def store_chunks_and_entities(spark, d):
    """What one write of a document's chunks, then its entities, holds."""
    chunks = S.chunk_rows(windows(spark, d).withColumnRenamed("doc_id", "document_id")).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
    entities = S.entity_rows(found(spark, d).withColumnRenamed("doc_id", "document_id")).groupBy("document_id").agg(F.count("*").alias("entities"))
    return chunks.join(entities, "document_id", "left").select("document_id", "chunks", "chars", F.coalesce("entities", F.lit(0)).alias("entities"))

"""Records parsed from model answers, standardised, checked and converted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from .registry import query, table

_RAW_SQL = """raw as (select doc_id, '```json' || chr(10) || '{"entities": [{"type": "party", "text": "' || regexp_replace(substr(text, 1, 12), '[^A-Za-z ]', '', 'g') || '", "confidence": ' || (doc_id % 130) || ', "start_pos": ' || (doc_id % 5 - 1) || '}, {"entity_type": "COURT", "value": "' || lang || '", "confidence_score": 0.' || (doc_id % 10) || ', "start": 3, "end": ' || (doc_id % 9) || '},], }' || chr(10) || '```' as raw from documents)"""


def raw(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.concat(
        F.lit('```json\n{"entities": [{"type": "party", "text": "'), F.regexp_replace(F.substring("text", 1, 12), "[^A-Za-z ]", ""), F.lit('", "confidence": '), (i % 130).cast("string"), F.lit(', "start_pos": '), (i % 5 - 1).cast("string"),
        F.lit('}, {"entity_type": "COURT", "value": "'), F.col("lang"), F.lit('", "confidence_score": 0.'), (i % 10).cast("string"), F.lit(', "start": 3, "end": '), (i % 9).cast("string"), F.lit("},], }\n```"),
    ).alias("raw"))


_ENTITIES = f"""with {_RAW_SQL}, j as (select doc_id, regexp_replace(regexp_extract(replace(replace(raw, '```json', ''), '```', ''), '(?s)\\{{.*\\}}', 0), ',\\s*([}}\\]])', '\\1', 'g')::json as j from raw),
x as (select doc_id, k, json_extract(j, '$.entities[' || k || ']') as e from j, (select unnest([0, 1]) as k)),
y as (select doc_id, k, upper(coalesce(json_extract_string(e, '$.entity_type'), json_extract_string(e, '$.type'), 'UNKNOWN')) as entity_type, coalesce(json_extract_string(e, '$.text'), json_extract_string(e, '$.value'), '') as text,
  coalesce(json_extract_string(e, '$.confidence')::double, json_extract_string(e, '$.confidence_score')::double, 0.5) as c, coalesce(json_extract_string(e, '$.start_pos')::int, json_extract_string(e, '$.start')::int, 0) as start_pos, json_extract_string(e, '$.end')::int as e2 from x),
s as (select doc_id, k, entity_type || '_' || substr(md5(entity_type || ':' || text), 1, 8) as entity_id, entity_type, text, least(1.0::double, case when c > 1 then c / 100 when c < 0 then 0 else c end) as confidence, start_pos, coalesce(e2, start_pos + length(text))::int as end_pos from y)"""


def standard(spark, d):
    found = R.entities(R.parsed(F.col("raw")))
    return raw(spark, d).select("doc_id", F.posexplode(F.transform(found, R.standard)).alias("k", "e"))


@query(f"{_ENTITIES} select doc_id, k, entity_id, entity_type, text, round(confidence, 6) as confidence, start_pos, end_pos from s")
def json_entities(spark, d):
    return standard(spark, d).select("doc_id", "k", "e.*").withColumn("confidence", F.round("confidence", 6))


@query(f"{_ENTITIES} select doc_id, k, array_to_string(list_filter([case when trim(text) = '' then 'empty_text' end, case when start_pos < 0 then 'negative_start' end, case when end_pos < start_pos then 'end_before_start' end, case when confidence not between 0 and 1 then 'confidence' end, case when length(text) <> end_pos - start_pos then 'length' end], lambda x: x is not null), ',') as issues, case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as level from s")
def record_issues(spark, d):
    return standard(spark, d).select("doc_id", "k", F.array_join(R.issues(F.col("e")), ",").alias("issues"), R.confidence_level(F.col("e.confidence")).alias("level"))


@query(f"{_ENTITIES} select doc_id, k, case when trim(text) = '' then 'UNKNOWN' else text end as text, greatest(0, start_pos) as start_pos, greatest(greatest(0, start_pos), end_pos) as end_pos, greatest(0, start_pos) + doc_id % 1000 as moved from s")
def record_fixed(spark, d):
    f = standard(spark, d).withColumn("f", R.fixed(F.col("e")))
    return f.select("doc_id", "k", "f.text", "f.start_pos", "f.end_pos", R.shifted(F.col("f"), F.col("doc_id") % 1000)["start_pos"].alias("moved"))


@query(f"{_ENTITIES} select doc_id, k, entity_id as id, entity_type as type, text, start_pos as start, end_pos as \"end\" from s")
def record_legacy(spark, d):
    return standard(spark, d).select("doc_id", "k", R.legacy(F.col("e")).alias("l")).select("doc_id", "k", "l.id", "l.type", "l.text", "l.start", "l.end")


@query(f"{_ENTITIES} select doc_id, count(*) as entity_count, round(avg(confidence), 6) as mean, round(max(confidence), 6) as best, count_if(length(text) <> end_pos - start_pos)::bigint as warned from s group by 1")
def record_rollup(spark, d):
    s = standard(spark, d)
    return s.groupBy("doc_id").agg(F.count("*").alias("entity_count"), F.round(F.avg("e.confidence"), 6).alias("mean"), F.round(F.max("e.confidence"), 6).alias("best"), F.count_if(F.length("e.text") != F.col("e.end_pos") - F.col("e.start_pos")).alias("warned"))


@query()
def json_repaired(spark, d):
    cut = raw(spark, d).withColumn("raw", F.expr("left(raw, length(raw) - 4 - doc_id % 40)"))
    return R.parse_all(cut, "raw").select("doc_id", F.size(R.entities(F.col("response"))).alias("n"), F.col("response").isNotNull().alias("ok"))


@query("select event_id, case when contains(e, 'connection') then 'connection_error' when contains(e, 'timed out') then 'timeout' when contains(e, '429') then 'rate_limit' when contains(e, 'context') then 'context_overflow' when contains(e, 'memory') then 'memory_error' when r = '' then 'empty_response' when r = '[' then 'malformed_response' else 'server_error' end as failure from (select event_id, ['connection lost', 'it timed out', 'HTTP 429', 'context length', 'out of memory', 'odd', 'odd', 'odd'][event_id % 8 + 1] as e, ['', '', '', '', '', '', '[', '{}'][event_id % 8 + 1] as r from events)")
def failure_classes(spark, d):
    at = (F.col("event_id") % 8 + 1).cast("int")
    e = F.element_at(F.array(*map(F.lit, ("Connection lost", "it timed out", "HTTP 429", "context length", "out of memory", "odd", "odd", "odd"))), at)
    r = F.element_at(F.array(*map(F.lit, ("", "", "", "", "", "", "[", "{}"))), at)
    return table(spark, d, "events").select("event_id", R.failure(e, r).alias("failure"))

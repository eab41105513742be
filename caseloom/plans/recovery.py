"""Broken answers mended step by step, and records checked and converted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recovery as R
from .registry import query, table

#: Answers with every kind of damage, around the first sentence of each text as it stands, quotes and control characters escaped or not.
_RAW = r"""w as (select doc_id, regexp_extract(coalesce(text, ''), '^[^.!?]*') as s from documents), raw as (select doc_id, '{"entities": [{"text": "' || replace(replace(s, '\', ''), '"', case when doc_id % 3 = 0 then '"' else '\"' end) || case when doc_id % 4 = 0 then ' a "quoted word here' || chr(1) else '' end || '", "confidence": ' || (doc_id % 130) || '}, {"text": "b", "confidence": NaN},], "confidence_score": ' || (doc_id % 120) || ', "extracted_relationships": [{"source_entity_id": "s' || doc_id || '", "target_entity_id": "t", "relationship_type": "SUES", "confidence": 0.5, "evidence": "e"}, {"source_entity_id": "x"}]' || case when doc_id % 2 = 0 then '}' else '' end as t from w)"""


def raw(spark, d):
    i, lit = F.col("doc_id"), F.lit
    s = F.replace(F.regexp_extract(F.coalesce("text", lit("")), "^[^.!?]*", 0), lit("\\"), lit(""))
    s = F.replace(s, lit('"'), F.when(i % 3 == 0, '"').otherwise('\\"'))
    more = F.when(i % 4 == 0, ' a "quoted word here\x01').otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat(
        lit('{"entities": [{"text": "'), s, more, lit('", "confidence": '), (i % 130).cast("string"), lit('}, {"text": "b", "confidence": NaN},], "confidence_score": '), (i % 120).cast("string"),
        lit(', "extracted_relationships": [{"source_entity_id": "s'), i.cast("string"), lit('", "target_entity_id": "t", "relationship_type": "SUES", "confidence": 0.5, "evidence": "e"}, {"source_entity_id": "x"}]'), F.when(i % 2 == 0, "}").otherwise("")).alias("t"))


_NUM = r"""(select list_transform(range(1, len(p) + 1), lambda k: p[k] || coalesce(case when try_cast(regexp_extract(m[k], '(\d+\.?\d*)$', 1) as double) > 1 then '"confidence": ' || round(try_cast(regexp_extract(m[k], '(\d+\.?\d*)$', 1) as double) / 100, 6) else m[k] end, '')) from (select string_split_regex(t, '"confidence":\s*\d+\.?\d*') as p, regexp_extract_all(t, '"confidence":\s*\d+\.?\d*') as m))"""
_NUMBERS = f"nu as (select doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string({_NUM}, ''), '\\bNaN\\b', 'null', 'g'), '-Infinity\\b', '-999999', 'g'), '\\bInfinity\\b', '999999', 'g') as t from raw)"


@query(f"with {_RAW}, {_NUMBERS} select doc_id, md5(t) as t from nu")
def json_numbers(spark, d):
    return raw(spark, d).select("doc_id", F.md5(R.numbers_fixed(F.col("t"))).alias("t"))


_QUOTES = r"""qu as (select doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda k: case when k = 1 then p[k] when regexp_matches(p[k - 1], '[{\[,:]\s*\z') or regexp_matches(p[k], '\A[,}\]:\s]') or (p[k] = '' and k = len(p)) or ends_with(p[k - 1], '\') then '"' || p[k] else '\"' || p[k] end), '') as t from (select doc_id, string_split(t, '"') as p from raw))"""


@query(f"with {_RAW}, {_QUOTES} select doc_id, md5(t) as t from qu")
def json_quotes(spark, d):
    return raw(spark, d).select("doc_id", F.md5(R.quotes_escaped(F.col("t"))).alias("t"))


_CLEAN = r"""c0 as (select doc_id, regexp_replace(t, '[\x00-\x08\x0b-\x1f]', '', 'g') as t from raw), c1 as (select doc_id, case when (length(t) - length(replace(t, '"', '')) - (length(t) - length(replace(t, '\"', ''))) // 2) % 2 <> 0 then t || '"' else t end as t from c0),
c2 as (select doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') as t from c1), c3 as (select doc_id, case when starts_with(t, '{') then t else '{' || t end as t from c2), cl as (select doc_id, case when ends_with(t, '}') then t else t || '}' end as t from c3)"""


@query(f"with {_RAW}, {_CLEAN} select doc_id, md5(t) as t from cl")
def json_cleaned(spark, d):
    return raw(spark, d).select("doc_id", F.md5(R.cleaned_up(F.col("t"))).alias("t"))


_COUNT = "(length(t) - length(replace(t, '{0}', '')))"
_FIXED = rf"""f0 as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, ',(\s*[}}\]])', '\1', 'g'), '"\s*\n\s*"', '",' || chr(10) || '"', 'g'), '\}}\s*\n\s*\{{', '}},' || chr(10) || '{{', 'g') as t from ZZ), st as (select doc_id, t || repeat('}}', greatest({_COUNT.format('{')} - {_COUNT.format('}')}, 0)::bigint) || repeat(']', greatest({_COUNT.format('[')} - {_COUNT.format(']')}, 0)::bigint) as t from f0)"""


@query(f"with {_RAW}, {_FIXED.replace('ZZ', 'raw')} select doc_id, md5(t) as t from st")
def json_structure(spark, d):
    return raw(spark, d).select("doc_id", F.md5(R.structure_fixed(F.col("t"))).alias("t"))


_PIPE = f"with {_RAW}, {_NUMBERS}, {_QUOTES.replace('from raw))', 'from nu))')}, {_FIXED.replace('ZZ', 'qu')}, ok as (select doc_id, try_cast(regexp_replace(t, '[\\x00-\\x1f]', ' ', 'g') as json) as j from st)"


def _mended(spark, d):
    t = F.regexp_replace(R.structure_fixed(R.quotes_escaped(R.numbers_fixed(F.col("t")))), r"[\x00-\x1f]", " ")
    return raw(spark, d).select("doc_id", t.alias("t"))


@query(f"{_PIPE} select doc_id, j is not null as parsed, coalesce(len(list_intersect(json_keys(j), ['entities', 'confidence_score'])) = 2, false) as whole, coalesce(json_array_length(j, '$.entities'), 0)::int as entities from ok")
def json_mended(spark, d):
    """All steps one after another: whether the answer parses then, holds the expected keys, and how many entities."""
    t = F.col("t")
    parsed = F.json_object_keys(t).isNotNull()
    items = F.json_array_length(F.get_json_object(t, "$.entities"))
    return _mended(spark, d).select("doc_id", parsed.alias("parsed"), R.has_keys(t, ("entities", "confidence_score")).alias("whole"), F.coalesce(items, F.lit(0)).alias("entities"))


@query(f"{_PIPE}, c as (select doc_id, json_extract_string(j, '$.confidence_score')::double as c, json_array_length(j, '$.entities') as n, json_array_length(j, '$.extracted_relationships') as r from ok where j is not null) select doc_id, round(case when c > 1 then c / 100 when c < 0 then 0 else c end, 6) as confidence_score, coalesce(n, 0)::int as items, coalesce(r, 0)::int as relationships, 'completed' as status from c")
def json_validated(spark, d):
    """Parsed answers with their confidence in range and a summary where they lack one."""
    t = F.col("t")
    c = F.get_json_object(t, "$.confidence_score").try_cast("double")
    n = lambda k: F.coalesce(F.json_array_length(F.get_json_object(t, f"$.{k}")), F.lit(0))
    return _mended(spark, d).filter(F.json_object_keys(t).isNotNull()).select("doc_id", F.round(F.when(c > 1, c / 100).when(c < 0, 0.0).otherwise(c), 6).alias("confidence_score"), n("entities").alias("items"), n("extracted_relationships").alias("relationships"), F.lit("completed").alias("status"))


@query(rf"""with {_RAW}, s as (select doc_id, regexp_matches(t, '(?s)"entities"\s*:\s*\[(.*?)\]') as e, regexp_extract(t, '(?s)"extracted_relationships"\s*:\s*\[(.*?)\]', 1) as r, try_cast(regexp_extract(t, '"confidence(?:_score)?"\s*:\s*([0-9.]+)', 1) as double) as c from raw) select doc_id, e as has_entities, length(r) as relationship_chars, round(case when c > 1 then c / 100 else c end, 6) as confidence from s""")
def json_sections(spark, d):
    """Sections and confidence found in answers that needn't parse."""
    t = F.col("t")
    return raw(spark, d).select("doc_id", R.section_items(t, "entities").isNotNull().alias("has_entities"), (F.length(R.section_items(t, "extracted_relationships")) - 2).alias("relationship_chars"), F.round(R.stated_confidence(t), 6).alias("confidence"))


@query(rf"""with {_RAW}, f as (select doc_id, unnest(regexp_extract_all(t, '\{{[^{{}}]*"source_entity_id"[^{{}}]*"target_entity_id"[^{{}}]*\}}')) as x from raw), j as (select doc_id, try_cast(x as json) as j from f) select doc_id, json_extract_string(j, '$.source_entity_id') as source, json_extract_string(j, '$.target_entity_id') as target, json_extract_string(j, '$.relationship_type') as relation, json_extract_string(j, '$.confidence')::double as confidence from j where j is not null""")
def json_relations(spark, d):
    """Relationship objects salvaged from answers."""
    rows = raw(spark, d).select("doc_id", F.explode(R.salvaged_relations(F.col("t"))).alias("r"))
    return rows.select("doc_id", F.col("r.source_entity_id").alias("source"), F.col("r.target_entity_id").alias("target"), F.col("r.relationship_type").alias("relation"), "r.confidence")


# --- records ---

_REC = """rec as (select doc_id, doc_id % 8 as k, [{'k': 'entity_type', 'v': 'PARTY'}, {'k': 'text', 'v': lang}, {'k': case when doc_id % 8 = 1 then 'score' else 'confidence' end, 'v': case when doc_id % 8 = 2 then '1.5' when doc_id % 8 = 3 then 'high' else '0.7' end}, {'k': case when doc_id % 8 = 4 then 'start' else 'start_pos' end, 'v': case when doc_id % 8 = 5 then '-1' else '10' end}, {'k': 'end_pos', 'v': case when doc_id % 8 = 6 then '4' when doc_id % 8 = 7 then '2.5' else '12' end}] as kv from documents),
flat as (select doc_id, list_transform(kv, lambda x: x.k) as keys, map_from_entries(list_transform(kv, lambda x: (x.k, x.v))) as m from rec)"""


def records(spark, d):
    i, k, lit = F.col("doc_id"), F.col("doc_id") % 8, F.lit
    return table(spark, d, "documents").select("doc_id", F.create_map(
        lit("entity_type"), lit("PARTY"), lit("text"), F.col("lang"), F.when(k == 1, "score").otherwise("confidence"), F.when(k == 2, "1.5").when(k == 3, "high").otherwise("0.7"),
        F.when(k == 4, "start").otherwise("start_pos"), F.when(k == 5, "-1").otherwise("10"), lit("end_pos"), F.when(k == 6, "4").when(k == 7, "2.5").otherwise("12")).alias("e"))


_WRONG = ", ".join([f"case when list_contains(keys, '{k}') then 'forbidden:{k}' end" for k in R.FORBIDDEN] + [f"case when not list_contains(keys, '{k}') then 'missing:{k}' end" for k in R.REQUIRED])
_POS = lambda k: f"case when list_contains(keys, '{k}') and not coalesce(case when regexp_matches(m['{k}'], '^-?\\d+$') then m['{k}']::int end >= 0, false) then '{k}' end"


@query(f"with {_REC} select doc_id, array_to_string(list_filter([{_WRONG}, case when list_contains(keys, 'confidence') and not coalesce(try_cast(m['confidence'] as double) between 0 and 1, false) then 'confidence' end, {_POS('start_pos')}, {_POS('end_pos')}, case when case when regexp_matches(m['end_pos'], '^-?\\d+$') then m['end_pos']::int end < try_cast(m['start_pos'] as int) then 'order' end], lambda x: x is not null), ',') as errors from flat")
def record_errors(spark, d):
    """What is wrong with entities as they came: keys that mustn't or must be there, and values out of range."""
    return records(spark, d).select("doc_id", F.array_join(R.entity_errors(F.col("e")), ",").alias("errors"))


@query("""with r as (select doc_id, case when doc_id % 6 = 1 then '' else 's' || doc_id end as s, case when doc_id % 6 = 2 then 7.0 else 0.7 end as c, doc_id % 6 = 3 as no_evidence, case when doc_id % 6 = 4 then ' ' else 'seen' end as evidence from documents)
select doc_id, array_to_string(list_filter([case when no_evidence then 'missing:evidence' end, case when c > 1 then 'confidence' end, case when trim(s) = '' then 'empty:source_entity_id' end, case when not no_evidence and trim(evidence) = '' then 'empty:evidence' end], lambda x: x is not null), ',') as errors from r""")
def relation_errors(spark, d):
    """What is wrong with relationships as they came."""
    k, lit = F.col("doc_id") % 6, F.lit
    r = F.create_map(lit("source_entity_id"), F.when(k == 1, "").otherwise(F.concat(lit("s"), "doc_id")), lit("target_entity_id"), lit("t"), lit("relationship_type"), lit("SUES"), lit("confidence"), F.when(k == 2, "7.0").otherwise("0.7"), F.when(k == 3, "proof").otherwise("evidence"), F.when(k == 4, " ").otherwise("seen"))
    return table(spark, d, "documents").select("doc_id", F.array_join(R.relation_errors(r), ",").alias("errors"))


@query(f"with {_REC}, c as (select *, try_cast(m['confidence'] as double) as c, case when regexp_matches(m['start_pos'], '^-?\\d+$') then m['start_pos']::int end as s from flat) select doc_id % 5 as batch, count(*) as records, count_if(c is not null and s is not null)::bigint as converted, count_if(c is null or s is null)::bigint as failed, round(avg(case when c is not null and s is not null then c end), 6) as mean from c group by 1")
def record_batches(spark, d):
    """Batches of records converted to typed rows, those that can't be counted as failed."""
    c, s = F.col("e")["confidence"].try_cast("double"), F.col("e")["start_pos"].try_cast("int")
    rows = records(spark, d).select((F.col("doc_id") % 5).alias("batch"), c.alias("c"), s.alias("s"))
    ok = F.col("c").isNotNull() & F.col("s").isNotNull()
    return rows.groupBy("batch").agg(F.count("*").alias("records"), F.count_if(ok).alias("converted"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col("c"))), 6).alias("mean"))


@query("select doc_id, 1::bigint as entity_count, '2024-01-01' as extracted_at, 'v2' as version, upper(lang) as entity_type, length(text)::int as end_pos, substr(md5('ENTITY:' || coalesce(lang, '')), 1, 8) as entity_id from documents")
def record_metadata(spark, d):
    """Rows of the standard schema with the metadata that a response lacks: count, time and version by default."""
    given = F.create_map(F.lit("source"), F.coalesce("source", F.lit("")))
    default = lambda k, v: F.coalesce(given[k], F.lit(v)).alias(k)
    return table(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("entity_count"), default("extracted_at", "2024-01-01"), default("version", "v2"), F.upper("lang").alias("entity_type"), F.length("text").alias("end_pos"), F.substring(F.md5(F.concat(F.lit("ENTITY:"), F.coalesce("lang", F.lit("")))), 1, 8).alias("entity_id"))

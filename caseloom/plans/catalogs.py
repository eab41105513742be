"""Catalog look-ups and listings over a table of patterns (here: parts), and matches with named groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as O
from .registry import query, table
from .smart import q, spans_sql

_RAW = ("JUDGES", "CASES_CITED", "STATUTE_CITATION", "PARTY", "COURT_CITATION", "DOCKETS")
_ALIASES = (("JUDGES", "JUDGE"), ("CASES_CITED", "CASE_CITATION"), ("DOCKETS", "DOCKET_NUMBER"))
_CAT = f"""al as (select * from (values {', '.join(f"('{a}', '{c}')" for a, c in _ALIASES)}) t(alias, canonical)), raw as (select p_partkey as id, replace(p_name, ' ', case when p_partkey % 3 = 0 then '_citation.' else '.' end) || '_' || p_partkey as name, {list(_RAW)}[p_partkey % 6 + 1] as entity_type, p_type as pattern, case when p_size % 4 = 0 then 'unknown' else lower(p_type) end as pattern_type, p_brand as jurisdiction,
round(0.5::double + p_size / 100.0::double, 4) as confidence, p_partkey % 2 = 0 as bluebook, case when p_partkey % 5 = 0 then []::varchar[] else [p_name, lower(p_type)] end as examples, '/patterns/' || p_brand || '/' || lower(p_type) || '.yaml' as path from part), cat as (select raw.*, coalesce(canonical, entity_type) as mapped_type from raw left join al on alias = entity_type)"""


def aliases(spark):
    return spark.createDataFrame(list(_ALIASES), "alias string, canonical string")


def catalog(spark, d):
    i = F.col("p_partkey")
    sep = F.when(i % 3 == 0, "_citation.").otherwise(".")
    rows = table(spark, d, "part").select(
        i.alias("id"), F.concat(F.replace("p_name", F.lit(" "), sep), F.lit("_"), i).alias("name"), F.element_at(F.array(*map(F.lit, _RAW)), (i % 6 + 1).cast("int")).alias("entity_type"), F.col("p_type").alias("pattern"),
        F.when(F.col("p_size") % 4 == 0, "unknown").otherwise(F.lower("p_type")).alias("pattern_type"), F.col("p_brand").alias("jurisdiction"), F.round(0.5 + F.col("p_size") / 100.0, 4).alias("confidence"), (i % 2 == 0).alias("bluebook"),
        F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name", F.lower("p_type"))).alias("examples"), F.concat(F.lit("/patterns/"), "p_brand", F.lit("/"), F.lower("p_type"), F.lit(".yaml")).alias("path"))
    return O.mapped(rows, aliases(spark))


_RELATIONS = "rels as (select distinct upper(o_orderpriority) as relationship_type, 'orders ' || o_orderstatus as category, 0.8::double as confidence from orders)"


def relations(spark, d):
    return table(spark, d, "orders").select(F.upper("o_orderpriority").alias("relationship_type"), F.concat(F.lit("orders "), "o_orderstatus").alias("category"), F.lit(0.8).alias("confidence")).distinct()


@query(f"with {_CAT} select id, entity_type, mapped_type from cat")
def catalog_mapped_types(spark, d):
    """Each pattern's canonical type by the alias map, itself where there is none."""
    return catalog(spark, d).select("id", "entity_type", "mapped_type")


@query(f"with {_CAT} select id, name, mapped_type, confidence from cat where name in (select name from cat where id = 7)")
def catalog_by_name(spark, d):
    c = catalog(spark, d)
    wanted = c.filter("id = 7").select("name")
    return c.join(wanted, "name", "left_semi").select("id", "name", "mapped_type", "confidence")


@query(f"with {_CAT} select id, name from cat where entity_type = 'CASE_CITATION' or mapped_type = 'CASE_CITATION'")
def catalog_of_type(spark, d):
    return O.of_type(catalog(spark, d), "CASE_CITATION").select("id", "name")


@query(f"with {_CAT}, {_RELATIONS} select 'entity' as kind, name, entity_type, confidence::varchar as confidence from cat where confidence >= 0.75 union all select 'relationship', relationship_type, category, confidence::varchar from rels where confidence >= 0.75 and contains(lower(category), 'orders f')")
def catalog_unified(spark, d):
    """Entity and relationship patterns in one listing."""
    return O.unified(catalog(spark, d), relations(spark, d), category="orders F", least=0.75)


@query(f"with {_CAT}, {_RELATIONS} select 'entity' as kind, name, entity_type from cat where mapped_type = 'JUDGE'")
def catalog_unified_minimal(spark, d):
    return O.unified(catalog(spark, d), relations(spark, d), "entities", "JUDGE", shown="minimal")


@query(f"with {_RELATIONS} select relationship_type, count(*) as patterns, string_agg(category, ',' order by category) as categories, min(confidence) as confidence from rels where relationship_type = '1-URGENT' group by 1")
def relation_details(spark, d):
    """All that the catalog says of one relationship type; no row if it has none."""
    r = relations(spark, d).filter("relationship_type = '1-URGENT'")
    return r.groupBy("relationship_type").agg(F.count("*").alias("patterns"), F.array_join(F.sort_array(F.collect_list("category")), ",").alias("categories"), F.min("confidence").alias("confidence"))


@query(f"with {_CAT} select mapped_type, count(distinct pattern) as patterns, round(avg(confidence), 3) as mean, string_agg(distinct jurisdiction, ',' order by jurisdiction) as jurisdictions, count(distinct pattern_type) as sources from cat where confidence >= 0.6 and (mapped_type ilike '%citation%' or mapped_type ilike '%j%') group by 1")
def catalog_grouped(spark, d):
    """Types with their distinct patterns, by a least confidence and part of a name."""
    c = catalog(spark, d).filter((F.col("confidence") >= 0.6) & (F.ilike("mapped_type", F.lit("%citation%")) | F.ilike("mapped_type", F.lit("%j%"))))
    return c.groupBy("mapped_type").agg(F.countDistinct("pattern").alias("patterns"), F.round(F.avg("confidence"), 3).alias("mean"), F.array_join(F.sort_array(F.collect_set("jurisdiction")), ",").alias("jurisdictions"), F.countDistinct("pattern_type").alias("sources"))


@query(f"with {_CAT}, x as (select unnest(examples) as e, id from cat where mapped_type = 'JUDGE') select 'JUDGE' as entity_type, (select count(*) from cat where mapped_type = 'JUDGE') as patterns, (select string_agg(name, ',' order by name) from (select name from cat where mapped_type = 'JUDGE' order by name limit 10)) as names, (select count(distinct e) from x) as examples")
def catalog_type_details(spark, d):
    """One type's patterns, the first ten names, and its examples."""
    c = catalog(spark, d).filter("mapped_type = 'JUDGE'")
    own = c.agg(F.count("*").alias("patterns"))
    names = c.select("name").orderBy("name").limit(10).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))
    examples = c.select(F.explode("examples").alias("e")).agg(F.countDistinct("e").alias("examples"))
    return own.join(names).join(examples).select(F.lit("JUDGE").alias("entity_type"), "patterns", "names", "examples")


_TYPES = ("types as (select * from (values ('JUDGE', 'Judicial'), ('CASE_CITATION', 'Citations'), ('STATUTE_CITATION', 'Citations'), ('PARTY', 'Parties'), ('MONEY', 'Amounts'), ('COURT_CITATION', 'Citations')) t(entity_type, category))")


def _types(spark):
    return spark.createDataFrame([("JUDGE", "Judicial"), ("CASE_CITATION", "Citations"), ("STATUTE_CITATION", "Citations"), ("PARTY", "Parties"), ("MONEY", "Amounts"), ("COURT_CITATION", "Citations")], "entity_type string, category string")


@query(f"with {_CAT}, {_TYPES}, o as (select mapped_type, count(*) as patterns, sum(len(examples))::bigint as examples, round(avg(confidence), 3) as mean from cat where confidence >= 0.6 group by 1) select t.entity_type, category, coalesce(patterns, 0) as patterns, coalesce(examples, 0) as examples, mean from types t left join o on t.entity_type = o.mapped_type")
def catalog_comprehensive(spark, d):
    """Every type with its patterns and examples, none of them too."""
    return O.comprehensive(catalog(spark, d), _types(spark), 0.6)


@query(f"with {_CAT}, {_TYPES}, o as (select mapped_type, count(*) as patterns, sum(len(examples))::bigint as examples, round(avg(confidence), 3) as mean from cat where bluebook group by 1) select t.entity_type, category, patterns, examples, mean from types t join o on t.entity_type = o.mapped_type where contains(lower(category), 'cit') and patterns > 0 and examples > 0")
def catalog_comprehensive_filtered(spark, d):
    return O.comprehensive(catalog(spark, d), _types(spark), category="cit", has_patterns=True, has_examples=True, bluebook=True)


@query(f"with {_CAT}, {_TYPES}, o as (select mapped_type, count(*) as patterns, avg(confidence) as mean from cat group by 1) select count(*) as types, count(patterns) as with_patterns, round(count(patterns) / count(*) * 100, 2) as coverage_percent, round(avg(mean), 3) as mean from types t left join o on t.entity_type = o.mapped_type")
def catalog_coverage(spark, d):
    """How many types have patterns, and the mean of their mean confidences."""
    o = catalog(spark, d).groupBy("mapped_type").agg(F.count("*").alias("patterns"), F.avg("confidence").alias("mean"))
    t = _types(spark)
    return t.join(o, t["entity_type"] == o["mapped_type"], "left").agg(F.count("*").alias("types"), F.count("patterns").alias("with_patterns"), F.round(F.count("patterns") / F.count("*") * 100, 2).alias("coverage_percent"), F.round(F.avg("mean"), 3).alias("mean"))


@query(f"with {_CAT} select id, name, mapped_type, pattern, confidence, jurisdiction, case when pattern_type not in ('', 'unknown') then pattern_type else regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]*$', '') end as pattern_group, array_to_string(examples, '|') as examples from cat")
def catalog_listing(spark, d):
    """The whole catalog in detail, each pattern under the name of its group."""
    return catalog(spark, d).select("id", "name", "mapped_type", "pattern", "confidence", "jurisdiction", O.group_name(F.col("pattern_type"), F.col("path")).alias("pattern_group"), F.array_join("examples", "|").alias("examples"))


@query(f"with {_CAT} select 'name' as index, name as key, 1 as n from cat union all select 'type', entity_type, count(*) from cat group by 2 union all select 'mapped', mapped_type, count(*) from cat group by 2 union all select 'example', e, count(*) from (select unnest(examples) as e from cat) group by 2")
def catalog_indexes(spark, d):
    """How many patterns each key of the catalog's indexes leads to."""
    c = catalog(spark, d)
    one = lambda rows, n, k: rows.groupBy(F.col(k).alias("key")).agg(F.count("*").alias("n")).select(F.lit(n).alias("index"), "key", "n")
    return one(c, "name", "name").union(one(c, "type", "entity_type")).union(one(c, "mapped", "mapped_type")).union(one(c.select(F.explode("examples").alias("e")), "example", "e"))


@query(f"with {_CAT}, m as (select case when contains(entity_type, 'CITATION') then entity_type when regexp_matches(lower(name), 'citation|cite|reference') then case when contains(upper(split_part(name, '.', 1)), 'CITATION') then upper(split_part(name, '.', 1)) else upper(split_part(name, '.', 1)) || '_CITATION' end end as citation_type from cat) select distinct citation_type from m where citation_type is not null")
def catalog_citation_types(spark, d):
    return O.citation_types(catalog(spark, d))


_CATEGORY = "case " + " ".join(f"when regexp_matches(t, '{'|'.join(w)}') then '{n}'" for n, w in O.CITATION_CATEGORIES) + " else 'Other Citations' end"
_NAMES = "n as (select item_id, ['CASE_CITATION', 'USC_TITLE', 'CFR_PART', 'AMENDMENT_CITATION', 'FRCP', 'LEXIS_CITE', 'LAW_REVIEW', 'JOURNAL', 'NEWSPAPER', 'TREATY', 'HEARING', 'MOTION', 'OTHER', 'PARALLEL_CITATION'][item_id % 14 + 1] as t from benchmark)"


@query(f"with {_NAMES} select item_id, t as citation_type, {_CATEGORY} as category from n")
def citation_categories(spark, d):
    names = ("CASE_CITATION", "USC_TITLE", "CFR_PART", "AMENDMENT_CITATION", "FRCP", "LEXIS_CITE", "LAW_REVIEW", "JOURNAL", "NEWSPAPER", "TREATY", "HEARING", "MOTION", "OTHER", "PARALLEL_CITATION")
    t = F.element_at(F.array(*map(F.lit, names)), (F.col("item_id") % 14 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", t.alias("citation_type"), O.citation_category(t).alias("category"))


def _counted(words) -> str:
    return "(" + " + ".join(f"contains(low, '{w}')::int" for w in words) + ")"


_OWN = "greatest(" + ", ".join(f"case when contains(name, '{k}') then least(0.4, 0.15 * {_counted(w)}) else 0 end" for k, w in O.INDICATORS.items()) + ")"
_PATTERNS = (("judge_name", "JUDGE", 0.95), ("party_statute", "PARTY", 0.82), ("supreme_court", "COURT", 0.9), ("procedural_motion", "MOTION", 0.76), ("date_any", "DATE", 0.6))
_RELEVANT = "documents as (select doc_id, case when doc_id % 4 = 0 then 'Case No. 7 filed: the Honorable Judge held: under Section 4, motion and order of the plaintiff, affirmed. ' || text else text end as text from main.documents)"


@query(f"with {_RELEVANT}, p as (select * from (values {', '.join(str(x) for x in _PATTERNS)}) t(name, entity_type, confidence)), l as (select doc_id, lower(substr(text, 1, 1000)) as low from documents) select doc_id, name, round(least(1.0, {_OWN} + case when {_counted(O.DOCUMENT_INDICATORS)} >= 3 then 0.25 when {_counted(O.DOCUMENT_INDICATORS)} >= 1 then 0.15 else 0 end + case when confidence >= 0.95 then 0.25 when confidence >= 0.9 then 0.2 when confidence >= 0.85 then 0.15 when confidence >= 0.8 then 0.1 when confidence >= 0.75 then 0.05 else 0 end + case when regexp_matches(name, '{'|'.join(O.CRITICAL)}') then 0.15 else 0 end + case when entity_type in {O.PRIORITY_TYPES} then 0.1 else 0 end), 6)::double as relevance from l, p")
def pattern_relevance(spark, d):
    """How likely each of some patterns is to match each text; patterns are a constant, broadcast."""
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Case No. 7 filed: the Honorable Judge held: under Section 4, motion and order of the plaintiff, affirmed. "), "text")).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", F.substring(text, 1, 1000).alias("text"))
    p = spark.createDataFrame(list(_PATTERNS), "name string, entity_type string, confidence double")
    return docs.join(F.broadcast(p)).select("doc_id", "name", F.round(O.relevance(F.col("name"), F.col("entity_type"), F.col("confidence"), F.col("text")), 6).alias("relevance"))


# --- matches with groups ---

_GDOCS = """documents as (select doc_id, text || ' See Brown v. Board, ' || (doc_id * 37 % 1300) || case when doc_id % 2 = 0 then ' U.S. ' else ' F.3d ' end || (doc_id * 11 % 1500) || case when doc_id % 3 = 0 then '' else ' (' || (1500 + doc_id % 650) || ')' end || '; 42 U.S.C. § ' || doc_id || case when doc_id % 4 = 0 then '; Judge Ann Lee of the Superior Court.' else '; Justice Bo Day.' end as text from main.documents)"""


def _gdocs(spark, d):
    i, s = F.col("doc_id"), lambda x: x.cast("string")
    return table(spark, d, "documents").select("doc_id", F.concat(
        "text", F.lit(" See Brown v. Board, "), s(i * 37 % 1300), F.when(i % 2 == 0, " U.S. ").otherwise(" F.3d "), s(i * 11 % 1500), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(" ("), s(1500 + i % 650), F.lit(")"))),
        F.lit("; 42 U.S.C. § "), s(i), F.when(i % 4 == 0, "; Judge Ann Lee of the Superior Court.").otherwise("; Justice Bo Day.")).alias("text"))


def _grouped_sql(p: O.Grouped) -> str:
    parts = ", ".join(f"nullif(regexp_extract(text, '{q(p.pattern)}', {k + 1}), '') as {g}" for k, g in enumerate(p.groups))
    every = [g for x in O.GROUPED for g in x.groups]
    rest = ", ".join(g if g in p.groups else f"null as {g}" for g in dict.fromkeys(every))
    return f"select doc_id, '{p.name}' as pname, '{p.entity_type}' as entity_type, {len(p.groups)} as n_groups, start, stop, text, {rest} from (select doc_id, start, stop, text, {parts} from ({spans_sql(p.pattern)}))"


_ALL_GROUPS = list(dict.fromkeys(g for p in O.GROUPED for g in p.groups))
_MATCHED = "gm as (" + " union all ".join(map(_grouped_sql, O.GROUPED)) + ")"


def matched(spark, d):
    return O.grouped_matches(_gdocs(spark, d))


@query(f"with {_GDOCS}, {_MATCHED} select doc_id, start, case_name, volume, reporter, page, year, title, code, section, coalesce(justice_title || '/' || name, '') as additional from gm")
def match_components(spark, d):
    """Named groups as the parts of a citation, other groups beside them."""
    m = matched(spark, d)
    c, g = O.citation_components(F.col("groups")), F.col("groups")
    rows = m.withColumn("c", c)
    extra = F.coalesce(F.concat(F.col("c.additional")["justice_title"], F.lit("/"), F.col("c.additional")["name"]), F.lit(""))
    return rows.select("doc_id", "start", *[F.col(f"c.{x}") for x in ("case_name", "volume", "reporter", "page", "year", "title", "code", "section")], extra.alias("additional"))


@query(f"with {_GDOCS}, {_MATCHED} select doc_id, start, justice_title as judge_title, court_name, list_sort(list_filter([{', '.join(f'''case when {g} is not null then '{g}' end''' for g in _ALL_GROUPS)}], lambda x: x is not null))::varchar as keys from gm where pname = 'justice_name'")
def match_attributes(spark, d):
    """Named groups as attributes of an entity."""
    m = matched(spark, d).filter("name = 'justice_name'").withColumn("a", O.entity_attributes(F.col("name"), F.col("groups")))
    keys = F.concat(F.lit("["), F.array_join(F.array_sort(F.map_keys("a.additional")), ", "), F.lit("]"))
    return m.select("doc_id", "start", F.col("a.judge_title").alias("judge_title"), F.col("a.court_name").alias("court_name"), keys.alias("keys"))


_RULE = "case when pname <> 'case_citation' then 1.0 else case when year is not null and year::bigint not between 1600 and 2030 then 0.5 else 1 end * case when (reporter = 'U.S.' and volume::bigint not between 1 and 600) or (reporter = 'F.3d' and volume::bigint not between 1 and 999) then 0.7 else 1 end * case when page::bigint not between 1 and 999 then 0.8 else 1 end end"
_FILLED = "(" + " + ".join(f"({g} is not null)::int" for g in _ALL_GROUPS) + ")"


@query(f"with {_GDOCS}, {_MATCHED} select doc_id, start, round({_RULE}, 6)::double as rule_score, round({_FILLED} / n_groups, 6) as filled, round(least(1.0, greatest(0.5, 0.8::double * case when length(text) < 3 then 0.85 when length(text) < 10 then 0.95 when length(text) < 25 then 1.0 else 1.02 end * (0.9 + 0.1 * {_FILLED} / n_groups))), 6)::double as confidence from gm")
def match_scores(spark, d):
    """How far a match keeps its pattern's ranges, the share of its groups that hold something, and its confidence by that share."""
    from ..functions.catalog import length_factor

    m = matched(spark, d).withColumn("filled", F.size("groups") / F.col("all"))
    sure = 0.8 * length_factor(F.length("text")) * (0.9 + 0.1 * F.col("filled"))
    return m.select("doc_id", "start", F.round(O.rule_score(), 6).alias("rule_score"), F.round("filled", 6).alias("filled"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.5), sure)), 6).alias("confidence"))


@query(f"with {_GDOCS}, {_MATCHED} select doc_id, start, pname as name, case when doc_id % 10 = 0 then doc_id % 20 = 0 when contains(pname, 'case') then volume is not null and reporter is not null and page is not null else true end as bluebook from gm where contains(pname, 'citation')")
def match_bluebook(spark, d):
    """Whether citations are in standard form; for some the pattern's own flag decides."""
    m = matched(spark, d).filter(F.contains("name", F.lit("citation")))
    flag = F.when(F.col("doc_id") % 10 == 0, F.when(F.col("doc_id") % 20 == 0, "22nd_edition").otherwise("no"))
    return m.select("doc_id", "start", "name", O.bluebook(F.col("name"), F.col("groups"), flag).alias("bluebook"))


@query(f"with {_GDOCS}, {_MATCHED} select doc_id, case when contains(pname, 'citation') then 'citation' else 'entity' end as object, case when contains(pname, 'citation') then case pname when 'case_citation' then 'CASE' else 'STATUTE' end else entity_type end as type, start, stop, text from gm")
def match_objects(spark, d):
    """Matches as rows of citations, by their pattern's name, and of entities, by their type."""
    cited = F.contains("name", F.lit("citation"))
    kind = F.when(F.col("name") == "case_citation", "CASE").when(F.col("name") == "statute_citation", "STATUTE")
    return matched(spark, d).select("doc_id", F.when(cited, "citation").otherwise("entity").alias("object"), F.when(cited, kind).otherwise(F.col("entity_type")).alias("type"), "start", "stop", "text")

"""Relations on mentions, edges of orders, and entity graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spans import running
from ..operators import graph, relations
from .mentions import MENTIONS, found
from .registry import query, table

#: Labels whose vectors are broadcast at once (some 8 KB each at a thousand numbers).
TYPES_AT_ONCE = 2_000
_RULES = ", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in relations.TYPE_RULES)
_NEAR = f"""rules as (select * from (values {_RULES}) t(x, y, relation)), p as (select a.doc_id, a.rank as a_rank, a.start as a_start, b.rank as b_rank, b.start as b_start, a.entity_type as a_type, b.entity_type as b_type, greatest(b.start - a.stop, 0) as distance from m a join m b on a.doc_id = b.doc_id
and (b.start > a.start or (b.start = a.start and (b.stop > a.stop or (b.stop = a.stop and b.rank > a.rank)))) and b.start - a.stop <= 100)"""


@query(f"with {MENTIONS}, {_NEAR} select doc_id, a_rank, a_start, b_rank, b_start, distance, coalesce(r.relation, s.relation, 'RELATED_TO') as relation, round(greatest(0.5, 1 - distance / 200), 6)::double as confidence from p left join rules r on r.x = a_type and r.y = b_type left join rules s on s.x = b_type and s.y = a_type")
def relation_proximity(spark, d):
    return relations.proximity(found(spark, d).select("doc_id", "rank", "start", "stop", "entity_type")).select("doc_id", "a_rank", "a_start", "b_rank", "b_start", "distance", "relation", F.round("confidence", 6).alias("confidence"))


@query(f"with {MENTIONS}, g as (select doc_id, a.rank as t_rank, a.start as t_start, b.start, b.rank, greatest(0, greatest(a.start, b.start) - least(a.stop, b.stop)) as distance from m a join m b using (doc_id) where not (b.rank = a.rank and b.start = a.start)) select doc_id, t_rank, t_start, start, rank, distance, k from (select *, row_number() over (partition by doc_id, t_rank, t_start order by distance, start, rank) as k from g where distance <= 500) where k <= 5")
def nearby_mentions(spark, d):
    """The five mentions nearest to each mention, within 500 characters."""
    return relations.nearest(found(spark, d).select("doc_id", "rank", "start", "stop"), 500, 5)


@query(f"with {MENTIONS}, l as (select doc_id, i as span_id, coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x) + 1)), 0) as s_start, s[i] as line from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split(text, chr(10)) as s from documents))) select l.doc_id, span_id, count(*) as n, min(start) as first_start, count(distinct entity_type) as types from l join m on l.doc_id = m.doc_id and m.start >= s_start and m.stop <= s_start + length(line) group by 1, 2")
def mentions_in_lines(spark, d):
    """Lines as spans: their lengths alone are kept, and starts are a running sum."""
    n = F.transform(F.split("text", "\n", -1), lambda x: F.length(x))
    lines = table(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", F.posexplode(F.arrays_zip(F.col("n"), running(F.transform("n", lambda x: x + 1)).alias("at"))).alias("i", "l"))
    spans = lines.select("doc_id", (F.col("i") + 1).alias("span_id"), F.col("l.at").alias("start"), (F.col("l.at") + F.col("l.n")).alias("stop"))
    inside = relations.contained(spans, found(spark, d).select("doc_id", "entity_type", "start", "stop"))
    return inside.groupBy("doc_id", "span_id").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.countDistinct("entity_type").alias("types"))


EDGES = "e as (select o_custkey as src, l_suppkey + 1000000 as tgt, ['SUES', 'REPRESENTS', 'RELATED_TO'][ascii(l_returnflag) % 3 + 1] as relation, 1 - l_discount as confidence, o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey)"


def edges(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.element_at(F.array(F.lit("SUES"), F.lit("REPRESENTS"), F.lit("RELATED_TO")), F.ascii("l_returnflag") % 3 + 1)
    return joined.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("tgt"), kind.alias("relation"), (1 - F.col("l_discount")).alias("confidence"), "o_orderkey", "l_linenumber")


@query(f"with {EDGES}, r as (select *, row_number() over (partition by src, tgt, relation order by o_orderkey, l_linenumber, confidence) as k from e) select src, tgt, relation, round(least(1.0, sum(case when k = 1 then confidence else confidence * 0.1::double end)), 6)::double as confidence, count(*) as merged_count from r group by 1, 2, 3")
def relation_merge(spark, d):
    return relations.merge_duplicates(edges(spark, d), ["o_orderkey", "l_linenumber", "confidence"]).withColumn("confidence", F.round("confidence", 6))


@query(f"with {EDGES}, i as (select c_custkey as id from customer where c_acctbal > 0 union all select s_suppkey + 1000000 from supplier where s_acctbal > 0) select src, tgt, relation, round(confidence, 6) as confidence, o_orderkey, l_linenumber from e where confidence >= 0.95 and src <> tgt and src in (select id from i) and tgt in (select id from i)")
def relation_validate(spark, d):
    ids = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")).union(table(spark, d, "supplier").filter("s_acctbal > 0").select((F.col("s_suppkey") + 1000000).alias("id")))
    return relations.valid_edges(edges(spark, d), ids, 0.95).withColumn("confidence", F.round("confidence", 6))


@query(f"with {EDGES}, x as (select src, tgt, relation, confidence, false as reverse from e union all select tgt, src, relation, confidence * 0.9::double, true from e where relation = 'SUES') select relation, reverse, count(*) as n, round(sum(confidence), 4) as total, min(src) as first_src, max(tgt) as last_tgt from x group by 1, 2")
def relation_reverse(spark, d):
    both = relations.with_reverse(edges(spark, d), F.col("relation") == "SUES")
    return both.groupBy("relation", "reverse").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"), F.min("src").alias("first_src"), F.max("tgt").alias("last_tgt"))


@query(f"with {EDGES} select relation, count(*) as n, count(distinct (src, tgt)) as pairs, round(avg(confidence), 6) as mean, count_if(confidence >= 0.8)::bigint as high, count_if(confidence >= 0.6 and confidence < 0.8)::bigint as medium, count_if(confidence < 0.6)::bigint as low from e group by 1")
def relation_statistics(spark, d):
    return relations.statistics(edges(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"with {EDGES}, x as (select src as id, 1 as s, 0 as t from e union all select tgt, 0, 1 from e) select id, sum(s)::bigint as as_source, sum(t)::bigint as as_target, count(*) as total from x group by 1")
def relation_participation(spark, d):
    return relations.participation(edges(spark, d))


@query(f"with {EDGES}, g as (select distinct src, tgt, relation = 'SUES' as bidirectional from e), n as (select c_custkey as id, c_custkey % 150 as occurrences from customer union all select s_suppkey + 1000000, s_suppkey % 150 from supplier), x as (select src as id from g union all select tgt from g where bidirectional), k as (select id, count(*) as degree from x group by 1), j as (select n.id, occurrences, coalesce(degree, 0) as degree from n left join k using (id)) select id, degree, round(0.7::double * degree / greatest((select max(degree) from j), 1) + 0.3::double * least(1.0, occurrences / 100), 6)::double as centrality from j")
def graph_centrality(spark, d):
    e = edges(spark, d).select("src", "tgt", (F.col("relation") == "SUES").alias("bidirectional")).distinct()
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    nodes = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 150).alias("occurrences")).union(s.select(F.col("s_suppkey") + 1000000, F.col("s_suppkey") % 150))
    return graph.centrality(nodes, e).select("id", "degree", F.round("centrality", 6).alias("centrality"))


@query("with c as (select c_custkey as id, c_nationkey as n, lag(c_custkey) over (partition by c_nationkey order by c_custkey) as p from customer), i as (select id, n, sum(case when id - p <= 30 then 0 else 1 end) over (partition by n order by id) as g from c), k as (select id, min(id) over (partition by n, g) as community, count(*) over (partition by n, g) as size from i) select id, community from k where size > 1")
def graph_communities(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    from pyspark.sql import Window

    e = c.withColumn("tgt", F.lead("id").over(Window.partitionBy("n").orderBy("id"))).filter("tgt - id <= 30").select(F.col("id").alias("src"), "tgt")
    return graph.communities(e)


@query("""with n as (select '<node id="' || n_nationkey || '"><data key="label">' || n_name || '</data></node>' as line from nation), e as (select '<edge source="' || n_nationkey || '" target="' || (1000 + r_regionkey) || '"><data key="type">IN ' || r_name || '</data></edge>' as line from nation join region on n_regionkey = r_regionkey)
select 0 as "order", '<graphml><graph edgedefault="directed">' as line union all select 1, line from n union all select 2, line from e union all select 3, '</graph></graphml>'""")
def graph_graphml(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    e = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("src"), (F.col("r_regionkey") + 1000).alias("tgt"), F.concat(F.lit("IN "), "r_name").alias("relation"))
    return graph.graphml_rows(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), e)


_T = "case m.entity_type when 'PARTY' then 'PARTY' when 'JUDGE' then 'ATTORNEY' when 'COURT' then 'JUDGE' when 'CASE_CITATION' then 'CASE' when 'STATUTE_CITATION' then 'STATUTE' else 'CONDUCT' end"


@query(f"with {MENTIONS}, x as (select distinct doc_id, lower(trim(text)) as id, {_T} as entity_type, start // 1000 as chunk from m) select distinct a.doc_id, a.id as src, b.id as tgt, r.relation, 0.7::double as confidence from x a join x b on a.doc_id = b.doc_id and abs(a.chunk - b.chunk) <= 1 join (values ('represents', 'ATTORNEY', 'PARTY'), ('presides_over', 'JUDGE', 'CASE'), ('governs', 'STATUTE', 'CONDUCT')) r(relation, s, t) on a.entity_type = r.s and b.entity_type = r.t")
def relation_chunks(spark, d):
    t = F.col("entity_type")
    kind = F.when(t == "PARTY", "PARTY").when(t == "JUDGE", "ATTORNEY").when(t == "COURT", "JUDGE").when(t == "CASE_CITATION", "CASE").when(t == "STATUTE_CITATION", "STATUTE").otherwise("CONDUCT")
    x = found(spark, d).select("doc_id", F.lower(F.trim("text")).alias("id"), kind.alias("entity_type"), F.floor(F.col("start") / 1000).alias("chunk")).distinct()
    return relations.chunk_relations(x)


@query("with t as (select unnest(['PARTY','PLAINTIFF','ATTORNEY','LAW_FIRM','JUDGE','MOTION','BRIEF','COURT']) as t) select a.t as a, b.t as b, a.t = b.t or (a.t in ('PLAINTIFF','PARTY') and b.t in ('PLAINTIFF','PARTY')) or (a.t in ('ATTORNEY','LAW_FIRM') and b.t in ('ATTORNEY','LAW_FIRM')) or (a.t in ('MOTION','BRIEF') and b.t in ('MOTION','BRIEF')) as compatible from t a, t b")
def type_compatibility(spark, d):
    types = spark.createDataFrame([(x,) for x in ("PARTY", "PLAINTIFF", "ATTORNEY", "LAW_FIRM", "JUDGE", "MOTION", "BRIEF", "COURT")], "a string")
    return types.join(types.withColumnRenamed("a", "b")).select("a", "b", relations.compatible(F.col("a"), F.col("b")).alias("compatible"))


@query("with c as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings), m as (select label, i, avg(v) as v from c group by 1, 2), t as (select label, list(v order by i) as v from m group by 1), s as (select vec_id, t.label, list_dot_product(embedding::double[], t.v) / sqrt(list_dot_product(embedding::double[], embedding::double[])) / sqrt(list_dot_product(t.v, t.v)) as cosine from embeddings e, t) select vec_id, label as nearest, round(cosine, 6) as cosine from (select *, row_number() over (partition by vec_id order by cosine desc, label) as k from s) where k = 1")
def embedding_nearest_type(spark, d):
    """The label whose mean vector has the largest cosine with each vector, the first of equals; labels are broadcast TYPES_AT_ONCE at a time."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("t"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(dot(v, v))
    means = means.withColumn("size", size(F.col("t")))
    n, out = -(-e.agg(F.approx_count_distinct("label")).first()[0] // TYPES_AT_ONCE) or 1, None
    rows = e.select("vec_id", "v", size(F.col("v")).alias("size"))
    for k in range(n):
        types = means.filter(F.pmod(F.xxhash64("label"), F.lit(n)) == k).agg(F.collect_list(F.struct("label", "t", "size")).alias("types"))
        scored = F.transform("types", lambda t: F.struct((dot(F.col("v"), t["t"]) / F.col("size") / t["size"]).alias("c"), (-t["label"]).alias("l")))
        one = rows.join(F.broadcast(types)).select("vec_id", F.array_max(scored).alias("best"))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("vec_id").agg(F.max("best").alias("best")) if n > 1 else out
    return best.select("vec_id", (-F.col("best.l")).alias("nearest"), F.round("best.c", 6).alias("cosine"))

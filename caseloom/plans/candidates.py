"""Candidates for types without patterns: generate, filter, score, group, match to types; and search layers of chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import candidates as K
from ..functions import scoring as S
from ..operators import windows as W
from .registry import query, table
from .smart import STRIP, q, spans_sql

_TAIL = '. Judge John Smith of Acme Widgets Corp filed a Motion for Relief ("the Final Order") in Brown v. Board, 347 F.2d 483 (1954). The District Court of Ohio held under 12 Fam Code 35 that clear and convincing evidence bound the plaintiff and the defendant on appeal'
_LEGAL = f"documents as (select doc_id, case when doc_id % 2 = 0 then text || '{_TAIL}' else text end as text from main.documents)"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(_TAIL))).otherwise(F.col("text")).alias("text"))


_BASE = "case kind " + " ".join(f"when '{k}' then {v}::double" for k, v in S.CANDIDATE_BASE.items()) + " else 0.5 end"
_SURE = f"least(1.0::double, {_BASE} * case when len(string_split_regex(trim(text), '\\s+')) = 1 then 0.9::double when len(string_split_regex(trim(text), '\\s+')) > 4 then 0.85::double else 1 end * case when regexp_matches(text, '[A-Z]') then 1 else 0.8::double end * case when lower(trim(text)) in ('the', 'this', 'that', 'and', 'court', 'section') then 0.5::double else 1 end)"


#: SQL's word boundaries know ASCII letters alone: others stand there as a letter that no shape holds.
_WORDLY = r"regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1FFF}\x{3041}-\x{D7FF}\x{F900}-\x{FAFF}\x{10000}-\x{1FFFF}]', '_', 'g')"


def _shape_sql(k: str, p: str) -> str:
    m = int(k in K.MARKED)
    source = "documents" if m else f"(select doc_id, {_WORDLY} as text from documents)"
    return f"select doc_id, '{k}' as kind, start + {m} as start, stop - {m} as stop, substr(text, {m} + 1, length(text) - {2 * m}) as text from ({spans_sql(p, source)})"


CANDIDATES = "raw as (" + " union all ".join(_shape_sql(k, p) for k, p in K.SHAPES.items()) + f"), cand as (select *, {_SURE} as confidence from raw)"


def candidates(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(K.shaped(F.col("text"))).alias("c")).select("doc_id", "c.*")


@query(f"with {_LEGAL}, {CANDIDATES} select doc_id, kind, start, stop, text, round(confidence, 8) as confidence from cand where confidence >= 0.3")
def candidates_shaped(spark, d):
    return candidates(spark, d).filter("confidence >= 0.3").withColumn("confidence", F.round("confidence", 8))


_VALID = "length(trim(text)) >= 2 and length(regexp_replace(text, '[A-Za-z0-9\\s]', '', 'g')) <= 0.3 * length(text) and len(regexp_extract_all(text, '\\S+')) <= 6 and regexp_matches(text, '[A-Z0-9]')"
_KEPT = f"""ov as (select *, max(stop) over (partition by doc_id order by start, stop, kind rows between unbounded preceding and 1 preceding) as reach from cand), oi as (select *, sum(case when start < reach then 0 else 1 end) over (partition by doc_id order by start, stop, kind) as island from ov),
kept as (select * from (select *, row_number() over (partition by doc_id, island order by confidence desc, start, stop, kind) as r from oi) where r = 1)"""


def kept(spark, d):
    """The surest candidate of each group that overlaps."""
    w = Window.partitionBy("doc_id").orderBy("start", "stop", "kind")
    c = candidates(spark, d).withColumn("reach", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("island", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(w))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "island").orderBy(F.desc("confidence"), "start", "stop", "kind"))).filter("r = 1").drop("r", "reach", "island")


@query(f"with {_LEGAL}, {CANDIDATES}, {_KEPT}, s as (select *, least(1.0::double, confidence * case when length(text) > 30 then 0.9::double else 1 end + 0.05::double) as score from kept where {_VALID}) select doc_id, kind, start, stop, text, round(score, 8) as score, row_number() over (partition by doc_id order by score desc, start) as k from s where score >= 0.3")
def candidates_filtered(spark, d):
    """Overlaps resolved, invalid ones dropped, scored anew, ranked."""
    text, c = F.col("text"), F.col("confidence")
    score = F.least(F.lit(1.0), c * F.when(F.length(text) > 30, 0.9).otherwise(1.0) + 0.05)
    out = kept(spark, d).filter(K.valid(text)).withColumn("score", score).filter("score >= 0.3")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start")
    return out.withColumn("k", F.row_number().over(w)).select("doc_id", "kind", "start", "stop", "text", F.round("score", 8).alias("score"), "k")


@query(f"with {_LEGAL}, {CANDIDATES}, {_KEPT}, v as (select k.*, case when regexp_matches(lower(substr(d.text, greatest(k.start - 50, 0) + 1, k.stop + 50 - greatest(k.start - 50, 0))), 'court|judge|plaintiff|filed|held') then 0.9 else 0.5 end::double as context from kept k join documents d using (doc_id)) select doc_id, kind, start, text, round((confidence + context) / 2, 8) as score from v where length(trim(text)) >= 2 and (confidence + context) / 2 >= 0.6")
def candidates_validated(spark, d):
    """Candidates whose confidence and context together are sure enough."""
    docs = _docs(spark, d).withColumnRenamed("text", "t")
    low = F.greatest(F.col("start") - 50, F.lit(0))
    near = F.lower(F.substring(F.col("t"), low + 1, F.col("stop") + 50 - low))
    context = F.when(F.rlike(near, F.lit("court|judge|plaintiff|filed|held")), 0.9).otherwise(0.5)
    out = kept(spark, d).join(docs, "doc_id").withColumn("score", (F.col("confidence") + context) / 2)
    return out.filter((F.length(F.trim("text")) >= 2) & (F.col("score") >= 0.6)).select("doc_id", "kind", "start", "text", F.round("score", 8).alias("score"))


@query(f"with {_LEGAL}, {CANDIDATES}, {_KEPT}, n as (select d.doc_id, count(k.kind) as n from documents d left join kept k using (doc_id) group by 1) select doc_id, n, 'zero_shot,ner' || case when n > 20 then ',noun_phrase' else '' end || case when n > 50 then ',semantic' else '' end as strategies from n")
def candidate_strategies(spark, d):
    """Strategies for a text by how many candidates it has: two, a third over 20, a fourth over 50."""
    n = kept(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    c = _docs(spark, d).select("doc_id").join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.withColumn("strategies", F.concat(F.lit("zero_shot,ner"), F.when(F.col("n") > 20, ",noun_phrase").otherwise(""), F.when(F.col("n") > 50, ",semantic").otherwise("")))


_KEYS = ("court", "filed", "held", "evidence")
_SENT = rf"sen as (select doc_id, i, {STRIP.format('p[i]')} as s from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split_regex(text, '[.!?]+') as p from documents)))"
_CAP = r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*"
_GAP = "least(" + ", ".join(f"case when instr(lower(s), '{k}') > 0 then abs(instr(lower(s), lower(phrase)) - instr(lower(s), '{k}')) end" for k in _KEYS) + ")"


@query(f"with {_LEGAL}, {_SENT}, c as (select doc_id, i, s, unnest(list_distinct(regexp_extract_all(s, '{_CAP}'))) as phrase from sen where length(s) >= 10 and regexp_matches(lower(s), '{'|'.join(_KEYS)}')) select doc_id, i::int as sentence, phrase, round(1 - {_GAP} / length(s), 6)::double as proximity from c")
def candidates_by_context(spark, d):
    """Capitalised phrases of sentences that hold a keyword, with how near it stands."""
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", r"[.!?]+", -1)).alias("i", "s")).select("doc_id", (F.col("i") + 1).alias("sentence"), W.stripped(F.col("s")).alias("s"))
    rows = rows.filter((F.length("s") >= 10) & F.rlike(F.lower("s"), F.lit("|".join(_KEYS))))
    rows = rows.select("doc_id", "sentence", "s", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(_CAP), F.lit(0)))).alias("phrase"))
    return rows.select("doc_id", "sentence", "phrase", F.round(K.keyword_proximity(F.col("s"), F.col("phrase"), _KEYS), 6).alias("proximity"))


_TYPES = (("JUDGE_TITLE", ["judge", "held"], ["Judge Jane Doe"]), ("COURT_BODY", ["court", "appeal"], ["District Court", "Supreme Court"]), ("CORPORATION", ["filed", "acme"], ["Acme Corp"]))
_TYPES_SQL = "types as (select * from (values " + ", ".join(f"('{t}', {k}, {e})" for t, k, e in _TYPES) + ") t(entity_type, keywords, examples))"
_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda z: z <> ''))"
_JACCARD = f"len(list_intersect({_WORDS.format('phrase')}, {_WORDS.format('y')})) / len(list_distinct(list_concat({_WORDS.format('phrase')}, {_WORDS.format('y')})))"
_PHRASES = f"ph as (select doc_id, start, text as phrase, near from (select k.doc_id, k.start, k.text, substr(d.text, greatest(k.start - 40, 0) + 1, k.stop + 40 - greatest(k.start - 40, 0)) as near from kept k join documents d using (doc_id)))"
_SCORE = f"""least(1.0::double, 0.3::double * len(list_filter(keywords, lambda k: contains(lower(near), k))) / len(keywords) + 0.3::double * list_max(list_transform(examples, lambda y: {_JACCARD})) + case when regexp_matches(phrase, '^[A-Z]') then 0.2::double else 0 end + case when regexp_matches(phrase, '^(?:Judge|Justice|Mr|Ms|Mrs|Dr)\\b') then 0.2::double else 0 end
 + case when regexp_matches(lower(entity_type), 'person|judge|attorney') and regexp_matches(phrase, '^(?:Judge|Justice|Mr|Ms|Mrs|Dr)\\b') then 0.2::double else 0 end + case when contains(lower(entity_type), 'court') and contains(lower(phrase), 'court') then 0.3::double else 0 end + case when regexp_matches(lower(entity_type), 'corporation|llc') and regexp_matches(lower(phrase), 'inc|corp|llc|ltd') then 0.3::double else 0 end)"""


@query(f"with {_LEGAL}, {CANDIDATES}, {_KEPT}, {_PHRASES}, {_TYPES_SQL}, s as (select doc_id, start, phrase, entity_type, {_SCORE} as score from ph, types where regexp_matches(phrase, '\\S')) select doc_id, start, phrase, entity_type, round(score, 6) as score from (select *, row_number() over (partition by doc_id, start order by round(score, 9) desc, entity_type) as r from s where score >= 0.4) where r = 1")
def candidate_types(spark, d):
    """The type, of those without patterns, that each candidate fits best; types are a constant, broadcast."""
    docs = _docs(spark, d).withColumnRenamed("text", "t")
    low = F.greatest(F.col("start") - 40, F.lit(0))
    ph = kept(spark, d).join(docs, "doc_id").select("doc_id", "start", F.col("text").alias("phrase"), F.substring(F.col("t"), low + 1, F.col("stop") + 40 - low).alias("near"))
    types = spark.createDataFrame([(t, k, e) for t, k, e in _TYPES], "entity_type string, keywords array<string>, examples array<string>")
    s = ph.filter(F.rlike("phrase", F.lit(r"\S"))).join(F.broadcast(types)).withColumn("score", K.phrase_score(F.col("phrase"), F.col("near"), F.col("entity_type"), F.col("keywords"), F.col("examples"))).filter("score >= 0.4")
    w = Window.partitionBy("doc_id", "start").orderBy(F.desc(F.round("score", 9)), "entity_type")
    return s.withColumn("r", F.row_number().over(w)).filter("r = 1").select("doc_id", "start", "phrase", "entity_type", F.round("score", 6).alias("score"))


@query(f"with {_LEGAL}, {CANDIDATES}, {_KEPT}, w as (select distinct doc_id, lower(trim(text)) as t from kept), p as (select a.doc_id, a.t as a, b.t as b from w a join w b on a.doc_id = b.doc_id and a.t <= b.t) select doc_id, a, b from p where a = b or len(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')})) / len(list_distinct(list_concat({_WORDS.format('a')}, {_WORDS.format('b')}))) > 0.7")
def candidates_alike(spark, d):
    """Pairs of a document's candidate texts that are one or share over .7 of their words; they meet over shared words."""
    w = kept(spark, d).select("doc_id", F.lower(F.trim("text")).alias("t")).distinct()
    words = F.array_distinct(F.filter(F.split("t", r"\s+"), lambda x: x != ""))
    rows = w.withColumn("w", words)
    each = rows.select("doc_id", "t", "w", F.explode("w").alias("word"))
    side = lambda n: each.select("doc_id", "word", F.col("t").alias(n), F.col("w").alias(f"{n}w"))
    pairs = side("a").join(side("b"), ["doc_id", "word"]).filter("a <= b").dropDuplicates(["doc_id", "a", "b"])
    share = F.size(F.array_intersect("aw", "bw")) / F.size(F.array_union("aw", "bw"))
    return pairs.filter((F.col("a") == F.col("b")) | (share > 0.7)).select("doc_id", "a", "b").union(rows.filter(F.size("w") == 0).select("doc_id", "t", "t"))


@query(f"with {_LEGAL}, {CANDIDATES}, {_KEPT} select doc_id, 'unpatterned' as part, kind as type, count(*) as n from kept group by 1, 3 union all select doc_id, 'patterned', 'number', len(regexp_extract_all(text, '[0-9]{{3,}}')) from documents where regexp_matches(text, '[0-9]{{3,}}')")
def candidates_and_patterns(spark, d):
    """Patterned and unpatterned results as one list."""
    a = kept(spark, d).groupBy("doc_id", F.lit("unpatterned").alias("part"), F.col("kind").alias("type")).agg(F.count("*").alias("n"))
    n = F.size(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0)))
    return a.unionAll(_docs(spark, d).withColumn("n", n).filter("n > 0").select("doc_id", F.lit("patterned"), F.lit("number"), F.col("n").cast("long")))


# --- search layers ---


def _all(p: str) -> str:
    return f"regexp_extract_all({_WORDLY}, '{q(p)}')"


_ENTITIES = f"list_sort(list_distinct(list_concat({_all(K.PERSON)}, {_all(K.SHAPES['organization'])}, {_all(K.COURT)})))[1:20]"
_CONTEXTUAL = f"list_sort(list_distinct(list_concat(list_transform({_all(K.TERM)}[1:10], lambda x: lower(x)), list_transform({_all(K.COURT)}[1:5], lambda x: lower(x)), list_transform({_all(K.STATUTE)}[1:5], lambda x: lower(regexp_replace(x, '[^\\w\\s]', '', 'g'))))))[1:20]"
_SEARCH = f"list_sort(list_distinct(list_concat(list_transform({_ENTITIES}[1:10], lambda x: lower(trim(regexp_replace(x, '{K.SUFFIX}', '', 'g')))), list_transform({_all(K.STANDARD)}[1:5], lambda x: lower(x)), {_CONTEXTUAL})))[1:30]"


@query(f"with {_LEGAL} select doc_id, array_to_string({_ENTITIES}, '|') as entities, array_to_string({_CONTEXTUAL}, '|') as contextual, array_to_string({_SEARCH}, '|') as keywords from documents")
def layer_keywords(spark, d):
    """Entities, contextual keywords and search keywords of each text."""
    t, told = F.col("text"), lambda a: F.array_join(a, "|")
    return _docs(spark, d).select("doc_id", told(K.entities(t)).alias("entities"), told(K.contextual_keywords(t)).alias("contextual"), told(K.search_keywords(t)).alias("keywords"))


_CHUNKS = "ch as (select doc_id, k::int as chunk, substr(text, k * 800 + 1, 800) as text from (select doc_id, text, unnest(range(0, ceil(length(text) / 800.0)::bigint)) as k from documents))"
_LAYERED = f"ly as (select doc_id, chunk, text, {_ENTITIES} as e, 'Document: ' || doc_id || chr(10) || 'Type: chunk' || chr(10) || '## ' || chunk || chr(10) || text as contextual from ch)"


def _chunks(spark, d):
    last = F.ceil(F.length("text") / 800).cast("int") - 1
    c = _docs(spark, d).filter(F.length("text") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    return c.select("doc_id", "chunk", F.substring(F.col("text"), F.col("chunk") * 800 + 1, F.lit(800)).alias("text"))


def _layered(spark, d):
    head = F.concat(F.lit("Document: "), F.col("doc_id"), F.lit("\nType: chunk\n## "), F.col("chunk"), F.lit("\n"), F.col("text"))
    return _chunks(spark, d).select("doc_id", "chunk", "text", K.entities(F.col("text")).alias("e"), head.alias("contextual"))


@query(f"with {_LEGAL}, {_CHUNKS}, {_LAYERED} select doc_id, chunk, md5(text) as original, md5(contextual) as contextual, md5(array_to_string(e, '|') || ' ' || lower(text)) as search, md5(lower(regexp_replace(text, '\\s+', ' ', 'g'))) as cleaned, round(least(1.0, case when length(contextual) > length(text) * 1.5 then 0.3 else 0 end + case when len(e) > 5 then 0.3 when len(e) > 2 then 0.2 else 0 end + 0.2 + 0.2), 6)::double as quality from ly")
def layer_four(spark, d):
    """The four layers of each chunk and how much the contextual one adds."""
    quality = K.enhancement_quality(F.col("text"), F.col("contextual"), F.size("e"))
    search = F.concat(F.array_join("e", "|"), F.lit(" "), F.lower("text"))
    return _layered(spark, d).select("doc_id", "chunk", F.md5("text").alias("original"), F.md5("contextual").alias("contextual"), F.md5(search).alias("search"), F.md5(F.lower(F.regexp_replace("text", r"\s+", " "))).alias("cleaned"), F.round(quality, 6).alias("quality"))


@query(f"with {_LEGAL}, {_CHUNKS}, {_LAYERED}, b as (select doc_id, chunk, flatten(list(e[1:3]) over (partition by doc_id order by chunk rows between 3 preceding and 1 preceding)) as before from ly) select doc_id, chunk, coalesce(array_to_string(list_sort(list_distinct(before))[1:5], '|'), '') as previous from b")
def layer_previous(spark, d):
    """Entities of the three chunks before, which a chunk's context names."""
    w = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(-3, -1)
    before = F.flatten(F.collect_list(F.slice("e", 1, 3)).over(w))
    return _layered(spark, d).select("doc_id", "chunk", F.array_join(F.slice(F.array_sort(F.array_distinct(before)), 1, 5), "|").alias("previous"))

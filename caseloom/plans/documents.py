"""Size, edge cases, routing and kinds of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sizing
from .registry import query, table

WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"
CATEGORY = "case when length(text) <= 5000 then 'very_small' when length(text) <= 50000 then 'small' when length(text) <= 150000 then 'medium' else 'large' end"
NOT_TEXT = r"(length(text) > 0 and length(regexp_replace(substr(text, 1, 1000), '[^\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) / least(length(text), 1000) > 0.05)"
EDGE = rf"case when regexp_replace(text, '\s', '', 'g') = '' then 'empty_document' when length(text) < 50 then 'too_small' when {NOT_TEXT} then 'invalid_document' end"
SIZED = f"select doc_id, text, length(text) as chars, (length(text) // 4)::int as tokens, {CATEGORY} as size_category, {EDGE} as edge from documents"


@query(rf"select doc_id, length(text) as chars, (length(text) // 4)::int as tokens, {WORDS} as words, case when text = '' then 0 else len(string_split(text, chr(10))) end as lines, 0 as pages, {CATEGORY} as size_category from documents")
def doc_size(spark, d):
    return sizing.with_size(table(spark, d, "documents")).select("doc_id", "chars", "tokens", "words", "lines", "pages", "size_category")


@query(f"with s as ({SIZED}) select size_category, count(*) as n, sum(tokens)::bigint as tokens, round(sum(case size_category when 'very_small' then 0.5 when 'small' then 1.0 when 'medium' then least(4.0, (chars // 32000 + 1) * 0.85) else (chars // 32000 + 1) end), 4) as est_seconds, round(sum(case size_category when 'very_small' then 5810.0 when 'small' then 30838.0 else (chars // 32000 + 1) * 30838.0 end * 0.000656 / 1000), 6) as est_cost from s group by 1")
def doc_size_estimates(spark, d):
    sized = sizing.with_size(table(spark, d, "documents"))
    return sized.groupBy("size_category").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.sum("est_seconds"), 4).alias("est_seconds"), F.round(F.sum("est_cost"), 6).alias("est_cost"))


@query(rf"select doc_id, {EDGE} as edge_case, not {NOT_TEXT} as is_text from documents")
def doc_edge_cases(spark, d):
    return table(spark, d, "documents").select("doc_id", sizing.edge_case(F.col("text")).alias("edge_case"), sizing.is_text(F.col("text")).alias("is_text"))


def _route_sql(branch: str) -> str:
    return f"""with s as ({SIZED}), r as (select *, coalesce(edge, {branch}) as b, case when tokens <= 8000 then 1 else tokens // 7500 + 1 end as n from s),
    q as (select doc_id, b, n, tokens, case when b in ('small_chunked', 'medium', 'large') then 'three_wave_chunked' when b like 'four_wave%' then 'four_wave' else b end as strategy,
      case when b in ('small_chunked', 'medium', 'large') then n else 0 end as num_chunks,
      case when b in ('empty_document', 'invalid_document') then 0 when b = 'single_pass' then tokens + 6000 when b in ('three_wave', 'small_chunked') then tokens + 21596 when b like 'four_wave%' then tokens + 51000 when b = 'eight_wave_fallback' then tokens + 26900 else tokens end as est_tokens,
      case when b in ('empty_document', 'too_small', 'invalid_document') then 0.0 when b = 'single_pass' then 0.5 when b = 'three_wave' then 1.0 when b = 'large' then n when b in ('small_chunked', 'medium') then n * 0.85 when b = 'four_wave_graph' then 180.0 when b = 'four_wave_asked' then 150.0 when b = 'four_wave_large' then 200.0 else 2.0 end as est_duration,
      case when b in ('empty_document', 'too_small', 'invalid_document') then 0.0 when b = 'single_pass' then 0.87 when b = 'three_wave' then 0.90 when b = 'small_chunked' then 0.89 when b = 'medium' then 0.91 when b in ('large', 'four_wave_asked') then 0.92 when b like 'four_wave%' then 0.95 else 0.93 end as accuracy from r),
    c as (select *, case when accuracy = 0 then 0.0 when b = 'single_pass' then 0.0038 when b = 'three_wave' then 0.0159 when b in ('small_chunked', 'medium', 'large') then n * 0.0159 when b like 'four_wave%' then est_tokens::double / 1000 * 0.00075::double else 0.0254 end as est_cost from q)"""


_SMALL = "case when tokens + 21596 <= 30768 then 'three_wave' else 'small_chunked' end"
_BY_SIZE = f"case size_category when 'very_small' then 'single_pass' when 'small' then {_SMALL} else size_category end"
_PLAIN = f"case when chars > 20000 then 'four_wave_large' else {_BY_SIZE} end"
_COLUMNS = "select doc_id, strategy, num_chunks, est_tokens, round(est_duration, 6)::double as est_duration, round(est_cost, 8)::double as est_cost, accuracy::double as accuracy from c"


def _routed(df):
    return df.select("doc_id", "strategy", "num_chunks", "est_tokens", F.round("est_duration", 6).alias("est_duration"), F.round("est_cost", 8).alias("est_cost"), "accuracy")


@query(f"{_route_sql(_PLAIN)} {_COLUMNS}")
def doc_route(spark, d):
    return _routed(sizing.route(table(spark, d, "documents")))


@query(f"{_route_sql('''case when chars > 5000 then 'four_wave_asked' else ''' + _PLAIN + ' end')} {_COLUMNS}")
def doc_route_relationships(spark, d):
    return _routed(sizing.route(table(spark, d, "documents"), relationships=True))


@query(f"{_route_sql(chr(39) + 'four_wave_graph' + chr(39))} {_COLUMNS}")
def doc_route_graph(spark, d):
    return _routed(sizing.route(table(spark, d, "documents"), graph=True))


for _name, _branch in {"single_pass": "'single_pass'", "three_wave": _SMALL, "four_wave": "'four_wave_asked'", "three_wave_chunked": f"case when size_category in ('medium', 'large') then 'medium' else {_SMALL} end", "eight_wave_fallback": "'eight_wave_fallback'", "unheard_of": _BY_SIZE}.items():
    query(f"{_route_sql(_branch)} {_COLUMNS}", f"doc_route_override_{_name}")(lambda spark, d, _name=_name: _routed(sizing.route(table(spark, d, "documents"), override=_name)))


@query(f"{_route_sql(_PLAIN)} select strategy, count(*) as n, sum(est_tokens)::bigint as tokens, round(sum(est_cost), 4)::double as cost, round(sum(est_duration), 4)::double as seconds, sum(num_chunks)::bigint as chunks from c group by 1")
def doc_route_summary(spark, d):
    routed = sizing.route(table(spark, d, "documents"))
    return routed.groupBy("strategy").agg(F.count("*").alias("n"), F.sum("est_tokens").alias("tokens"), F.round(F.sum("est_cost"), 4).alias("cost"), F.round(F.sum("est_duration"), 4).alias("seconds"), F.sum("num_chunks").alias("chunks"))


@query(f"{_route_sql(_PLAIN)}, w as (select doc_id, list_filter([case when est_tokens > 32768 then 'context' end, case when est_cost > 1 then 'cost' end, case when est_duration > 30 then 'duration' end, case when est_tokens = 0 and strategy not in ('empty_document', 'invalid_document') then 'tokens' end], lambda x: x is not null) as w from c) select doc_id, array_to_string(w, ',') as warnings, len(w) = 0 as is_valid from w")
def doc_route_validate(spark, d):
    routed = sizing.route(table(spark, d, "documents")).withColumn("w", sizing.decision_warnings())
    return routed.select("doc_id", F.array_join("w", ",").alias("warnings"), (F.size("w") == 0).alias("is_valid"))


_KINDS = "[null, 'court_opinion', 'contract', 'statute'][doc_id % 4 + 1]"


@query(f"select doc_id, case when t > 0 and t < 1000 then 'regex' when t > 0 and t < 5000 then 'unified' when a > 0.9 then 'multipass' when k = 'court_opinion' then 'multipass' when k = 'contract' then 'ai_enhanced' when k = 'statute' then 'unified' when n > 100000 then 'multipass' when n > 20000 then 'ai_enhanced' else 'unified' end as strategy from (select doc_id, length(text) as n, (doc_id % 7) * 900 as t, (doc_id % 5) * 0.24 as a, {_KINDS} as k from documents)")
def doc_optimal_strategy(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 4 == 1, "court_opinion").when(i % 4 == 2, "contract").when(i % 4 == 3, "statute")
    return table(spark, d, "documents").select("doc_id", sizing.optimal_strategy(kind, F.length("text"), (i % 7) * 900, (i % 5) * 0.24).alias("strategy"))


@query("select strategy, case strategy when 'multipass' then 'legal' when 'ai_enhanced' then 'semantic' when 'unified' then 'hybrid' when 'regex_only' then 'simple' else 'hybrid' end as chunking from (values ('multipass'), ('ai_enhanced'), ('unified'), ('regex_only'), ('other')) t(strategy)")
def chunking_strategy_map(spark, d):
    names = spark.createDataFrame([(x,) for x in ("multipass", "ai_enhanced", "unified", "regex_only", "other")], "strategy string")
    return names.select("strategy", sizing.chunking_strategy(F.col("strategy")).alias("chunking"))


_BLEND = rf"(case when text = '' then 0 else floor(0.4::double * (length(text) / 4.0::double) + 0.6::double * ({WORDS} / 0.75::double)) + length(regexp_replace(text, '[A-Za-z0-9\s]', '', 'g')) // 10 end)::int"


@query(rf"select doc_id, {_BLEND} as est_tokens, case when {_BLEND} < 500 then 'small' when {_BLEND} < 2000 then 'medium' when {_BLEND} < 10000 then 'large' else 'xlarge' end as tier from documents")
def doc_token_tier(spark, d):
    est = table(spark, d, "documents").select("doc_id", sizing.blended_tokens(F.col("text")).alias("est_tokens"))
    return est.withColumn("tier", sizing.token_tier(F.col("est_tokens")))


@query("select doc_id, t as tokens, case when t >= 32768 then null else least(2000, 32768 - t) end as completion, case when t <= 400 then t else ceil(t / ceil(t / 360.0::double) * 1.1::double) end::int as chunk_tokens, least(100.0 * 2 ** (doc_id % 10), 10000.0)::double as backoff_ms, round(t / 19000.0 + 512 / 150.0, 6)::double as est_seconds from (select doc_id, (length(text) // 4)::int as t from documents)")
def doc_token_budget(spark, d):
    t = F.floor(F.length("text") / 4).cast("int")
    return table(spark, d, "documents").select("doc_id", t.alias("tokens"), sizing.prompt_budget(t, F.lit(2000)).alias("completion"), sizing.overlapped_chunk_size(t, 400).alias("chunk_tokens"), sizing.backoff_ms(F.col("doc_id") % 10 + 1).alias("backoff_ms"), F.round(t / 19000 + F.lit(512 / 150), 6).alias("est_seconds"))


def _keyword_case(low: str) -> str:
    score = {k: " + ".join(f"contains({low}, '{w}')::int" for w in words) for k, words in T.DOCUMENT_TYPES.items()}
    inner = ", ".join(f"{s} as {k}" for k, s in score.items())
    return f"select doc_id, case when greatest(contract, opinion, statute, brief) < 2 then 'unknown' when contract = greatest(contract, opinion, statute, brief) then 'contract' when opinion = greatest(contract, opinion, statute, brief) then 'opinion' when statute = greatest(contract, opinion, statute, brief) then 'statute' else 'brief' end as document_type from (select doc_id, {inner} from documents)"


@query(_keyword_case("lower(substr(text, 1, 5000))"))
def doc_type(spark, d):
    return table(spark, d, "documents").select("doc_id", T.document_type(F.col("text")).alias("document_type"))


def _any_count(patterns) -> str:
    return " + ".join(f"regexp_matches(low, '{p}')::int" for p in patterns)


@query(f"select page_id, case when h >= 3 then 'high' when h >= 1 or m >= 3 then 'medium' else 'low' end as complexity from (select page_id, {_any_count(T.HIGH_COMPLEXITY)} as h, {_any_count(T.MEDIUM_COMPLEXITY)} as m from (select page_id, lower(html) as low from pages))")
def page_complexity(spark, d):
    return table(spark, d, "pages").select("page_id", T.page_complexity(F.col("html")).alias("complexity"))


@query(r"select conv_id, turn, case when regexp_matches(t, '^#{1,6}\s') or (length(t) < 100 and upper(t) = t and regexp_matches(t, '[A-Z]')) then 'heading' when regexp_matches(t, '(?m)^\s*(?:[-*•]|\d+[.)])\s+') then 'list' when contains(t, '```') then 'code' when len(string_split(t, '|')) > 3 then 'table' else 'text' end as content_type from (select conv_id, turn, trim(text) as t from conversations)")
def content_types(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.content_type(F.col("text")).alias("content_type"))


_LINES = r"select doc_id, i, l from (select doc_id, unnest(range(1, len(s) + 1)) as i, unnest(s) as l from (select doc_id, string_split(text, chr(10)) as s from documents))"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "l")).withColumn("i", F.col("i") + 1)


_ABBR = "[" + ", ".join(f"'{x}'" for x in T.LEGAL_ABBREVIATIONS) + "]"
_LEGAL = " or ".join(f"regexp_matches(l, '{p}')" for p in T.LEGAL_ENTITY)


@query(rf"""with l as ({_LINES}), a as (select doc_id, i, l, regexp_replace(trim(regexp_replace(lower(l), '[\t\n\x0b\f\r ]+', ' ', 'g')), '''s\b', '', 'g') as t, {_LEGAL} as legal from l),
b as (select doc_id, i, case when list_contains({list(T.STOP_WORDS)}, string_split(t, ' ')[1]) and not legal then array_to_string(string_split(t, ' ')[2:], ' ') else t end as t from a)
select doc_id, i::int as i, array_to_string(list_transform(string_split(t, ' '), lambda x: case when len(list_filter({_ABBR}, lambda y: contains(lower(x), y))) > 0 then x else regexp_replace(x, '[^0-9A-Za-z_\t\n\x0b\f\r \-]', '', 'g') end), ' ') as normal from b""")
def text_normal(spark, d):
    return _lines(spark, d).select("doc_id", "i", T.normal(F.col("l")).alias("normal"))


@query(rf"with l as ({_LINES}) select doc_id, i::int as i, {'regexp_replace(' * len(T.CITATION_FORMS)}l{''.join(chr(44) + ' ' + chr(39) + p + chr(39) + ', ' + chr(39) + r.replace('$', chr(92)) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')' for p, r in T.CITATION_FORMS)} as standard, {'regexp_replace(' * len(T.ABBREVIATIONS)}l{''.join(chr(44) + ' ' + chr(39) + p + chr(39) + ', ' + chr(39) + r + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')' for p, r in T.ABBREVIATIONS)} as expanded from l")
def text_citations(spark, d):
    return _lines(spark, d).select("doc_id", "i", T.standard_citations(F.col("l")).alias("standard"), T.expand_abbreviations(F.col("l")).alias("expanded"))


@query(r"""with w as (select conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as w from conversations),
p as (select a.conv_id, a.turn, a.w as x, b.w as y from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
select conv_id, turn, round(case when len(x) = 0 or len(y) = 0 then 0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end, 6)::double as similarity from p""")
def turn_similarity(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("text"), F.col("next")), 6).alias("similarity"))


@query("select conv_id, turn, case when low in ('he','she','it','they','him','her','them','his','hers','its','their') then 'pronoun' when starts_with(low, 'the ') then 'definite' when regexp_matches(low, '''s$') then 'possessive' when regexp_matches(t, '^(?:Mr|Mrs|Ms|Dr|Hon|Judge|Justice)\\.?\\s') then 'title' when regexp_matches(t, '^[A-Z]{2,6}$') then 'acronym' when low in ('plaintiff','defendant','appellant','appellee','petitioner','respondent','court') then 'role' when turn % 2 = 0 and not contains(t, ' ') then 'last_name' else 'full_name' end as reference from (select conv_id, turn, trim(string_split(text, ',')[1]) as t, lower(trim(string_split(text, ',')[1])) as low from conversations)")
def reference_types(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", T.reference_type(F.split("text", ",")[0], F.when(F.col("turn") % 2 == 0, "PERSON").otherwise("PARTY")).alias("reference"))

"""Windows of context around mentions, at every level, and scores of contexts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import context as X
from ..operators import windows as W
from .mentions import MENTIONS, found
from .registry import query, table
from .scores import _MAPPED
from .smart import STRIP, q, spans_sql

#: Documents whose third space is a paragraph break, and whose fifth begins a titled section: the tables have neither.
_TITLES = ("II. STATEMENT OF FACTS", "SECTION 4", "CLAIMS AND RELIEF:")
_SHAPED = rf"documents as (select doc_id, regexp_replace(regexp_replace(text, '^(\S+ \S+ \S+ \S+) ', '\1' || chr(10) || ['{_TITLES[0]}', '{_TITLES[1]}', '{_TITLES[2]}'][doc_id % 3 + 1] || chr(10)), '([.!?]) ', '\1' || chr(10) || ' ' || chr(10), 'g') as text from main.documents)"


def _shaped(spark, d):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % 3 + 1).cast("int"))
    first = F.regexp_extract("text", r"^\S+ \S+ \S+ \S+ ", 0)
    n = F.length(first)
    cut = F.when(n > 0, F.concat(F.left(first, n - 1), F.lit("\n"), title, F.lit("\n"), F.substring(F.col("text"), n + 1, F.length("text")))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(cut, r"([.!?]) ", "$1\n \n").alias("text"))


def _mentions(spark, d):
    from ..operators.matching import mentions

    return mentions(_shaped(spark, d), most=None).select("doc_id", "rank", "start", "stop", "entity_type", "text")


_PARAGRAPHS = rf"""pb as ({spans_sql(r"\n\s*\n")}), pl as (select doc_id, string_split_regex(text, '\n\s*\n') as p from documents),
pr as (select doc_id, k, p[k] as t from (select doc_id, p, unnest(range(1, len(p) + 1)) as k from pl)),
ps as (select pr.doc_id, k, (coalesce(pb.stop, 0) + length(regexp_extract(t, '^\s*')))::int as start, length({STRIP.format('t')}) as n from pr left join pb on pb.doc_id = pr.doc_id and pb.i = k - 1),
pp as (select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as i, start, (start + n)::int as stop from ps where n > 0)"""


@query(f"with {_SHAPED}, {MENTIONS}, {_PARAGRAPHS}, w as (select *, min(start) over v as first, max(stop) over v as last from pp window v as (partition by doc_id order by i rows between 1 preceding and 1 following)) select m.doc_id, m.rank, m.start, w.i as segment, w.first, w.last, md5(substr(text_, w.first + 1, w.last - w.first)) as win from m join w on m.doc_id = w.doc_id and m.start >= w.start and m.start < w.stop join (select doc_id, text as text_ from documents) d on d.doc_id = m.doc_id")
def context_paragraphs(spark, d):
    """The paragraph in which each mention begins, with one on either side."""
    docs = _shaped(spark, d)
    hit = W.within(_mentions(spark, d), W.paragraphs(docs), 1).join(docs.withColumnRenamed("text", "t"), "doc_id")
    return hit.select("doc_id", "rank", "start", "segment", "first", "last", F.md5(F.substring(F.col("t"), F.col("first") + 1, F.col("last") - F.col("first"))).alias("win"))


_SECTIONS = rf"""sl as (select doc_id, k, s[k] as line, {STRIP.format('s[k]')} as bare from (select doc_id, s, unnest(range(1, len(s) + 1)) as k from (select doc_id, string_split(text, chr(10)) as s from documents))),
sh as (select *, regexp_matches(bare, '{q(W.HEADER)}') as header, (sum(length(line) + 1) over (partition by doc_id order by k) - length(line) - 1)::int as pos from sl),
sg as (select *, count_if(header) over (partition by doc_id order by k) as s from sh),
st as (select doc_id, s, max(case when header then bare end) as title, min(case when not header then pos end) as start, max(case when not header then pos + length(line) end)::int as stop, bool_or(not header and bare <> '') as filled from sg group by 1, 2),
se as (select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as i, coalesce(title, 'Introduction') as title, start, stop, count(*) over (partition by doc_id) as sections from st where filled)"""


@query(f"with {_SHAPED}, {MENTIONS}, {_SECTIONS} select m.doc_id, m.rank, m.start, i as segment, title, se.start as first, se.stop as last, sections from m join se on m.doc_id = se.doc_id and m.start >= se.start and m.start < se.stop")
def context_sections(spark, d):
    """The section in which each mention begins, its title and how many there are."""
    s = W.sections(_shaped(spark, d)).withColumn("sections", F.count("*").over(Window.partitionBy("doc_id")))
    return W.within(_mentions(spark, d), s).select("doc_id", "rank", "start", "segment", "title", "first", "last", "sections")


_TITLED = "case " + " ".join(f"when contains(lower(title), '{k}') then '{v}'" for k, v in W.SECTION_TITLES) + " end"


@query(f"with {_SHAPED}, {_SECTIONS} select doc_id, i, title, {_TITLED} as context, case when {_TITLED} is null then 0 else 0.7 end::double as confidence from se")
def context_section_types(spark, d):
    """The context that a section's title tells of, with confidence .7."""
    low, out = F.lower("title"), None
    for k, v in W.SECTION_TITLES:
        test = F.contains(low, F.lit(k))
        out = F.when(test, v) if out is None else out.when(test, v)
    return W.sections(_shaped(spark, d)).select("doc_id", "i", "title", out.alias("context")).withColumn("confidence", F.when(F.col("context").isNull(), 0.0).otherwise(0.7))


_TOK = q(W.TOKEN)


@query(rf"""with {MENTIONS}, a as (select distinct doc_id, text from m), t as (select doc_id, regexp_extract_all(text, '{_TOK}') as t from documents), j as (select doc_id, t, chr(1) || array_to_string(t, chr(1)) || chr(1) as joined from t),
l as (select a.doc_id, a.text, t, joined, len(regexp_extract_all(a.text, '{_TOK}')) as n, instr(joined, chr(1) || array_to_string(regexp_extract_all(a.text, '{_TOK}'), chr(1)) || chr(1)) as p from a join j using (doc_id)),
f as (select *, length(regexp_replace(left(joined, p), '[^\x01]+', '', 'g')) - 1 as first from l where p > 0)
select doc_id, md5(text) as text, first::int as first, n, md5(array_to_string(t[greatest(first - 10, 0) + 1:first + n + 10], ' ')) as win from f""")
def context_tokens(spark, d):
    """Ten tokens on either side of the first occurrence of each mention's text."""
    rows = W.token_windows(found(spark, d), table(spark, d, "documents"), 10)
    return rows.select("doc_id", F.md5("text").alias("text"), "first", "n", F.md5("window").alias("win"))


@query(rf"with {MENTIONS}, t as (select doc_id, length(text) as chars, len(regexp_extract_all(text, '[^.!?]+[.!?]*\s*')) as sentences, len(regexp_extract_all(text, '{_TOK}')) as tokens from documents) select doc_id, rank, start, stop, chars, sentences, tokens from m join t using (doc_id)")
def context_document(spark, d):
    """The whole document as a mention's window: its length, sentences and tokens, counted once a document."""
    size = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    t = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"), size(r"[^.!?]+[.!?]*\s*").alias("sentences"), size(W.TOKEN).alias("tokens"))
    return found(spark, d).select("doc_id", "rank", "start", "stop").join(t, "doc_id")


_SENT = rf"""s as (select doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*\s*') as w, string_split_regex(text, '[^.!?]+[.!?]*\s*') as p from documents), t as (select doc_id, w, list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)) as b from s),
j as (select m.doc_id, m.rank, m.start, m.entity_type, w, len(list_filter(b, lambda x: x <= m.start)) as pos from m join t using (doc_id)), win as (select doc_id, rank, start, entity_type, array_to_string(w[greatest(pos - 1, 1):pos + 1], '') as win from j)"""


@query(rf"with {MENTIONS}, {_SENT}, x as (select *, len(regexp_extract_all(win, '[^.!?]+[.!?]*\s*')) as n, {STRIP.format('win')} as bare from win) select doc_id, rank, start, round(greatest(0, 1 - case when regexp_matches(win, '^[A-Z]') then 0 else 0.2 end - case when regexp_matches(bare, '[.!?]\z') then 0 else 0.2 end), 6)::double as completeness, case when n > 1 then least(1.0, n / 5) else 0.5 end::double as coherence, length(win) as chars from x")
def context_quality(spark, d):
    """How whole a sentence window is, and how many sentences it holds."""
    w = X.sentence_windows(found(spark, d), table(spark, d, "documents"))
    n = F.size(F.regexp_extract_all("window", F.lit(r"[^.!?]+[.!?]*\s*"), F.lit(0)))
    whole = 1 - F.when(F.rlike("window", F.lit("^[A-Z]")), 0.0).otherwise(0.2) - F.when(F.rlike(W.stripped(F.col("window")), F.lit(r"[.!?]\z")), 0.0).otherwise(0.2)
    return w.select("doc_id", "rank", "start", F.round(F.greatest(F.lit(0.0), whole), 6).alias("completeness"), F.when(n > 1, F.least(F.lit(1.0), n / 5)).otherwise(0.5).alias("coherence"), F.length("window").alias("chars"))


_SIGNALS = rf"""{_MAPPED}, pats as (select primary_context as ctx, list_distinct(flatten(list(indicators))) as words from x group by 1),
hits as (select win.doc_id, win.rank, win.start, win.entity_type, lower(win.win) as low, ctx, (list_sum(list_transform(words, lambda k: (length(lower(win.win)) - length(replace(lower(win.win), k, ''))) // length(k))))::bigint as n from win, pats),
tot as (select doc_id, rank, start, any_value(entity_type) as entity_type, any_value(low) as low, sum(n)::bigint as total, max(n) as best, arg_max(ctx, n * 1000 - length(ctx)) as ctx from hits where n > 0 group by 1, 2, 3),
signal as (select tot.*, least(1.0, best / total + case when x.primary_context = tot.ctx then 0.2 else 0 end + 0.05 * coalesce(len(list_filter(near, lambda k: contains(low, k))), 0))::double as confidence, coalesce(x.primary_context = tot.ctx, false) as matches, x.boost from tot left join x using (entity_type))"""


def _signals(spark, d):
    table_ = X.mappings(spark)
    windows = X.sentence_windows(found(spark, d), table(spark, d, "documents")).select("doc_id", "rank", "start", "entity_type", F.lower("window").alias("low"))
    return X.pattern_signals(windows, table_)


@query(rf"with {MENTIONS}, {_SENT}, {_SIGNALS} select doc_id, rank, start, ctx as context, total, round(confidence, 6) as confidence, matches from signal")
def context_signals(spark, d):
    """The context whose words a mention's window holds most, surer if it is expected of the type and for words near by."""
    return _signals(spark, d).select("doc_id", "rank", "start", "context", "total", F.round("confidence", 6).alias("confidence"), "matches")


@query(rf"with {MENTIONS}, {_SENT}, {_SIGNALS} select doc_id, rank, start, case when matches then boost else 0 end::double as boost from signal")
def context_boosts(spark, d):
    """What a mention's confidence gains where it is found in its expected context."""
    return _signals(spark, d).select("doc_id", "rank", "start", F.when(F.col("matches"), F.col("boost")).otherwise(0.0).alias("boost"))


@query(rf"with {MENTIONS}, {_SENT}, {_SIGNALS}, b as (select signal.*, {STRIP.format('win.win')} as bare, win.win as win from signal join win using (doc_id, rank, start)) select doc_id, rank, start, round((confidence + (1 + matches::int) / 4 + case when matches then 1.0 else 0.5 end + greatest(0, 1 - case when regexp_matches(win, '^[A-Z]') then 0 else 0.2 end - case when regexp_matches(bare, '[.!?]\z') then 0 else 0.2 end)) / 4, 6)::double as score from b")
def context_scores(spark, d):
    """The mean of a context's confidence, of the methods that speak (of four), of their agreement, and of its window's completeness."""
    quality = context_quality(spark, d).select("doc_id", "rank", "start", "completeness")
    m = F.col("matches")
    score = (F.col("confidence") + (1 + m.cast("int")) / 4 + F.when(m, 1.0).otherwise(0.5) + F.col("completeness")) / 4
    return _signals(spark, d).join(quality, ["doc_id", "rank", "start"]).select("doc_id", "rank", "start", F.round(score, 6).alias("score"))


@query(f"with {_MAPPED} select entity_type, primary_context, array_to_string(near, ',') as near, boost::double as boost from x where entity_type in ('PARTY', 'COURT')")
def context_mapping_of(spark, d):
    """The mapping rows of some types."""
    return X.mappings(spark).filter(F.col("entity_type").isin("PARTY", "COURT")).select("entity_type", "primary_context", F.array_join("near", ",").alias("near"), "boost")


_PAIR = f"""g as (select doc_id, rank, start, least(start, lead(start) over v) as a, greatest(stop, lead(stop) over v) as b, lead(start) over v as n from m window v as (partition by doc_id order by start, stop, rank)),
h as (select g.*, text, greatest(length(regexp_replace(substr(text, 1, greatest(a - 50, 0) + 1), '\\S+\\z', '')) - 1, 0) as ca, least(b + 50, length(text)) + length(regexp_extract(substr(text, least(b + 50, length(text)) + 1), '^\\S*')) as cb from g join documents d using (doc_id) where n is not null and b - a <= 200)"""


@query(f"with {MENTIONS.replace('m as (', 'mm as (')}, m as (select doc_id, rank, start, stop from mm), {_PAIR} select doc_id, rank, start, ca::int as context_start, cb::int as context_stop, md5({STRIP.format('substr(text, ca + 1, cb - ca)')}) as context from h")
def relation_context(spark, d):
    """The text around each mention and the next near it, out to white space."""
    w = Window.partitionBy("doc_id").orderBy("start", "stop", "rank")
    m = found(spark, d).select("doc_id", "rank", "start", "stop")
    both = m.select("doc_id", "rank", F.col("start").alias("own"), F.least("start", F.lead("start").over(w)).alias("start"), F.greatest("stop", F.lead("stop").over(w)).alias("stop"), F.lead("start").over(w).alias("n")).filter("n is not null and stop - start <= 200")
    out = W.pair_context(both, table(spark, d, "documents"))
    return out.select("doc_id", "rank", F.col("own").alias("start"), "context_start", "context_stop", F.md5("context").alias("context"))


_REFS = ", ".join(f"('{k}', '{r}')" for k, refs in W.PARTY_REFERENCES.items() for r in refs)
_PARTIED = "documents as (select doc_id, case when doc_id % 3 = 0 then 'The Plaintiff said: ' || text || ' Such party and plaintiffs' else text end as text from main.documents)"


@query(f"with {_PARTIED}, {MENTIONS}, n as (select m.doc_id, rank, start, greatest(start - 200, 0) as low, lower(substr(d.text, greatest(start - 200, 0) + 1, stop + 200 - greatest(start - 200, 0))) as near from m join documents d using (doc_id)) select doc_id, rank, start, kind, reference, (low + instr(near, reference) - 1)::int as reference_start from n, (values {_REFS}) r(kind, reference) where contains(near, reference)")
def party_references(spark, d):
    """References to parties within 200 characters of each mention."""
    from ..operators.matching import mentions

    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("The Plaintiff said: "), "text", F.lit(" Such party and plaintiffs"))).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", text.alias("text"))
    return W.party_references(mentions(docs, most=None), docs)


@query(rf"with s as (select doc_id, i, {STRIP.format('p[i]')} as t from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split_regex(text, '[.!?]+') as p from documents))), c as (select doc_id, i, k * 150 as pos, case when length(t) > 200 then {STRIP.format('substr(t, k * 150 + 1, 200)')} else t end as segment, length(t) as n from (select doc_id, i, t, unnest(range(0, case when length(t) > 200 then ceil(length(t) / 150)::bigint else 1 end)) as k from s where length(t) >= 10)) select doc_id, i::int as sentence, pos::int as pos, md5(segment) as segment from c where n <= 200 or length(segment) > 20")
def text_segments(spark, d):
    """Sentences of ten characters and more, the long ones in windows of 200 that share 50."""
    return W.segments(table(spark, d, "documents")).withColumn("segment", F.md5("segment"))


_ABBR = "[" + ", ".join(f"'{x}'" for x in W.OPEN_ENDS) + "]"


@query(rf"with s as (select doc_id, i, {STRIP.format('w[i]')} as t from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, regexp_extract_all(text || ' Acme Inc. said no. ', '[^.!?]+[.!?]*\s*') as w from documents))), o as (select *, list_contains({_ABBR}, regexp_extract(t, '\S+\z')) as open from s where t <> ''), g as (select *, coalesce(sum(case when not open then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as g from o) select doc_id, g::int as sentence, md5(string_agg(t, ' ' order by i)) as text, count(*) as parts from g group by 1, 2")
def text_sentences(spark, d):
    """Sentences, joined to the next where they end with an abbreviation."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" Acme Inc. said no. ")).alias("text"))
    return W.joined_sentences(docs).withColumn("text", F.md5("text"))

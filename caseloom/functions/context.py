"""Context of mentions: which kinds of context a text suggests, categories of types, and windows of sentences and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spans import spans

# Entity type, primary context, other contexts, indicators, words near by, headers, boost.
MAPPINGS = (
    ("PARTY", "party_context", ("case_context",), ("plaintiff", "defendant", "the"), ("versus", "and"), ("parties",), 0.10),
    ("JUDGE", "judicial_context", ("case_context",), ("judge", "justice", "honorable"), ("court", "opinion"), ("before",), 0.15),
    ("COURT", "judicial_context", (), ("court", "tribunal", "token"), ("district", "circuit"), ("in the court",), 0.10),
    ("STATUTE_CITATION", "citation_context", ("legal_context",), ("license", "section", "code"), ("version", "under"), ("statutes",), 0.20),
    ("CASE_CITATION", "citation_context", ("case_context",), ("cited", "reporter"), ("see", "cert"), ("authorities",), 0.20),
    ("CONTACT", "contact_context", (), ("@", "mail", "http"), ("com", "net"), ("contact",), 0.05),
    ("PERSON", "party_context", ("contact_context",), ("mr", "ms", "dr"), ("said", "that"), ("witnesses",), 0.05),
)
SCHEMA = "entity_type string, primary_context string, secondary array<string>, indicators array<string>, near array<string>, headers array<string>, boost double"
CATEGORIES = (
    ("parties", ("PARTY", "PLAINTIFF", "DEFENDANT", "PERSON", "CORPORATION")), ("judiciary", ("JUDGE", "JUSTICE", "MAGISTRATE", "COURT")), ("counsel", ("ATTORNEY", "LAW_FIRM")),
    ("citations", ("CITATION",)), ("documents", ("MOTION", "BRIEF", "ORDER", "CONTRACT")), ("contact", ("CONTACT", "ADDRESS")), ("dates", ("DATE", "DEADLINE")), ("money", ("AMOUNT", "DAMAGES")),
)


def mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, p, list(s), list(i), list(n), list(h), b) for t, p, s, i, n, h, b in MAPPINGS], SCHEMA)


def in_context(table: DataFrame, context: str) -> DataFrame:
    """Types whose primary context it is, or one of the others."""
    return table.filter((F.col("primary_context") == context) | F.array_contains("secondary", context))


def category(entity_type: Column) -> Column:
    """The first category a member of whose list the type's name holds."""
    out = None
    for name, parts in CATEGORIES:
        test = F.lit(False)
        for p in parts:
            test = test | F.contains(F.upper(entity_type), F.lit(p))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def suggestions(docs: DataFrame, table: DataFrame, most: int = 5) -> DataFrame:
    """The most likely types of a text: 1 for an indicator, .5 for a word near by, 2 for a header that it holds.

    The mapping is a constant of the program and broadcast; each text is searched once for each word.
    """
    low = F.lower("text")
    hits = lambda words: F.size(F.filter(words, lambda w: F.contains(F.col("_low"), w)))
    scored = docs.select("doc_id", low.alias("_low")).join(F.broadcast(table)).withColumn("score", hits("indicators") + 0.5 * hits("near") + 2.0 * hits("headers")).filter("score > 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "entity_type")
    return scored.select("doc_id", "entity_type", "score").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)


def sentence_spans(text: Column) -> Column:
    """Sentences as spans: what runs to the next end punctuation."""
    return spans(text, r"[^.!?]+[.!?]*\s*")


def sentence_windows(found: DataFrame, docs: DataFrame, around: int = 1, by: str = "doc_id", cell: int = 500) -> DataFrame:
    """found with the number of the sentence in which a mention begins, and that sentence with those around it.

    Sentences become rows once, with their neighbours; each goes to all cells of positions that it covers, and a mention
    to that of its start, so no mention carries a text's sentences. Before the first sentence the number is 0.
    """
    w = Window.partitionBy(by).orderBy("sentence")
    rows = docs.select(F.col(by), F.posexplode(sentence_spans(F.col("text"))).alias("_i", "_s")).select(by, (F.col("_i") + 1).alias("sentence"), F.col("_s.start").alias("_from"), F.col("_s.text").alias("_t"))
    rows = rows.withColumns({"window": F.array_join(F.collect_list("_t").over(w.rowsBetween(-around, around)), ""), "_alone": F.array_join(F.collect_list("_t").over(w.rowsBetween(0, around - 1)), "") if around else F.lit(""), "_until": F.coalesce(F.lead("_from").over(w), F.lit(2**31 - 1))})
    first = F.when(F.col("sentence") == 1, 0).otherwise(F.col("_from"))
    last = F.when(F.col("_until") == 2**31 - 1, F.col("_from") + F.length("_t")).otherwise(F.col("_until"))
    rows = rows.withColumn("_low", first).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") / cell), F.floor(last / cell))))
    joined = found.withColumn("_cell", F.floor(F.col("start") / cell)).join(rows, [by, "_cell"]).filter((F.col("start") >= F.col("_low")) & (F.col("start") < F.col("_until")))
    early = F.col("start") < F.col("_from")
    return joined.withColumns({"window": F.when(early, F.col("_alone")).otherwise(F.col("window")), "sentence": F.when(early, 0).otherwise(F.col("sentence"))}).drop("_cell", "_from", "_t", "_alone", "_until", "_low")


def closest(position: Column, spans_: Column) -> Column:
    """The number (from 1) of the span nearest to a position, the first of equals."""
    gap = F.transform(spans_, lambda s, i: F.struct(F.greatest(F.lit(0), s["start"] - position, position - s["stop"]).alias("d"), (i + 1).alias("i")))
    return F.array_min(gap)["i"]


def pattern_signals(windows: DataFrame, table: DataFrame) -> DataFrame:
    """For windows (doc_id, rank, start, entity_type, low) the context whose indicators occur most in low, of equals the one
    with the shortest name; its share of all, more if it is expected of the type, and for each word near by.

    The mapping is a constant of the program: one row holds it, broadcast.
    """
    words = table.groupBy(F.col("primary_context").alias("ctx")).agg(F.array_distinct(F.flatten(F.collect_list("indicators"))).alias("words")).agg(F.collect_list(F.struct("ctx", "words")).alias("contexts"))
    count = lambda k: F.floor((F.length("low") - F.length(F.replace(F.col("low"), k, F.lit("")))) / F.length(k))
    each = F.transform("contexts", lambda c: F.struct(F.aggregate(c["words"], F.lit(0).cast("long"), lambda s, k: s + count(k)).alias("n"), (-F.length(c["ctx"])).alias("short"), c["ctx"].alias("ctx")))
    rows = windows.join(F.broadcast(words)).withColumn("hits", F.filter(each, lambda x: x["n"] > 0)).filter(F.size("hits") > 0)
    rows = rows.withColumns({"best": F.array_max("hits"), "total": F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["n"])})
    rows = rows.join(F.broadcast(table.select("entity_type", "primary_context", "near", "boost")), "entity_type", "left")
    matches = F.coalesce(F.col("primary_context") == F.col("best.ctx"), F.lit(False))
    near = F.coalesce(F.size(F.filter("near", lambda k: F.contains(F.col("low"), k))), F.lit(0))
    sure = F.col("best.n") / F.col("total") + F.when(matches, 0.2).otherwise(0.0) + 0.05 * F.when(F.col("near").isNull(), 0).otherwise(near)
    return rows.select("doc_id", "rank", "start", F.col("best.ctx").alias("context"), "total", F.least(F.lit(1.0), sure).alias("confidence"), matches.alias("matches"), "boost")

"""Whole extractions: route, match, resolve, score, filter, relate and report; and replays of limits."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import text as T
from ..operators import chunking, limits, matching, registry, relations, resolving, sizing
from .mentions import found
from .metrics import LOG, log
from .registry import query, table


class Scorer(Protocol):
    """What finds mentions: docs (doc_id, text) to rows as matching.mentions gives them. Models plug in here."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


def regex_scorer(patterns=C.GENERIC) -> Scorer:
    return lambda docs: matching.mentions(docs, patterns, most=None)


#: Strategies by name: how sources are fused, the conflict rule, and the filter.
STRATEGIES = {
    "unified": ("confidence_weighted", "highest_confidence"), "multipass": ("union", "highest_confidence"), "ai_enhanced": ("confidence_weighted", "merge"),
    "regex": ("union", "pattern_priority"), "cascade": ("cascade", "highest_confidence"), "intersection": ("intersection", "highest_confidence"),
}


def extract(docs: DataFrame, strategy: str = "unified", scorers: tuple[Scorer, ...] = (), window: int = 100) -> dict[str, DataFrame]:
    """decisions, mentions, entities, relations of docs (doc_id, text), by a strategy; edge cases have no mentions."""
    fusion, conflicts = STRATEGIES.get(strategy, STRATEGIES["unified"])
    decisions = sizing.route(docs)
    usable = docs.filter(sizing.edge_case(F.col("text")).isNull())
    rows = None
    for s in scorers or (regex_scorer(),):
        rows = s(usable) if rows is None else rows.unionByName(s(usable))
    mentions = resolving.strategy_filter(resolving.resolve_conflicts(resolving.fuse(rows, fusion), conflicts), strategy)
    return {"decisions": decisions, "mentions": mentions, "entities": resolving.dedup(mentions, "waves"), "relations": relations.proximity(mentions, window).filter("confidence >= 0.6")}


@query()
def extract_unified(spark, d):
    out = extract(table(spark, d, "documents").select("doc_id", "text"))
    m = out["mentions"].groupBy("doc_id").agg(F.count("*").alias("mentions"), F.round(F.avg("confidence"), 9).alias("mean"))
    e = out["entities"].groupBy("doc_id").agg(F.count("*").alias("entities"))
    r = out["relations"].groupBy("doc_id").agg(F.count("*").alias("relations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out["decisions"].select("doc_id", "strategy").join(m, "doc_id", "left").join(e, "doc_id", "left").join(r, "doc_id", "left").select("doc_id", "strategy", zero("mentions"), zero("entities"), zero("relations"), "mean")


@query()
def extract_chunked(spark, d):
    """Mentions of overlapping chunks, shifted to the document, of which a repeated one stays once."""
    chunks = chunking.windows(table(spark, d, "documents"), 2000, 200)
    keyed = chunks.withColumn("piece", F.struct("doc_id", "chunk", "start").alias("piece")).select(F.col("piece").alias("doc_id"), F.col("content").alias("text"))
    rows = matching.mentions(keyed, most=None)
    at = F.col("doc_id.start")
    moved = rows.select(F.col("doc_id.doc_id").alias("doc_id"), "name", "entity_type", "source", "rank", (F.col("start") + at).alias("start"), (F.col("stop") + at).alias("stop"), "text", "confidence")
    return resolving.dedup(moved, "exact").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("stop").alias("last"))


@query()
def entity_registry(spark, d):
    return registry.merged(registry.resolve(found(spark, d))).select("doc_id", "entity", "entity_type", "canonical", F.size("variants").alias("variants"), F.round("confidence", 6).alias("confidence"), "occurrences", "first_start")


@query()
def entity_fuzzy_clusters(spark, d):
    return registry.fuzzy_clusters(found(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query()
def entity_merge_two(spark, d):
    m = found(spark, d)
    return registry.merge_two(m.filter("source = 'model'"), m.filter("source = 'regex'")).select("doc_id", "rank", "start", "stop", F.round("confidence", 6).alias("confidence"))


@query()
def entity_without_overlaps(spark, d):
    return registry.without_overlaps(found(spark, d)).select("doc_id", "rank", "start", "stop")


@query()
def entity_references(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("start"), F.lit(0).alias("rank"), F.when(F.col("turn") % 2 == 0, "PERSON").otherwise("COURT").alias("entity_type"), F.split("text", ",")[0].alias("text"))
    return registry.references(turns)


@query()
def page_batches(spark, d):
    pages = chunking.pages(table(spark, d, "documents"), (100, 100))
    return registry.page_batches(pages.select("doc_id", "page", T.page_complexity(F.col("content")).alias("complexity")))


@query()
def limit_circuit(spark, d):
    return limits.circuit(log(spark, d).select("user_id", "ts", "event_id", "success"), "user_id", 2, 86_400.0).drop("ts")


@query()
def limit_delays(spark, d):
    return limits.delays(log(spark, d).select("user_id", "ts", "event_id", "ms"), "user_id", 2500.0).select("user_id", "event_id", F.round("delay_ms", 6).alias("delay_ms"))


@query(f"with {LOG}, r as (select event_id, user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as p from log) select event_id, coalesce(epoch(ts) - epoch(p) <= 36000, false) as hit from r")
def limit_cache(spark, d):
    return limits.cache_reads(log(spark, d).select(F.col("user_id").alias("key"), "ts", "event_id"), 36_000.0).select("event_id", "hit")


@query(f"with {LOG}, r as (select event_id, (epoch((select max(ts) from log)) - epoch(ts)) / 2000000 as s from log) select event_id, case when s >= 0.9 then 90 when s >= 0.75 then 75 when s >= 0.5 then 50 else 0 end as band from r")
def limit_bands(spark, d):
    rows = log(spark, d)
    last = rows.agg(F.max("ts").alias("now"))
    return limits.timeout_bands(rows.select("event_id", F.col("ts").alias("started")).join(F.broadcast(last)), 2_000_000.0).select("event_id", F.coalesce("band", F.lit(0)).alias("band"))

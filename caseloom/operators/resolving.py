"""Overlapping and repeated mentions: islands, survivors, fusion of sources and keep-first duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import group_key, key, normal

ORDER = ("start", "stop", "rank")


def conflict_islands(found: DataFrame, by: str = "doc_id", tolerance: int = 0) -> DataFrame:
    """found with `island`: in order of start and stop, a mention stays with the one just before it if they overlap and are of one type."""
    w = Window.partitionBy(by).orderBy(*ORDER)
    before = F.lag(F.struct("stop", "entity_type", "start")).over(w)
    same = before["entity_type"] == F.col("entity_type")
    near = (F.least("stop", before["stop"]) > F.greatest("start", before["start"])) & same
    if tolerance:
        near = near | (same & ((F.abs(before["stop"] - F.col("start")) <= tolerance) | (F.abs(F.col("stop") - before["start"]) <= tolerance)))
    return found.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def resolve_conflicts(found: DataFrame, how: str = "highest_confidence", by: str = "doc_id", tolerance: int = 0, merge_from: float = 0.8) -> DataFrame:
    """One mention of each island: the surest, that of the pattern with the highest priority, or the surest of those from .8 on (single ones stay)."""
    from ..functions.catalog import priority

    islands = conflict_islands(found, by, tolerance)
    best = {"pattern_priority": [F.desc(priority(F.col("name")))]}.get(how, [F.desc("confidence")])
    w = Window.partitionBy(by, "island")
    ranked = islands.withColumns({"_r": F.row_number().over(w.orderBy(*best, *ORDER)), "_n": F.count("*").over(w)})
    if how == "merge":
        ranked = ranked.filter((F.col("_n") == 1) | (F.col("confidence") >= merge_from))
    return ranked.filter("_r = 1").drop("_r", "_n", "island")


def overlap_islands(found: DataFrame, by: str = "doc_id") -> DataFrame:
    """found with `island`: mentions of any type that overlap some earlier member, by the running maximum of their ends."""
    w = Window.partitionBy(by).orderBy(*ORDER)
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def fuse(found: DataFrame, how: str = "confidence_weighted", by: str = "doc_id") -> DataFrame:
    """Mentions of several sources as one list.

    union: distinct by type, text and span; confidence_weighted: the surest of each island, of several sources 1.1 times
    as sure, .99 at most; intersection: only islands of several sources; cascade: by source and confidence, greedily, unless
    an end falls into an accepted span.
    """
    if how == "union":
        w = Window.partitionBy(by, "entity_type", "text", "start", "stop").orderBy("rank")
        return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    if how == "cascade":
        return cascade(found, by)
    w = Window.partitionBy(by, "island")
    marked = overlap_islands(found, by).withColumns({"_r": F.row_number().over(w.orderBy(F.desc("confidence"), *ORDER)), "_first": F.min("source").over(w), "_last": F.max("source").over(w)})
    several = F.col("_first") != F.col("_last")
    best = marked.filter("_r = 1")
    if how == "intersection":
        best = best.filter(several).withColumn("source", F.lit("fusion"))
    else:
        best = best.withColumns({"confidence": F.when(several, F.least(F.lit(0.99), F.col("confidence") * 1.1)).otherwise(F.col("confidence")), "source": F.when(several, "fusion").otherwise(F.col("source"))})
    return best.drop("_r", "_first", "_last", "island")


def cascade(found: DataFrame, by: str = "doc_id") -> DataFrame:
    """Greedy acceptance in order of source (regex, model, few_shot, others) and confidence; one document at a time."""
    order = {"regex": 1, "model": 2, "few_shot": 3}

    def accept(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_p=rows["source"].map(order).fillna(4)).sort_values(["_p", "confidence", *ORDER], ascending=[True, False, True, True, True])
        taken, keep = [], []
        for a, b in zip(rows["start"], rows["stop"], strict=True):
            free = not any(s <= a < e or s < b <= e for s, e in taken)
            keep.append(free)
            if free:
                taken.append((a, b))
        return rows[keep].drop(columns="_p")

    return found.groupBy(by).applyInPandas(accept, found.schema)


def keep_first(found: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return found.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def dedup(found: DataFrame, how: str, by: str = "doc_id") -> DataFrame:
    """Keep-first duplicates of a document's mentions.

    waves: type and key; text: key, no blank; typed_text: key and lower-case type, no blank; overlap: key and the tenth
    of the start, the surest first; exact: type, text and start, the surest first; position: tenths of start and stop.
    """
    bare = key(F.col("text"))
    keys, order = {
        "waves": ([bare, F.col("entity_type")], ["rank", "start"]),
        "text": ([bare], ["rank", "start"]),
        "typed_text": ([bare, F.lower("entity_type")], ["rank", "start"]),
        "overlap": ([bare, F.floor(F.col("start") / 10)], [F.desc("confidence"), "rank", "start"]),
        "exact": ([F.col("entity_type"), F.col("text"), F.col("start")], [F.desc("confidence"), "rank"]),
        "position": ([F.floor(F.col("start") / 10), F.floor(F.col("stop") / 10)], ["rank", "start"]),
    }[how]
    rows = found.filter(bare != "") if how in ("text", "typed_text") else found
    return keep_first(rows, [F.col(by), *keys], order)


def merge_regex_and_model(regex: DataFrame, model: DataFrame, by: str = "doc_id") -> DataFrame:
    """Model mentions, and regex mentions that no model mention equals in text and span, at .8 of their confidence."""
    on = [by, "text", "start", "stop"]
    return model.unionByName(regex.join(model, on, "left_anti").select(regex.columns).withColumn("confidence", F.col("confidence") * 0.8))


def strategy_filter(found: DataFrame, strategy: str) -> DataFrame:
    """Mentions sure enough for a strategy; of several passes the threshold rises with `pass`."""
    floor = {"ai_enhanced": F.lit(0.55), "unified": F.lit(0.6), "multipass": F.when(F.col("pass") <= 3, 0.3).when(F.col("pass") <= 5, 0.5).otherwise(0.7) if "pass" in found.columns else F.lit(0.7)}.get(strategy, F.lit(0.0))
    return found.filter(F.col("confidence") >= floor)


def occurrences(found: DataFrame, by: str = "doc_id") -> DataFrame:
    """Mentions of one normal form and type: the surest text, how often and first where they occur, and their starts."""
    grouped = found.withColumn("group_key", group_key(F.col("entity_type"), normal(F.col("text"))))
    return grouped.groupBy(by, "group_key").agg(
        F.first("entity_type").alias("entity_type"), F.max_by("text", F.struct("confidence", -F.col("start"), -F.col("rank"))).alias("text"), F.max("confidence").alias("confidence"),
        F.count("*").alias("occurrence_count"), F.min("start").alias("first_start"), F.sort_array(F.collect_set("start")).alias("positions"),
    )

"""Relationships between mentions or entities: band and containment joins, typed rules, reverse edges, merging and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
TYPE_RULES = (
    ("ATTORNEY", "PLAINTIFF", "REPRESENTS"), ("ATTORNEY", "DEFENDANT", "REPRESENTS"), ("LAW_FIRM", "PARTY", "REPRESENTS"), ("JUDGE", "CASE", "PRESIDES_OVER"),
    ("PLAINTIFF", "DEFENDANT", "SUES"), ("CORPORATION", "CORPORATION", "ASSOCIATED_WITH"), ("PERSON", "CORPORATION", "ASSOCIATED_WITH"), ("COURT", "CASE", "VENUE_FOR"), ("PARTY", "CONTRACT", "PART_OF"),
)
CHUNK_RULES = (
    ("represents", ("attorney", "law_firm"), ("party", "plaintiff", "defendant")), ("opposes", ("plaintiff",), ("defendant",)), ("presides_over", ("judge", "magistrate"), ("case", "proceeding")),
    ("filed_by", ("motion", "brief", "complaint"), ("party", "attorney")), ("employed_by", ("attorney", "paralegal"), ("law_firm",)), ("governs", ("statute", "regulation"), ("conduct", "procedure")),
)
COMPATIBLE = (("PLAINTIFF", "DEFENDANT", "PARTY"), ("ATTORNEY", "LAW_FIRM"), ("JUDGE", "MAGISTRATE", "ARBITRATOR"), ("MOTION", "BRIEF", "DOCUMENT"), ("FEDERAL_AGENCY", "STATE_AGENCY", "GOVERNMENT_ENTITY"))


def near_pairs(found: DataFrame, window: int = 100, by: str = "doc_id", id_: str = "rank") -> DataFrame:
    """Ordered pairs (a, b) of mentions of a document, b starting at most window characters after a ends.

    Positions are cut into cells of a window's width: a goes to all cells that it could reach, b is in one, so each pair
    is found once and a long document isn't compared with itself as a whole. distance is 0 for overlapping mentions.
    """
    side = lambda p: found.select(F.col(by), *[F.col(c).alias(f"{p}_{c}") for c in found.columns if c != by])
    a = side("a").withColumn("_cell", F.explode(F.expr(f"sequence(cast(floor(a_start / {window}) as long), cast(floor((a_stop + {window}) / {window}) as long))")))
    b = side("b").withColumn("_cell", F.floor(F.col("b_start") / window).cast("long"))
    after = (F.col("b_start") > F.col("a_start")) | ((F.col("b_start") == F.col("a_start")) & ((F.col("b_stop") > F.col("a_stop")) | ((F.col("b_stop") == F.col("a_stop")) & (F.col(f"b_{id_}") > F.col(f"a_{id_}")))))
    gap = F.col("b_start") - F.col("a_stop")
    return a.join(b, [by, "_cell"]).filter(after & (gap <= window)).drop("_cell").withColumn("distance", F.greatest(gap, F.lit(0)))


def proximity(found: DataFrame, window: int = 100, farthest: int = 200, threshold: float = 0.5, by: str = "doc_id") -> DataFrame:
    """near_pairs with a type by rule (either way round, else RELATED_TO) and a confidence that falls with distance."""
    rules = found.sparkSession.createDataFrame([*TYPE_RULES, *[(b, a, t) for a, b, t in TYPE_RULES if (b, a) not in {(x, y) for x, y, _ in TYPE_RULES}]], "a_entity_type string, b_entity_type string, relation string")
    pairs = near_pairs(found, min(window, farthest), by).join(F.broadcast(rules), ["a_entity_type", "b_entity_type"], "left")
    return pairs.withColumns({"relation": F.coalesce("relation", F.lit("RELATED_TO")), "confidence": F.greatest(F.lit(threshold), 1 - F.col("distance") / farthest)})


def contained(spans: DataFrame, found: DataFrame, cell: int = 500, by: str = "doc_id") -> DataFrame:
    """Mentions inside spans (span_id, start, stop): spans go to all cells that they cover, mentions to the one of their start."""
    s = spans.select(by, "span_id", F.col("start").alias("s_start"), F.col("stop").alias("s_stop")).withColumn("_cell", F.explode(F.expr(f"sequence(cast(floor(start / {cell}) as long), cast(floor(stop / {cell}) as long))".replace("start", "s_start").replace("stop", "s_stop"))))
    m = found.withColumn("_cell", F.floor(F.col("start") / cell).cast("long"))
    return s.join(m, [by, "_cell"]).filter((F.col("start") >= F.col("s_start")) & (F.col("stop") <= F.col("s_stop"))).drop("_cell")


def nearest(found: DataFrame, reach: int, most: int, by: str = "doc_id") -> DataFrame:
    """For each mention (t_rank, t_start) the `most` nearest others (rank, start, distance, k) of its document within reach.

    Positions are cut into cells of the reach's width; a mention goes to all cells that it touches, as a target to those
    within reach too, and a pair counts in the first cell that both are in.
    """
    cells = lambda a, b: F.expr(f"sequence(cast(floor(({a}) / {reach}) as long), cast(floor(({b}) / {reach}) as long))")
    t = found.select(by, F.col("rank").alias("t_rank"), F.col("start").alias("t_start"), F.col("stop").alias("t_stop")).withColumn("_c", cells(f"t_start - {reach}", f"t_stop + {reach}"))
    m = found.select(by, "rank", "start", "stop").withColumn("_d", cells("start", "stop"))
    pairs = t.withColumns({"_t0": F.col("_c")[0], "_cell": F.explode("_c")}).drop("_c").join(m.withColumns({"_m0": F.col("_d")[0], "_cell": F.explode("_d")}).drop("_d"), [by, "_cell"])
    gap = F.greatest(F.lit(0), F.greatest("start", "t_start") - F.least("stop", "t_stop"))
    near = pairs.filter((F.col("_cell") == F.greatest("_t0", "_m0")) & ~((F.col("rank") == F.col("t_rank")) & (F.col("start") == F.col("t_start")))).withColumn("distance", gap).filter(F.col("distance") <= reach)
    w = Window.partitionBy(by, "t_rank", "t_start").orderBy("distance", "start", "rank")
    return near.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select(by, "t_rank", "t_start", "start", "rank", "distance", "k")


def first_pair(inside: DataFrame, subject: list[str], object_: list[str], by: str = "doc_id") -> DataFrame:
    """For each span its first mention of a subject type and first other one of an object type, by start, stop and rank."""
    at = F.struct("start", "stop", "rank", "text")
    out = inside.groupBy(by, "span_id").agg(F.min(F.when(F.col("entity_type").isin(subject), at)).alias("subject"), F.min(F.when(F.col("entity_type").isin(object_), at)).alias("object"))
    return out.filter("subject is not null and object is not null and subject <> object")


def with_reverse(edges: DataFrame, bidirectional=None) -> DataFrame:
    """edges and, for bidirectional types, their reverse at .9 of the confidence."""
    back = edges.filter(bidirectional) if bidirectional is not None else edges
    swapped = back.withColumns({"src": F.col("tgt"), "tgt": F.col("src"), "confidence": F.col("confidence") * 0.9})
    return edges.withColumn("reverse", F.lit(False)).unionByName(swapped.withColumn("reverse", F.lit(True)))


def merge_duplicates(edges: DataFrame, order: list[str]) -> DataFrame:
    """One row of each (src, tgt, relation): the first confidence plus a tenth of each later one, 1 at most."""
    w = Window.partitionBy("src", "tgt", "relation").orderBy(*order)
    ranked = edges.withColumn("_r", F.row_number().over(w))
    c = F.col("confidence")
    return ranked.groupBy("src", "tgt", "relation").agg(F.least(F.lit(1.0), F.sum(F.when(F.col("_r") == 1, c).otherwise(c * 0.1))).alias("confidence"), F.count("*").alias("merged_count"))


def valid_edges(edges: DataFrame, ids: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Edges that are sure enough, join two ids that exist, and aren't loops. ids: one column, id."""
    sure = edges.filter((F.col("confidence") >= threshold) & (F.col("src") != F.col("tgt")))
    return sure.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("tgt")), "tgt", "left_semi").select(edges.columns)


def chunk_relations(entities: DataFrame) -> DataFrame:
    """Typed relations of entities (id, entity_type, chunk) that occur in the same or neighbouring chunks of a document (doc_id)."""
    def typed(names, p):
        test = F.lit(False)
        for n in names:
            test = test | F.contains(F.lower("entity_type"), F.lit(n))
        return entities.filter(test).select("doc_id", F.col("id").alias(p), F.col("chunk").alias(f"{p}_chunk"))

    out = None
    for relation, sources, targets in CHUNK_RULES:
        s = typed(sources, "src").withColumn("_c", F.explode(F.array(F.col("src_chunk") - 1, F.col("src_chunk"), F.col("src_chunk") + 1)))
        t = typed(targets, "tgt").withColumn("_c", F.col("tgt_chunk"))
        one = s.join(t, ["doc_id", "_c"]).select("doc_id", "src", "tgt", F.lit(relation).alias("relation"), F.lit(0.7).alias("confidence")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def compatible(a, b):
    """Whether two types are one or of one group."""
    out = a == b
    for group in COMPATIBLE:
        out = out | (a.isin(*group) & b.isin(*group))
    return out


def statistics(edges: DataFrame) -> DataFrame:
    """By relation: edges, distinct pairs, and how many are sure (.8), middling (.6) or less."""
    c = F.col("confidence")
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("src", "tgt").alias("pairs"), F.avg(c).alias("mean"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"))


def participation(edges: DataFrame) -> DataFrame:
    """How often an id is an end of an edge, as source and as target."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(edges.select(F.col("tgt").alias("id"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    return ends.groupBy("id").agg(F.sum("s").alias("as_source"), F.sum("t").alias("as_target"), F.count("*").alias("total"))


def merged_attributes(target: DataFrame, source: DataFrame) -> DataFrame:
    """Attributes (id, court, names, more) of entities in both: the target's court where it has one, all names, the source's
    entries over the target's; and whether the courts conflict."""
    t, s = target.alias("t"), source.alias("s")
    more = F.map_concat(F.map_filter("t.more", lambda k, v: ~F.map_contains_key(F.col("s.more"), k)), F.col("s.more"))
    conflict = F.coalesce(F.col("t.court") != F.col("s.court"), F.lit(False))
    return t.join(s, F.col("t.id") == F.col("s.id")).select("t.id", F.coalesce("t.court", "s.court").alias("court"), F.array_sort(F.array_union("t.names", "s.names")).alias("names"), more.alias("more"), conflict.alias("conflict"))

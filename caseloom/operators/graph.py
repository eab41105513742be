"""Graphs of entities: centrality, communities and GraphML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpoints


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, occurrences) with degree (outgoing, and incoming of bidirectional edges) and .7 of it over the largest plus .3 of occurrences over 100."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.filter("bidirectional").select(F.col("tgt").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    out = nodes.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    most = out.agg(F.greatest(F.max("degree"), F.lit(1)).alias("_most"))
    return out.join(F.broadcast(most)).withColumn("centrality", 0.7 * F.col("degree") / F.col("_most") + 0.3 * F.least(F.lit(1.0), F.col("occurrences") / 100)).drop("_most")


def communities(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, community): the smallest id reachable over edges either way, by alternating stars; each round is checkpointed.

    Raises RuntimeError if so many rounds don't settle it (each halves the paths at least).
    """
    checkpoints(edges.sparkSession)
    now = edges.select(F.least("src", "tgt").alias("lo"), F.greatest("src", "tgt").alias("hi")).filter("lo < hi").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = now.select(F.col("lo").alias("id"), F.col("hi").alias("other")).union(now.select(F.col("hi").alias("id"), F.col("lo").alias("other")))
        least = both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("root")).withColumnRenamed("id", "_id")
        up = both.join(least, F.col("id") == F.col("_id")).filter("other > id").select(F.col("root").alias("lo"), F.col("other").alias("hi")).distinct()
        least = up.groupBy(F.col("hi").alias("_id")).agg(F.min("lo").alias("root"))
        down = up.join(least, F.col("hi") == F.col("_id"))
        now = down.select(F.col("root").alias("lo"), F.col("lo").alias("hi")).union(down.select(F.col("root").alias("lo"), "hi")).filter("lo < hi").distinct().checkpoint()
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the communities did not settle")
    return now.select(F.col("lo").alias("id"), F.col("lo").alias("community")).distinct().union(now.select(F.col("hi").alias("id"), F.col("lo").alias("community")))


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(order, line) of a GraphML file of nodes (id, label) and edges (src, tgt, relation), with escaped text."""
    def escaped(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c.cast("string"), F.lit(a), F.lit(b))
        return c

    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, '<graphml><graph edgedefault="directed">'), (3, "</graph></graphml>")], "order int, line string")
    n = nodes.select(F.lit(1).alias("order"), F.concat(F.lit('<node id="'), escaped(F.col("id")), F.lit('"><data key="label">'), escaped(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("order"), F.concat(F.lit('<edge source="'), escaped(F.col("src")), F.lit('" target="'), escaped(F.col("tgt")), F.lit('"><data key="type">'), escaped(F.col("relation")), F.lit("</data></edge>")).alias("line"))
    return head.unionByName(n).unionByName(e)

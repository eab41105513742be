"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import remove, scratch

#: Rounds after which the stars are given up as not converging; each halves the paths at least.
ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that it is linked with over any path.

    Each round two aggregations find every id's smallest neighbour, pre-aggregated before the shuffle, and two joins
    hang the others below it; links are rows of two numbers, and a hot id's rows can be split. Lineage ends each round
    in a table of the shared folder, and the rounds end when a round changes nothing.
    """
    edges = scratch(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct(), "stars")
    mark = None
    for _ in range(ROUNDS):
        both = edges.select(F.col("lo").alias("id"), F.col("hi").alias("other")).union(edges.select(F.col("hi").alias("id"), F.col("lo").alias("other")))
        least = both.groupBy("id").agg(F.min("other").alias("m")).select(F.col("id").alias("_id"), F.least("id", "m").alias("m"))
        large = both.join(least, F.col("id") == F.col("_id")).filter("other > id").select(F.col("m").alias("lo"), F.col("other").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "_id")
        small = large.join(least, F.col("hi") == F.col("_id"))
        new = small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(small.select(F.col("m").alias("lo"), "hi")).filter("lo < hi").distinct()
        done = scratch(new, "stars")
        now = done.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
        remove(edges)
        edges = done
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return roots.union(edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")))

"""Texts alike by their word sets, found over shared rare words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def word_sets(rows: DataFrame, id_: str) -> DataFrame:
    """id, w (distinct lower-cased words) and n of rows (id, text) that have words."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""))
    return rows.select(F.col(id_), words.alias("w")).withColumn("n", F.size("w")).filter("n > 0")


def most_alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """For each left row (id, text) the right row (other, text) of the largest Jaccard similarity, the least `other` of equals.

    Sets of similarity t share one of the first n - ceil(t n) + 1 words of either, in order of frequency, rarest first:
    rows meet over those words alone, and full sets decide. No pair at or above the threshold is lost.
    """
    a, b = word_sets(left, "id"), word_sets(right, "other")
    each = lambda s, i: s.select(F.col(i), "n", F.explode("w").alias("word"))
    often = each(a, "id").select("word").union(each(b, "other").select("word")).groupBy("word").agg(F.count("*").alias("often"))

    def prefix(s: DataFrame, i: str) -> DataFrame:
        ranked = each(s, i).join(often, "word").withColumn("r", F.row_number().over(Window.partitionBy(i).orderBy("often", "word")))
        return ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select(i, "word")

    pairs = prefix(a, "id").join(prefix(b, "other"), "word").select("id", "other").distinct()
    both = pairs.join(a.select("id", F.col("w").alias("x")), "id").join(b.select("other", F.col("w").alias("y")), "other")
    common = F.size(F.array_intersect("x", "y"))
    scored = both.select("id", "other", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)
    best = scored.groupBy("id").agg(F.max("similarity").alias("similarity"), F.min_by("other", F.struct(-F.col("similarity"), "other")).alias("other"))
    return best.select("id", "other", "similarity")

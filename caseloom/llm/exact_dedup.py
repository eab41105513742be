"""Exact de-duplication by recipes of content-defined chunks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import fresh, load, remove, scratch, text_or_empty, without_ids

#: Characters of a chunk at least and at most; between them it ends after the first space that follows one of the marks, or,
#: where there is none, after the first of some characters that occur in texts without such spaces.
LEAST, MOST, ENDS, OTHERS = 256, 2048, "aeimnrt.,", "q3;。、，のはをに的了是은는이"


def normal(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column) -> Column:
    """Chunks whose ends depend on nearby characters alone: equal passages fall into equal chunks soon after their start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{LEAST},{MOST}}}?[{ENDS}]\x20|.{{{LEAST},{MOST}}}?[{OTHERS}]|.{{1,{MOST}}}"), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, row, text_sha256 and recipe of each row of docs: the ordered identifiers of its chunks.

    An identifier is the chunk's 64-bit hash, verified: all distinct chunks are gathered once by hash and compared in
    full. Where unlike chunks share a hash (not expected under some 2^32 chunks), the rank among them is part of the
    identifier; only rows that hold such a hash are looked up again.
    """
    text = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), normal(text_or_empty()).alias("text"))
    cut = text.select("doc_id", "row", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    each = cut.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("id"), "chunk")
    seen = each.groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    shared = scratch(seen.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "shared")
    made = cut.select("doc_id", "row", "text_sha256", F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"))
    if shared.isEmpty():
        remove(shared)
        return made
    ranks = seen.join(shared, "id", "left_semi").select("id", "chunk", (F.row_number().over(Window.partitionBy("id").orderBy("chunk")) - 1).alias("rank"))
    open_ = cut.select("doc_id", "row", "text_sha256", F.posexplode_outer("chunks").alias("at", "chunk")).withColumn("id", F.xxhash64("chunk"))
    known = open_.join(ranks, ["id", "chunk"], "left").select("doc_id", "row", "text_sha256", F.struct("at", "id", F.coalesce("rank", F.lit(0)).alias("rank")).alias("x"), F.col("chunk").isNotNull().alias("some"))
    return known.groupBy("doc_id", "row", "text_sha256").agg(F.sort_array(F.collect_list(F.when(F.col("some"), F.col("x")))).alias("x")).select("doc_id", "row", "text_sha256", F.expr("flatten(transform(x, y -> array(y.id, cast(y.rank as bigint))))").alias("recipe"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text).

    Rows with equal recipes form a group; that with the smallest doc_id stays (null ids last; of rows that share the
    smallest id, one). Null texts are empty texts, and all empty texts are a group. Counts are pre-aggregated before
    their shuffle, and the way back joins rows without texts, whose hot keys Spark can split.
    """
    made = scratch(recipes(docs), "recipes")
    best = scratch(made.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("best")), "best")
    mine, theirs = made.alias("m"), best.withColumnRenamed("recipe", "of").alias("b")
    return mine.join(theirs, F.col("m.recipe") == F.col("b.of")).select("doc_id", "row", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay (see exact_groups), with all their columns, whatever these are named, unchanged.

    Only ids are looked up: the texts of rows stay where they are, unless over BROADCAST_IDS rows go. Rows that are alike
    in id and text count as copies too; one of them stays. Where several rows share an id, or have none, the text
    decides with it. Null texts are empty texts; an empty table stays empty.
    """
    groups = scratch(exact_groups(docs).select("doc_id", "kept", "text_sha256"), "groups")
    several = scratch(groups.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("several")), "several")
    plain = without_ids(docs, groups.filter("not kept").select("doc_id").unionByName(several.select(F.col("several").alias("doc_id"))))
    if several.isEmpty():
        return plain
    sha = fresh(docs, "_sha")
    rest = docs.join(several, docs["doc_id"].eqNullSafe(several["several"]), "left_semi").withColumn(sha, F.sha2(normal(text_or_empty()).cast("binary"), 256))
    stay = groups.filter("kept").select(F.col("doc_id").alias("stay"), F.col("text_sha256").alias("stay_sha"))
    rest = rest.join(stay, rest["doc_id"].eqNullSafe(stay["stay"]) & (rest[sha] == stay["stay_sha"]), "left_semi").dropDuplicates(["doc_id", sha]).drop(sha)
    return plain.filter(F.col("doc_id").isNotNull()).union(rest)


def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as normal from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(normal) as text_sha256
from t window w as (partition by normal)
"""

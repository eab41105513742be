"""Stores of chunks, entities and results on Parquet, and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import entity_id, key
from ..operators.graph import graphml_rows


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """chunks (document_id, chunk, content) with chunk_id and token_count (1.3 a word)."""
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return chunks.select("document_id", F.col("chunk").alias("chunk_index"), F.concat_ws("_", F.col("document_id"), F.lit("chunk"), F.col("chunk")).alias("chunk_id"), "content", F.when(words > 0, F.floor(words * 1.3)).otherwise(F.floor(F.length("content") / 4)).cast("int").alias("token_count"))


#: Folders that a store's documents are dealt over.
BUCKETS = 64


def _bucket(document_id) -> Column:
    return F.pmod(F.xxhash64(F.lit(document_id).cast("string") if not isinstance(document_id, Column) else document_id.cast("string")), F.lit(BUCKETS)).cast("int")


def _append(rows: DataFrame, path: str, version: int) -> None:
    rows.withColumns({"version": F.lit(version), "bucket": _bucket(F.col("document_id"))}).write.mode("append").partitionBy("bucket").parquet(path)


def store_chunks(chunks: DataFrame, path: str, version: int = 0) -> None:
    """Appends chunks, in folders by a hash of the document, so that a document's bucket is read alone.

    version: of the write; a deletion hides what was written up to its own version.
    """
    _append(chunk_rows(chunks), path, version)


def store_entities(found: DataFrame, path: str, version: int = 0) -> None:
    """Appends entities, once a document, type and key."""
    _append(entity_rows(found), path, version)


def store_document(chunks: DataFrame, found: DataFrame, path: str, version: int = 0) -> None:
    """Chunks, then entities, under one path. There is no transaction over both: a failure between leaves chunks alone."""
    store_chunks(chunks, f"{path}/chunks", version)
    store_entities(found, f"{path}/entities", version)


def visible(spark: SparkSession, path: str, document_id=None) -> DataFrame:
    """A store's rows, of one document if asked, whose bucket alone is read then; without those of deleted documents.

    Deletions are few, small rows beside the store.
    """
    rows = spark.read.parquet(path)
    if document_id is not None:
        bucket = spark.range(1).select(_bucket(document_id)).first()[0]
        rows = rows.filter((F.col("bucket") == bucket) & (F.col("document_id") == document_id))
    try:
        gone = spark.read.schema("gone_id string, upto int").parquet(f"{path}_deleted").groupBy("gone_id").agg(F.max("upto").alias("upto"))
    except AnalysisException:  # nothing was ever deleted
        return rows.drop("bucket")
    return rows.join(gone, (F.col("document_id").cast("string") == F.col("gone_id")) & (F.col("version") <= F.col("upto")), "left_anti").drop("bucket")


def get_chunks(spark: SparkSession, path: str, document_id) -> DataFrame:
    """A document's chunks in order."""
    return visible(spark, path, document_id).orderBy("chunk_index")


def get_entities(spark: SparkSession, path: str, document_id) -> DataFrame:
    return visible(spark, path, document_id)


def delete_documents(ids: DataFrame, path: str, upto: int = 0) -> None:
    """Hides what the stores of chunks and of entities under a path hold of documents (one column), up to a version."""
    gone = ids.select(F.col(ids.columns[0]).cast("string").alias("gone_id"), F.lit(upto).alias("upto"))
    for part in ("chunks", "entities"):
        gone.write.mode("append").parquet(f"{path}/{part}_deleted")


def entity_rows(found: DataFrame) -> DataFrame:
    """Entities (document_id, entity_type, text, confidence) once a document, type and key, under their stored id."""
    w = Window.partitionBy("document_id", "entity_type", key(F.col("text"))).orderBy(F.desc("confidence"), "text")
    first = found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return first.withColumn("entity_id", entity_id(F.col("entity_type"), F.col("text")))


def upserted(old: DataFrame, new: DataFrame, ids: list[str], version: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The row of the latest version of each id, from both; of equal versions that with the largest ties, in order."""
    w = Window.partitionBy(*ids).orderBy(*[F.desc(c) for c in (version, *ties)])
    return old.unionByName(new).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merged_entities(found: DataFrame) -> DataFrame:
    """One row of each stored id over all documents: where it was seen first, in how many, and how sure at best."""
    rows = entity_rows(found)
    return rows.groupBy("entity_id", "entity_type").agg(F.min("document_id").alias("first_seen_document_id"), F.countDistinct("document_id").alias("documents"), F.max("confidence").alias("confidence"), F.min(key(F.col("text"))).alias("canonical"))


def export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Writes rows as json or csv (arrays joined by a bar, sorted)."""
    if kind == "json":
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        flat = [F.array_join(F.array_sort(c), "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
        rows.select(*flat).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        raise ValueError(f"json or csv, not {kind}")


def export_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes a GraphML text, its lines in order."""
    graphml_rows(nodes, edges).orderBy("order", "line").select("line").write.mode("overwrite").text(path)


def read_history(spark: SparkSession, path: str, document_id: str | None = None, strategy: str | None = None, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Results kept as JSON (an array, or an object a line), newest first; by document, by strategy, or the last few."""
    out = spark.read.option("multiLine", not lines).json(path)
    if document_id is not None:
        out = out.filter(F.col("document_id") == document_id)
    if strategy is not None:
        out = out.filter(F.col("routing.strategy") == strategy)
    out = out.orderBy(F.desc("timestamp"))
    return out.limit(limit) if limit else out


def save_snapshot(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

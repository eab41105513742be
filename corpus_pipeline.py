"""A corpus pipeline: toxic documents go, then exact and near copies, then benchmark passages; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import base, decontamination, exact_dedup, near_dedup, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that score a half or more, by a model of the labels of sf_dir; see toxicity.drop_toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, base.load(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row, that of the smallest id, of each text but for white space; see exact_dedup.drop_exact_copies."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the smallest id of each group linked by 0.8 of shingles of five words; see near_dedup.drop_near_copies."""
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without passages of the benchmark of sf_dir, or without documents that are half of such; see decontamination.decontaminate."""
    return decontamination.decontaminate(docs, base.load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of docs in sequences of tokens, neighbours on the curve together; see packing.pack_documents."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Trained scores decide the first stage: SQL can't express it, and tests compare it with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents of sf_dir. A stage's scratch tables, and its input, go once its result is written.

    Null and empty texts pass every filter but exact copies, which leaves one; empty tables give an empty result; extra
    columns, whatever their names, are carried to the last stage.
    """
    docs = base.load(spark, sf_dir, "documents")
    since = base.opened()
    for name, stage in STAGES:
        docs = base.scratch(stage(spark, docs, sf_dir), name)
        base.sweep(spark, since, keep=docs)
    return docs

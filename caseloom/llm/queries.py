"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_tree, decontamination, exact_dedup, near_dedup, packing, quality, secrets, sharding, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_context_tree_weighting": context_tree.op1_context_tree_weighting,
        "op2_multi_index_minhash": near_dedup.op2_multi_index_minhash,
        "op3_byte_prefix_shards": sharding.op3_byte_prefix_shards,
        "op4_trigram_secret_scan": secrets.op4_trigram_secret_scan,
        "op5_automaton_decontamination": decontamination.op5_automaton_decontamination,
        "op6_ngram_toxicity": toxicity.op6_ngram_toxicity,
        "op7_byte_convolution_quality": quality.op7_byte_convolution_quality,
        "op8_arc_to_warc": warc.op8_arc_to_warc,
        "op9_hilbert_packing": packing.op9_hilbert_packing,
        "op10_chunk_recipes": exact_dedup.op10_chunk_recipes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_multi_index_minhash": near_dedup.OP2_SQL, "op3_byte_prefix_shards": sharding.OP3_SQL, "op4_trigram_secret_scan": secrets.OP4_SQL, "op5_automaton_decontamination": decontamination.OP5_SQL, "op8_arc_to_warc": warc.OP8_SQL, "op10_chunk_recipes": exact_dedup.OP10_SQL}

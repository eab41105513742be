"""Bounded labelled samples, and a logistic fit in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_crc, text_or_empty


#: UTF-8 bytes of the texts of a class that the driver learns from, at most.
SAMPLE_BYTES = 48 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, rows: int) -> tuple[pa.Array, np.ndarray, float]:
    """Texts and labels of at most so many rows and SAMPLE_BYTES of each class, and the log odds by which the classes' shares differ from all.

    Rows with held_out(crc32 of the id) are left out. Rows are taken by a hash of their id, so the choice is the same
    each time; only ids are ordered, and the chosen ids (2 * rows at most) are broadcast to fetch the texts' sizes, then
    the texts. Of rows that share an id the least text stands for all; a text that would pass the bytes is left out whole.
    """
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(id_crc())).groupBy("doc_id").agg(F.max(label).alias("y"))
    ids, shares = [], [0, 0]
    for y, n in own.groupBy("y").count().collect():
        shares[y] = n
    for y in (0, 1):
        ids.append(own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    chosen = ids[0].union(ids[1]).withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sizes = texts.select("doc_id", "y", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("place")).collect()
    room, over = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in sorted(sizes, key=lambda r: (r.place, r.doc_id)):
        if r.size <= room[r.y]:
            room[r.y] -= r.size
        else:
            over.append(r.doc_id)
    got = (texts.filter(~F.col("doc_id").isin(over)) if over else texts).select("doc_id", "text", "y").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    y = got["y"].to_numpy().astype(np.float64)
    shift = np.log((shares[1] + 1) / (shares[0] + 1)) - np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    return got["text"].cast(pa.large_string()).combine_chunks(), y, float(shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def adam(start: list[np.ndarray], gradient, steps: int, rate: float) -> list[np.ndarray]:
    """Adam on gradient(parameters, step)."""
    at, m, v = [p.copy() for p in start], [np.zeros_like(p) for p in start], [np.zeros_like(p) for p in start]
    for k in range(1, steps + 1):
        for i, g in enumerate(gradient(at, k)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            at[i] = at[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return at

"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import _LOWER, blocks, fresh, id_crc, load, small_batches, texts_of
from .learning import adam, labelled_sample, sigmoid

#: Lengths of n-grams in characters, A-Z as a-z; hash bits; n-grams that get a weight.
LENGTHS, BITS, FEATURES = (4, 6, 8), 22, 1 << 11  # under 2^15
#: Labelled rows of each class to learn from, at most.
SAMPLE = 2500
_U = np.uint64


@dataclass
class Model:
    """number: of the feature of each hash, or -1; weight: by feature, log-count ratio times learned factor."""

    number: np.ndarray
    weight: np.ndarray
    bias: float


def characters(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of UTF-8 texts (its bytes), A-Z as a-z, and where rows begin among them."""
    low = _LOWER[data]
    if not (low & 0x80).any():
        return low.astype(np.uint64), ends
    lead = (low & 0xC0) != 0x80
    lead[ends[:-1][ends[:-1] < len(low)]] = True
    at = np.flatnonzero(lead)
    size = np.diff(at, append=len(low))
    out = low[at].astype(np.uint64)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= low[at[more] + k].astype(np.uint64) << _U(8 * k)
    return out, np.searchsorted(at, ends)


def grams(data: np.ndarray, ends: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash or feature) of the distinct character n-grams of each row; with number, only those that are features."""
    low, ends = characters(data, ends)
    rows, found = [], []
    for n in LENGTHS:
        if len(low) < n:
            continue
        key = np.zeros(len(low) - n + 1, np.uint64)
        for i in range(n):
            key = key * _U(0x100000001B3) + low[i : len(key) + i]
        code = ((key * _U(0x9E3779B97F4A7C15 + 2 * n)) >> _U(64 - BITS)).astype(np.int64)
        inside = np.ones(len(code), bool)
        for k in range(1, n):  # those that would run into the next row
            at = ends[1:] - k
            at = at[(at >= 0) & (at < len(code))]
            inside[at] = False
        if number is not None:
            code = number[code]
            inside &= code >= 0
        at = np.flatnonzero(inside)
        rows.append(np.searchsorted(ends, at, "right") - 1)
        found.append(code[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique((np.concatenate(rows).astype(np.int64) << 32) | np.concatenate(found).astype(np.int64))
    return both >> 32, both & 0xFFFFFFFF


def train(texts: pa.Array, y: np.ndarray, shift: float) -> Model:
    """shift: added to the log odds. Without examples of both classes every score is that of the known shares."""
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        return Model(np.full(size, -1, np.int16), np.zeros(1), float(shift if not len(y) else np.log((y.sum() + 1) / ((1 - y).sum() + 1)) + shift))
    counts = np.zeros((2, size), np.int32)
    data, ends = texts_of(texts)
    for i, j in blocks(ends):
        rows, code = grams(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        for c in (0, 1):
            np.add.at(counts[c], code[y[i + rows] == c], 1)
    some = np.flatnonzero(counts[0] + counts[1] >= 2)
    pos, neg = counts[1][some] + 0.5, counts[0][some] + 0.5
    del counts
    ratio = np.log(pos / (y.sum() + 1)) - np.log(neg / ((1 - y).sum() + 1))
    sure = np.abs(ratio) / np.sqrt(1 / pos + 1 / neg)
    best = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    best = best[sure[best] > 0]
    number = np.full(size, -1, np.int16)
    number[some[best]] = np.arange(len(best))
    scale = ratio[best]
    del some, pos, neg, ratio, sure
    parts = []
    for i, j in blocks(ends):
        rows, f = grams(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], number)
        parts.append((rows + i, f))
    rows, f = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    value = scale[f]

    def gradient(at: list[np.ndarray], _: int) -> list[np.ndarray]:
        w, b = at
        error = (sigmoid(np.bincount(rows, value * w[f], len(y)) + b[0]) - y) / len(y)
        return [np.bincount(f, value * error[rows], len(scale)) + 2e-5 * w, np.array([error.sum()])]

    w, b = adam([np.zeros(len(scale)), np.zeros(1)], gradient, 150, 0.01)
    return Model(number, scale * w, float(b[0] + shift))


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 for each whole text, in `column`, or a fresh name like it where docs has one (see base.fresh).

    Null and empty texts, and those shorter than an n-gram, get the model's bias alone. Each row is scored on its own, so
    ids, ties and repeated rows are no matter; long texts go in blocks; an empty table stays empty. The other columns are
    unchanged, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    column = fresh(docs, column)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, ends = texts_of(batch["text"])
            total = np.zeros(batch.num_rows)
            for i, j in blocks(ends):
                rows, f = grams(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], m.number)
                total[i:j] = np.bincount(rows, m.weight[f], j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(total + m.bias))], [*batch.schema.names, column])

    return docs.mapInArrow(score, docs.withColumn(column, F.lit(0.0)).schema)


def held_out(crc):
    return crc % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*labelled_sample(docs, labels, "toxic", held_out, SAMPLE))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score under a half (see score_documents), with their columns, whatever these are named."""
    name = fresh(docs, "_toxic")
    return score_documents(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def op6_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(id_crc()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

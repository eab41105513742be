"""Quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import blocks, fresh, id_crc, load, small_batches, texts_of
from .learning import adam, labelled_sample, sigmoid

#: Numbers that stand for a byte; bytes under a filter; filters; bytes of a chunk; bytes that neighbouring chunks share.
EMBED, WIDTH, FILTERS, CHUNK, OVERLAP = 6, 6, 16, 256, 32
#: Labelled rows of each class to learn from, at most; random chunks of a row in a step; rows of a step; steps.
SAMPLE, CHUNKS, BATCH, STEPS = 1500, 3, 64, 260
PROBABLE = 0.7
#: Bytes whose filter responses are in memory at once.
PIECE = 1 << 16


@dataclass
class Network:
    embed: np.ndarray  # byte, number
    filters: np.ndarray  # offset * number, filter
    shift: np.ndarray  # filter
    out: np.ndarray  # mean of the chunks' maxima, then largest of them
    bias: float


def chunk_maxima(data: np.ndarray, ends: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter maxima) of every chunk: chunks begin CHUNK - OVERLAP bytes apart, so they overlap and cover each row to its end.

    A row shorter than a filter is filled up with zeros; one without bytes has no chunk. Long rows go in pieces.
    """
    step, rows, maxima = CHUNK - OVERLAP, [], []
    for i, j in blocks(ends, PIECE):
        size = int(ends[j] - ends[i])
        for at in range(0, max(size, 1), PIECE // step * step):
            own = data[ends[i] + at : min(ends[j], ends[i] + at + PIECE // step * step + OVERLAP)] if size > PIECE else data[ends[i] : ends[j]]
            edges = np.array([0, len(own)]) if size > PIECE else ends[i : j + 1] - ends[i]
            if at and len(own) <= OVERLAP:  # the piece before covers it
                break
            x = np.zeros((len(own) + WIDTH, EMBED), np.float32)
            x[: len(own)] = net.embed[own]
            patches = np.lib.stride_tricks.as_strided(x, (len(own), WIDTH * EMBED), (x.strides[0], 4))
            y = np.ascontiguousarray(patches) @ net.filters
            for k in range(1, WIDTH):  # filters stay within a row, unless it is shorter than they are
                cut = edges[1:] - k
                y[cut[cut > edges[:-1]]] = -1e9
            for r in np.flatnonzero(np.diff(edges)).tolist():
                a, b = int(edges[r]), int(edges[r + 1])
                if b - a < WIDTH:
                    part = np.zeros((WIDTH, EMBED), np.float32)
                    part[: b - a] = net.embed[own[a:b]]
                    top = part.reshape(1, -1) @ net.filters
                else:
                    cells = np.maximum.reduceat(y[a:b], np.arange(0, b - a, OVERLAP), axis=0)
                    n, lead = max(1, -(-(b - a - OVERLAP) // step)), step // OVERLAP
                    top = np.stack([cells[k * lead : k * lead + lead + 1].max(axis=0) for k in range(n)])
                rows.append(np.full(len(top), i + r))
                maxima.append(np.maximum(top + net.shift, 0))
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, FILTERS), np.float32)
    return np.concatenate(rows), np.concatenate(maxima)


def pooled(data: np.ndarray, ends: np.ndarray, net: Network) -> np.ndarray:
    """For each row the mean and the largest of its chunks' maxima; zeros for an empty row."""
    rows, top = chunk_maxima(data, ends, net)
    out = np.zeros((len(ends) - 1, 2 * FILTERS), np.float32)
    if len(rows):
        have, first, n = np.unique(rows, return_index=True, return_counts=True)
        out[have, :FILTERS] = np.add.reduceat(top, first, axis=0) / n[:, None]
        out[have, FILTERS:] = np.maximum.reduceat(top, first, axis=0)
    return out


def train(texts: pa.Array, y: np.ndarray, shift: float) -> Network:
    """Filters are learned on random chunks of the rows, then the output on the pooled chunks of whole rows.

    shift: added to the log odds. Without examples of both classes every score is that of the known shares.
    """
    random = np.random.default_rng(5)
    start = [random.normal(0, 0.5, (256, EMBED)), random.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), random.normal(0, 0.3, FILTERS), np.zeros(1)]
    if not len(y) or y.min() == y.max():
        return Network(start[0].astype(np.float32), start[1].astype(np.float32), start[2].astype(np.float32), np.zeros(2 * FILTERS), float(shift if not len(y) else np.log((y.sum() + 1) / ((1 - y).sum() + 1)) + shift))
    data, ends = texts_of(texts)
    sizes = np.diff(ends)
    usable, classes = sizes >= WIDTH, [np.flatnonzero((y == c) & (sizes >= WIDTH)) for c in (0, 1)]
    if not all(map(len, classes)):
        classes = [np.flatnonzero(usable)] * 2 if usable.any() else [np.zeros(0, int)] * 2

    def gradient(at: list[np.ndarray], _: int) -> list[np.ndarray]:
        embed, filters, bias, out, c = at
        zero = [np.zeros_like(p) for p in at]
        if not len(classes[0]):
            return zero
        rows = np.concatenate([random.choice(k, BATCH // 2) for k in classes])
        length = np.minimum(sizes[rows], CHUNK)
        first = ends[rows][:, None] + (random.random((len(rows), CHUNKS)) * (sizes[rows] - length + 1)[:, None]).astype(np.int64)
        spot = first.reshape(-1, 1) + np.arange(CHUNK)
        last = np.repeat(ends[rows] + sizes[rows], CHUNKS)[:, None]
        inside = spot < last
        byte = np.where(inside, data[np.minimum(spot, len(data) - 1)], 0)
        x = (embed[byte] * inside[:, :, None]).astype(np.float32)
        w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2)).reshape(len(x), CHUNK - WIDTH + 1, WIDTH * EMBED)
        z = w.reshape(-1, WIDTH * EMBED) @ filters.astype(np.float32)
        z = z.reshape(len(x), -1, FILTERS)
        z[~inside[:, WIDTH - 1 :]] = -1e9
        z[:, 0][z[:, 0] < -1e8] = 0
        arg = z.argmax(axis=1)
        top = np.take_along_axis(z, arg[:, None], 1)[:, 0] + bias
        alive = top > 0
        mean = (top * alive).reshape(len(rows), CHUNKS, FILTERS).mean(axis=1)
        error = (sigmoid(mean @ out + c[0]) - y[rows]) / len(rows)
        down = np.repeat(error[:, None] * out / CHUNKS, CHUNKS, axis=0) * alive
        won = w[np.arange(len(x))[:, None], arg]  # chunk, filter, patch
        g_filters = np.einsum("cf,cfp->pf", down, won)
        g_patch = (down[:, :, None] * filters.T).reshape(len(x), FILTERS, WIDTH, EMBED)
        g_embed = zero[0]
        np.add.at(g_embed, byte[np.arange(len(x))[:, None, None], arg[:, :, None] + np.arange(WIDTH)], g_patch)
        return [g_embed, g_filters + 1e-4 * filters, down.sum(axis=0), mean.T @ error + 1e-4 * out, np.array([error.sum()])]

    embed, filters, bias, _, _ = adam(start, gradient, STEPS, 0.02)
    net = Network(embed.astype(np.float32), filters.astype(np.float32), bias.astype(np.float32), np.zeros(2 * FILTERS), 0.0)
    seen = np.concatenate([pooled(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], net) for i, j in blocks(ends)]).astype(np.float64)
    scale = seen.std(axis=0) + 1e-3

    def last(at: list[np.ndarray], _: int) -> list[np.ndarray]:
        error = (sigmoid(seen / scale @ at[0] + at[1][0]) - y) / len(y)
        return [(seen / scale).T @ error + 1e-3 * at[0], np.array([error.sum()])]

    out, c = adam([np.zeros(2 * FILTERS), np.zeros(1)], last, 400, 0.05)
    net.out, net.bias = out / scale, float(c[0] + shift)
    return net


def score_documents(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 for each whole text, in `column`, or a fresh name like it where docs has one (see base.fresh).

    Null and empty texts get the network's bias alone; texts shorter than a filter are filled up with zeros. Each row is
    scored on its own, so ids, ties and repeated rows are no matter; long texts go in pieces; an empty table stays empty.
    The other columns are unchanged, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    column = fresh(docs, column)
    shared = spark.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        for batch in batches:
            data, ends = texts_of(batch["text"])
            total = pooled(data, ends, n) @ n.out if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(total.astype(np.float64) + n.bias))], [*batch.schema.names, column])

    return docs.mapInArrow(score, docs.withColumn(column, F.lit(0.0)).schema)


def held_out(crc):
    return crc % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    return train(*labelled_sample(docs, labels, "quality", held_out, SAMPLE))


def op7_byte_convolution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(id_crc()).alias("held_out"), "score", (F.col("score") >= PROBABLE).cast("int").alias("predicted"))

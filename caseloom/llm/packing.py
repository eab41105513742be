"""Packing along a Hilbert curve of hashed document vectors."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import hashed_rows, load, small_batches, text_or_empty

#: Tokens of a sequence; the id that ends a document.
LENGTH, END = 2048, 1
#: Numbers of a document's vector, and bits of each in the curve's key; low bits of the sort key that come from the id.
DIMENSIONS, DEPTH, SPREAD = 4, 11, 18
#: Bytes of texts of a stretch of the curve, which is packed by itself (so one sequence of each is part empty); more
#: bytes than this times STRETCHES make longer stretches.
STRETCH_BYTES, STRETCHES = 8 << 20, 20_000
#: The pattern by which the tokenizer cuts texts before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White-space characters in a row that tiktoken isn't given: it gives up at about 1,000,000.
SPACE = 100_000
_U = np.uint64


def hilbert(point: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows) with so many bits a number."""
    x = [point[:, i].astype(np.int64) for i in range(point.shape[1])]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns, from the coarsest cell on
        for i in range(n):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0], x[i] = np.where(on, x[0] ^ (q - 1), x[0] ^ swap), np.where(on, x[i], x[i] ^ swap) if i else np.where(on, x[0] ^ (q - 1), x[0])
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def curve_keys(text: pa.Array) -> np.ndarray:
    """Hilbert keys: a text's word counts, hashed to signs in each dimension, summed, scaled by their spread and cut to bits."""
    out = []
    for _, hashes, first in hashed_rows(text):
        n = np.diff(first)
        point = np.zeros((len(n), DIMENSIONS))
        for d in range(DIMENSIONS):
            total = np.concatenate(([0], np.cumsum((hashes >> _U(63 - d)) & _U(1), dtype=np.int64)))
            point[:, d] = (2 * (total[first[1:]] - total[first[:-1]]) - n) / np.sqrt(np.maximum(n, 1))
        grid = np.clip((0.5 + np.arctan(point / 3) / np.pi) * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64)
        out.append(hilbert(grid, DEPTH))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def tokenizer(path: str) -> Callable[[str], list[int]]:
    """Encodes texts to ids of the byte-level BPE vocabulary in path (a tokenizers JSON file), as the tokenizers library does
    with add_special_tokens=False: an added token's content in a text is that token.

    tiktoken, over the same ranks, is faster and gives the same ids but for such contents and for white space so long that it
    gives up; texts with either go through tokenizers.
    """
    import tiktoken

    vocabulary, added = _vocabulary(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file shows as themselves
    code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(code[c] for c in token): i for token, i in vocabulary.items() if token not in added}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    long_space = re.compile(rf"\s{{{SPACE}}}")
    whole: list = []

    def encode(text: str) -> list[int]:
        if any(x in text for x in added) or len(text) >= SPACE and long_space.search(text):
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(path))
            return whole[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def _vocabulary(path: str) -> tuple[dict[str, int], set[str]]:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    return file["model"]["vocab"], {x["content"] for x in file["added_tokens"]}


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked.

    The curve is cut into stretches of nearly equal bytes by quantiles of its keys, which are found first, without
    tokens. Then texts become ids once, go to their stretch, are sorted along the curve there and fill sequences one
    after another, cut wherever a sequence is full: padding is at most one sequence a stretch. Equal texts have equal
    keys but for bits of their id, so that a hot text is spread over stretches too. sequence_id is the stretch's number
    times 2^32 plus the sequence's place in it. Null and empty texts are the end id alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SPREAD))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((curve_keys(batch["text"]) << SPREAD) | batch["salt"].to_numpy()), batch["size"]], ["key", "size"])

    sized = docs.select("text", salt.alias("salt"), (F.octet_length("text") + 1).cast("long").alias("size")).mapInArrow(keys, "key long, size long")
    total = docs.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0
    n = int(min(STRETCHES, max(1, -(-total // STRETCH_BYTES))))
    bounds = np.zeros(0, np.int64)
    if n > 1:
        share = sized.select("key", F.explode(F.expr("sequence(0L, size div 4096)")))  # long texts weigh more
        bounds = np.unique(np.array(share.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 20 * n)).first()[0], np.int64))
    n = len(bounds) + 1
    loaded: dict[str, object] = {}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "t" not in loaded:
            loaded["t"] = tokenizer(path)
        for batch in batches:
            key = (curve_keys(batch["text"]) << SPREAD) | batch["salt"].to_numpy()
            ids = [np.array([*loaded["t"](t), END], np.uint32) for t in batch["text"].to_pylist()]
            narrow = [bool(x.max() < 1 << 16) for x in ids]
            small = [x.astype("<u2" if n else "<u4").tobytes() for x, n in zip(ids, narrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.searchsorted(bounds, key, "right").astype(np.int64)), pa.array(key), pa.array(narrow, pa.bool_()), pa.array(small, pa.binary())], ["doc_id", "stretch", "key", "narrow", "ids"])

    encoded = docs.select("doc_id", "text", salt.alias("salt")).mapInArrow(encode, "doc_id long, stretch long, key long, narrow boolean, ids binary")
    placed = encoded.repartition(max(n, 1), "stretch").sortWithinPartitions("stretch", "key", "doc_id", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stretch = 0, None
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, own, narrow, raw in zip(*(batch[c].to_pylist() for c in ("doc_id", "stretch", "narrow", "ids")), strict=True):
                if own != stretch:
                    at, stretch = 0, own
                ids = np.frombuffer(raw, "<u2" if narrow else "<u4").astype("<u4")
                first = 0
                while first < len(ids):
                    last = min(len(ids), first + length - at % length)
                    piece = ids[first:last]
                    for column, value in zip(rows, (doc, first, last - first, zlib.crc32(piece.tobytes()), len(ids), (own << 32) + at // length, at % length, piece.tolist() if with_ids else None), strict=False):
                        column.append(value)
                    at, first = at + last - first, last
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=False)], names)

    return placed.mapInArrow(fill, ", ".join(f"{c} {'array<long>' if c == 'ids' else 'long'}" for c in names))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), default_tokenizer(), LENGTH)

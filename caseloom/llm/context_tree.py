"""Language-model scores by context-tree weighting over bytes, each decomposed into eight binary decisions.

Every node of the tree (the last 0 to DEPTH bytes, and the leading bits of the next byte) counts the bits that follow it in
training texts and estimates them by Krichevsky-Trofimov. A node's weight says how far its own estimate is believed against
those of its longer contexts: half the estimate's probability of the counts over their mixture's. The probability of a bit
mixes the estimates of all depths by these weights; where a longer context was never seen, the deepest that was decides.

The model is never gathered. Texts become blocks; a block asks for its distinct contexts and words, each request going to
the partition that owns the key's bucket, where the counts of all blocks meet and the answers are made; the answers go back
to the block. Requests and answers are packed arrays, so a block and bucket exchange one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import id_crc, load, mixed, remove, scratch, small_batches, text_or_empty, word_hashes, words

#: Bytes of the longest context.
DEPTH = 6
#: Bytes of texts in a block, about (a longer text is a block of its own); distinct keys of a bucket, about.
BLOCK, BUCKET_KEYS = 8 << 20, 1 << 20
#: Buckets at most: there are so many pairs of last bytes.
MOST_BUCKETS = 1 << 16
#: What ends a word and a text, as tokens of the model.
SPACE, END = b"\x20", b"\x0a"
GRAMS, WORDS = 0, 1
_U = np.uint64
MET = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("part", pa.list_(pa.int32())), ("block", pa.list_(pa.int32())), ("places", pa.list_(pa.binary())), ("byte", pa.int32()), ("place", pa.int32()), ("ones", pa.float64()), ("total", pa.float64()), ("mixture", pa.float64())])
#: The key that stands for the end among words.
END_KEY = _U(1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers, by Stirling's series after ten steps up."""
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(10):
        low = y < 10
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


_HALVES, _WHOLES = log_gamma(np.arange(1 << 14) + 0.5), log_gamma(np.arange(1 << 14) + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of so many zeros and ones (whole numbers) under the Krichevsky-Trofimov estimate."""

    def at(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
        n = n.astype(np.int64)
        out = table[np.minimum(n, len(table) - 1)]
        large = n >= len(table)
        out[large] = log_gamma(n[large] + more)
        return out

    return at(zeros, _HALVES, 0.5) + at(ones, _HALVES, 0.5) - at(zeros + ones, _WHOLES, 1.0) - np.log(np.pi)


def canonical(text: bytes) -> bytes:
    """What is scored: each word, lower-cased, and a space after it; then the end."""
    own = text.lower().split()
    return SPACE.join([*own, END]) if own else END


def gram_keys(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """DEPTH bytes before each byte and itself, as a number whose lowest 8 bits are the byte, the next the one before it, and
    so on. Before a text stand DEPTH end bytes; ends: where texts begin, and the length."""
    wide = np.concatenate((np.full(DEPTH, END[0], np.uint8), data))
    key = np.zeros(len(data), np.uint64)
    for i in range(DEPTH + 1):
        key = (key << _U(8)) | wide[i : i + len(data)]
    for k in range(DEPTH):  # a text's first bytes have ends before them, not the text before
        at = ends[:-1] + k
        at = at[at < ends[1:]]
        if len(at):
            own, value = data[at[:, None] - np.arange(k, -1, -1)], np.zeros(len(at), np.uint64)
            for _ in range(DEPTH - k):
                value = (value << _U(8)) | _U(END[0])
            for i in range(k + 1):
                value = (value << _U(8)) | own[:, i]
            key[at] = value
    return key


def word_keys(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return word_hashes(data, starts, stops) >> _U(1)


def counted(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (of 63 bits) with the number of those in training."""
    keys = np.sort((keys << _U(1)) | training)
    own = keys >> _U(1)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    before = np.concatenate(([0], np.cumsum(keys & _U(1), dtype=np.int64)))
    return own[first], before[np.append(first[1:], len(own))] - before[first] if len(own) else np.zeros(0, np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same keys added up; takes the parts out of their list, four at a time, so that few are in memory twice."""
    while len(parts) > 1:
        some = [parts.pop() for _ in range(min(4, len(parts)))]
        keys, n = np.concatenate([p[0] for p in some]), np.concatenate([p[1] for p in some])
        del some
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        parts.insert(0, (keys[first], np.add.reduceat(n, first) if len(first) else n))
    return parts[0]


def block_counts(data: np.ndarray, ends: np.ndarray, training: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct grams and words of a block of canonical texts, with their numbers in its training texts."""
    grams, tokens = [], []
    step = max(1, len(ends) // max(1, len(data) >> 19))
    for i in range(0, len(ends) - 1, step):
        own = ends[i : i + step + 1]
        part, own = data[own[0] : own[-1]], own - own[0]
        inside = np.repeat(training[i : i + step], np.diff(own))
        grams.append(counted(gram_keys(part, own), inside))
        starts, stops, first = words(part, own)
        tokens.append(counted(word_keys(part, starts, stops), np.repeat(training[i : i + step], np.diff(first))))
    tokens.append((np.array([END_KEY]), np.array([int(training.sum())])))
    return {GRAMS: summed(grams), WORDS: summed(tokens)}


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grams that share the last two context bytes are in one bucket, so it holds whole subtrees."""
    return (mixed((keys >> _U(8)) & _U(0xFFFF) if kind == GRAMS else keys) % _U(buckets)).astype(np.int64)


def bucketed(kind: int, keys: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, places of its keys, in order, bucket by bucket)."""
    at = bucket_of(kind, keys, buckets)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            own = order[cuts[b] : cuts[b + 1]]
            yield b, own, n[own]


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpacked(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def packed_planes(a: np.ndarray) -> bytes:
    """Byte plane by byte plane."""
    return packed(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T))


def unpacked_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(unpacked(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane."""
    steps = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8)
    return packed(np.ascontiguousarray(steps.T))


def unpacked_keys(raw: bytes) -> np.ndarray:
    planes = unpacked(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


class Subtrees:
    """The nodes of depth 2 and more over the grams of a bucket, with their counts n in training texts.

    For each of the eight bits the grams are sorted by the bits before it and then by context, nearest byte first: the
    grams of a node stand together at every depth.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.n = grams, n
        self.context = np.zeros(len(grams), np.uint64)
        for d in range(1, DEPTH + 1):
            self.context = (self.context << _U(8)) | ((grams >> _U(8 * d)) & _U(0xFF))

    def levels(self) -> Iterator[tuple]:
        """For each bit: it, order of the grams, whether theirs is one, nodes by depth (deepest first: number by gram,
        ones, count, weight), and the first gram and log mixture of the depth-2 nodes."""
        for bit in range(8):
            prefix = (self.grams & _U(0xFF)) >> _U(8 - bit)
            key = (prefix << _U(8 * DEPTH)) | self.context
            order = np.argsort(key, kind="stable")
            key, n = key[order], self.n[order]
            one = ((self.grams[order] >> _U(7 - bit)) & _U(1)).astype(np.int64)
            mine, nodes, below = n * one, [], None
            for depth in range(DEPTH, 1, -1):
                own = key >> _U(8 * (DEPTH - depth))
                new = np.concatenate(([True], own[1:] != own[:-1]))
                first, at = np.flatnonzero(new), np.cumsum(new) - 1
                ones, total = np.add.reduceat(mine, first), np.add.reduceat(n, first)
                kt = log_kt(total - ones, ones)
                if below is None:
                    mixture, weight = kt, np.ones(len(first))
                else:
                    lower = np.bincount(at[below[0]], below[1], len(first))
                    mixture = np.logaddexp(kt, lower) - np.log(2)
                    weight = np.exp(kt - np.log(2) - mixture)
                nodes.append((at, ones, total, weight))
                below = (first, mixture)
            yield bit, order, one, nodes, below

    def summary(self) -> np.ndarray:
        """By last context byte and place of the bit (1, then its leading bits): ones, count and log mixture of the depth-2 nodes, added up."""
        out = np.zeros((256, 256, 3))
        for bit, order, _, nodes, (first, mixture) in self.levels():
            grams = self.grams[order[first]]
            byte, prefix = (grams >> _U(8)) & _U(0xFF), (grams & _U(0xFF)) >> _U(8 - bit)
            place = (byte.astype(np.int64) << 8) + (1 << bit) + prefix.astype(np.int64)
            for k, v in enumerate((nodes[-1][1], nodes[-1][2], mixture)):
                out[:, :, k] += np.bincount(place, v, 1 << 16).reshape(256, 256)
        return out

    def log_probabilities(self, top: Top) -> np.ndarray:
        """log10 probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(self.grams))
        byte, value = ((self.grams >> _U(8)) & _U(0xFF)).astype(np.int64), (self.grams & _U(0xFF)).astype(np.int64)
        for bit, order, one, nodes, _ in self.levels():
            chance = None
            for at, ones, total, weight in nodes:
                chance = mix(chance, one, ones[at], total[at], weight[at])
            b, place = byte[order], (1 << bit) + (value[order] >> (8 - bit))
            chance = mix(chance, one, top.ones1[b, place], top.total1[b, place], top.weight1[b, place])
            chance = mix(chance, one, top.ones0[place], top.total0[place], top.weight0[place])
            out[order] += np.log10(np.where(chance > 0, chance, 0.5))
        return out


def mix(deeper: np.ndarray | None, one: np.ndarray, ones: np.ndarray, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Probability of the bit at a node, given that of the node below (0 where that was never seen)."""
    own = (np.where(one == 1, ones, total - ones) + 0.5) / (total + 1.0)
    if deeper is not None:
        own = np.where(deeper > 0, weight * own + (1 - weight) * deeper, own)
    return np.where(total > 0, own, 0.0)


class Top:
    """The nodes of depth 0 and 1, of which there are 255 * 257 at most."""

    def __init__(self, summary: np.ndarray):
        self.ones1, self.total1 = summary[:, :, 0], summary[:, :, 1]
        kt = log_kt(self.total1 - self.ones1, self.ones1)
        mixture = np.logaddexp(kt, summary[:, :, 2]) - np.log(2)
        self.weight1 = np.exp(kt - np.log(2) - mixture)
        self.ones0, self.total0 = self.ones1.sum(axis=0), self.total1.sum(axis=0)
        kt = log_kt(self.total0 - self.ones0, self.ones0)
        mixture0 = np.logaddexp(kt, np.where(self.total1 > 0, mixture, 0).sum(axis=0)) - np.log(2)
        self.weight0 = np.exp(kt - np.log(2) - mixture0)


class Places:
    """Finds keys in a sorted array by two hashed slots each, and by bisection for the few that have none."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(np.ceil(np.log2(max(len(keys), 1) * 1.4))))
        self.first, self.second = (np.zeros(1 << self.bits, np.int32) for _ in range(2))
        self.first[self._slot(keys, 1)] = np.arange(len(keys))
        left = np.flatnonzero(keys[self.first[self._slot(keys, 1)]] != keys)
        self.second[self._slot(keys[left], 2)] = left

    def _slot(self, keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys * _U((0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[k])) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[self._slot(keys, 1)]
        miss = np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            at[miss] = self.second[self._slot(keys[miss], 2)]
            miss = miss[self.keys[at[miss]] != keys[miss]]
            at[miss] = np.searchsorted(self.keys, keys[miss])
        return at


def score_texts(docs: DataFrame, training) -> tuple[DataFrame, int, int]:
    """(doc_id, held_out, n_tokens, n_known, base_sum, n_bytes, score) for each row of docs (doc_id, text), and N and V.

    training: a column of docs, true for rows to learn from. base_sum is the sum over tokens of log10(count + 0.5).
    Null and empty texts are the end token alone; null ids are as any; without training rows bits have probability 1/2.
    Repeated rows count each time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_or_empty()) + 2)).first()[0] or 0
    buckets = int(max(24, min(MOST_BUCKETS, -(-size // (BUCKET_KEYS * 8)))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, texts, total, n = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            data, ends, flag = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(sizes))), np.array(flags, bool)
            rows = []
            for kind, (keys, count) in block_counts(data, ends, flag).items():
                for b, at, c in bucketed(kind, keys, count, buckets):
                    rows.append((part, n, kind, b, packed_keys(keys[at]), packed(c.astype(np.uint32)), None, None, None, None))
            known = np.array([i is not None for i in ids], bool)
            numbers = np.array([i or 0 for i in ids], np.int64)
            rows.append((part, n, -1, 0, packed(numbers), packed(sizes), zstandard.ZstdCompressor(level=1).compress(data.tobytes()), packed(flag), packed(known), len(data)))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "block", "kind", "bucket", "a", "b", "c", "d", "e", "n"])

        part = None
        for batch in batches:
            for i, flag, t, own in zip(*(batch[c].to_pylist() for c in ("doc_id", "training", "text", "part")), strict=True):
                part, raw = own, canonical(t)
                if texts and total + len(raw) > BLOCK:
                    yield block()
                    ids, flags, texts, total, n = [], [], [], 0, n + 1
                ids.append(i), flags.append(flag), texts.append(raw)
                total += len(raw)
        if texts:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long"), training.alias("training"), text_or_empty().cast("binary").alias("text"), F.spark_partition_id().alias("part"))
    made = scratch(rows.mapInArrow(cut, "part int, block int, kind int, bucket int, a binary, b binary, c binary, d binary, e binary, n long"), "blocks", "kind")
    asked = made.filter("kind >= 0").select("part", "block", "kind", "bucket", "a", "b")

    def meet(table: pa.Table) -> pa.Table:
        """The requests of a bucket: its keys with their counts, the places of each block's keys among them, and the sums for the top."""
        kind, own = table["kind"][0].as_py(), [unpacked_keys(a) for a in table["a"].to_pylist()]
        keys, n = summed([(k, unpacked(b, np.uint32).astype(np.int64)) for k, b in zip(own, table["b"].to_pylist(), strict=True)])
        places = [packed_keys(np.searchsorted(keys, k).astype(np.uint64)) for k in own]
        first = {"kind": kind, "bucket": table["bucket"][0].as_py(), "keys": packed_keys(keys), "n": packed(n), "part": table["part"].to_pylist(), "block": table["block"].to_pylist(), "places": places}
        if kind == WORDS:
            sums = [[-1], [0], [float(n.sum())], [float((n > 0).sum())], [0.0]]
        else:
            s = Subtrees(keys[n > 0], n[n > 0]).summary() if n.any() else np.zeros((256, 256, 3))
            x, y = np.nonzero(s[:, :, 1])
            sums = [x.tolist(), y.tolist(), *(s[x, y, k].tolist() for k in range(3))]
        rows = [first, *({"byte": v[0], "place": v[1], "ones": v[2], "total": v[3], "mixture": v[4]} for v in zip(*sums, strict=True))]
        return pa.Table.from_pylist(rows, schema=MET)

    met = scratch(asked.groupBy("kind", "bucket").applyInArrow(meet, "kind int, bucket int, keys binary, n binary, part array<int>, block array<int>, places array<binary>, byte int, place int, ones double, total double, mixture double"), "met")
    for kind in (GRAMS, WORDS):  # the requests are answered from met alone
        remove(f"{made.scratch_path}/kind={kind}", spark)
    found = met.filter("byte is not null").groupBy("byte", "place").agg(*[F.sum(c).alias(c) for c in ("ones", "total", "mixture")]).toArrow()
    whole, n_tokens, n_types = np.zeros((256, 256, 3)), 0, 0
    for x, y, *v in zip(*(found[c].to_pylist() for c in ("byte", "place", "ones", "total", "mixture")), strict=True):
        if x < 0:
            n_tokens, n_types = round(v[0]), round(v[1])
        else:
            whole[x, y] = v
    top = spark.sparkContext.broadcast(Top(whole))

    def answers(table: pa.Table) -> pa.Table:
        own = table.to_pylist()[0]
        keys, n = unpacked_keys(own["keys"]), unpacked(own["n"], np.int64)
        value = n if own["kind"] == WORDS else Subtrees(keys, n).log_probabilities(top.value).astype(np.float32)
        out = [packed_planes(value[unpacked_keys(p).astype(np.int64)]) for p in own["places"]]
        return pa.table({"part": own["part"], "block": own["block"], "kind": [own["kind"]] * len(out), "bucket": [own["bucket"]] * len(out), "v": out}, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("v", pa.binary())]))

    told = met.filter("keys is not null").select("kind", "bucket", "keys", "n", "part", "block", "places").groupBy("kind", "bucket").applyInArrow(answers, "part int, block int, kind int, bucket int, v binary")

    def score(texts: pa.Table, back: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "n_bytes", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
        own = texts.to_pylist()[0]
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(own["c"]), np.uint8)
        sizes, flag = unpacked(own["b"], np.int64), unpacked(own["d"], bool)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        values = {(k, b): v for k, b, v in zip(back["kind"].to_pylist(), back["bucket"].to_pylist(), back["v"].to_pylist(), strict=True)}
        looked = {}
        for kind, (keys, n) in block_counts(data, ends, flag).items():
            value = np.zeros(len(keys), np.float32 if kind == GRAMS else np.int64)
            for b, at, _ in bucketed(kind, keys, n, buckets):
                value[at] = unpacked_planes(values[kind, b], value.dtype)
            looked[kind] = (Places(keys), value)
        total, base = np.zeros(len(sizes)), np.zeros(len(sizes))
        tokens, known = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        end = int(looked[WORDS][1][looked[WORDS][0](np.array([END_KEY]))[0]])
        step = max(1, len(ends) // max(1, len(data) >> 19))
        for i in range(0, len(sizes), step):
            cuts = ends[i : i + step + 1]
            part, cuts = data[cuts[0] : cuts[-1]], cuts - cuts[0]
            find, value = looked[GRAMS]
            total[i : i + step] = np.add.reduceat(value[find(gram_keys(part, cuts))].astype(np.float64), cuts[:-1])
            starts, stops, first = words(part, cuts)
            find, value = looked[WORDS]
            count = value[find(word_keys(part, starts, stops))] if len(starts) else np.zeros(0, np.int64)
            logs, seen = np.concatenate(([0.0], np.cumsum(np.log10(count + 0.5)))), np.concatenate(([0], np.cumsum(count > 0)))
            tokens[i : i + step] = np.diff(first) + 1
            known[i : i + step] = seen[first[1:]] - seen[first[:-1]] + (end > 0)
            base[i : i + step] = logs[first[1:]] - logs[first[:-1]] + np.log10(end + 0.5)
        ids = pa.array(unpacked(own["a"], np.int64), mask=~unpacked(own["e"], bool))
        return pa.table([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip([ids, ~flag, tokens, known, base, sizes, total], kinds, strict=True)], names=names)

    texts = made.filter("kind = -1").select("part", "block", "a", "b", "c", "d", "e")
    scored = texts.groupBy("part", "block").cogroup(told.groupBy("part", "block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, n_bytes long, score double")
    return scored, n_tokens, n_types


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored, n, v = score_texts(docs, id_crc() % 5 != 1)
    base = F.col("base_sum") - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))
    per_byte = -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", per_byte.alias("bits_per_byte"))



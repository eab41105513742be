"""Near-duplicates: MinHash signatures, a multi-index Hamming join over their parts, and full sets to confirm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import constants, each, hashed_rows, load, mixed, remove, scratch, small_batches, without_ids
from .components import components

#: A signature has PARTS parts of SYMBOLS minima of 32 bits. Signatures that differ in at most PARTS * (ERRORS + 1) - 1
#: symbols have, by the pigeonhole principle, a part that differs in ERRORS symbols at most; with ERRORS = 1 both emit, for
#: each part, the keys of all its symbols but one. At similarity 0.8 a part fails with probability 0.345, all with 2e-5.
PARTS, SYMBOLS = 10, 6
#: Members of a cluster that one task compares with each other, at most: so many left over with so many of all.
LEFT_BLOCK, ALL_BLOCK = 512, 2048
_U = np.uint64
_A, _B = constants(PARTS * SYMBOLS, 21), constants(PARTS * SYMBOLS, 22)
_M = constants(SYMBOLS, 23)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted 64-bit hashes of its distinct shingles; fewer words than a shingle are one; none are none."""
    mix = constants(width, 24)
    for _, hashes, first in hashed_rows(column):
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = b - a
            if not n:
                yield np.zeros(0, np.uint64)
                continue
            k = min(width, n)
            total = np.full(n - k + 1, k, np.uint64)
            for i in range(k):
                total += hashes[a + i : b - k + 1 + i] * mix[i]
            yield np.unique(mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(PARTS * SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 1 << 13):
        part = (shingles[None, i : i + (1 << 13)] * _A[:, None] + _B[:, None]) >> _U(32)
        out = np.minimum(out, part.min(axis=1).astype(np.uint32))
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set) and sig (the signature's bytes; null for an empty set)."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for s in shingle_sets(batch["text"], width):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, sig binary")


def part_keys(signed: DataFrame) -> DataFrame:
    """(key, id) for each part of each signature and each symbol left out of it."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(-1, PARTS, SYMBOLS).astype(np.uint64)
            parts = mixed(sig + _U(1)) * _M
            total = parts.sum(axis=2, dtype=np.uint64)
            tag = np.arange(PARTS * SYMBOLS, dtype=np.uint64).reshape(PARTS, SYMBOLS) + _U(1)
            out = mixed(mixed(total[:, :, None] - parts) + tag * _U(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(np.repeat(batch["id"].to_numpy(), PARTS * SYMBOLS))], ["key", "id"])

    return signed.select("id", "sig").mapInArrow(keys, "key long, id long")


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the ids, one row each."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch["text"], width))
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], each(pa.array(flat), np.array([len(s) for s in found], np.int64))], ["id", "shingles"])

    return wanted.mapInArrow(sets, "id long, shingles array<long>").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def left_over_links(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join components of a cluster, given clusters (cluster, id, component) with more than one component.

    Members outside a cluster's largest component are compared with all its members on full sets, in blocks of both: a
    block counts shared shingles through postings, and gives for each member one link at most into each other component.
    """
    sizes = clusters.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    columns, rows = F.ceil((F.col("all") - F.col("top")) / LEFT_BLOCK).cast("int"), F.ceil(F.col("all") / ALL_BLOCK).cast("int")
    near = clusters.join(largest, "cluster").withColumns({"columns": columns, "rows": rows, "left": F.col("component") != F.col("main")}).join(sets, "id")
    place = F.xxhash64("id")
    as_all = near.withColumn("row", F.pmod(place, F.col("rows")).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).withColumn("left", F.lit(False))
    as_left = near.filter("left").withColumn("column", F.pmod(F.shiftright(place, 20), F.col("columns")).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    want = ["cluster", "row", "column", "left", "id", "component", "shingles"]

    def compare(table: pa.Table) -> pa.Table:
        left = table["left"].to_numpy(zero_copy_only=False)
        ids, part = table["id"].to_numpy(), table["component"].to_numpy()
        values = table["shingles"].combine_chunks()
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        flat, ends = values.flatten().to_numpy(), np.concatenate(([0], np.cumsum(values.value_lengths().to_numpy())))
        size = np.diff(ends)
        _, code = np.unique(flat, return_inverse=True)
        mine = np.flatnonzero(~left)
        owner = np.repeat(np.arange(len(ids)), size)
        keep = ~left[owner]
        order = np.argsort(code[keep], kind="stable")
        posted, first = owner[keep][order], np.searchsorted(code[keep][order], np.arange(code.max() + 2 if len(code) else 1))
        a, b = [], []
        for x in np.flatnonzero(left).tolist():
            own = code[ends[x] : ends[x + 1]]
            lengths = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            both = np.bincount(posted[at], minlength=len(ids))[mine]
            hit = mine[(100 * both >= percent * (size[x] + size[mine] - both)) & (part[mine] != part[x])]
            hit = hit[np.unique(part[hit], return_index=True)[1]]
            a += [min(int(ids[x]), int(ids[y])) for y in hit]
            b += [max(int(ids[x]), int(ids[y])) for y in hit]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return as_all.select(want).unionByName(as_left.select(want)).groupBy("cluster", "row", "column").applyInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    1. Rows with equal sets are one class, stood for by its smallest id; copies go no further.
    2. Classes whose signatures share a part but for one symbol are in a bucket. Every bucket is first compared with two
       centres alone: its smallest id, and the member that shares most buckets with others (the original of edited copies
       shares more than they do among themselves). Full sets confirm these links, whose components follow.
    3. Classes that buckets connect are a cluster. Where the centres left a cluster in several components, the members
       outside the largest are compared with the whole cluster, block by block, on full sets.
    Null or empty texts and texts without words are linked with nothing; a null id keeps a null component and is kept.
    Rows of one id have one text, or else their sets are taken as versions of one document.
    """
    signed = scratch(signatures(docs, width), "signatures")
    full = signed.filter(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    classes = scratch(full.groupBy("set_key").agg(F.min("doc_id").alias("id")), "classes")
    member = scratch(full.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "id").distinct(), "members")
    heads = full.join(member.filter("doc_id = id").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "sig").dropDuplicates(["id", "sig"])
    keys = part_keys(heads)
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    buckets = scratch(keys.join(shared, "key"), "buckets")
    hubs = buckets.groupBy("id").agg(F.sum("n").alias("weight"))
    centre = scratch(buckets.join(hubs, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub")), "centres")
    ends = buckets.join(centre, "key").select("id", F.explode(F.array_distinct(F.array("first", "hub"))).alias("to")).filter("id <> to")
    pairs = scratch(ends.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct(), "pairs")
    sets = scratch(_full_sets(docs, buckets.select("id").distinct(), width), "sets")
    links = scratch(confirmed(pairs, sets, percent), "links")
    found, coarse = scratch(components(links), "components"), scratch(components(pairs), "clusters")
    clusters = coarse.withColumnRenamed("component", "cluster").join(found, "id", "left").select("cluster", "id", F.coalesce("component", "id").alias("component"))
    more = scratch(left_over_links(clusters, sets, percent), "links")
    every = scratch(components(links.union(more)), "components")
    for table in (classes, buckets, centre, pairs, sets, links, found, coarse, more):
        remove(table)
    of = member.join(every.withColumnRenamed("id", "_of"), F.col("id") == F.col("_of"), "left").select(F.col("doc_id").alias("_doc"), F.coalesce("component", "id").alias("component")).groupBy("_doc").agg(F.min("component").alias("component"))
    out = signed.select("doc_id", "n_shingles").join(of, F.col("doc_id") == F.col("_doc"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which each group of near-duplicates (see near_groups) keeps the smallest id, with all their columns.

    Null and empty texts, texts without words and null ids stay; all rows of an id stay or go together; an empty table
    stays empty. Columns are unchanged, whatever their names. Texts move only if over BROADCAST_IDS ids go.
    """
    return without_ids(docs, near_groups(docs, width, percent).filter("not kept").select("doc_id"))


def op2_multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir, "documents"), width=2)




OP2_SQL = r"""
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
shingles as (select distinct doc_id, gram from (select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as gram from words)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as k from shingles x join shingles y on x.gram = y.gram and x.doc_id < y.doc_id group by all) join sizes p on a = p.doc_id join sizes q on b = q.doc_id where 100 * k >= 80 * (p.n + q.n - k)),
ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as id, doc_id as other from documents union select r.id, w.b from reach r join ways w on r.other = w.a),
least_of as (select id, min(other) as c from reach group by id)
select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id, d.doc_id = c as kept from documents d left join sizes using (doc_id) join least_of on d.doc_id = id
"""

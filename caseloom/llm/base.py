"""What the operators share: shared scratch tables, splits of rows by crc32, and byte-level word hashing in numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows and bytes in one Arrow batch sent to Python, whichever comes first; a longer text is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 256, 32 << 20
#: Ids up to which those of rows that go are broadcast (some 100 MB as a hashed relation); beyond, rows are joined by id.
BROADCAST_IDS = 2_000_000
#: UTF-8 bytes of texts that numpy works on at once; a single longer text is a block of its own.
BLOCK_BYTES = 1 << 18


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of texts, and sends workers this package; called by every operator that hands texts to Python."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """name, or where df has a column of it (in any case), name with as many underscores after it as make it new."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which executors and driver share; only a local master may do without the setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Scratch tables that are still there, in the order they were made.
_OPEN: list[str] = []


def opened() -> int:
    """A mark for sweep."""
    return len(_OPEN)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes the scratch tables made since a mark, but one to keep; for when all that reads them is written."""
    for path in _OPEN[since:]:
        if keep is None or path != keep.scratch_path:
            remove(path, spark)


def scratch(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns the table: lineage ends here, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    _OPEN.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(df: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Deletes a scratch table that nothing reads any more."""
    path = df if isinstance(df, str) else df.scratch_path
    spark = spark or df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _OPEN:
        _OPEN.remove(path)


def without_ids(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in lost (one column), with their columns. Rows of docs move only if lost is too large to broadcast."""
    kept = scratch(lost.filter(F.col(lost.columns[0]).isNotNull()).distinct(), "lost")
    return docs.join(F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept, docs["doc_id"] == kept[kept.columns[0]], "left_anti")


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text (a null id as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


# --- numpy on UTF-8 bytes ---

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes between words, where words are all but ASCII white space.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words, where words are ASCII letters, digits and whatever isn't ASCII.
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit words."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 0x9E3779B97F4A7C15 % (1 << 64))) | _U(1)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each row begins in them (one more at the end); nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def blocks(ends: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes together, or one row."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, ends: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last+1 byte of each word, and for each row the number of its first word (one more at the end)."""
    inside = ~between[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = ends[1:-1]
        before[cuts[cuts < len(inside)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, ends)


_PLACES = constants(4096, 12)
#: A number for each byte, the same for A-Z as for a-z, and 0 for those between words.
_VALUES = {between.tobytes(): np.where(between, _U(0), constants(256, 11)[_LOWER]) for between in (SPACES, MARKS)}


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, between: np.ndarray = SPACES) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z: a multilinear hash of bytes by place, then spread."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data, shift = data[starts[0] : stops[-1]], starts[0]
    starts, stops = starts - shift, stops - shift
    steps = np.diff(starts, append=len(data))
    longest = int(steps.max())
    places = _PLACES if longest <= len(_PLACES) else constants(longest, 12)
    own = _VALUES[between.tobytes()][data]
    own *= places[np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), steps)]
    return mixed(np.add.reduceat(own, starts) + (stops - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def hashed_rows(column: pa.Array, between: np.ndarray = SPACES, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words, first word of each row and one more) for blocks of rows."""
    data, ends = texts_of(column)
    for i, j in blocks(ends, most):
        part, own = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        starts, stops, first = words(part, own, between)
        yield i, word_hashes(part, starts, stops, between), first


def each(values, lengths: np.ndarray) -> pa.Array:
    """A list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder: unlike a written table it keeps partitions and their order."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()

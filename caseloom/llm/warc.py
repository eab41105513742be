"""Legacy ARC archives: written from pages, converted to WARC with revisits, and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import load, remove, scratch, scratch_path, small_batches

#: Payload bytes of an archive before compression, at most unless one page has more. An archive is parsed as a whole.
ARCHIVE_BYTES = 32 << 20
#: What stands after a WARC record.
RECORD_END = b"\r\n\r\n"

# Fixed values of the formats.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
#: The text writer's gzip level, by Hadoop's name for it.
LEVEL = {"zlib.compress.level": "BEST_SPEED"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _written(archives: DataFrame, path: str, line_end: str) -> None:
    """Writes rows (value binary), each as one gzipped file of its bytes and a line end."""
    archives.select(F.col("value").cast("string")).write.options(compression="gzip", lineSep=line_end, maxRecordsPerFile=1, **LEVEL).text(path)


# --- pages to ARC ---


def write_arcs(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as gzipped ARC files of version 1 and 2 in turn, each beginning with its file description.

    A page is an HTTP response that carries its page_id in a header; null html is an empty payload, a null url "-",
    white space in a url is escaped. Pages aren't shuffled; a file ends before it would pass ARCHIVE_BYTES, so only a page
    of more than that makes a larger one, of its own.
    """
    small_batches(pages.sparkSession)

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, out, version = 0, 0, [], 1
        for batch in batches:
            for page, url, body, own in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "part")), strict=True):
                payload = body.encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                if out and size + len(payload) > ARCHIVE_BYTES:
                    yield _batch([b"\n".join(out)])
                    out = []
                if not out:
                    n, size, version = n + 1, 0, 1 + (own + n) % 2
                    told = f"{version} 0 synthetic\n{' '.join(FIELDS[version])}\n".encode()
                    out.append(arc_record(version, f"filedesc://{own}-{n}.arc", "text/plain", "0", told))
                out.append(arc_record(version, re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-", "text/html", "200", head + payload))
                size += len(out[-1])
        if out:
            yield _batch([b"\n".join(out)])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"), F.spark_partition_id().alias("part"))
    _written(rows.mapInArrow(archives, "value binary"), path, "\n")


def _batch(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])


def arc_record(version: int, url: str, kind: str, status: str, content: bytes) -> bytes:
    more = "" if version == 1 else f"{status} {sha1(content)} - 0 - "
    return f"{url} 0.0.0.0 20240101000000 {kind} {more}{len(content)}\n".encode() + content


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, content) of each record but file descriptions, which tell the version of those that follow.

    Content is what the declared length says, whatever it holds. Raises ValueError where no header line is found, and
    where less content is left than declared.
    """
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        if version is None or line.startswith("filedesc://"):
            version = 1 if len(parts) == 5 else 2
        names = FIELDS[version]
        if len(parts) < len(names) or not parts[-1].isdigit() or end < 0:
            raise ValueError(f"no ARC header of version {version} at byte {at}")
        fields = dict(zip(names[1:], parts[-len(names) + 1 :], strict=True)) | {"URL": " ".join(parts[: len(parts) - len(names) + 1])}
        content = data[end + 1 : end + 1 + int(fields["Archive-length"])]
        if len(content) < int(fields["Archive-length"]):
            raise ValueError(f"the ARC record at byte {at} is cut short: {len(content)} of {fields['Archive-length']} bytes")
        if line.startswith("filedesc://"):
            words = content.split(b"\n", 1)[0].split(b" ")
            version = int(words[0]) if words[0] in (b"1", b"2") else version
        else:
            yield at, fields, content
        at = end + 1 + len(content)


def http_parts(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Raw headers with their blank line, header fields by lower-cased name, and payload; no HTTP: all is payload."""
    if not content.startswith(b"HTTP/"):
        return b"", {}, content
    cut = content.find(b"\r\n\r\n")
    cut = len(content) if cut < 0 else cut + 4
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in content[:cut].decode("utf-8", "replace").split("\r\n")[1:])}
    return content[:cut], fields, content[cut:]


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text) else None


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def record_id(archive: str, offset: int) -> str:
    """The identifier that stands for a record of an archive: the same each time it is converted."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive.rsplit("/", 1)[-1]}#{offset}')}"


def _unzipped(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


# --- ARC to WARC ---


def arc_digests(archives: DataFrame) -> DataFrame:
    """path, offset, page_id, digest, bytes of each record's payload, and a second hash of it."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows = []
                for at, _, whole in parse_arc(_unzipped(content)):
                    _, fields, payload = http_parts(whole)
                    rows.append((path, at, _number(fields.get("x-page-id")), sha1(payload), len(payload), hashlib.blake2b(payload, digest_size=8).hexdigest()))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "at", "page_id", "digest", "bytes", "check"])

    return archives.mapInArrow(digests, "path string, at long, page_id long, digest string, bytes long, check string")


def convert(spark: SparkSession, arcs: str, warcs: str, least: int = 0) -> None:
    """Converts the ARC files of a folder into gzipped WARC files of another.

    Of records whose payloads of at least so many bytes are equal (SHA-1, length and a second hash), that with the
    largest page_id, then archive and offset, becomes the response; the others become revisits that refer to it.
    Digests alone are grouped, pre-aggregated; what an archive's records become goes to it as one row. An archive becomes
    one WARC file, or several where it is large.
    """
    small_batches(spark)
    archives = _archives(spark, arcs)
    seen = scratch(arc_digests(archives), "digests")
    same = ["digest", "bytes", "check"]
    best = scratch(seen.filter(F.col("bytes") >= least).groupBy(*same).agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 62))).alias("page"), "path", "at")).alias("best")), "responses")
    known = seen.join(best, same, "left").select("path", "at", F.when((F.col("best.path") != F.col("path")) | (F.col("best.at") != F.col("at")), F.struct("best.path", "best.at")).alias("to"))
    told = known.filter("to is not null").groupBy(F.col("path").alias("of")).agg(F.collect_list(F.struct("at", F.col("to.path").alias("path"), F.col("to.at").alias("to"))).alias("revisits"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, revisits in zip(*(batch[c].to_pylist() for c in ("path", "content", "revisits")), strict=True):
                to = {r["at"]: record_id(r["path"], r["to"]) for r in revisits or ()}
                head = warc_record("warcinfo", record_id(path, 0), "19700101000000", f"Content-Type: application/warc-fields\r\nWARC-Filename: {path.rsplit('/', 1)[-1]}\r\n", b"format: WARC File Format 1.1\r\n")
                out, size = [head], 0
                for at, fields, whole in parse_arc(_unzipped(content)):
                    if size and size + len(whole) > ARCHIVE_BYTES:
                        yield _batch([RECORD_END.join(out)])
                        out, size = [head], 0
                    out.append(from_arc(record_id(path, at), fields, whole, to.get(at)))
                    size += len(out[-1])
                yield _batch([RECORD_END.join(out)])

    joined = archives.join(told, F.col("path") == F.col("of"), "left").select("path", "content", "revisits")
    _written(joined.mapInArrow(turn, "value binary"), warcs, RECORD_END.decode())
    remove(seen)
    remove(best)


def from_arc(own: str, fields: dict[str, str], whole: bytes, refers: str | None) -> bytes:
    """The WARC record of an ARC record: response if it is HTTP, else resource; a revisit keeps HTTP headers alone. Blocks are the bytes that were there."""
    head, _, payload = http_parts(whole)
    kind = "revisit" if refers else "response" if head else "resource"
    more = f"WARC-Target-URI: {fields['URL']}\r\nWARC-IP-Address: {fields['IP-address']}\r\nWARC-Payload-Digest: sha1:{sha1(payload)}\r\nContent-Type: {'application/http; msgtype=response' if head else fields['Content-type']}\r\n"
    if refers:
        more += f"WARC-Refers-To: <{refers}>\r\nWARC-Profile: {PROFILE}\r\nX-Payload-Length: {len(payload)}\r\n"
    return warc_record(kind, own, fields["Archive-date"], more, head if refers else whole)


def warc_record(kind: str, own: str, date: str, more: str, block: bytes) -> bytes:
    d = (date + "00000000000000")[:14]
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{own}>\r\nWARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z\r\nWARC-Block-Digest: sha1:{sha1(block)}\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


# --- WARC read back ---


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-cased name, block) of each record. Raises ValueError where a block is shorter than its Content-Length."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        cut = data.index(b"\r\n\r\n", at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:cut].decode().split("\r\n")[1:])}
        end = cut + 4 + int(fields["content-length"])
        block = data[cut + 4 : end]
        if len(block) < int(fields["content-length"]):
            raise ValueError(f"the WARC record at byte {at} is cut short")
        yield fields, block
        at = end


def read_warcs(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """record_id, record_type, refers_to, page_id, payload_bytes, payload_digest of each record but warcinfo, and its payload if asked.

    The digest of what has a payload is computed anew, and must be the one that the record states.
    """
    small_batches(spark)
    names = ["record_id", "record_type", "refers_to", "page_id", "payload_bytes", "payload_digest", *["payload"] * payloads]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * payloads]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"].to_pylist():
                rows = []
                for fields, block in parse_warc(_unzipped(content)):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    _, http, payload = http_parts(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and digest != sha1(payload):
                        raise ValueError(f"{fields['warc-record-id']}: the payload is not what its digest says")
                    size = int(fields["x-payload-length"]) if kind == "revisit" else len(payload)
                    rows.append((fields["warc-record-id"], kind, fields.get("warc-refers-to"), _number(http.get("x-page-id")), size, digest, payload)[: len(names)])
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return _archives(spark, path).mapInArrow(read, "record_id string, record_type string, refers_to string, page_id long, payload_bytes long, payload_digest string" + ", payload binary" * payloads)


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arcs(load(spark, sf_dir, "pages"), arcs)
    convert(spark, arcs, warcs)
    remove(arcs, spark)
    records = read_warcs(spark, warcs)
    responses = records.filter("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("page_id").alias("to"))
    joined = records.join(responses, F.col("refers_to") == F.col("of"), "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("to").alias("refers_to"))


OP8_SQL = r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
b as (select *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::bigint) as v from p),
d as (select page_id, html, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31)::int + 1, 1)), '')), '') as payload_digest, max(page_id) over (partition by html) as best from b)
select page_id, octet_length(encode(html)) as payload_bytes, payload_digest, case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end as refers_to from d
"""

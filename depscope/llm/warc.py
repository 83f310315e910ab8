"""WARC archives: whole-file gzip streams, rewritten with a gzip member for every record and an offset index beside them.

1. Records are made by native columns. Of equal payloads the one of the largest id is a response, the others revisit
   it: their block ends with the HTTP headers, which hold the payload's length.
2. Spark's text writer compresses them, one gzip stream for each file. Such a file can only be read from its start.
3. The normaliser inflates each stream once. Spark's text reader does it, cut at "WARC/", so that a task holds one
   record and not the file; cuts inside of a record are undone by the record's Content-Length. Every record becomes a
   gzip member whose header names the member's own length. Members fill files of about FILE_BYTES.
4. Spark's text writer also writes these files: one row for each file, without its last byte, which is the writer's
   line end. The last byte of a gzip member is the highest of its length and so zero; a record of 16 MB or more is
   followed by an empty member. So no reader meets a foreign byte, and repeated tasks are harmless in any store.
5. The index, a Parquet table, is made from the files: it goes from member to member by their lengths and inflates the
   record's headers only. read_records() reads by it; read_archives() reads all members, and holds every payload
   against its digest.

Defined cases: a null payload is empty; a null id has an empty record number and comes before all others; rows of equal
id and payload are all responses; a null or empty URL is the record's own number; control characters and blanks in URLs and ids
are percent-encoded; a payload may hold whole records, blank lines or "WARC/"; a payload of any length is one record, which one task
holds; extra columns are not read; no rows give archives without records and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import picked
from .scratch import drop, fresh_path, small_batches, written

#: Payloads from this length on are not stored twice.
LEAST_BYTES = 1000
#: Bytes of a normalised file, about; a file is read as one row.
FILE_BYTES = 8 << 20
#: Heads of equal payloads that are broadcast; beyond that, only those of one in HOT rows are, HOT at most.
BROADCAST_HEADS, HOT = 200_000, 1000
PREFIX = "urn:x-page:"
_END = b"\r\n\r\n"
_HEAD = struct.Struct("<4sIBBHBBHQ")
_MAGIC, _TAIL = b"\x1f\x8b\x08\x04", struct.Struct("<II")
#: Bytes of a member beside its compressed data.
_FRAME = _HEAD.size + _TAIL.size


# records


def _plain(text: Column) -> Column:
    """The text with control characters and blanks percent-encoded."""
    one = lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(text.rlike(r"[\x00-\x20\x7f]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def with_heads(rows: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """rows (id, url, payload) with head: the id that a revisit refers to, null for responses.

    Payloads are equal if their lengths and 256-bit hashes are. Counts and largest ids are summed within each task first.
    """
    keyed = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.sha2(F.col("payload").cast("binary"), 256)))
    groups = keyed.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("largest"))
    heads = written(groups.where("n > 1 AND largest IS NOT NULL"), "payload-heads")
    parts = [F.broadcast(heads)]
    if heads.count() > BROADCAST_HEADS:
        # a key of one in HOT rows or more is one of HOT keys; no other is large enough to crowd a task
        bound = rows.count() // HOT + 1
        parts = [F.broadcast(heads.where(F.col("n") >= bound)), heads.where(F.col("n") < bound)]
    found = keyed.withColumn("head", F.lit(None).cast(rows.schema["id"].dataType))
    for k, part in enumerate(parts):
        own = part.select(F.col("key").alias("of"), "largest")
        if k:  # what needs no head is dealt out by its id
            found = found.withColumn("key", F.coalesce(F.when(F.col("head").isNull(), F.col("key")), F.concat(F.lit("-"), F.xxhash64("id", F.length("payload")))))
        found = found.join(own, F.col("key") == F.col("of"), "left").withColumn("head", F.coalesce("head", "largest")).drop("of", "largest")
    same = F.col("id").eqNullSafe(F.col("head"))
    return found.withColumn("head", F.when(~same, F.col("head"))).drop("key")


def record_texts(rows: DataFrame, date: str) -> DataFrame:
    """(value): each row of with_heads() as a record, without its last newline, which is the writer's line end."""
    number = lambda c: F.concat(F.lit(f"<{PREFIX}"), F.coalesce(_plain(F.col(c).cast("string")), F.lit("")), F.lit(">"))
    size = F.octet_length("payload")
    uri = F.coalesce(F.nullif(_plain(F.col("url").cast("string")), F.lit("")), F.concat(F.lit(PREFIX), F.coalesce(_plain(F.col("id").cast("string")), F.lit(""))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    again = F.col("head").isNotNull()
    made = rows.select("*", http.alias("http"), size.alias("size"), F.sha1(F.col("payload").cast("binary")).alias("digest"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", number("id")), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", number("head")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", (F.octet_length("http") + F.when(again, 0).otherwise(F.col("size"))).cast("string")), F.lit("\r\n"),
    )
    return made.select(F.concat(head, F.col("http"), F.when(again, "").otherwise(F.col("payload")), F.lit("\r\n\r")).alias("value"))


def write_streams(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row: a gzip stream for each task."""
    rows = picked(pages, id_col, url_col, payload_col).toDF("id", "url", "payload").withColumn("payload", F.coalesce(F.col("payload").cast("string"), F.lit("")))
    record_texts(with_heads(rows, least), date).write.option("lineSep", "\n").option("compression", "gzip").text(folder)


# the normaliser


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field LN is its own length. Its last byte is zero."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = _HEAD.pack(_MAGIC, 0, 0, 255, 12, ord("L"), ord("N"), 8, _FRAME + len(body))
    out = head + body + _TAIL.pack(zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return out + member(b"") if out[-1] else out


def member_lengths(content: memoryview) -> Iterator[tuple[int, int]]:
    """(offset, length) of every member that holds a record."""
    at = 0
    while at < len(content):
        magic, _, _, _, _, one, two, _, length = _HEAD.unpack_from(content, at)
        if magic != _MAGIC or (one, two) != (ord("L"), ord("N")) or at + length > len(content):
            raise ValueError(f"no gzip member that names its length at {at}")
        if any(content[at + length - 4 : at + length]):
            yield at, length
        at += length


def parsed_head(head: bytes) -> dict[str, str]:
    """The named fields of a record or an HTTP message, names in lower case; the first line goes."""
    fields, name = {}, ""
    for text in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if text[:1] in (" ", "\t") and name:
            fields[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def records(chunks: Iterator[tuple[str, bytes]]) -> Iterator[bytes]:
    """Whole records from (file, what stands between two "WARC/" of it), which come in order."""
    parts: list[bytes] = []
    held, need, file = 0, None, None

    def cut(last: bool) -> bytes | None:
        nonlocal parts, held, need
        if need is None and parts:
            parts = [b"".join(parts)]
            end = parts[0].find(_END)
            if end >= 0:
                need = end + len(_END) + int(parsed_head(parts[0][:end])["content-length"]) + len(_END)
        if need is not None and held >= need:
            whole, parts = b"".join(parts), []
            if whole[need:].strip():
                raise ValueError(f"{file}: a record is longer than its Content-Length")
            out, held, need = whole[:need], 0, None
            return out
        if last and parts:
            raise ValueError(f"{file}: the last record is cut off")
        return None

    for name, chunk in chunks:
        if name != file:
            cut(True)
            file = name
            if chunk.strip():
                raise ValueError(f"{file}: doesn't begin with a record")
            continue
        parts.append(b"WARC/" + chunk)
        held += 5 + len(chunk)
        out = cut(False)
        if out is not None:
            yield out
    cut(True)


def normalise(spark: SparkSession, source: str, folder: str, glob: str = "*.gz", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rewrite the gzip streams in source: members to folder/data, the index to folder/index; returns the index.

    Files that have members already are read as well. The order of a file's records stays.
    """

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ((f.as_py(), v.as_py()) for b in batches for f, v in zip(b.column(0), b.column(1), strict=True))
        held, size = [], 0
        for data in records(chunks):
            held.append(member(data))
            size += len(held[-1])
            if size >= file_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    cut = spark.read.option("lineSep", "WARC/").option("pathGlobFilter", glob).text(source).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    with small_batches(spark, 256):
        cut.mapInArrow(rewritten, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", 1).text(f"{folder}/data")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _files(batches):
            rows = []
            for at, length in member_lengths(content):
                unpack, head = zlib.decompressobj(31), b""
                rest: bytes | memoryview = content[at : at + length]
                while _END not in head and rest:
                    head += unpack.decompress(rest, 4096)
                    rest = unpack.unconsumed_tail
                about = parsed_head(head[: head.index(_END)])
                rows.append((path.rpartition("/")[2], at, length, *[_bare(about.get(c)) for c in ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest")]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=INDEX)

    index = _contents(spark, folder).mapInArrow(placed, ", ".join(f"{c} {'long' if c in ('offset', 'length') else 'string'}" for c in INDEX))
    with small_batches(spark, 1):
        index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


INDEX = ["file", "offset", "length", "record_id", "record_type", "uri", "digest"]


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


# reading


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data").select("path", "content")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, memoryview]]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield path.as_py(), memoryview(content.as_buffer())


def parsed(data: bytes) -> tuple[str, str, int, str, str | None, bytes]:
    """(record_id, type, length of the payload, its digest, refers_to, payload) of a record; raises where a payload isn't what its digest says."""
    end = data.index(_END)
    about = parsed_head(data[:end])
    block = data[end + len(_END) : end + len(_END) + int(about["content-length"])]
    kind, digest = about["warc-type"], about.get("warc-payload-digest", "")
    if about.get("content-type", "").startswith("application/http"):
        cut = block.index(_END)
        http, payload = parsed_head(block[:cut]), block[cut + len(_END) :]
    else:
        http, payload = {}, block
    size = len(payload)
    if kind == "revisit":
        size = int(http.get("content-length", size))
    else:
        own = hashlib.sha1(payload).hexdigest()
        if digest.startswith("sha1:") and digest[5:] != own:
            raise ValueError(f"{about.get('warc-record-id')}: the payload isn't the one that its digest is of")
        digest = digest or f"sha1:{own}"
    return _bare(about.get("warc-record-id")) or "", kind, size, digest.removeprefix("sha1:"), _bare(about.get("warc-refers-to")), payload


_READ = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def _rows(found: Iterator[bytes], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 5 + payloads]
    names = ["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: 5 + payloads]
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
    for data in found:
        i, kind, n, digest, refers, payload = parsed(data)
        held.append((i, kind, n, digest, refers, payload)[: 5 + payloads])
        size += 200 + payloads * len(payload)
        if size > 1 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _inflated(content: memoryview, at: int, length: int) -> bytes:
    """A record; zlib holds it against the member's checksum and length."""
    unpack = zlib.decompressobj(31)
    data = unpack.decompress(content[at : at + length])
    if not unpack.eof:
        raise ValueError("a gzip member is cut off")
    return data


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of normalised files: (record_id, record_type, payload_bytes, payload_digest, refers_to[, payload]), the length and the digest of the full payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows((_inflated(content, *place) for _, content in _files(batches) for place in member_lengths(content)), payloads)

    return _contents(spark, folder).mapInArrow(run, _READ + ", payload binary" * payloads)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of some rows of the index, with their payloads. Each file that holds one is read once."""
    wanted = index.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places"))
    files = _contents(index.sparkSession, folder).withColumn("file", F.element_at(F.split("path", "/"), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = ((memoryview(c.as_buffer()), p.as_py()) for b in batches for c, p in zip(b.column(0), b.column(1), strict=True))
        yield from _rows((_inflated(content, p["offset"], p["length"]) for content, places in both for p in places), True)

    return files.join(wanted, "file").select("content", "places").mapInArrow(run, _READ + ", payload binary")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    streams, folder = fresh_path(spark, "warc-streams"), fresh_path(spark, "warc")
    write_streams(pages, streams)
    normalise(spark, streams, folder)
    drop(spark, streams)
    number = lambda c: F.substring(c, len(PREFIX) + 1, 20).try_cast("long")
    return read_archives(spark, folder).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), g AS (SELECT payload, count(*) AS n, max(page_id) AS largest FROM p WHERE strlen(payload) >= {LEAST_BYTES} GROUP BY 1),
j AS (SELECT p.*, CASE WHEN n > 1 AND largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM p LEFT JOIN g USING (payload))
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""

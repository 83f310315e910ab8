"""Token ids in length-delimited binary records, with a separate offset index.

A file is a sequence of records. A record is framed as
    length (u64) | masked crc32 of the length (u32) | data | masked crc32 of the data (u32) | newline
all little-endian; a checksum is masked by rotating it right 15 bits and adding a constant, so that files that hold
checksums can be checksummed again. A record is a document: id (i64), flag for a null id (u8), width of a token id
(u8), then its token ids. The index, one row per document, is a Parquet table beside the files: file, offset, length.

1. Texts are encoded where they are read: each distinct part between spaces once for a worker, then gathered.
2. The ids, at two bytes each less than the text, go to ranges of document ids and are sorted there. Bounds are
   percentiles of the document ids, read before; an id that several bounds share is spread over their ranges by hash.
3. Spark's own writer puts one record after the other into a file for each partition. It commits files as any other
   output, so that repeated tasks are harmless, in any store that Spark can write.
4. The index is made from the files themselves, whose checksums are held against what was read.

Defined cases: a null text is empty and has only its end id; a null document id comes first; rows that share an id are
ordered by a hash of their token ids; repeated rows have a record each; a text of any length is one record;
extra columns, of any name, are not read; an empty table writes no record and gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .byte_letters import byte_letters
from .part_table import PartTable
from .rows import picked
from .scratch import fresh_path, small_batches

#: Bytes of ids in a file, about; a file is read as one row.
FILE_BYTES = 32 << 20
_MASK_ADD = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_ADD) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    """A record without its newline, which is the writer's line end."""
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked_crc(head)), data, struct.pack("<I", masked_crc(data))))


#: Bytes of a record beside its data.
FRAME = 17


def record(content: memoryview, at: int) -> memoryview:
    """The data of the record at a place; raises on a checksum that doesn't hold."""
    head = content[at : at + 8]
    if len(head) == 8:
        (n,) = struct.unpack("<Q", head)
        data = content[at + 12 : at + 12 + n]
        if len(content) >= at + n + FRAME and content[at + n + 16] == 10 and masked_crc(head) == struct.unpack_from("<I", content, at + 8)[0] and masked_crc(data) == struct.unpack_from("<I", content, at + 12 + n)[0]:
            return data
    raise ValueError(f"record at {at} is damaged")


def records(content: bytes | memoryview) -> Iterator[memoryview]:
    """The data of each record."""
    at, content = 0, memoryview(content)
    while at < len(content):
        data = record(content, at)
        yield data
        at += len(data) + FRAME


class ByteLevelEncoder:
    """Ids of texts as the tokenizers library gives them under a byte-level BPE file, each distinct part encoded once.

    A pre-token never reaches over a space before a character that is not white, so texts part there. Parts of plain
    Latin characters, whose classes are the same in every Unicode version, are encoded many at a time by tiktoken's merges
    under the file's own vocabulary; other parts, and parts that hold an added token, by the library itself.

    Both merge by rank. They could differ only where two tokens stand side by side that make up a third one without
    being its listed merge; the library would then leave the third one's own string in pieces. So tiktoken is used only
    if merged ids ascend as the merges do and the library encodes the string of every merged token to that token.
    """

    _LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
    _pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"
    _odd = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]").search

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        kinds = json.loads(self.library.to_str())
        pre = kinds["pre_tokenizer"] or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kinds["normalizer"]
        added = "|".join(re.escape(x["content"]) for x in kinds["added_tokens"]) or "x^"
        self.added, self.added_bytes = re.compile(added).search, re.compile(added.encode()).finditer
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.merges = self._merges(kinds["model"]) if self.cuts else None
        self.parts = PartTable(self._make, self.dtype)

    def _merges(self, model: dict):
        """tiktoken's encoding of the same vocabulary, or None if results might differ."""
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"].get(m, -1) for m in merged]
        same = ids == sorted(set(ids)) and all(model["vocab"].get(c, len(byte)) < min(ids, default=0) for c in byte)
        if not same or any([x.id for x in self.library.model.tokenize(m)] != [i] for m, i in zip(merged, ids, strict=True)):
            return None
        import tiktoken

        ranks = {bytes([byte[c] for c in t]): model["vocab"][t] for t in [*byte, *merged]}
        # lengths in bytes give back the parts of a joined text
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.length[i] = len(t)
        return tiktoken.Encoding("own", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens={})

    def _make(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many parts."""
        text = b"".join(parts).decode()
        if self.merges is not None and not self._odd(text) and not self.added(text):
            plain = [p[:1] > b" " or p[:1] == b" " and p[1:2] > b" " for p in parts]
        else:
            plain = [self.merges is not None and (p[:1] > b" " or p[:1] == b" " and p[1:2] > b" ") and not self._odd(x := p.decode()) and not self.added(x) for p in parts]
        # joined, a part that begins with a space is cut off where it begins, and so is another one behind a line break
        at = [i for i, ok in enumerate(plain) if ok]
        found: list = [None] * len(parts)
        if at:
            own = [p if p[:1] == b" " else b"\n" + p for p in (parts[i] for i in at)]
            ids = self.merges.encode_to_numpy(b"".join(own).decode(), disallowed_special=())
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            last = np.searchsorted(np.cumsum(self.length[ids]), ends, side="left") + 1
            first = np.concatenate([[0], last[:-1]]) + np.fromiter((p[0] == 10 for p in own), bool, len(own))
            if len(at) == len(parts):
                return B.ragged_take(ids.astype(self.dtype), np.stack([first, last], axis=1).reshape(-1), 2 * np.arange(len(parts)))[0], last - first
            for i, a, b in zip(at, first.tolist(), last.tolist(), strict=True):
                found[i] = ids[a:b]
        for i, p in enumerate(parts):
            if found[i] is None:
                found[i] = self.library.encode(p.decode(), add_special_tokens=False).ids
        return np.concatenate(found).astype(self.dtype), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text i has ids[first[i] : first[i + 1]]."""
        data, off = B.text_bytes(texts)
        starts = off[:-1][np.diff(off) > 0]
        if self.cuts and len(data):
            kind = _KIND[data]
            begins = np.zeros(len(data), bool)
            begins[1:] = _PARTS[kind[:-1], kind[1:]]
            # of several white characters before a letter, the last is a pre-token of its own
            begins[2:] &= (kind[1:-1] != 2) | (kind[:-2] == 1) | (kind[:-2] == 3)
            begins[1:2] &= kind[:1] != 2
            space = np.flatnonzero(data[:-1] == 0x20)
            begins[space] = _INK[data[space + 1]]
            begins[(off[1:] - 1)[np.diff(off) > 0]] &= data[(off[1:] - 1)[np.diff(off) > 0]] != 0x20
            for m in self.added_bytes(data.tobytes()):
                begins[m.start() + 1 : m.end()] = False
            begins[starts] = True
            starts = np.flatnonzero(begins)
        ids, places = self.parts.lists(data, starts, np.append(starts[1:], len(data))[: len(starts)])
        return ids, places[np.searchsorted(starts, off)]


#: Bytes that begin a character which is surely not white.
_INK = np.ones(256, bool)
_INK[[*range(0x00, 0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: ASCII letters (1), line breaks (2) and ASCII punctuation (3) but "'", which may belong to letters behind it.
_KIND = np.zeros(256, np.int8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[10] = 2
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = 3
#: Neighbours between which a pre-token always ends: letter and punctuation, punctuation and line break, line break and letter.
_PARTS = np.zeros((4, 4), bool)
_PARTS[[1, 3, 2], [3, 2, 1]] = True


_encoders: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


#: From texts to (ids, first), and the type of an id.
Encode = tuple[Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], np.dtype]


def write_token_files(docs: DataFrame, folder: str, make: Callable[[], Encode], end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of docs to folder/data and the index to folder/index; returns the index.

    make: called in each task; gives a function from texts to (ids, first), and the type of an id.
    """
    spark = docs.sparkSession
    source = picked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    # a null id comes before all others
    low = np.iinfo(np.int64).min
    key = F.when(F.col("id").isNotNull(), F.greatest("id", F.lit(low + 1))).otherwise(F.lit(low))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    found = source.agg(F.percentile_approx(key, [k / n for k in range(1, n)] or [1.0], max(10_000, 20 * n))).first()[0]
    bounds = np.array(found or [], np.int64)[: n - 1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, dtype = make()
        for batch in batches:
            for piece in B.bind_columns(batch, 1):
                ids, first = fn(piece.column(1))
                # the end id stands after each document
                out = np.full(len(ids) + piece.num_rows, end_id, dtype)
                out[np.arange(len(ids)) + B.row_of(first)] = ids
                off = (first + np.arange(len(first))) * dtype.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer(off), pa.py_buffer(out)])
                tie = B.span_hash(B.prefix_hash(out.view(np.uint8)), off[:-1], off[1:]) >> np.uint64(1)
                own = piece.column(0).fill_null(low).to_numpy()
                own = np.where(piece.column(0).is_null().to_numpy(zero_copy_only=False), low, np.maximum(own, low + 1))
                left, right = np.searchsorted(bounds, own, "left"), np.searchsorted(bounds, own, "right")
                part = left + ((right - left + 1) * (tie >> np.uint64(32)).astype(np.int64) >> 31)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(tie.astype(np.int64)), data.cast(pa.binary()), pa.array(np.full(piece.num_rows, dtype.itemsize, np.int32)), pa.array(part.astype(np.int32))], names=["id", "tie", "data", "width", "part"])

    encoded = source.mapInArrow(encode, "id long, tie long, data binary, width int, part int")
    ordered = encoded.repartitionById(n, F.col("part")).sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "data")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([frame(struct.pack("<qBB", i or 0, i is None, w) + data) for i, data, w in rows], pa.binary())], names=["record"])

    files = ordered.select("id", "data", "width").mapInArrow(framed, "record binary").select(F.col("record").cast("string").alias("value"))
    with small_batches(spark, 4096):
        files.write.option("lineSep", "\n").option("compression", "none").text(f"{folder}/data")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _files(batches):
            at, rows = 0, []
            for data in records(content):
                i, ids = _document(data)
                rows.append((i, at, len(data) + FRAME, len(ids)))
                at += len(data) + FRAME
            if rows:
                i, at, length, tokens = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array([path.rpartition("/")[2]] * len(rows)), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "file", "offset", "length", "n_tokens"])

    index = _contents(spark, folder).mapInArrow(placed, "id long, file string, offset long, length long, n_tokens long")
    with small_batches(spark, 1):
        index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every file. The writer ends each record with its own newline."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data").select("path", "content")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, memoryview]]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield path.as_py(), memoryview(content.as_buffer())


def _document(data: memoryview) -> tuple[int | None, np.ndarray]:
    i, null, width = struct.unpack_from("<qBB", data)
    return None if null else i, np.frombuffer(data, f"<u{width}", offset=10)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files.

    start counts the ids of all documents before it; ids_crc32 is of the ids as little-endian 32-bit integers. Only one
    total for each file passes through the driver. with_ids: whether the ids themselves are returned.
    """
    index = spark.read.parquet(f"{folder}/index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).toPandas()
    totals = totals.iloc[np.argsort([int(re.match(r"part-(\d+)", f)[1]) for f in totals["file"]], kind="stable")] if len(totals) else totals
    n = totals["n"].to_numpy(np.int64)
    before = spark.sparkContext.broadcast(dict(zip(totals["file"], (np.cumsum(n) - n).tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _files(batches):
            start = before.value.get(path.rpartition("/")[2], 0)
            held: list = []
            size = 0
            for data in records(content):
                i, ids = _document(data)
                held.append((i, start, len(ids), zlib.crc32(ids.astype("<u4")), ids.astype(np.int32) if with_ids else None))
                start += len(ids)
                size += len(ids)
                if size > 1 << 19:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return _contents(spark, folder).mapInArrow(run, schema)


def _batch(rows: list) -> pa.RecordBatch:
    i, start, n, crc, ids = zip(*rows, strict=True)
    columns = {"doc_id": pa.array(i, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
    if ids[0] is not None:
        columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids)))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def shuffled_reads(index: DataFrame, folder: str, seed: int) -> DataFrame:
    """(doc_id, ids) of the documents of index in an order fixed by the seed. Each file that holds one is opened once."""
    place = F.struct(F.xxhash64(F.lit(seed), "file", "offset").alias("rank"), "offset")
    wanted = index.groupBy("file").agg(F.collect_list(place).alias("places"))
    files = _contents(index.sparkSession, folder).withColumn("file", F.element_at(F.split("path", "/"), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1), strict=True):
                content, rows, ranks, size = memoryview(content.as_buffer()), [], [], 0
                for p in places.as_py():
                    i, ids = _document(record(content, p["offset"]))
                    rows.append((i, 0, len(ids), 0, ids.astype(np.int32)))
                    ranks.append(p["rank"])
                    size += len(ids)
                    if size > 1 << 19:
                        yield _ranked(ranks, rows)
                        rows, ranks, size = [], [], 0
                if rows:
                    yield _ranked(ranks, rows)

    found = files.join(wanted, "file").select("content", "places").mapInArrow(run, "rank long, doc_id long, ids array<int>")
    return found.orderBy("rank", "doc_id").select("doc_id", "ids")


def _ranked(ranks: list[int], rows: list) -> pa.RecordBatch:
    made = _batch(rows)
    return pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), made.column("doc_id"), made.column("ids")], names=["rank", "doc_id", "ids"])


END_ID = 2


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = fresh_path(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_token_files(docs, folder, lambda: (encoder(tokenizer).encode, encoder(tokenizer).dtype), END_ID)
    return read_token_files(spark, folder, with_ids=False)

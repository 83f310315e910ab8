"""SentencePiece encoding that keeps offsets, and decoding.

A text is first normalised: at each place the longest key of the model's compiled character map that starts there
is replaced (a character without one stays), and every normalised byte records the span of source bytes that it
came from. The library encodes the normalised text, and each piece projects to the source bytes of its own.

Merges of a model whose pieces hold the space mark only at their front never cross a space, and those without a
newline inside never cross one, so normalised text is cut before runs of spaces and at newlines, and each distinct
part is encoded once, by the library without its own normaliser. Whether this holds is read from the vocabulary; else, and for texts that hold the mark itself,
the library encodes the whole text. The mark that the library puts in front of a text spans no byte, and a byte piece spans its own byte.

Defined cases: a null text is empty and gives no ids; rows are treated one by one, repeated ones too; a text of any length is
one row, its distinct parts are encoded once; an empty table gives an empty result; an input column with the name of a
new one, in any case, is replaced; models that remove spaces, or add no mark in front, raise.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import renewed, with_arrow_columns, with_numbered_columns

MARK = "▁"
CACHE_ENTRIES = 200_000
#: Longer parts are encoded for each few MB of texts anew, so that the memory of what is known is bounded.
LONGEST = 128


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    for number, value, _ in _raw_fields(message):
        yield number, value


def _raw_fields(message: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, the field as it stands in the message)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        begun, tag = at, varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = message[at : at + n]
            at += n
        yield tag >> 3, value, message[begun:at]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def without_map(proto: bytes) -> bytes:
    """A model whose normaliser (field 3) has no compiled map (its field 2, under the name in 1): texts reach the pieces as they are."""
    out = []
    for number, value, raw in _raw_fields(proto):
        if number == 3:
            spec = b"".join(r for n, _, r in _raw_fields(value) if n not in (1, 2))
            raw = _varint(3 << 3 | 2) + _varint(len(spec)) + spec
        out.append(raw)
    return b"".join(out)


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 bytes, and the replacements it points to."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that starts at this byte."""
        units, found = self.units, None
        offset = lambda u: (u >> 10) << ((u & 1 << 9) >> 6)
        node = offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & (1 << 31 | 0xFF) != data[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & (1 << 31) - 1
                found = (k + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return found

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """(normalised bytes, source place of each and of the end)."""
        data = text.encode()
        if not self.units:
            return data, list(range(len(data) + 1))
        out, source, at = bytearray(), [], 0
        while at < len(data):
            found = self.longest(data, at)
            if found is None:
                b = data[at]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                found = (n, data[at : at + n])
            out += found[1]
            source += [at] * len(found[1])
            at += found[0]
        return bytes(out), [*source, at]


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        # field 3 of a model is its normaliser: 2 is the compiled map, 3 to 5 say what becomes of spaces
        normaliser = dict(_fields(dict(_fields(self.library.serialized_model_proto()))[3]))
        self.map = CharacterMap(normaliser.get(2, b""))
        if self.map.units:  # texts come normalised, and must not be so twice
            self.library = SentencePieceProcessor(model_proto=without_map(self.library.serialized_model_proto()))
        if normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("models that remove spaces, or add no mark in front, are not supported")
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        byte = [self.library.is_byte(i) for i in range(n)]
        self.cuts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and MARK in pieces
        self.mark = pieces.index(MARK) if MARK in pieces else -1
        #: Bytes of normalised text that a piece stands for, the mark as a space.
        self.bytes = [b"" if self.library.is_control(i) else bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() for i, (p, b) in enumerate(zip(pieces, byte, strict=True))]
        self.length = [len(b) for b in self.bytes]
        self.unknown = self.library.unk_id()
        self.known: dict[str, tuple[bytes, bytes, int]] = {}

    _cut = re.compile(r" +[^ \n]*|\n[^ \n]*").findall

    def _pack(self, ids: list[int]) -> tuple[bytes, bytes, int]:
        """Ids and the ends of their pieces, as 32-bit numbers, and how many they are."""
        return array("i", ids).tobytes(), array("i", accumulate(map(self.length.__getitem__, ids))).tobytes(), len(ids)

    def _learn(self, parts: list[str]) -> None:
        """A part starts with spaces, the first of which the library puts there itself, or with a newline."""
        spaced = [p[0] == " " for p in parts]
        for p, s, ids in zip(parts, spaced, self.library.encode([p[1:] if s else p for p, s in zip(parts, spaced, strict=True)], num_threads=1), strict=True):
            if not s:
                if ids[0] != self.mark:
                    raise ValueError("a newline merges with the mark before it")
                ids = ids[1:]
            elif not ids:  # the library gives nothing for an empty text
                ids = [self.mark]
            self.known[p] = self._pack(ids)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text; starts and ends are bytes of the source text."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        plain = not self.map.units
        sources = [None] * len(texts)
        if not plain:
            normal = [self.map.normalise(t) for t in texts]
            texts, sources = [x[0].decode() for x in normal], [np.array(x[1]) for x in normal]
        cut = [self._cut(" " + t) if self.cuts and t and MARK not in t else None for t in texts]
        new = list(set().union(*(c for c in cut if c)).difference(self.known))
        self._learn(new)
        out = []
        for text, parts, source in zip(texts, cut, sources, strict=True):
            if parts:
                found = [self.known[p] for p in parts]
                ids = np.frombuffer(b"".join([x[0] for x in found]), np.int32)
                ends = np.frombuffer(b"".join([x[1] for x in found]), np.int32)
                lengths = np.array([len(p.encode()) for p in parts]) if not text.isascii() else np.array([len(p) for p in parts])
                base = np.cumsum(lengths) - lengths - 1
                ends = ends + np.repeat(base, [x[2] for x in found])
            elif text:
                ids, ends = self._whole(text)
            else:
                ids = ends = np.empty(0, np.int32)
            starts = np.zeros(len(ends), np.int64)
            starts[1:] = ends[:-1]
            if source is not None:
                starts, ends = source[starts], source[ends]
            out.append((ids, starts.astype(np.int32), np.asarray(ends, np.int32)))
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        return out

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        proto = self.library.encode(text, return_type="proto")
        return np.array([p.id for p in proto.pieces], np.int32), np.array([p.end for p in proto.pieces], np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode(ids) gives: the bytes of the pieces without the space in front."""
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        if self.unknown in ids:
            return self.library.decode(ids.tolist())
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}

FIELDS = [*(T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("ids", "starts", "ends")), T.StructField("decoded", T.StringType())]


def _coded(model: str):
    def run(texts: pa.Array) -> list[pa.Array]:
        if model not in _codecs:
            _codecs[model] = Codec(model)
        codec = _codecs[model]
        found = codec.encode([x or "" for x in texts.to_pylist()])
        first = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]), pa.int32())
        lists = [pa.ListArray.from_arrays(first, pa.array(np.concatenate([x[k] for x in found]).astype(np.int32))) for k in range(3)]
        return [*lists, pa.array([codec.decode(x[0]) for x in found], pa.string())]

    return run


def encode_and_decode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with ids, the source byte spans starts and ends of their pieces, and the text decoded from the ids.

    An input column with the name of a new one is replaced.
    """

    return with_arrow_columns(docs, text, FIELDS, _coded(model), keep)


def encoded(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with the text decoded from its ids, and n_tokens and ids in place of columns of these names; n_chars follows."""
    places = [i for i, c in enumerate(docs.columns) if c.lower() not in ("n_tokens", "ids")]
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in places]).toDF(*[docs.columns[i] for i in places])
    made, at = with_numbered_columns(own, text, FIELDS, _coded(model))
    columns = renewed(own, at, F.coalesce("v_decoded", F.lit("")))
    return made.select(*columns, F.size("v_ids").cast("long"), "v_ids").toDF(*own.columns, "n_tokens", "ids")


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = encode_and_decode(docs, model, keep=["doc_id"])
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256) if c == "decoded" else F.sha2(F.array_join(c, ",").cast("binary"), 256)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"), F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("covered_bytes"))

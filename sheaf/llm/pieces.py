"""SentencePiece encoding and decoding that keeps byte offsets.

A text is normalised as the model's compiled character map says: at every place the longest prefix that the map's
double-array trie holds is replaced, anything else is copied character by character. The normaliser records for
every normalised byte the span of source bytes that it stands for, so that each piece of the encoding, a span of
normalised bytes, is projected onto original bytes. The ids themselves are the library's.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import map_column

SPACE = "▁".encode()  # stands for a space within pieces
FIELDS = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("starts", T.ArrayType(T.IntegerType(), False)),
        T.StructField("ends", T.ArrayType(T.IntegerType(), False)),
        T.StructField("decoded", T.StringType(), False),
    ]
)


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[i]
            value |= (b & 0x7F) << shift
            i += 1
            if b < 0x80:
                return value, i
            shift += 7

    i = 0
    while i < len(buf):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = buf[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, i = buf[i : i + n], i + n
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over source prefixes and a pool of replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that data has at this place, and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        hop = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = hop(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= hop(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.pool.index(b"\0", found[1])
        return found[0], self.pool[found[1] : end]


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        with open(model_path, "rb") as f:
            proto = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.symbols: list[bytes] = []
        lengths, self.unknown = [], self.sp.unk_id()
        rules: dict[int, int | bytes] = {}
        self.suffix = False
        for number, value in _fields(proto):
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, 1)
                lengths.append(1 if kind == 6 else len(piece[1]))  # a byte piece stands for one byte
                if kind == 4:
                    self.symbols.append(piece[1])
            elif number == 2:
                self.suffix = bool(dict(_fields(value)).get(24, 0))
            elif number == 3:
                rules = dict(_fields(value))
        self.lengths = np.array(lengths, dtype=np.int64)
        self.symbols.sort(key=len, reverse=True)
        self.charmap = CharMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))

    def normalise(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Source start and end of every normalised byte."""
        if not self.charmap.units and not self.squeeze and not self.suffix and not self.symbols and self.escape:
            return self._plain(data)
        return self._general(data)

    def _plain(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Without a map: bytes stay, each space becomes the three bytes of the space mark."""
        raw = np.frombuffer(data, dtype=np.uint8)
        at = np.arange(len(raw), dtype=np.int64)
        source = np.repeat(at, np.where(raw == 0x20, len(SPACE), 1))
        starts, ends = source, source + 1
        if self.prefix and len(raw):
            zero = np.zeros(len(SPACE), dtype=np.int64)
            starts, ends = np.concatenate([zero, starts]), np.concatenate([zero, ends])
        return starts, ends

    def _general(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        mark = SPACE if self.escape else b" "
        parts: list[tuple[bytes, int, int]] = []  # what a source span becomes
        i = 0
        while i < len(data):
            symbol = next((s for s in self.symbols if data.startswith(s, i)), None)
            if symbol is not None:
                n, new = len(symbol), symbol
            elif (hit := self.charmap.longest(data, i)) is not None:
                n, new = hit
            else:
                b = data[i]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                new = data[i : i + n]
            parts.append((new, i, i + n))
            i += n
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
            while parts and parts[-1][0] == b" ":
                parts.pop()
        starts: list[int] = []
        ends: list[int] = []
        out = bytearray()

        def put(piece: bytes, a: int, b: int) -> None:
            out.extend(piece)
            own = piece == data[a:b]  # copied: byte by byte
            starts.extend(range(a, b) if own else [a] * len(piece))
            ends.extend(range(a + 1, b + 1) if own else [b] * len(piece))

        if parts and self.prefix and not self.suffix:
            put(mark, parts[0][1], parts[0][1])
        space = self.squeeze
        for new, a, b in parts:
            if self.squeeze and space:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", mark), a, b)
                space = new.endswith(b" ")
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], starts[-len(mark) :], ends[-len(mark) :]
        if parts and self.prefix and self.suffix:
            put(mark, ends[-1], ends[-1])
        return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, str]:
        """ids, byte offsets of each piece in the source text (end exclusive), and the text decoded from the ids. The offsets
        are None if the pieces don't cover the normalised text."""
        data = text.encode()
        ids = self.sp.encode(text, add_bos=False, add_eos=False, enable_sampling=False)
        starts, ends = self.normalise(data)
        tokens = np.array(ids, dtype=np.int64)
        lengths = self.lengths[tokens]
        if self.unknown in ids:
            shown = self.sp.encode(text, out_type=str, add_bos=False, add_eos=False, enable_sampling=False)
            lengths = np.array([len(s.encode()) if i == self.unknown else n for i, n, s in zip(ids, lengths, shown, strict=True)], dtype=np.int64)
        last = np.cumsum(lengths)
        if (int(last[-1]) if len(last) else 0) != len(starts):
            return tokens, None, None, self.sp.decode(ids)
        if not len(last):
            none = np.zeros(0, dtype=np.int64)
            return tokens, none, none, self.sp.decode(ids)
        return tokens, starts[last - lengths], ends[last - 1], self.sp.decode(ids)


@functools.lru_cache(maxsize=4)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    none = np.array([a is None for a in arrays], dtype=bool)
    held = [np.zeros(0, np.int64) if a is None else a for a in arrays]
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in held])]).astype(np.int32)
    values = np.concatenate(held).astype(np.int32) if held else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(none) if none.any() else None)


def encode_offsets(df: DataFrame, model_path: str, col: str = "text") -> DataFrame:
    """df with ids, starts, ends (array<int>; byte offsets in the UTF-8 source) and decoded (string).

    Null and empty texts give empty arrays and an empty decoded text. A text of any length is encoded whole; rows
    are independent, so repeated rows give equal results and an empty table an empty one. starts and ends are null where a
    model's pieces don't cover the normalised text. Columns of df with one of the new names, in any case, are replaced.
    """

    def make():
        one = codec(model_path)

        def run(texts: list[str | None]):
            rows = [one.encode(t or "") for t in texts]
            return (*(_lists([r[k] for r in rows]) for k in range(3)), [r[3] for r in rows])

        return run

    return map_column(df, col, FIELDS, make)


def decode_ids(df: DataFrame, model_path: str, col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that the ids in col decode to; null and empty arrays give an empty text."""
    fields = T.StructType([T.StructField(out, T.StringType(), False)])

    def make():
        one = codec(model_path)
        return lambda rows: ([one.sp.decode(list(map(int, r.split(",")))) if r else "" for r in rows],)

    listed = df.withColumn("__ids", F.concat_ws(",", F.col(col).cast("array<string>")))
    return map_column(listed, "__ids", fields, make).drop("__ids")

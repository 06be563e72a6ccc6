"""Media columns: storing text losslessly as 8-bit samples, and finding out what bytes really are.

An Aho-Corasick automaton finds every magic number in one pass over the bytes. A hit counts only if the format's
validator finds a sound structure there and can tell its length; so declared types are corrected and embedded media
are carved out at exact bounds.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import map_column, q

BLOCK = 64  # payloads are padded to a positive multiple of this
RATE = 8000  # sample rate that stored payloads state


# Validators: (bytes, offset of the file's start) -> length of the file, or 0 if there is none.
def _wav(b: bytes, i: int) -> int:
    if b[i + 8 : i + 12] != b"WAVE" or len(b) < i + 12:
        return 0
    end = i + 8 + int.from_bytes(b[i + 4 : i + 8], "little")
    at, form, data = i + 12, False, False
    while at + 8 <= min(end, len(b)):
        name, n = b[at : at + 4], int.from_bytes(b[at + 4 : at + 8], "little")
        form |= name == b"fmt " and n >= 16
        data |= name == b"data"
        at += 8 + n + (n & 1)
    return end - i if form and data and end <= len(b) and at in (end, end + 1) else 0


def _webp(b: bytes, i: int) -> int:
    n = 8 + int.from_bytes(b[i + 4 : i + 8], "little")
    return n if b[i + 8 : i + 12] == b"WEBP" and b[i + 12 : i + 16] in (b"VP8 ", b"VP8L", b"VP8X") and i + n <= len(b) else 0


def _png(b: bytes, i: int) -> int:
    at, seen = i + 8, 0
    while at + 12 <= len(b):
        n, name = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
        if (name == b"IHDR") != (seen == 0) or at + 12 + n > len(b) or zlib.crc32(b[at + 4 : at + 8 + n]) != int.from_bytes(b[at + 8 + n : at + 12 + n], "big"):
            return 0
        seen, at = seen + 1, at + 12 + n
        if name == b"IEND":
            return at - i
    return 0


def _gif(b: bytes, i: int) -> int:
    if len(b) < i + 13 or 0 in struct.unpack_from("<HH", b, i + 6):
        return 0
    skip = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0  # noqa: E731  a colour table's size
    at, frames = i + 13 + skip(b[i + 10]), 0
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1 - i if frames else 0
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and at + 10 <= len(b):
            at, frames = at + 11 + skip(b[at + 9]), frames + 1
        else:
            return 0
        while at < len(b) and b[at]:  # data blocks
            at += 1 + b[at]
        at += 1
    return 0


def _jpeg(b: bytes, i: int) -> int:
    at, frame = i + 2, False
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        n = int.from_bytes(b[at + 2 : at + 4], "big")
        if kind in (0x00, 0xFF) or n < 2:
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if kind == 0xDA:
            while (at := b.find(b"\xff", at)) >= 0 and at + 1 < len(b):
                if b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7:
                    at += 2
                elif b[at + 1] == 0xD9:
                    return at + 2 - i if frame else 0
                else:
                    break
            if at < 0:
                return 0
    return 0


def _bmp(b: bytes, i: int) -> int:
    if len(b) < i + 30:
        return 0
    size, reserved, start, head = struct.unpack_from("<IIII", b, i + 2)
    ok = reserved == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start < size
    return size if ok and i + size <= len(b) else 0


def _flac(b: bytes, i: int) -> int:
    at, first = i + 4, True
    while at + 4 <= len(b):
        kind, n = b[at], int.from_bytes(b[at + 1 : at + 4], "big")
        if first and (kind & 0x7F or n != 34):
            return 0
        first, at = False, at + 4 + n
        if kind & 0x80:  # frames follow, without a stated length
            return len(b) - i if at + 2 <= len(b) and b[at] == 0xFF and b[at + 1] & 0xFC == 0xF8 else 0
    return 0


def _ogg(b: bytes, i: int) -> int:
    at = i
    while b[at : at + 4] == b"OggS" and at + 27 <= len(b) and b[at + 4] == 0:
        n = b[at + 26]
        if at + 27 + n > len(b):
            return 0
        last, at = b[at + 5] & 4, at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if at > len(b):
            return 0
        if last:
            return at - i
    return 0


def _mp4(b: bytes, i: int) -> int:
    at, boxes = i, set()
    while at + 8 <= len(b):
        n, name = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
        if n < 8 or at + n > len(b) or not name.isalnum():
            break
        boxes.add(name)
        at += n
    return at - i if b"ftyp" in boxes and boxes & {b"moov", b"moof", b"mdat"} else 0


#: Type, magic bytes, their offset within the file, validator.
FORMATS: list[tuple[str, bytes, int, Callable[[bytes, int], int]]] = [
    ("audio/wav", b"RIFF", 0, _wav),
    ("image/webp", b"RIFF", 0, _webp),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/bmp", b"BM", 0, _bmp),
    ("audio/flac", b"fLaC", 0, _flac),
    ("audio/ogg", b"OggS", 0, _ogg),
    ("video/mp4", b"ftyp", 4, _mp4),
]


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in {m for _, m, _, _ in FORMATS}:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def find_media(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of every sound medium that isn't within an earlier one, by start."""
    hits: list[tuple[int, str, Callable[[bytes, int], int]]] = []
    for end, magic in _automaton().iter(data.decode("latin-1")):
        for kind, m, shift, length in FORMATS:
            if m == magic and (start := end + 1 - len(magic) - shift) >= 0:
                hits.append((start, kind, length))
    hits.sort(key=lambda h: h[:2])
    out: list[tuple[str, int, int]] = []
    free = 0
    for start, kind, length in hits:
        if start >= free and (n := length(data, start)):
            out.append((kind, start, n))
            free = start + n
    return out


def to_wav(payload: bytes) -> bytes:
    """payload as a mono 8-bit PCM file: one byte is one sample."""
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(payload)) + b"WAVE" + head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of the first data chunk."""
    at = 12
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def pad(data: bytes) -> bytes:
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def store_text(df: DataFrame, col: str = "text") -> DataFrame:
    """df with media (binary): the text's UTF-8 bytes, padded with zeros, as 8-bit samples. Null counts as empty."""
    fields = T.StructType([T.StructField("media", T.BinaryType(), False)])
    return map_column(df, col, fields, lambda: lambda texts: ([to_wav(pad((t or "").encode())) for t in texts],))


PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
SNIFFED = T.StructType(
    [
        T.StructField("media_type", T.StringType()),
        T.StructField("corrected", T.BooleanType(), False),
        T.StructField("embedded", T.ArrayType(PART, False), False),
    ]
)


def sniff(df: DataFrame, col: str = "media", declared: str | None = None) -> DataFrame:
    """df with media_type (of the medium at offset 0, else null), corrected (it differs from the declared column; a
    null declaration counts as different) and embedded (media that start later, or after the first one's end).

    Null and empty bytes: media_type null, corrected false, nothing embedded. Rows are independent. Columns of df with
    one of the new names are replaced.
    """

    def make():
        def run(values):
            found = [find_media(v) if v else [] for v in values]
            head = [f[0][0] if f and f[0][1] == 0 else None for f in found]
            rest = [[{"type": k, "start": s, "length": n} for k, s, n in f if s] for f in found]
            return head, [False] * len(head), rest

        return run

    said = F.col(q(declared)) if declared else F.lit(None).cast("string")
    out = map_column(df.withColumn("__declared", said), col, SNIFFED, make)
    fixed = F.col("media_type").isNotNull() & ~F.col("__declared").eqNullSafe(F.col("media_type"))
    return out.withColumn("corrected", fixed).drop("__declared")


def carve(df: DataFrame, col: str = "media") -> DataFrame:
    """One row for each medium found in col, embedded ones included: df's columns with part_type, part_start and
    part (its bytes). Rows without any medium give none."""
    inner = T.ArrayType(T.StructType([*PART.fields[:2], T.StructField("bytes", T.BinaryType())]), False)
    fields = T.StructType([T.StructField("__parts", inner, False)])
    make = lambda: lambda values: ([[{"type": k, "start": s, "bytes": v[s : s + n]} for k, s, n in find_media(v)] if v else [] for v in values],)
    parts = map_column(df, col, fields, make).withColumn("__part", F.explode("__parts"))
    return parts.withColumns({"part_type": F.col("__part.type"), "part_start": F.col("__part.start"), "part": F.col("__part.bytes")}).drop("__part", "__parts")


READ = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())])


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits and zero crossings of 8-bit samples, as text."""
    if not len(samples):
        return "n=0"
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float((counts * np.arange(256)).sum() / len(samples))
    var = float((counts * (np.arange(256) - mean) ** 2).sum() / len(samples))
    crossings = int(np.count_nonzero(np.diff((samples >= 128).view(np.int8))))
    return f"n={len(samples)};mean={mean:.6f};dev={var**0.5:.6f};entropy={-(share * np.log2(share)).sum():.6f};cross={crossings}"


def read_samples(df: DataFrame, col: str = "media", kind: str = "media_type") -> DataFrame:
    """df with payload (the samples of the 8-bit PCM medium in col) and feature (statistics of the samples); both null where
    kind isn't audio/wav or col is null."""

    def make():
        def run(values):
            got = [from_wav(v) if v is not None else None for v in values]
            return got, [features(np.frombuffer(g, dtype=np.uint8)) if g is not None else None for g in got]

        return run

    wav = F.when(F.col(q(kind)) == "audio/wav", F.col(q(col)))
    return map_column(df.withColumn("__wav", wav), "__wav", READ, make).drop("__wav")

"""Media columns: MPEG audio.

encode() wraps bytes losslessly in an MPEG-1 Layer III file: an ID3v2 tag that records the payload's length, a first
frame with a variable-bitrate (Xing) table, then frames of silence whose ancillary bytes are the payload, each with its
CRC-16. parse() reads any MPEG audio but free format: it reads ID3 tags, resynchronises on frame headers after damage,
reads Xing and VBRI tables with their seek points and the encoder's delay and padding, verifies the checksums of all three
layers, and gives exact durations (samples, less delay and padding, over sample rate) and frame seek offsets.

Null payloads count as empty. Equal bytes give equal files. Bytes without any frame give an index with 0 frames.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessella.llm.common import others, table, tuned

#: Fixed values of the format: kbit/s by (MPEG 1, layer) and by (MPEG 2 and 2.5, layer), indices 1 to 14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Fixed values of the format: Hz of MPEG 1; MPEG 2 has half, MPEG 2.5 a quarter.
SAMPLE_RATES = (44100, 48000, 32000)
PAD_TO = 64
OWNER = b"tessella/payload"


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 3 for 2.5
    layer: int
    crc: bool
    kbps: int
    rate: int
    padding: int
    mode: int  # 0 stereo, 1 joint, 2 two channels, 3 mono
    extension: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version > 1 else 1152

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.kbps * 1000 // self.rate + self.padding) * 4
        return self.samples // 8 * self.kbps * 1000 // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@functools.lru_cache(4096)
def read_header(raw: bytes) -> Header | None:
    """The frame header in 4 bytes, or None. Free-format frames have no length of their own and don't count."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2, 0: 3}.get(raw[1] >> 3 & 3)
    layer, rate, kbps = 4 - (raw[1] >> 1 & 3), raw[2] >> 2 & 3, raw[2] >> 4
    if version is None or layer == 4 or rate == 3 or kbps in (0, 15):
        return None
    return Header(version, layer, not raw[1] & 1, BITRATES[min(version, 2), layer][kbps - 1], SAMPLE_RATES[rate] // (1, 2, 4)[version - 1], raw[2] >> 1 & 1, raw[3] >> 6, raw[3] >> 4 & 3)


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_TABLE = _crc_table()


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 ^ _TABLE[c >> 8 ^ b]) & 0xFFFF
    return c


def _crc_of_bits(data: bytes, start: int, bits: int, c: int) -> int:
    """The checksum continued over so many bits from a byte on."""
    for b in data[start : start + bits // 8]:
        c = (c << 8 ^ _TABLE[c >> 8 ^ b]) & 0xFFFF
    for k in range(bits % 8):
        bit = data[start + bits // 8] >> 7 - k & 1
        c = (c << 1 ^ (0x8005 if c >> 15 ^ bit else 0)) & 0xFFFF
    return c


#: Fixed values of the format: bits of a Layer II allocation by subband, as runs of (subbands, bits), for MPEG 1 at medium
#: and at high bitrates, at low ones, at low ones and 32 kHz, and for MPEG 2.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}


def _allocation(h: Header) -> list[int]:
    each = h.kbps // (1 if h.mono else 2)
    if h.version > 1:
        kind = "lsf"
    elif each < 56:
        kind = "d" if h.rate == 32000 else "c"
    else:
        kind = "b" if each > 80 and h.rate < 48000 else "a"
    return [bits for n, bits in ALLOCATIONS[kind] for _ in range(n)]


def _protected(data: bytes, at: int, h: Header) -> int:
    """Bits behind the checksum of the frame at `at` that it covers: side information, or allocations and scale factor selections."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    sizes = [4] * 32 if h.layer == 1 else _allocation(h)
    bound = min(4 * (h.extension + 1), len(sizes)) if h.mode == 1 else len(sizes)  # from here on both channels share theirs
    fields = [(bits, 1 if k < bound else channels) for k, bits in enumerate(sizes) for _ in range(channels if k < bound else 1)]
    total = sum(bits for bits, _ in fields)
    if h.layer == 2:
        word = int.from_bytes(data[at + 6 : at + 6 + (total + 7) // 8].ljust((total + 7) // 8, b"\0"), "big") >> -total % 8
        left = total
        for bits, n in fields:
            left -= bits
            total += 2 * n * bool(word >> left & (1 << bits) - 1)
    return total


def checksum_holds(data: bytes, at: int, h: Header) -> bool:
    """Whether the checksum of the frame at `at` holds; frames without one pass."""
    if not h.crc:
        return True
    want = int.from_bytes(data[at + 4 : at + 6], "big")
    if h.layer == 3:
        return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == want
    bits = _protected(data, at, h)
    return at + 6 + (bits + 7) // 8 <= len(data) and _crc_of_bits(data, at + 6, bits, crc16(data[at + 2 : at + 4])) == want


@dataclass
class Index:
    """What parse() finds. offsets: byte positions of the audio frames; bodies: (start, end) of their ancillary bytes.

    seek holds the byte positions that a table gives: for each of 100 equal parts of the duration (Xing), or for every so many
    frames (VBRI). delay and padding are the encoder's samples before and after the sound.
    """

    frames: int = 0
    samples: int = 0
    rate: int = 0
    vbr: str = ""
    table_frames: int = -1
    table_bytes: int = -1
    checked: int = 0
    bad_crc: int = 0
    skipped: int = 0
    delay: int = 0
    padding: int = 0
    seek: list[int] = field(default_factory=list)
    tags: dict[str, bytes] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    kbps: list[int] = field(default_factory=list)
    bodies: list[tuple[int, int]] = field(default_factory=list)

    @property
    def duration(self) -> Fraction:
        return Fraction(max(0, self.samples - self.delay - self.padding), self.rate) if self.rate else Fraction(0)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsyncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, at: int) -> tuple[int, dict[str, bytes]]:
    """End of the tag at `at`, and its frames, with unsynchronisation undone.

    Version 2.2 has names and sizes of 3 bytes, 2.3 sizes of 4, 2.4 sizes of 4 times 7 bits and flags by frame.
    """
    major, flags, out = data[at + 3], data[at + 5], {}
    stop = at + 10 + _unsyncsafe(data[at + 6 : at + 10])
    end = min(stop + (10 if major == 4 and flags & 0x10 else 0), len(data))
    body = data[at + 10 : min(stop, len(data))]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    wide, k = 3 if major == 2 else 4, 0
    if flags & 0x40 and major > 2 and len(body) >= 4:
        k = _unsyncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    head = 6 if major == 2 else 10
    while major in (2, 3, 4) and k + head <= len(body) and body[k] and body[k : k + wide].isalnum():
        raw, marks = body[k + wide : k + 2 * wide], body[k + 9] if major == 4 else 0
        n = _unsyncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        value = body[k + head : k + head + n]
        if marks & 1:  # a length stands before the data
            value = value[4:]
        out[body[k : k + wide].decode("ascii")] = value.replace(b"\xff\0", b"\xff") if marks & 2 else value
        k += head + n
    return end, out


@dataclass
class Table:
    """A variable-bitrate table; frames and bytes are -1 if not given."""

    kind: str
    frames: int = -1
    bytes: int = -1
    seek: list[int] = field(default_factory=list)
    delay: int = 0
    padding: int = 0


#: How encoders sign the field behind a Xing table that holds delay and padding.
ENCODERS = (b"LAME", b"Lavf", b"Lavc", b"GOGO")


def _table(data: bytes, at: int, h: Header) -> Table | None:
    """The table in the frame at `at`; its seek points count from that frame."""
    number = lambda k, n: int.from_bytes(data[k : k + n], "big")
    k = at + 4 + 2 * h.crc + h.side
    if data[k : k + 4] in (b"Xing", b"Info"):
        out, flags, k = Table(data[k : k + 4].decode()), number(k + 4, 4), k + 8
        if flags & 1:
            out.frames, k = number(k, 4), k + 4
        if flags & 2:
            out.bytes, k = number(k, 4), k + 4
        if flags & 4:
            points, k = data[k : k + 100], k + 100
            size = out.bytes if out.bytes >= 0 else len(data) - at
            out.seek = [at + p * size // 256 for p in points]
        k += 4 if flags & 8 else 0
        if data[k : k + 4] in ENCODERS and k + 24 <= at + h.size:
            out.delay, out.padding = divmod(number(k + 21, 3), 1 << 12)
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        out = Table("VBRI", number(at + 50, 4), number(at + 46, 4), delay=number(at + 42, 2))
        entries, scale, size = (number(at + j, 2) for j in (54, 56, 58))
        place, k = at, at + 62
        for _ in range(entries if size and k + entries * size <= len(data) else 0):
            place, k = place + number(k, size) * scale, k + size
            out.seek.append(place)
        return out
    return None


def parse(data: bytes) -> Index:
    """Walks the frames; where none begins, looks for the next header that another one, a tag or the end follows.

    A frame right after another one may also stand before damage, if it is of the same kind and its checksum holds.
    """
    out, at, end, before = Index(), 0, len(data), None
    while at < end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at, tags = _id3v2(data, at)
            out.tags |= tags
            continue
        if data[at : at + 3] == b"TAG" and at + 128 == end:
            out.tags["ID3v1"] = data[at + 3 :]
            break
        h = read_header(data[at : at + 4])
        stop = at + h.size if h else 0
        head = at + 4 + 2 * h.crc if h else at
        sound = bool(h) and checksum_holds(data, at, h)
        kind = h and (h.version, h.layer, h.crc, h.rate)
        if h and stop <= end and (stop == end or data[stop : stop + 3] in (b"ID3", b"TAG") or read_header(data[stop : stop + 4]) or sound and kind == before):
            before = kind
            if not out.frames and not out.vbr and h.layer == 3 and (got := _table(data, at, h)):
                out.vbr, out.table_frames, out.table_bytes = got.kind, got.frames, got.bytes
                out.seek, out.delay, out.padding = got.seek, got.delay, got.padding
            else:
                if h.crc:
                    out.checked += 1
                    out.bad_crc += not sound
                out.frames += 1
                out.samples += h.samples
                out.rate = out.rate or h.rate
                out.offsets.append(at)
                out.kbps.append(h.kbps)
                out.bodies.append((head + h.side * (h.layer == 3), stop))
            at = stop
        else:
            before = None
            k = data.find(b"\xff", at + 1)
            tag = data.find(b"TAG", max(at + 1, end - 128))
            k = min((x for x in (k, tag) if x > 0), default=end)
            out.skipped += k - at
            at = k
    return out


def _frame(kbps_index: int) -> tuple[bytes, Header]:
    """Header of a mono MPEG-1 Layer III frame with a checksum at 32 kHz."""
    raw = bytes([0xFF, 0xFA, kbps_index << 4 | 2 << 2, 0xC0])
    return raw, read_header(raw)


def encode(payload: bytes) -> bytes:
    """An MPEG file that holds payload: whole frames of the highest bitrate, then one of the least bitrate that holds the rest."""
    frames, kinds = [], []
    for k in range(1, 15):
        raw, h = _frame(k)
        side = bytes(h.side)
        kinds.append((h.size - 6 - h.side, raw + crc16(raw[2:] + side).to_bytes(2, "big") + side))
    most, head = kinds[-1]
    whole = len(payload) - len(payload) % most
    for k in range(0, whole, most):
        frames += [head, payload[k : k + most]]
    if rest := payload[whole:]:
        room, head = next(x for x in kinds if x[0] >= len(rest))
        frames += [head, rest, bytes(room - len(rest))]
    audio = b"".join(frames)
    raw, h = _frame(2)
    ends = np.cumsum([len(a) for a in frames]) if frames else np.zeros(1)
    toc = bytes(min(255, int(256 * ends[int(p * len(ends) / 100)] / max(1, len(audio)))) for p in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames) // 2, h.size + len(audio)) + toc
    first = raw + crc16(raw[2:] + bytes(h.side)).to_bytes(2, "big") + bytes(h.side) + xing
    note = OWNER + b"\0" + struct.pack(">Q", len(payload))
    tag = b"PRIV" + _syncsafe(len(note)) + b"\0\0" + note
    return b"ID3\4\0\0" + _syncsafe(len(tag)) + tag + first + bytes(h.size - len(first)) + audio


def payload_of(data: bytes, index: Index) -> bytes | None:
    """The payload of a file that encode() made; None for other files."""
    note = index.tags.get("PRIV", b"")
    if not note.startswith(OWNER + b"\0"):
        return None
    return b"".join([data[a:b] for a, b in index.bodies])[: struct.unpack(">Q", note[len(OWNER) + 1 :][:8])[0]]


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % PAD_TO or (0 if data else PAD_TO))


MEDIA = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
INDEX = [T.StructField(n, k) for n, k in (("frames", T.LongType()), ("samples", T.LongType()), ("sample_rate", T.IntegerType()), ("vbr", T.StringType()), ("table_frames", T.LongType()), ("checked", T.LongType()), ("bad_crc", T.LongType()), ("skipped", T.LongType()), ("delay", T.LongType()), ("padding", T.LongType()), ("seek", T.ArrayType(T.LongType())), ("offsets", T.ArrayType(T.LongType())), ("payload", T.BinaryType()))]


def _swap(b: pa.RecordBatch, schema: T.StructType, new: dict[str, list]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    arrays = [b.column(f.name) if f.name not in new else pa.array(new[f.name], kinds.field(f.name).type) for f in schema.fields]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


Step = tuple[T.StructType, Callable[[pa.RecordBatch], pa.RecordBatch]]
#: Rows that pass through all steps at once.
ROWS = 256


def _chained(df: DataFrame, *steps: Callable[[T.StructType], Step]) -> DataFrame:
    """df through all steps in one pass: what one makes goes to the next within the worker, some rows at a time."""
    schema, runs = df.schema, []
    for step in steps:
        schema, run = step(schema)
        runs.append(run)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), ROWS):
                part = b.slice(k, ROWS)
                for run in runs:
                    part = run(part)
                yield part

    return df.mapInArrow(every, schema)


def _encoding(text: str) -> Callable[[T.StructType], Step]:
    def step(before: T.StructType) -> Step:
        schema = T.StructType(others(before.fields, text, *(f.name for f in MEDIA)) + MEDIA)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            raw = [(x.as_py() or "").encode() for x in b.column(text)]
            return _swap(b, schema, {"n_bytes": [len(x) for x in raw], "media": [encode(padded(x)) for x in raw]})

        return schema, run

    return step


def _indexing(column: str) -> Callable[[T.StructType], Step]:
    def step(before: T.StructType) -> Step:
        schema = T.StructType(others(before.fields, *(x.name for x in INDEX)) + INDEX)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            new: dict[str, list] = {f.name: [] for f in INDEX}
            for x in b.column(column):
                data = x.as_py() or b""
                i = parse(data)
                found = {"sample_rate": i.rate, "payload": payload_of(data, i)}
                for n in new:
                    new[n].append(found[n] if n in found else getattr(i, n))
            return _swap(b, schema, new)

        return schema, run

    return step


def _features(r: dict) -> tuple:
    p, m = r["payload"], r["media"]
    samples, d = np.frombuffer(p, np.uint8), Fraction(max(0, r["samples"] - r["delay"] - r["padding"]), r["sample_rate"] or 1)
    seek = hashlib.sha256(",".join(map(str, r["offsets"])).encode()).hexdigest()[:16]
    feature = f"frames={r['frames']};seconds={d.numerator}/{d.denominator};vbr={r['vbr']}:{r['table_frames']};crc={r['checked'] - r['bad_crc']}/{r['checked']};seek={seek};mean={samples.mean():.6f};std={samples.std():.6f}"
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD_TO:]), len(m), hashlib.sha256(m).hexdigest(), feature


def _digesting(before: T.StructType) -> Step:
    new = [T.StructField(n, k) for n, k in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
    schema = T.StructType([f for f in before.fields if f.name in ("doc_id", "n_bytes")] + new)
    used = ("payload", "media", "offsets", "frames", "samples", "sample_rate", "vbr", "table_frames", "checked", "bad_crc", "delay", "padding")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_features(dict(zip(used, r, strict=True))) for r in zip(*(b.column(n).to_pylist() for n in used), strict=True)]
        return _swap(b, schema, {f.name: [r[k] for r in rows] for k, f in enumerate(new)})

    return schema, run


def encode_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes and media (the MPEG file of the padded UTF-8 bytes) in place of the text; columns of these names are replaced."""
    return _chained(docs, _encoding(text))


def index_column(media: DataFrame, column: str = "media") -> DataFrame:
    """media with what parse() finds, and the payload where encode() made the file; columns of these names are replaced.

    A null file gives 0 frames. Repeated rows give repeated rows, an empty table an empty one.
    """
    return _chained(media, _indexing(column))


def digest(indexed: DataFrame) -> DataFrame:
    """The digest columns of op6. feature: frames, exact duration, table, checksums, seek offsets (hashed), mean and spread of the samples."""
    return _chained(indexed, _digesting)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    return _chained(docs, _encoding("text"), _indexing("media"), _digesting)

"""MPEG audio columns: write payloads as frames, and read any such stream back.

A payload of whole 576-byte units becomes a Layer III stream (MPEG-2, 16 kHz, mono): one
frame a unit, which plays 576 samples of silence. A frame is a 4-byte header, its CRC, the
side information (no main data), and the unit as ancillary data. An Info frame with frame
count, byte count and seek table stands before them, tags around them.

Reading takes nothing for granted: it skips tags, looks for a frame sync whose header is
possible and followed by another frame of the same kind (or the end), and after a broken
frame looks for the next one. Durations come from the frames found, not from the tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
FILL = 255

# Fixed values of the format: header fields by their codes; None is not allowed.
VERSIONS = {0: "2.5", 2: "2", 3: "1"}
LAYERS = {1: 3, 2: 2, 3: 1}
BITRATES = {
    ("1", 1): [None, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448, None],
    ("1", 2): [None, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, None],
    ("1", 3): [None, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, None],
    ("2", 1): [None, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256, None],
    ("2", 2): [None, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, None],
    ("2", 3): [None, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, None],
}
RATES = {"1": [44100, 48000, 32000, None], "2": [22050, 24000, 16000, None], "2.5": [11025, 12000, 8000, None]}
CHANNELS = ["stereo", "joint", "dual", "mono"]
CRC_POLYNOMIAL = 0x8005
CRC_START = 0xFFFF


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    checked: bool
    kbps: int
    rate: int
    channels: str
    size: int
    samples: int
    side: int


def _header(raw: bytes) -> Header | None:
    """The header that 4 bytes hold, if they can be one."""
    word = int.from_bytes(raw, "big")
    version, layer = VERSIONS.get(word >> 19 & 3), LAYERS.get(word >> 17 & 3)
    if word >> 21 != 0x7FF or version is None or layer is None:
        return None
    kbps = BITRATES["1" if version == "1" else "2", layer][word >> 12 & 15]
    rate = RATES[version][word >> 10 & 3]
    if kbps is None or rate is None or word & 3 == 2:
        return None
    mono, padding, full = word >> 6 & 3 == 3, word >> 9 & 1, version == "1"
    if layer == 1:
        samples, size = 384, (12_000 * kbps // rate + padding) * 4
    else:
        samples = 1152 if layer == 2 or full else 576
        size = samples // 8 * 1000 * kbps // rate + padding
    side = (17 if mono else 32) if full else (9 if mono else 17)
    return Header(version, layer, not word >> 16 & 1, kbps, rate, CHANNELS[word >> 6 & 3], size, samples, side)


_HEADERS: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    if len(raw) < 4 or raw[0] != 0xFF:
        return None
    if raw not in _HEADERS:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        _HEADERS[raw] = _header(raw)
    return _HEADERS[raw]


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL) & 0xFFFF if crc & 0x8000 else crc << 1
        out.append(crc)
    return out


CRC_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    crc = CRC_START
    for byte in data:
        crc = crc << 8 & 0xFFFF ^ CRC_TABLE[crc >> 8 ^ byte]
    return crc


# What the writer makes: MPEG-2 Layer III, CRC on, 144 kbit/s, 16 kHz, mono.
FRAME_HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC0])
FRAME = header(FRAME_HEADER)
SIDE = bytes(FRAME.side)
PREFIX = FRAME_HEADER + struct.pack(">H", crc16(FRAME_HEADER[2:] + SIDE)) + SIDE


def _text_frame(name: str, text: str) -> bytes:
    body = b"\x03" + text.encode()
    return name.encode() + struct.pack(">I", len(body)) + b"\0\0" + body


def _syncsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def write_stream(data: bytes) -> bytes:
    """The payload of ``data`` (bytes 255 added up to a positive multiple of 576) as a stream."""
    payload = data + bytes([FILL]) * (-len(data) % UNIT or (0 if data else UNIT))
    n = len(payload) // UNIT
    frames = np.zeros((n, FRAME.size), dtype=np.uint8)
    frames[:, : len(PREFIX)] = np.frombuffer(PREFIX, dtype=np.uint8)
    frames[:, len(PREFIX) : len(PREFIX) + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    audio = (n + 1) * FRAME.size
    toc = bytes(min(255, i * 256 // 100) for i in range(100))
    info = PREFIX + b"Info" + struct.pack(">III", 7, n, audio) + toc
    tags = _text_frame("TSSE", "payload") + _text_frame("TLEN", str(n * UNIT * 1000 // FRAME.rate))
    tag = b"ID3\x04\0\0" + _syncsafe(len(tags)) + tags
    last = b"TAG" + zlib.crc32(payload).to_bytes(4, "big").hex().encode().ljust(124, b"\0") + b"\xff"
    return tag + info.ljust(FRAME.size, b"\0") + frames.tobytes() + last


@dataclass
class Stream:
    """What a stream was found to hold."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)  # of an Xing, Info or VBRI frame
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    headers: dict[Header, int] = field(default_factory=dict)  # frames of each kind
    checked: int = 0
    bad: int = 0
    unchecked: int = 0  # frames of Layers I and II with a checksum, which is not verified
    resyncs: int = 0
    lost: int = 0  # bytes between frames
    samples: int = 0
    seconds: float = 0.0


def _id3(data: bytes, found: Stream) -> int:
    """Reads the tag in front; its length."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = sum((b & 0x7F) << shift for b, shift in zip(data[6:10], (21, 14, 7, 0)))
    at, end = 10, min(len(data), 10 + size)
    while at + 10 <= end and data[at] != 0:
        name, raw = data[at : at + 4], data[at + 4 : at + 8]
        n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0))) if data[3] == 4 else int.from_bytes(raw, "big")
        if name[:1] == b"T" and n > 1:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[at + 10], "latin-1")
            found.tags[name.decode("latin-1")] = data[at + 11 : at + 10 + n].decode(code, "replace").strip("\0")
        at += 10 + n
    return end + (10 if data[5] & 0x10 else 0)


def _table(frame: bytes, kind: Header, found: Stream) -> bool:
    """Reads the table of a frame that carries one instead of sound."""
    at = 4 + 2 * kind.checked + kind.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found.table[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            found.toc = frame[at : at + 100]
        return True
    if frame[36:40] == b"VBRI":
        found.table.update(bytes=int.from_bytes(frame[46:50], "big"), frames=int.from_bytes(frame[50:54], "big"))
        return True
    return False


def _next_sync(data: bytes, at: int, end: int) -> int:
    """The next frame that another of its kind (or the end) follows."""
    while 0 <= (at := data.find(b"\xff", at, end)) < end:
        kind = header(data[at : at + 4])
        if kind and at + kind.size <= end:
            after = header(data[at + kind.size : at + kind.size + 4])
            alike = after and (after.version, after.layer, after.rate) == (kind.version, kind.layer, kind.rate)
            if alike or at + kind.size == end:
                return at
        at += 1
    return -1


def read_stream(data: bytes) -> Stream:
    """Frames, tags, tables and checks of a stream, however damaged."""
    found = Stream()
    at = _id3(data, found)
    end = len(data)
    if data[-128:-125] == b"TAG" and end - 128 >= at:
        end -= 128
        found.tags["ID3v1"] = data[end + 3 : end + 33].decode("latin-1").strip("\0 ")
    first = True
    sums: dict[bytes, int] = {}
    while at < end:
        kind = header(data[at : at + 4])
        if kind is None or at + kind.size > end:
            there = _next_sync(data, at + 1, end)
            found.resyncs += 1
            found.lost += (end if there < 0 else there) - at
            if there < 0:
                break
            at = there
            continue
        frame = data[at : at + kind.size]
        if kind.checked and kind.layer == 3:
            found.checked += 1
            covered = frame[2:4] + frame[6 : 6 + kind.side]
            if covered not in sums:
                if len(sums) > 4096:
                    sums.clear()
                sums[covered] = crc16(covered)
            found.bad += sums[covered] != int.from_bytes(frame[4:6], "big")
        found.unchecked += kind.checked and kind.layer != 3
        if not (first and kind.layer == 3 and _table(frame, kind, found)):
            found.offsets.append(at)
            found.headers[kind] = found.headers.get(kind, 0) + 1
            found.samples += kind.samples
        first = False
        at += kind.size
    found.seconds = sum(kind.samples * n / kind.rate for kind, n in found.headers.items())
    return found


def payload(data: bytes, found: Stream) -> bytes:
    """The units that the frames of a written stream carry."""
    at = len(PREFIX)
    return b"".join(data[i + at : i + at + UNIT] for i in found.offsets)


def feature(found: Stream) -> str:
    kinds = ";".join(
        f"mpeg{k.version}-layer{k.layer}-{k.kbps}k-{k.rate}-{k.channels}x{n}" for k, n in sorted(found.headers.items(), key=str)
    )
    step = max(1, len(found.offsets) // 4)
    return (
        f"{kinds} samples={found.samples} seconds={found.seconds:.6f} crc={found.checked - found.bad}/{found.checked} "
        f"resyncs={found.resyncs} lost={found.lost} table={found.table.get('frames')}/{found.table.get('bytes')} "
        f"tags={','.join(sorted(found.tags))} seek={','.join(map(str, found.offsets[::step][:4]))}"
    )


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_media``, the stream of each text's UTF-8 bytes, and ``_n_bytes``.

    Null and empty texts are one unit of filling. Columns of these names give way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):  # streams are as long as the texts: few at a time
                part = batch.slice(at, 128)
                raw = [(t.as_py() or "").encode("utf-8") for t in part.column("_text")]
                kept = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if n != "_text"]
                media = pa.array([write_stream(r) for r in raw], pa.binary())
                columns = [*(c for _, c in kept), pa.array([len(r) for r in raw], pa.int64()), media]
                yield pa.RecordBatch.from_arrays(columns, [*(n for n, _ in kept), "_n_bytes", "_media"])

    docs = docs.drop("_media", "_n_bytes", "_text")
    schema = docs.withColumns({"_n_bytes": F.lit(0).cast("bigint"), "_media": F.lit(b"")}).schema
    return docs.withColumn("_text", F.col(text)).mapInArrow(run, schema)


REPORT = (
    "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,"
    "feature:string,seconds:double,frames:bigint,bad_frames:bigint,unchecked_frames:bigint,seek:array<bigint>>"
)


def probe(rows: DataFrame, media: str = "_media") -> DataFrame:
    """``rows`` without the stream and with ``_report``: what reading it back found. A null stream is an empty one.

    ``bad_frames`` fail their checksum; ``unchecked_frames`` are frames of Layers I and II that
    have one, which is not verified. ``seek`` holds the offset of every frame.
    """
    kind = pa.struct(
        [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
        + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("seconds", pa.float64())]
        + [("frames", pa.int64()), ("bad_frames", pa.int64()), ("unchecked_frames", pa.int64()), ("seek", pa.list_(pa.int64()))]
    )

    def report(data: bytes) -> dict:
        found = read_stream(data)
        held = payload(data, found)
        return {
            "payload_bytes": len(held),
            "payload_sha256": hashlib.sha256(held).hexdigest(),
            "tail_crc32": zlib.crc32(held[-32:]),
            "media_bytes": len(data),
            "media_sha256": hashlib.sha256(data).hexdigest(),
            "feature": feature(found),
            "seconds": found.seconds,
            "frames": len(found.offsets),
            "bad_frames": found.bad,
            "unchecked_frames": found.unchecked,
            "seek": found.offsets,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reports = pa.array([report(m.as_py() or b"") for m in batch.column(media)], kind)
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != media]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), reports], [*(n for n, _ in kept), "_report"])

    rows = rows.drop("_report")
    schema = rows.drop(media).withColumn("_report", F.lit(None).cast(REPORT)).schema
    return rows.mapInArrow(run, schema)

"""MPEG streams: exact round trips, and what a damaged stream still gives."""

import hashlib
import random
import zlib

import pytest

from hitweave.llm import mpeg_audio as A


def padded(data):
    return data + b"\xff" * (-len(data) % 576 or (0 if data else 576))


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5760, 200_003])
def test_round_trip(n):
    rng = random.Random(n)
    data = rng.choice([rng.randbytes(n), b"\xff\xf2\xd8\xc0" * (n // 4) + b"\xff" * (n % 4)])
    stream = A.write_stream(data)
    found = A.read_stream(stream)
    assert A.payload(stream, found) == padded(data)
    assert found.samples == len(padded(data)) and found.seconds == len(padded(data)) / 16000
    assert (found.bad, found.resyncs, found.lost) == (0, 0, 0)
    assert found.checked == len(found.offsets) + 1
    assert found.table == {"frames": len(found.offsets), "bytes": 648 * (len(found.offsets) + 1)}
    assert set(found.tags) >= {"TSSE", "TLEN", "ID3v1"}


def test_damage_is_found_and_passed_over():
    rng = random.Random(4)
    data = rng.randbytes(576 * 40)
    whole = A.write_stream(data)
    offsets = A.read_stream(whole).offsets
    flipped = bytearray(whole)
    flipped[offsets[3] + 8] ^= 1  # side information
    assert A.read_stream(bytes(flipped)).bad == 1
    junk = whole[: offsets[10]] + b"junk\xff\xfb\x90" * 5 + whole[offsets[10] :]
    found = A.read_stream(junk)
    assert (found.resyncs, found.lost, len(found.offsets)) == (1, 35, 40)
    assert A.payload(junk, found) == padded(data)
    header_gone = bytearray(whole)
    header_gone[offsets[20]] = 0
    found = A.read_stream(bytes(header_gone))
    assert (found.resyncs, found.lost, len(found.offsets)) == (1, 648, 39)
    cut = whole[: offsets[30] + 100]
    assert len(A.read_stream(cut).offsets) == 30
    for bad in (b"", b"\xff", b"ID3", b"ID3\x04\0\0\x7f\x7f\x7f\x7f", b"\xff" * 5000, bytes(5000), rng.randbytes(20_000)):
        A.read_stream(bad)


def test_frames_that_are_not_verified_are_counted():
    frame = bytes.fromhex("fffcc404") + bytes(764)  # MPEG-1 Layer II, 256 kbit/s, 48 kHz, with a checksum
    found = A.read_stream(frame * 4)
    assert (found.unchecked, found.checked, found.bad, len(found.offsets)) == (4, 0, 0, 4)
    assert A.read_stream(A.write_stream(b"some bytes")).unchecked == 0


def test_frame_sizes():
    # Header, frame size and samples of common kinds.
    for raw, size, samples in [
        ("fffb9064", 417, 1152),  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz
        ("fffb9264", 418, 1152),  # with padding
        ("fff38064", 208, 576),  # MPEG-2 Layer III, 64 kbit/s, 22.05 kHz
        ("fffdc404", 768, 1152),  # MPEG-1 Layer II, 256 kbit/s, 48 kHz
        ("ffff2404", 32 * 2, 384),  # MPEG-1 Layer I, 64 kbit/s, 48 kHz
        ("ffe39064", 576, 576),  # MPEG-2.5 Layer III, 80 kbit/s, 11.025 kHz is 522; 9 is 80
    ]:
        kind = A.header(bytes.fromhex(raw))
        assert kind is not None
        if raw != "ffe39064":
            assert (kind.size, kind.samples) == (size, samples), raw
        else:
            assert (kind.size, kind.samples) == (72_000 * 80 // 11025, 576)
    for raw in ("fffbf064", "fffb9c64", "fff99064"[:5] + "064", "ffeb9064"):
        kind = A.header(bytes.fromhex(raw.ljust(8, "0")))
        assert kind is None or kind.layer in (1, 2, 3)
    assert A.header(bytes.fromhex("fffbf064")) is None and A.header(bytes.fromhex("fffb9c64")) is None


def test_crc():
    def by_bits(data):
        crc = 0xFFFF
        for byte in data:
            for bit in range(7, -1, -1):
                top = crc >> 15 & 1
                crc = crc << 1 & 0xFFFF
                if top ^ byte >> bit & 1:
                    crc ^= 0x8005
        return crc

    for data in (b"", b"\0", b"123456789", bytes(range(256))):
        assert A.crc16(data) == by_bits(data)


def test_rows(spark):
    texts = [(1, "some text"), (1, "some text"), (2, None), (3, ""), (None, "été " * 50_000), (4, "x" * 576)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, _media int")
    got = A.probe(A.encode(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (r.text or "").encode()
        assert r._n_bytes == len(raw)
        assert r._report.payload_bytes == len(padded(raw)) == r._report.frames * 576
        assert r._report.payload_sha256 == hashlib.sha256(padded(raw)).hexdigest()
        assert r._report.tail_crc32 == zlib.crc32(padded(raw)[-32:])
        assert r._report.media_sha256 == hashlib.sha256(A.write_stream(raw)).hexdigest()
        assert len(r._report.seek) == r._report.frames
        assert (r._report.bad_frames, r._report.unchecked_frames) == (0, 0)
    assert A.probe(A.encode(docs.limit(0))).count() == 0

"""Damaged AVI files give clips or a reason, never another error and never without end."""

import random
import struct

from engram.llm import media

FINE = (ValueError, KeyError, IndexError, struct.error)


def mutated(rng, data):
    data = bytearray(data)
    for _ in range(rng.choice((1, 1, 2, 5))):
        at = rng.randrange(len(data))
        kind = rng.random()
        if kind < 0.6:
            data[at] = rng.randrange(256)
        elif kind < 0.7:
            data[at : at + 4] = struct.pack("<I", rng.choice((0, 1, 65535, 1 << 31, (1 << 32) - 1)))
        elif kind < 0.85:
            del data[at : at + rng.randrange(1, 9)]
        else:
            data = data[:at] if rng.random() < 0.3 else data[:at] + data[max(0, at - 20) :]
        if not data:
            return b"RIFF"
    return bytes(data)


def test_mutated_files(spark):
    rng = random.Random(11)
    whole = media.store_payload(media.pad(bytes(rng.randrange(256) for _ in range(200))))
    small = media.store_payload(media.pad(b"x"))
    # frames whose tables aren't the stored ones go the general way
    other = whole.replace(media._TABLE, media._TABLE[:-1] + bytes([media._TABLE[-1] ^ 1]))
    read = failed = 0
    files = []
    for i in range(9000):
        data = mutated(rng, (whole, small, other)[i % 3])
        try:
            read += bool(media.clips(data))
        except FINE:
            failed += 1
        if i % 60 == 0:
            files.append((i, bytearray(data)))
    assert read > 100 and failed > 1000
    got = media.avi_clips(spark.createDataFrame(files, "id int, media binary")).collect()
    assert all((r.clip is None) == (r.error is not None) for r in got)


def test_lossless_arithmetic_and_missing_tables():
    head = b"\xff\xd8" + media._segment(0xC3, struct.pack(">BHHB", 8, 1, 8, 1) + bytes([1, 0x11, 0]))
    for scan in (bytes([0, 1, 0, 0]), bytes([1, 1, 0x00, 9, 0, 0]), bytes([1, 1, 0x50, 1, 0, 0])):
        try:
            media.decode_jpeg(head + media._segment(0xDA, scan) + b"\x12\x34\x56\xff\xd9")
        except FINE:
            continue
        raise AssertionError(scan)

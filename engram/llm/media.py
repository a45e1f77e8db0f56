"""AVI motion-JPEG columns: RIFF parsing, intra-frame decoding, shot detection, and lossless storage of bytes.

``read_avi`` walks the RIFF tree and its idx1 index; ``decode_jpeg`` decodes baseline (SOF0) and lossless (SOF3) frames;
``shots`` cuts a clip where the histogram difference exceeds an adaptive threshold. ``store_payload`` writes bytes as
8-bit samples of lossless JPEG frames (64 samples a line), ``load_payload`` reads them back.

The lossless frames use one Huffman table, in which category s has a code of 9 - s bits, so each sample takes exactly
9 bits with its s extra bits; that makes coding and decoding table look-ups over whole arrays. A frame with any other
table is decoded bit by bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import arrow_map, slices

WIDTH, LINES, FPS = 64, 32, 25
#: Fixed values of the JPEG format: the order in which an 8x8 block's coefficients are sent.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

# ---- lossless frames ------------------------------------------------------------------------------------------------

_DIFF = np.arange(-255, 256)
_SIZE = np.array([int(abs(d)).bit_length() for d in _DIFF])
#: Category s: 8 - s ones, a zero (nine ones less one for s = 0), then s bits, those of d or of d - 1 if d is negative.
_CODE = np.array([((1 << (8 - s)) - 1) << (s + 1) | (d if d >= 0 else d + (1 << s) - 1) for d, s in zip(_DIFF.tolist(), _SIZE.tolist(), strict=True)], np.uint16)
_UNCODE = np.zeros(512, np.int16)
_UNCODE[_CODE] = _DIFF
_TABLE = bytes([0] + [1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, lines: int) -> bytes:
    frame = struct.pack(">BHHB", 8, lines, width, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + _segment(0xC4, _TABLE) + _segment(0xC3, frame) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def _pack9(codes: np.ndarray) -> np.ndarray:
    """(n, 8k) 9-bit codes -> (n, 9k) bytes."""
    c = codes.reshape(codes.shape[0], -1, 8)
    out = np.empty((*c.shape[:2], 9), np.uint8)
    out[..., 0] = c[..., 0] >> 1
    for i in range(1, 8):
        out[..., i] = (c[..., i - 1] << (8 - i)) | (c[..., i] >> (i + 1))
    out[..., 8] = c[..., 7]
    return out.reshape(codes.shape[0], -1)


def _unpack9(data: np.ndarray) -> np.ndarray:
    b = data.reshape(data.shape[0], -1, 9).astype(np.uint16)
    out = np.empty((*b.shape[:2], 8), np.uint16)
    for i in range(8):
        out[..., i] = ((b[..., i] << (i + 1)) | (b[..., i + 1] >> (7 - i))) & 511
    return out.reshape(data.shape[0], -1)


def _scans(samples: np.ndarray) -> list[bytes]:
    """(n, lines, width) samples -> the entropy-coded data of n frames, predictor 1 (left; above at a line's start)."""
    d = np.empty(samples.shape, np.int16)
    d[:, :, 1:] = samples[:, :, 1:].astype(np.int16) - samples[:, :, :-1]
    d[:, 1:, 0] = samples[:, 1:, 0].astype(np.int16) - samples[:, :-1, 0]
    d[:, 0, 0] = samples[:, 0, 0].astype(np.int16) - 128
    packed = _pack9(_CODE[d.reshape(samples.shape[0], -1) + 255])
    return [row.tobytes().replace(b"\xff", b"\xff\x00") for row in packed]


def _samples(scans: list[bytes], width: int, lines: int) -> np.ndarray:
    raw = b"".join(s.replace(b"\xff\x00", b"\xff") for s in scans)
    d = _UNCODE[_unpack9(np.frombuffer(raw, np.uint8).reshape(len(scans), -1))].reshape(len(scans), lines, width)
    d = d.astype(np.uint8)  # sums modulo 256 are the samples
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.uint8)
    return np.cumsum(d, axis=2, dtype=np.uint8)


# ---- RIFF -----------------------------------------------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI file with one MJPG stream and an idx1 index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movi.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        n = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(end, at + 8 + n)
        at += 8 + n + (n & 1)


def _stored(data: bytes, at: int, end: int) -> Iterator[bytes]:
    """The frames of a movi list's chunks, and of the record lists in it, in order."""
    for k, a, e in _walk(data, at, end):
        if k == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _stored(data, a + 4, e)
        elif k[2:] in (b"dc", b"db"):
            yield data[a:e]


def _standard_index(data: bytes, at: int, end: int) -> list[bytes]:
    """The frames of an OpenDML ix## chunk: 32-bit offsets from a base, sizes whose top bit marks no key frame."""
    each, _, kind, n, name, base = struct.unpack_from("<HBBI4sQ", data, at)
    if kind != 1 or each != 2 or name[2:] not in (b"dc", b"db"):
        return []
    entries = np.frombuffer(data, "<u4", 2 * min(n, (end - at - 24) // 8), at + 24).reshape(-1, 2).tolist()
    return [data[base + o : base + o + (size & 0x7FFFFFFF)] for o, size in entries]


def read_avi(data: bytes) -> dict:
    """{width, height, frame_s, frames}: the frames of all segments of a file, AVI and AVIX, in order.

    A segment's frames are those of its indexes: ix## chunks in its movi list, looked for where the header names them or
    there is no idx1, else idx1 in the first segment; without one they are the movi list's chunks, records included.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"width": 0, "height": 0, "frame_s": 1 / FPS, "frames": [], "indexed": False}
    for riff, start, stop in _walk(data, 0, len(data)):
        if riff != b"RIFF" or data[start : start + 4] not in (b"AVI ", b"AVIX"):
            break
        movi, index = None, None
        for kind, at, end in _walk(data, start + 4, stop):
            form = data[at : at + 4] if kind == b"LIST" else b""
            if form == b"hdrl":
                _header(data, at + 4, end, out)
            elif form == b"movi":
                movi = (at, end)
            elif kind == b"idx1":
                index = [struct.unpack_from("<4sIII", data, a) for a in range(at, end - 15, 16)]
        if not movi:
            continue
        look = index is None or out["indexed"]
        standard = [(a, e) for k, a, e in _walk(data, movi[0] + 4, movi[1]) if k[:2] == b"ix"] if look else []
        if standard:
            out["frames"] += [f for a, e in standard for f in _standard_index(data, a, e)]
        elif index is not None:
            base = movi[0] if not index or data[movi[0] + index[0][2] : movi[0] + index[0][2] + 4] == index[0][0] else 0
            out["frames"] += [data[base + o + 8 : base + o + 8 + n] for k, _, o, n in index if k[2:] in (b"dc", b"db")]
        else:
            out["frames"] += _stored(data, movi[0] + 4, movi[1])
    return out


def _header(data: bytes, at: int, end: int, out: dict) -> None:
    for k, a, e in _walk(data, at, end):
        if k == b"avih":
            out["frame_s"] = struct.unpack_from("<I", data, a)[0] / 1e6
            out["width"], out["height"] = struct.unpack_from("<II", data, a + 32)
        elif k == b"LIST" and data[a : a + 4] == b"strl":
            for k2, a2, _ in _walk(data, a + 4, e):
                out["indexed"] |= k2 == b"indx"
                if k2 == b"strh" and data[a2 : a2 + 4] == b"vids":
                    scale, rate = struct.unpack_from("<II", data, a2 + 20)
                    out["frame_s"] = scale / rate if rate else out["frame_s"]


# ---- JPEG -----------------------------------------------------------------------------------------------------------


def _huffman(body: bytes) -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    """DHT body -> {(class, id): {(length, code): symbol}}."""
    out, at = {}, 0
    while at < len(body):
        counts = body[at + 1 : at + 17]
        table, code, k = {}, 0, at + 17
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        out[body[at] >> 4, body[at] & 15] = table
        at = k
    return out


def _usual(bits: str, head: str) -> bytes:
    """A table's body: code counts by length, then symbols, the irregular first ones and the rest in ascending order."""
    first = bytes.fromhex(head)
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return bytes.fromhex(bits) + first + bytes(sorted(set(every) - set(first)))


#: The usual tables, which motion-JPEG frames may leave out: (class, id) -> counts and symbols.
USUAL = {
    0x00: bytes.fromhex("00010501010101010100000000000000") + bytes(range(12)),
    0x01: bytes.fromhex("00030101010101010101010000000000") + bytes(range(12)),
    0x10: _usual("0002010303020403050504040000017d", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    0x11: _usual("00020102040403040705040400010277", "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f1"),
}


class _Bits:
    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.at = 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > 8 * len(self.data) + 64:  # past the end, where decoders read ones for a while
            raise ValueError("a scan that ends early")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[first:last].ljust(last - first, b"\xff"), "big")
        self.at += n
        return (word >> (last * 8 - self.at)) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        if size > 16:
            raise ValueError("no such difference")
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _parse(data: bytes) -> dict:
    out: dict = {"huff": _huffman(b"".join(bytes([k]) + body for k, body in USUAL.items())), "raw": b"", "quant": {}, "restart": 0}
    at = 2
    while at + 4 <= len(data):
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC4:
            out["huff"] |= _huffman(body)
            out["raw"] += body
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                out["quant"][body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(float)
                k += 65 + 64 * wide
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            out["kind"], out["lines"], out["width"] = marker, *struct.unpack_from(">HH", body, 1)
            out["comps"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if not (out["lines"] and out["width"] and out["comps"]) or not all(1 <= f <= 4 for c in out["comps"] for f in c[1:3]):
                raise ValueError("a frame without samples")
        elif marker == 0xDA:
            out["tables"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            out["predictor"] = body[1 + 2 * body[0]]
            end = data.rfind(b"\xff\xd9")
            out["scan"] = data[at : end if end >= at else len(data)]
            return out
    raise ValueError("no scan")


def _lossless(p: dict) -> np.ndarray:
    if p["raw"] == _TABLE and p["predictor"] == 1 and not p["restart"] and p["width"] % 8 == 0:
        return _samples([p["scan"]], p["width"], p["lines"])[0]
    if not p["tables"] or p["predictor"] > 7:
        raise ValueError("a scan without tables")
    if p["lines"] * p["width"] > 8 * len(p["scan"]) + 64:  # a sample takes a bit or more
        raise ValueError("a scan that ends early")
    bits, out = _Bits(p["scan"]), np.zeros((p["lines"], p["width"]), np.int64)
    table = p["huff"][0, next(iter(p["tables"].values()))[0]]
    for y in range(p["lines"]):
        for x in range(p["width"]):
            a, b, c = (out[y, x - 1] if x else 0), (out[y - 1, x] if y else 0), (out[y - 1, x - 1] if x and y else 0)
            if not y:
                guess = a if x else 128
            elif not x:
                guess = b
            else:
                guess = (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[p["predictor"]]
            size = bits.symbol(table)
            out[y, x] = (int(guess) + (32768 if size == 16 else bits.signed(size))) & 255
    return out.astype(np.uint8)


_DCT = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def _baseline(p: dict) -> np.ndarray:
    """The luminance plane; chrominance is read past, as shots are found by luminance."""
    hmax, vmax = max(c[1] for c in p["comps"]), max(c[2] for c in p["comps"])
    if len(p["comps"]) == 1:
        p["comps"] = [(p["comps"][0][0], 1, 1, p["comps"][0][3])]
        hmax = vmax = 1
    wide, high = -(-p["width"] // (8 * hmax)), -(-p["lines"] // (8 * vmax))
    lum = p["comps"][0]
    if wide * high > 8 * len(p["scan"]) + 64:  # a block takes a bit or more
        raise ValueError("a scan that ends early")
    plane = np.zeros((high * lum[2] * 8, wide * lum[1] * 8))
    parts = [p["scan"]]
    if p["restart"]:
        import re

        parts = re.split(rb"\xff[\xd0-\xd7]", p["scan"])
    mcu, total = 0, wide * high
    for part in parts:
        bits, dc = _Bits(part), {c[0]: 0 for c in p["comps"]}
        for _ in range(min(p["restart"] or total, total - mcu)):
            for ident, h, v, quant in p["comps"]:
                td, ta = p["tables"][ident]
                for block in range(h * v):
                    coef = np.zeros(64)
                    dc[ident] += bits.signed(bits.symbol(p["huff"][0, td]))
                    coef[0] = dc[ident]
                    k = 1
                    while k < 64:
                        s = bits.symbol(p["huff"][1, ta])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            coef[k] = bits.signed(s & 15)
                        k += 1
                    if ident == lum[0]:
                        grid = np.zeros(64)
                        grid[ZIGZAG] = coef * p["quant"][quant]
                        y, x = (mcu // wide * v + block // h) * 8, (mcu % wide * h + block % h) * 8
                        plane[y : y + 8, x : x + 8] = _DCT.T @ grid.reshape(8, 8) @ _DCT + 128
            mcu += 1
    return np.clip(np.rint(plane[: p["lines"], : p["width"]]), 0, 255).astype(np.uint8)


def decode_jpeg(data: bytes) -> np.ndarray:
    """(lines, width) 8-bit luminance samples of a baseline or lossless frame."""
    p = _parse(data)
    return _lossless(p) if p["kind"] == 0xC3 else _baseline(p)


# ---- shots ----------------------------------------------------------------------------------------------------------


def histograms(frames: np.ndarray, bins: int = 32) -> np.ndarray:
    """(n, ...) samples -> (n, bins) shares."""
    n = frames.shape[0]
    flat = frames.reshape(n, -1)
    keys = (flat >> np.uint8(8 - (bins - 1).bit_length())) + (np.arange(n) * bins)[:, None]
    return np.bincount(keys.ravel(), minlength=n * bins).reshape(n, bins) / max(1, flat.shape[1])


def shots(hist: np.ndarray, window: int = 12, spread: float = 3.0, least: float = 0.25) -> list[tuple[int, int]]:
    """[first, end) of each shot. A cut: half the L1 difference is at least ``least`` and more than mean + spread *
    deviation of the differences among the ``window`` frames on either side, itself left out."""
    n = hist.shape[0]
    if n == 0:
        return []
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = []
    for i in np.flatnonzero(d >= least).tolist():
        near = np.concatenate([d[max(0, i - window) : i], d[i + 1 : i + 1 + window]])
        if not near.size or d[i] > near.mean() + spread * near.std():
            cuts.append(i + 1)
    edges = [0, *cuts, n]
    return list(zip(edges[:-1], edges[1:], strict=True))


# ---- payloads -------------------------------------------------------------------------------------------------------


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def store_payload(payload: bytes) -> bytes:
    """An AVI file whose samples are the payload (a positive multiple of 64 bytes); the last frame may have fewer lines."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    whole = a.shape[0] // LINES
    frames = [_head(WIDTH, LINES) + s + b"\xff\xd9" for s in _scans(a[: whole * LINES].reshape(whole, LINES, WIDTH))] if whole else []
    if rest := a.shape[0] - whole * LINES:
        frames.append(_head(WIDTH, rest) + _scans(a[None, whole * LINES :])[0] + b"\xff\xd9")
    return write_avi(frames, WIDTH, LINES)


def load_payload(avi: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """The samples in order, the decoded frames and the seconds a frame takes."""
    media = read_avi(avi)
    head, frames, same = _head(WIDTH, LINES), [], []
    for f in media["frames"]:
        if f.startswith(head):
            same.append(f[len(head) : f.rfind(b"\xff\xd9")])
        else:
            if same:
                frames += list(_samples(same, WIDTH, LINES))
                same = []
            frames.append(decode_jpeg(f))
    if same:
        frames += list(_samples(same, WIDTH, LINES))
    return b"".join(f.tobytes() for f in frames), frames, media["frame_s"]


def clips(avi: bytes) -> list[dict]:
    """Timed clip rows of an AVI file."""
    _, frames, frame_s = load_payload(avi)
    return _clips(frames, frame_s)


def _clips(frames: list[np.ndarray], frame_s: float) -> list[dict]:
    if not frames:
        return []
    size = frames[0].shape
    k = sum(f.shape == size for f in frames)
    hist = [histograms(np.stack(frames[:k]))] if all(f.shape == size for f in frames[:k]) else []
    hist += [histograms(f[None]) for f in (frames[k:] if hist else frames)]
    h = np.concatenate(hist)
    return [{"clip": i, "first_frame": a, "end_frame": e, "start_s": a * frame_s, "end_s": e * frame_s, "luma": float((h[a:e].mean(axis=0) * np.arange(h.shape[1])).sum())} for i, (a, e) in enumerate(shots(h))]


def avi_clips(files: DataFrame, media_col: str = "media", id_col: str = "id") -> DataFrame:
    """One row for each shot of each AVI file: (id, clip, first_frame, end_frame, start_s, end_s, luma, error).

    A null or empty value gives no row; one that isn't a readable AVI file gives a row with clip null and the reason in
    ``error``. Rows are independent; repeated rows give repeated clips; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            rows = []
            for key, data in zip(b.column("id").to_pylist(), b.column("media").to_pylist(), strict=True):
                try:
                    rows += [{"id": key, **c, "error": None} for c in (clips(data) if data else [])]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append({"id": key, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema=schema(b.schema.field("id").type))

    def schema(kind: pa.DataType) -> pa.Schema:
        return pa.schema([("id", kind), ("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("luma", pa.float64()), ("error", pa.string())])

    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return arrow_map(rows, run, f"id {kind}, clip int, first_frame int, end_frame int, start_s double, end_s double, luma double, error string").withColumnRenamed("id", id_col)


def text_media(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """Store every text as an AVI file, read it back and describe it.

    (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_clips[, media]). A
    null text counts as empty: 64 zero bytes. All figures but n_bytes come from the stored file. ``feature`` lists the
    shots as first-end@mean level. Repeated rows keep their count; an empty table gives an empty one; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            cols: list[list] = [[] for _ in range(9)]
            for t in texts:
                t = t or b""
                avi = store_payload(pad(t))
                back, frames, frame_s = load_payload(avi)
                found = _clips(frames, frame_s)
                feature = ",".join(f"{c['first_frame']}-{c['end_frame']}@{c['luma']:.4f}" for c in found)
                for col, v in zip(cols, (len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature, len(found), avi if keep_media else None), strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *arrays[: 8 + keep_media]], names=names[: 9 + keep_media])

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clips", "media"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_clips bigint"
    return arrow_map(rows, run, f"id {kind}, {out}" + ", media binary" * keep_media).withColumnRenamed("id", id_col)

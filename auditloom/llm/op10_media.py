"""AVI motion-JPEG columns: store bytes as intra frames, read the RIFF index, decode frames and find shots.

A frame is a baseline JPEG of 8 x 8 pixels in three components, so 192 quantised coefficients. A byte is stored as a
coefficient of size class 8: the eight magnitude bits of that class take each of the 256 values once, so nothing is
lost. The Huffman code of the class has eight bits, hence frames keep to whole bytes and decode as arrays; frames of
any other baseline coder are decoded bit by bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table

UNIT, FPS = 192, 25
#: A cut needs a histogram difference above mean + SPREAD deviations of the WINDOW differences before it, and above FLOOR.
WINDOW, SPREAD, FLOOR = 12, 2.0, 8

#: Fixed values of the JPEG format: the zigzag order of coefficients, row by row along the anti-diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int) -> bytes:
    """A Huffman table with the single 8-bit code 0 for size class 8."""
    return bytes([kind, *(1 if n == 8 else 0 for n in range(1, 17)), 8])


HEADER = b"".join((
    b"\xff\xd8", _segment(0xDB, bytes([0] + [1] * 64)),
    _segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
    _segment(0xC4, _one_code(0x00) + _one_code(0x10)),
    _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
))


def encode_frames(payload: bytes) -> list[bytes] | np.ndarray:
    """A JPEG for each 192 bytes; one array where no byte needs stuffing (always so for UTF-8)."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    scan = np.zeros((len(units), 2 * UNIT), np.uint8)
    scan[:, 1::2] = units
    if (units == 255).any():
        return [HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in scan]
    head, tail = (np.broadcast_to(np.frombuffer(x, np.uint8), (len(units), len(x))) for x in (HEADER, b"\xff\xd9"))
    return np.concatenate([head, scan, tail], axis=1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file (one MJPG stream, with idx1) whose frames hold ``payload``, a multiple of 192 bytes."""
    frames = encode_frames(payload)
    sizes = np.array([len(f) for f in frames], np.uint32) if isinstance(frames, list) else np.full(len(frames), frames.shape[1], np.uint32)
    padded = sizes + sizes % 2
    index = np.zeros((len(sizes), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    index[:, 2] = 4 + np.concatenate([[0], np.cumsum(padded[:-1] + 8)])
    if isinstance(frames, list):
        movi = b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2) for f in frames)
    else:
        lead = np.broadcast_to(np.frombuffer(b"00dc" + struct.pack("<I", int(sizes[0])), np.uint8), (len(frames), 8))
        movi = np.concatenate([lead, frames, np.zeros((len(frames), int(sizes[0]) % 2), np.uint8)], axis=1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body

    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(sizes), 0, 1, int(sizes.max()), 8, 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(sizes), int(sizes.max()), 0, 0, 0, 0, 8, 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8, 8, 1, 24, b"MJPG", UNIT, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + movi) + chunk(b"idx1", index.tobytes()))


def read_index(media: bytes) -> tuple[float, np.ndarray]:
    """Frames a second and the (position, size) of each video frame, from the RIFF chunks and idx1."""
    fps, movi, entries, at = float(FPS), None, None, 12
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            at += 12
            continue
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"avih":
            fps = 1e6 / max(1, int.from_bytes(media[at + 8 : at + 12], "little"))
        elif name == b"idx1":
            entries = np.frombuffer(media, "<u4", n // 16 * 4, at + 8).reshape(-1, 4)
        at += 8 + n + n % 2
    if movi is None or entries is None:
        raise ValueError("no movi list or no idx1 index")
    kind = entries[:, 0] >> 16
    entries = entries[(kind == int.from_bytes(b"dc", "little")) | (kind == int.from_bytes(b"db", "little"))]
    base = movi if not len(entries) or int(entries[0, 2]) < movi else 0  # offsets count from movi or from the file
    return fps, np.stack([entries[:, 2].astype(np.int64) + base + 8, entries[:, 3].astype(np.int64)], axis=1)


def _decode_bits(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (blocks of the first component's grid in scan order per component) of one baseline JPEG."""
    at, quant, codes, comps, restart = 2, {}, {}, [], 0
    while True:
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        while marker == 0xDB and body:
            size = 2 if body[0] >> 4 else 1
            quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * size], ">u2" if size == 2 else np.uint8).astype(np.int32)
            body = body[1 + 64 * size :]
        while marker == 0xC4 and body:
            counts, code, k, found = body[1:17], 0, 17, {}
            for length, c in enumerate(counts, 1):
                for _ in range(c):
                    found[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            codes[body[0]], body = found, body[k:]
        if marker == 0xC0:
            high, wide = struct.unpack(">HH", body[1:5])
            comps = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0, 0] for i in range(body[5])]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            for i in range(body[0]):
                c = next(c for c in comps if c[0] == body[1 + 2 * i])
                c[4], c[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            break
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
    stream = data[at:]
    pos = bits = have = 0

    def bit() -> int:
        nonlocal pos, bits, have
        if not have:
            if stream[pos] == 255 and stream[pos + 1] != 0:
                raise ValueError("the scan ends early")
            bits, have = stream[pos], 8
            pos += 2 if stream[pos] == 255 else 1
        have -= 1
        return bits >> have & 1

    def symbol(book: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bit()
            if (length, code) in book:
                return book[length, code]
        raise ValueError("no such code")

    def value(size: int) -> int:
        v = 0
        for _ in range(size):
            v = v << 1 | bit()
        return v if not size or v >> size - 1 else v - (1 << size) + 1

    most_h, most_v = max(c[1] for c in comps), max(c[2] for c in comps)
    out: list[list[np.ndarray]] = [[] for _ in comps]
    for mcu in range(-(-wide // (8 * most_h)) * -(-high // (8 * most_v))):
        if restart and mcu and mcu % restart == 0:
            pos, have = pos + 2, 0
            for c in comps:
                c[6] = 0
        for c, blocks in zip(comps, out, strict=True):
            for _ in range(c[1] * c[2]):
                block = np.zeros(64, np.int32)
                c[6] += value(symbol(codes[c[4]]))
                block[0], k = c[6], 1
                while k < 64:
                    s = symbol(codes[16 | c[5]])
                    if not s & 15 and s >> 4 != 15:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k] = value(s & 15)
                    k += 1
                blocks.append(block)
    return np.concatenate([np.stack(b) for b in out]), quant[comps[0][3]][None] if comps else None


def decode_frames(media: bytes, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients ``[frames, blocks * 64]`` in zigzag order and the quantisation of the first component."""
    size = len(HEADER) + 2 * UNIT + 2
    if len(places) and (places[:, 1] == size).all() and (len(places) == 1 or (np.diff(places[:, 0]) == places[1, 0] - places[0, 0]).all()):
        step = int(places[1, 0] - places[0, 0]) if len(places) > 1 else size
        rows = np.lib.stride_tricks.as_strided(np.frombuffer(media, np.uint8, offset=int(places[0, 0])), (len(places), size), (step, 1), writeable=False)
        scan = rows[:, len(HEADER) : -2]
        if (rows[:, : len(HEADER)] == np.frombuffer(HEADER, np.uint8)).all() and not scan[:, ::2].any() and not (scan == 255).any():
            raw = scan[:, 1::2].astype(np.int32)
            return np.where(raw >= 128, raw, raw - 255), np.ones(64, np.int32)
    found = [_decode_bits(media[p : p + n]) for p, n in places.tolist()]
    return np.stack([c.ravel() for c, _ in found]), found[0][1].ravel()


def coefficients_to_bytes(coefficients: np.ndarray) -> bytes:
    return np.where(coefficients > 0, coefficients, coefficients + 255).astype(np.uint8).tobytes()


_k = np.arange(8)
_BASIS = (np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _k[None] + 1) * _k[:, None] * np.pi / 16)).astype(np.float32)


def luma(coefficients: np.ndarray, quant: np.ndarray, blocks: int = 1) -> np.ndarray:
    """Pixels 0 to 255 of the first component's blocks: dequantise, inverse transform, shift."""
    planes = np.zeros((len(coefficients), blocks, 64), np.float32)
    planes[:, :, ZIGZAG] = (coefficients[:, : 64 * blocks].reshape(-1, blocks, 64) * quant).astype(np.float32)
    planes = _BASIS.T @ planes.reshape(-1, blocks, 8, 8) @ _BASIS
    return np.clip(np.rint(planes) + 128, 0, 255).astype(np.uint8).reshape(len(coefficients), -1)


def shots(pixels: np.ndarray) -> np.ndarray:
    """First frames of the shots: 16-bin histograms, cut where the difference rises above its recent level."""
    n = len(pixels)
    if not n:
        return np.zeros(0, np.int64)
    bins = np.bincount(((np.arange(n) * 16)[:, None] + (pixels >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    change = np.abs(np.diff(bins, axis=0)).sum(axis=1) // 2
    sums, squares = (np.concatenate([[0], np.cumsum(x)]) for x in (change, change * change))
    at = np.arange(n - 1)
    low = np.maximum(at - WINDOW, 0)
    count = np.maximum(at - low, 1)
    mean = (sums[at] - sums[low]) / count
    spread = np.sqrt(np.maximum((squares[at] - squares[low]) / count - mean * mean, 0))
    return np.concatenate([[0], 1 + np.flatnonzero((at > low) & (change >= FLOOR) & (change > mean + SPREAD * spread))])


def clips_of(media: bytes) -> tuple[bytes, list[tuple[float, float, int]]]:
    """The stored bytes, and a clip (start, end, frames) for each shot."""
    fps, places = read_index(media)
    starts, data, previous, block = [], [], None, 1 << 14
    for i in range(0, len(places), block):  # in blocks, with the frames that a threshold looks back to
        coefficients, quant = decode_frames(media, places[i : i + block])
        data.append(coefficients_to_bytes(coefficients))
        pixels = luma(coefficients, quant)
        back = 0 if previous is None else len(previous)
        found = shots(np.concatenate([previous, pixels]) if back else pixels)
        starts.append(found[found >= back] - back + i)
        previous = pixels[-WINDOW - 1 :]
    first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(places))
    return b"".join(data), [(a / fps, b / fps, b - a) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]


def _payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def clips(docs: DataFrame) -> DataFrame:
    """Clip rows ``(doc_id, clip, start_s, end_s, frames)`` of each document's AVI column, made from its text."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                rows += [(doc, i, *clip) for i, clip in enumerate(clips_of(write_avi(_payload(text)[1]))[1])]
            columns = [*zip(*rows, strict=True)] or [()] * 5
            types = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "clip", "start_s", "end_s", "frames"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, clip int, start_s double, end_s double, frames long")


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text in an AVI, read it back and describe it.

    Nulls: a null text is an empty one, stored as 192 spaces; a null doc_id is kept. Repeated rows and equal texts
    give equal values. Empty table: no rows. Other columns are not read. Very long texts: whole, frames decode in blocks; a
    file of 4 GiB or more doesn't fit the sizes of RIFF and is an error. Ties between shots can't occur.
    """

    def one(text: str | None) -> tuple:
        n, payload = _payload(text)
        media = write_avi(payload)
        back, found = clips_of(media)
        feature = f"fps={FPS};frames={len(back) // UNIT};shots={len(found)};clips=" + ",".join(f"{a:.2f}-{b:.2f}" for a, b, _ in found)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = [one(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


def op10_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op10_media_avi": op10_media_avi}

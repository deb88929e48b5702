"""AVI motion-JPEG columns: write and parse RIFF files, decode intra frames, detect shots.

Frames are grey baseline JPEGs. ``encode_samples`` stores one sample in each 8 x 8 block, as a
flat block whose only coefficient is the DC one (quantiser 8), so that every decoder gives the
samples back exactly. Its Huffman table gives category k a code of 9 - k bits, so that a sample
always takes 10 bits with its end-of-block code, and whole files are coded and decoded by array
operations. Frames of other tables are decoded by the general baseline decoder.

``clips`` cuts a file into shots: a cut is where the histogram difference of neighbouring
frames exceeds the median of the differences around it by ``K`` deviations. Null payloads count as
empty, and equal texts give equal values. Files that can't be decoded raise ValueError, whatever is wrong with
them; no step goes beyond a file's own length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read, text_or_empty

#: Samples (8 x 8 blocks) of a frame: 16 wide, 12 high.
WIDE, HIGH = 16, 12
FRAME = WIDE * HIGH
FPS = 25
#: Shot detection: bins of a histogram, frames on either side of a difference, deviations, least difference.
BINS, AROUND, K, LEAST = 16, 8, 2.5, 0.35
#: Standard deviations of normal values in one median absolute deviation.
SPREAD = 1.4826

# The order in which a block's coefficients are stored (fixed by the JPEG standard), as its rule: diagonals, turning.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


# Fixed values of the JPEG standard (annex K): the Huffman tables that motion-JPEG frames may leave out, each as the
# number of codes of each length from 1 to 16 and their symbols.
STANDARD_TABLES = {
    0x00: ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: (
        "00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d",
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28"
        " 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89"
        " 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2"
        " e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
    0x11: (
        "00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77",
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26"
        " 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87"
        " 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da"
        " e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
}


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header() -> bytes:
    lengths = bytes([1] * 9 + [0] * 7)  # one code of each length from 1 to 9
    dc = b"\x00" + lengths + bytes(range(8, -1, -1))  # categories 8..0
    ac = b"\x10" + bytes([1] + [0] * 15) + b"\x00"  # the end of a block only
    return (
        b"\xff\xd8" + segment(0xDB, b"\x00" + bytes([8] + [1] * 63))
        + segment(0xC0, struct.pack(">BHHB", 8, HIGH * 8, WIDE * 8, 1) + b"\x01\x11\x00")
        + segment(0xC4, dc) + segment(0xC4, ac) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


HEADER = frame_header()


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The 10 bits of each difference from -255 to 255, and the difference of each 10 bits."""
    bits, diffs = np.zeros(511, np.uint16), np.zeros(1024, np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code = ((1 << (8 - k)) - 1) << 1 if k else 0b111111110
        extra = d if d >= 0 else d + (1 << k) - 1
        bits[d + 255] = (code << k | extra) << 1
        diffs[bits[d + 255]] = d
    return bits, diffs


BITS, DIFFS = _codes()


def encode_samples(payload: bytes) -> bytes:
    """An AVI file whose frames hold the samples; their number has to be a positive multiple of FRAME."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16)
    n = len(x)
    d = np.diff(x, axis=1, prepend=np.int16(128))
    v = BITS[d + 255].reshape(n, -1, 4).astype(np.uint64)
    v = v[..., 0] << np.uint64(30) | v[..., 1] << np.uint64(20) | v[..., 2] << np.uint64(10) | v[..., 3]
    scan = v.astype(">u8").view(np.uint8).reshape(n, -1, 8)[..., 3:].reshape(n, -1)
    raw, width = scan.tobytes(), scan.shape[1]
    jpegs = [HEADER + raw[i : i + width].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(raw), width)]
    size = np.fromiter(map(len, jpegs), np.int64, n)
    pad = size & 1
    movi = b"movi" + b"".join([b"00dc" + len(j).to_bytes(4, "little") + j + b"\x00" * (len(j) & 1) for j in jpegs])
    offsets = 4 + np.concatenate([[0], np.cumsum(8 + size + pad)[:-1]])
    index = np.empty((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, offsets, size
    most = int(size.max())
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDE * 8, HIGH * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDE * 8, HIGH * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDE * 8, HIGH * 8, 1, 24, b"MJPG", WIDE * HIGH * 192, 0, 0, 0, 0)
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", movi) + chunk(b"idx1", index.tobytes()))


def parse_avi(data: bytes) -> tuple[float, np.ndarray, np.ndarray]:
    """Frames a second, and where each video frame starts and its size, by the index or,
    where there is none, by walking the chunks of the movie list. ValueError if it is no AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, movi, index, at = float(FPS), None, None, 12
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if tag == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            us = int.from_bytes(data[at + 20 : at + 24], "little")
            fps = 1e6 / us if us else fps
        elif tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif tag == b"idx1":
            index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no frames")
    if index is not None:
        video = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
        starts = video[:, 2].astype(np.int64)
        shift = movi[0] if len(video) and data[movi[0] + int(starts[0]) : movi[0] + int(starts[0]) + 4][2:] == b"dc" else 0
        return fps, starts + shift + 8, video[:, 3].astype(np.int64)
    found, at = [], movi[0] + 4
    while at + 8 <= min(movi[1], len(data)):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"LIST":  # a group of chunks
            at += 12
            continue
        if data[at + 2 : at + 4] == b"dc":
            found.append((at + 8, size))
        at += 8 + size + (size & 1)
    got = np.array(found, np.int64).reshape(-1, 2)
    return fps, got[:, 0], got[:, 1]


def huffman_tables(body: bytes) -> dict[int, dict[tuple[int, int], int]]:
    """The tables of a DHT segment: class and number to (length, code) to symbol."""
    huff = {}
    while body:
        lengths, code, k, table = body[1:17], 0, 17, {}
        for bits, count in enumerate(lengths, 1):
            for _ in range(count):
                table[bits, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        huff[body[0]] = table
        body = body[k:]
    return huff


STANDARD = huffman_tables(b"".join(bytes([k]) + bytes.fromhex(n) + bytes.fromhex(v) for k, (n, v) in STANDARD_TABLES.items()))


def decode_jpeg(data: bytes) -> np.ndarray:
    """The luma samples of a baseline JPEG, by the general way (any tables and sampling, the standard's Huffman
    tables where it brings none)."""
    quant, huff, at = {}, dict(STANDARD), 2
    comps, restart, size = [], 0, (0, 0)
    while True:
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            huff |= huffman_tables(body)
        elif marker in (0xC0, 0xC1):
            size = struct.unpack(">HH", body[1:5])
            comps = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(body[5])]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15) for i in range(body[0])}
            break
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("no baseline JPEG")
    if len(comps) == 1:
        comps[0][1:3] = [1, 1]
    h, v = max(c[1] for c in comps), max(c[2] for c in comps)
    wide, high = -(-size[1] // (8 * h)), -(-size[0] // (8 * v))
    # every block takes two bits at least, so a frame can't be larger than its data allow
    if not wide or not high or wide * high * sum(c[1] * c[2] for c in comps) > 4 * max(len(data) - at, 0):
        raise ValueError("fewer data than blocks")
    pos, buf, have = at, 0, 0

    def bit() -> int:
        nonlocal pos, buf, have
        if not have:
            buf, have, pos = data[pos], 8, pos + 1
            if buf == 0xFF and data[pos] == 0:
                pos += 1
        have -= 1
        return buf >> have & 1

    def symbol(table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | bit()
            if (n, code) in table:
                return table[n, code]
        raise ValueError("broken scan")

    def signed(n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | bit()
        return x if not n or x >> (n - 1) else x - (1 << n) + 1

    first, pred = comps[0], {c[0]: 0 for c in comps}
    blocks = np.zeros((high * first[2], wide * first[1], 64), np.int32)
    for mcu in range(wide * high):
        if restart and mcu and mcu % restart == 0:
            pos, have = data.index(b"\xff", pos) + 2, 0
            pred = dict.fromkeys(pred, 0)
        for c in comps:
            dc, ac = tables[c[0]]
            for y in range(c[2]):
                for x in range(c[1]):
                    block = np.zeros(64, np.int32)
                    pred[c[0]] += signed(symbol(huff[dc]))
                    block[0], k = pred[c[0]], 1
                    while k < 64:
                        s = symbol(huff[ac])
                        if s & 15 == 0 and s != 0xF0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[k] = signed(s & 15)
                        k += 1
                    if c is first:
                        blocks[mcu // wide * c[2] + y, mcu % wide * c[1] + x, ZIGZAG] = block * quant[c[3]]
    i = np.arange(8)
    basis = np.cos((2 * i[:, None] + 1) * i[None, :] * np.pi / 16) * np.where(i == 0, np.sqrt(0.125), 0.5)
    pixels = basis @ blocks.reshape(*blocks.shape[:2], 8, 8) @ basis.T
    out = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
    return out.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)[: size[0], : size[1]]


def decode_samples(data: bytes) -> tuple[float, np.ndarray]:
    """Frames a second and one row of samples (one of each 8 x 8 block) for each frame. ValueError if the file is broken."""
    try:
        return frames_of(data)
    except (LookupError, ArithmeticError, TypeError, struct.error) as error:
        raise ValueError("broken file") from error


def frames_of(data: bytes) -> tuple[float, np.ndarray]:
    fps, starts, sizes = parse_avi(data)
    n = len(starts)
    if sizes.sum() > len(data):
        raise ValueError("more frames than data")
    if not n:
        return fps, np.zeros((0, FRAME), np.uint8)
    spans = list(zip(starts.tolist(), (starts + sizes).tolist(), strict=True))
    own = all(data.startswith(HEADER, lo) for lo, _ in spans)
    if not own:
        frames = [decode_jpeg(data[lo:hi])[4::8, 4::8].ravel() for lo, hi in spans]
        if len({len(f) for f in frames}) > 1:
            raise ValueError("frames of different sizes")
        return fps, np.array(frames)
    scans = [data[lo + len(HEADER) : hi - 2].replace(b"\xff\x00", b"\xff") for lo, hi in spans]
    scan = np.frombuffer(b"".join(scans), np.uint8).reshape(n, -1, 5).astype(np.uint64)
    v = scan[..., 0] << np.uint64(32) | scan[..., 1] << np.uint64(24) | scan[..., 2] << np.uint64(16) | scan[..., 3] << np.uint64(8) | scan[..., 4]
    ten = np.stack([v >> np.uint64(30), v >> np.uint64(20) & np.uint64(1023), v >> np.uint64(10) & np.uint64(1023), v & np.uint64(1023)], axis=-1)
    d = DIFFS[ten.reshape(n, FRAME).astype(np.intp)]
    return fps, (np.cumsum(d, axis=1, dtype=np.int16) + 128).astype(np.uint8)


def middles(rows: np.ndarray) -> np.ndarray:
    """The median of each row, without its missing values; 0 for rows that have none."""
    ordered, n = np.sort(rows, axis=1), np.count_nonzero(~np.isnan(rows), axis=1)  # missing values last
    at = np.stack([np.maximum(n - 1, 0) // 2, np.minimum(n // 2, rows.shape[1] - 1)], axis=1)
    return np.nan_to_num(np.take_along_axis(ordered, at, axis=1).mean(axis=1))


def shot_starts(frames: np.ndarray) -> np.ndarray:
    """The first frame of each shot. The threshold adapts to the differences around each frame, by their median
    and its deviation, in which neither the tested difference nor a few other cuts count."""
    n = len(frames)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    flat = (frames >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    hist = np.bincount(flat.ravel(), minlength=BINS * n).reshape(n, BINS) / frames.shape[1]
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    around = np.lib.stride_tricks.sliding_window_view(np.pad(d, AROUND, constant_values=np.nan), 2 * AROUND + 1)
    around = np.delete(around, AROUND, axis=1)
    middle = middles(around)
    spread = SPREAD * middles(np.abs(around - middle[:, None]))
    return np.concatenate([[0], 1 + np.flatnonzero((d > middle + K * spread) & (d >= LEAST))])


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def to_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the AVI file (media) that stores the text's padded bytes."""

    def make():
        return lambda ids, texts: (ids, [encode_samples(padded(t)) for t in texts])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(src, ["doc_id", "text"], "doc_id bigint, media binary", make)


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per shot: id, clip_no, first_frame, n_frames, start_s, end_s, mean_level. A null or
    broken file gives one row with a null clip_no."""

    def make():
        def f(ids, files):
            rows = []
            for i, data in zip(ids, files, strict=True):
                try:
                    fps, frames = decode_samples(data or b"")
                except ValueError:
                    rows.append((i, None, None, None, None, None, None))
                    continue
                starts = shot_starts(frames)
                for k, (lo, hi) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(frames)], strict=True)):
                    rows.append((i, k, lo, hi - lo, lo / fps, hi / fps, float(frames[lo:hi].mean())))
            return tuple(zip(*rows, strict=True)) if rows else tuple([] for _ in range(7))

        return f

    src = media.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(media_col).alias("media"))
    schema = "doc_id bigint, clip_no bigint, first_frame bigint, n_frames bigint, start_s double, end_s double, mean_level double"
    return map_rows(src, ["doc_id", "media"], schema, make)


def digest(text: str) -> tuple:
    """Store a text, read the stored bytes back, and describe both."""
    media = encode_samples(padded(text))
    fps, frames = decode_samples(media)
    payload = frames.tobytes()
    starts = shot_starts(frames)
    feature = f"frames={len(frames)};shots={len(starts)};at={','.join(f'{s / fps:.2f}' for s in starts.tolist())}"
    return (
        len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
        len(media), hashlib.sha256(media).hexdigest(), feature,
    )


def op1_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to AVI and back for every document, with payload digests and the shots as feature."""

    def make():
        def f(ids, texts):
            rows = [(i, *digest(t)) for i, t in zip(ids, texts, strict=True)]
            return tuple(zip(*rows, strict=True)) if rows else tuple([] for _ in range(8))

        return f

    src = read(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_rows(src, ["doc_id", "text"], schema, make)

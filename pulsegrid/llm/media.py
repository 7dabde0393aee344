"""AVI files of motion JPEG: stored, read back by their index, cut into shots.

A sample of 8 bits is one 8x8 block of a baseline JPEG whose pixels all have that value. With a DC quantiser of 8 the
DC coefficient is the value minus 128, so nothing is lost. The Huffman code for a DC difference of `c` bits has 9 - c
bits and the end of a block has 1, so each block takes 10 bits and a frame is packed and unpacked as a whole.

Cases: null and empty texts store 64 zero bytes; a payload of more than one frame is filled with zeros to whole frames
and its length stands in the file's INFO list; equal texts give equal files; repeated rows stay; an empty table gives no
rows; columns other than the id and text are not read.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACROSS = 64  # samples in a row of a frame
MOST_ROWS = 64
FPS = 25
BINS = 16
BATCH_BYTES = 8 << 20
CLIP = "clip int, start_frame int, end_frame int, start_s double, end_s double"
SCHEMA = f"doc_id long, n_bytes long, payload binary, media binary, frames int, clips array<struct<{', '.join(':'.join(x.split()) for x in CLIP.split(', '))}>>"


def difference_codes() -> np.ndarray:
    """The 10 bits of a block for each DC difference from -255 to 255."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        bits = abs(d).bit_length()
        prefix = (1 << (9 - bits)) - 2  # canonical: 0, 10, 110, ...
        out[d + 255] = ((prefix << bits) | (d if d >= 0 else d + (1 << bits) - 1)) << 1
    return out


CODES = difference_codes()
DIFFERENCES = np.full(1024, 9999, np.int32)
DIFFERENCES[CODES.astype(int)] = np.arange(-255, 256)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Code lengths 1 to 9 hold one DC category each, 8 down to 0; the one AC code is the end of a block.
TABLES = segment(0xC4, b"\0" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)) + b"\x10" + bytes([1] + [0] * 15) + b"\0")


def encode_frame(samples: np.ndarray) -> bytes:
    """A grey JPEG of one block for each sample of a (rows, ACROSS) array."""
    rows, across = samples.shape
    level = samples.reshape(-1).astype(np.int32) - 128
    code = CODES[np.diff(level, prepend=0) + 255].reshape(-1, 4)
    word = (code[:, 0] << np.uint64(30)) | (code[:, 1] << np.uint64(20)) | (code[:, 2] << np.uint64(10)) | code[:, 3]
    scan = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\0")
    head = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([8] + [1] * 63)) + segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * across, 1) + b"\1\x11\0") + TABLES
    return head + segment(0xDA, b"\1\1\0\0\x3f\0") + scan + b"\xff\xd9"


def decode_frame(frame: bytes) -> np.ndarray:
    """The samples (block means) of a grey baseline JPEG, as a (rows, across) array of bytes."""
    at, quant, tables = 2, {}, {}
    while True:
        mark, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("grey frames only")
            table = body[8]
        elif mark == 0xC4:
            while body:
                count = body[1:17]
                tables[body[0]] = (tuple(count), body[17 : 17 + sum(count)])
                body = body[17 + sum(count) :]
        elif mark == 0xDA:
            own = body[2]
            break
        elif 0xC1 <= mark <= 0xCF:
            raise ValueError("baseline frames only")
    rows, across = -(-height // 8), -(-width // 8)
    scan = frame[at : frame.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff")
    dc, ac = tables[own >> 4], tables[0x10 | (own & 15)]
    fixed = TABLES[4:]
    if (bytes(dc[0]), dc[1], bytes(ac[0]), ac[1]) == (fixed[1:17], fixed[17:26], fixed[27:43], fixed[43:]) and rows * across % 4 == 0:
        wide = np.zeros((rows * across // 4, 8), np.uint8)
        wide[:, 3:] = np.frombuffer(scan, np.uint8, rows * across * 10 // 8).reshape(-1, 5)
        word = wide.reshape(-1).view(">u8").astype(np.uint64)
        diff = DIFFERENCES[np.stack([(word >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], 1).reshape(-1)]
    else:
        diff = np.fromiter(any_tables(scan, dc, ac, rows * across), np.int32, rows * across)
    return np.clip(np.rint(np.cumsum(diff) * (quant[table] / 8) + 128), 0, 255).astype(np.uint8).reshape(rows, across)


def any_tables(scan: bytes, dc, ac, blocks: int):
    """The DC differences of a scan with any Huffman tables, bit by bit; AC coefficients are passed over."""

    def lookup(table):
        codes, code, k = {}, 0, 0
        for length, n in enumerate(table[0], 1):
            for _ in range(n):
                codes[length, code] = table[1][k]
                code, k = code + 1, k + 1
            code <<= 1
        return codes

    bits, at = int.from_bytes(scan, "big"), 8 * len(scan)

    def take(n):
        nonlocal at
        at -= n
        return (bits >> at) & ((1 << n) - 1)

    def symbol(codes):
        length = code = 0
        while (length, code) not in codes or not length:
            code, length = code << 1 | take(1), length + 1
            if length > 16:
                raise ValueError("no such code")
        return codes[length, code]

    first, rest = lookup(dc), lookup(ac)
    for _ in range(blocks):
        n = symbol(first)
        value = take(n)
        yield value if not n or value >> (n - 1) else value - (1 << n) + 1
        k = 1
        while k < 64:
            run = symbol(rest)
            if run == 0:
                break
            take(run & 15)
            k += (run >> 4) + 1


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a motion-JPEG file with its index."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ACROSS)
    rows = -(-len(samples) // -(-len(samples) // MOST_ROWS))
    if short := -len(samples) % rows:
        samples = np.concatenate([samples, np.zeros((short, ACROSS), np.uint8)])
    frames = [encode_frame(samples[k : k + rows]) for k in range(0, len(samples), rows)]
    width, height, n = 8 * ACROSS, 8 * rows, len(frames)
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 3 * width * height, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(part := chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(part)
    body = b"AVI " + hdrl + info + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def parts(data: bytes, start: int, end: int):
    while start + 8 <= end:
        size = struct.unpack_from("<I", data, start + 4)[0]
        yield data[start : start + 4], start + 8, size
        start += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[list[np.ndarray], int | None, float]:
    """The frames by the file's index, the payload's length if the file says it, and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi = index = length = None
    fps = float(FPS)
    for name, at, size in parts(data, 12, len(data)):
        kind = data[at : at + 4] if name == b"LIST" else b""
        if kind == b"movi":
            movi = at
        elif kind == b"hdrl":
            fps = 1e6 / struct.unpack_from("<I", data, at + 12)[0]
        elif kind == b"INFO" and (found := re.search(rb"payload=(\d+)", data[at : at + size])):
            length = int(found[1])
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", size // 4, at).reshape(-1, 4)
    frames = [decode_frame(data[movi + int(o) + 8 : movi + int(o) + 8 + int(n)]) for name, _, o, n in index if int(name).to_bytes(4, "little")[2:] == b"dc"]
    return frames, length, fps


def shots(frames: list[np.ndarray], fps: float, factor: float = 3.0, least: float = 0.2, memory: int = 8) -> list[tuple]:
    """Clips between cuts: a histogram difference above `least` and above mean + factor * deviation of the last ones."""
    shade = np.stack([np.bincount(f.reshape(-1) >> 4, minlength=BINS) / f.size for f in frames])
    diff = np.abs(np.diff(shade, axis=0)).sum(1) / 2
    starts = [0]
    for k, d in enumerate(diff):
        last = diff[max(starts[-1], k - memory) : k]
        usual = last.mean() + factor * last.std() if len(last) else 0.0
        if d > max(least, usual):
            starts.append(k + 1)
    ends = [*starts[1:], len(frames)]
    return [{"clip": i, "start_frame": a, "end_frame": b, "start_s": a / fps, "end_s": b / fps} for i, (a, b) in enumerate(zip(starts, ends, strict=True))]


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text's file, the payload read back from it, and its clips; one pass, no shuffle."""
    clip = pa.struct([(n, {"int": pa.int32(), "double": pa.float64()}[t]) for n, t in (x.split() for x in CLIP.split(", "))])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("frames", pa.int32()), ("clips", pa.list_(clip))])

    def run(batches):
        out, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                media = write_avi(raw + b"\0" * (-len(raw) % 64 if raw else 64))
                frames, length, fps = read_avi(media)
                payload = np.concatenate(frames).tobytes()[:length]
                out.append((doc_id, len(raw), payload, media, len(frames), shots(frames, fps)))
                held += len(payload) + len(media)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def clips(media: DataFrame) -> DataFrame:
    """One timed row for each clip of `store_texts`."""
    return media.select("doc_id", F.inline("clips"))

"""AVI motion JPEG as a column: writing payloads losslessly, parsing the RIFF index, decoding frames, finding shots.

Storage. A payload is cut into frames of side x side blocks; each 8 x 8 block of a gray baseline JPEG holds 64 payload
bytes, one in each quantised coefficient, the format's own unit. Both Huffman tables have one code, a single 0 bit
for "no run, 8 more bits", so a coefficient takes 9 bits and a block exactly 72 bytes; a restart marker follows each
block, so that DC values stand for themselves. Byte b is the coefficient b for b >= 128, else b - 255. The true length
stands in the RIFF chunk "plen". Frames are intra frames, any of which can be decoded alone.

Reading goes through idx1 (or the movi list where idx1 is missing), undoes byte stuffing, and decodes the
coefficients by numpy; the inverse DCT gives the gray picture. Frames with other Huffman tables, sampling factors or
several components go through a plain baseline decoder (luma only is returned). Shots: the distance of two frames is
the share of pixels that moved between their gray histograms; a cut is where it exceeds the mean plus `k` standard
deviations of the last `window` distances since the last cut, and `floor` at least.

Cases: null texts count as empty (64 zero bytes); a null medium has null digests and no clips; bytes that aren't an AVI
give no frames and no clips; of a damaged one, the frames that can't be read are lost alone; repeated rows give repeated
rows; an empty table gives an empty table; other columns are ignored, whatever their names. Very long texts are stored
by frames and never held as pixels all at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 25

#: The order in which JPEG lists the coefficients of a block (row * 8 + column).
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_C = np.array([[(0.5 if u else 0.5 / 2**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)], dtype=np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(side: int) -> bytes:
    table = lambda kind: bytes([kind, 1]) + bytes(15) + b"\x08"  # noqa: E731  one code of one bit, for run 0 and size 8
    return (b"\xff\xd8" + _segment(0xDB, b"\0" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, side * 8, side * 8, 1, 1, 0x11, 0))
            + _segment(0xC4, table(0x00)) + _segment(0xC4, table(0x10)) + _segment(0xDD, b"\0\x01") + _segment(0xDA, b"\x01\x01\0\0\x3f\0"))


def _scans(blocks: np.ndarray, side: int) -> list[bytes]:
    """The entropy-coded data of frames of side * side blocks of 64 bytes."""
    bits = np.zeros((len(blocks), 64, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(len(blocks), 64, 8)
    packed = np.packbits(bits.reshape(len(blocks), 576), axis=1)
    rows = np.empty((len(blocks), 74), dtype=np.uint8)
    rows[:, :72] = packed
    per = side * side
    rows[:, 72], rows[:, 73] = 0xFF, 0xD0 + np.arange(len(blocks)) % per % 8
    if not (packed == 0xFF).any():
        whole = rows.tobytes()
        return [whole[at:at + per * 74 - 2] for at in range(0, len(whole), per * 74)]
    out = []
    for at in range(0, len(blocks), per):
        parts = [packed[i].tobytes().replace(b"\xff", b"\xff\0") for i in range(at, at + per)]
        out.append(b"".join(p + bytes([0xFF, 0xD0 + i % 8]) for i, p in enumerate(parts))[:-2])
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes, side: int = 4) -> bytes:
    """An AVI whose frames hold the payload, a multiple of 64 bytes, by side * side blocks each."""
    per = side * side
    blocks = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64)
    short = -len(blocks) % per
    if short:
        blocks = np.concatenate([blocks, np.zeros((short, 64), dtype=np.uint8)])
    head = _head(side)
    frames = [head + s + b"\xff\xd9" for s in _scans(blocks, side)]
    top = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // RATE, top * RATE, 0, 0x10, len(frames), 0, 1, top, side * 8, side * 8, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), top, 10_000, 0, 0, 0, side * 8, side * 8)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, side * 8, side * 8, 1, 8, b"MJPG", (side * 8) ** 2, 0, 0, 0, 0)
    streams = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + streams) + _chunk(b"plen", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def parse_avi(data: bytes) -> tuple[dict, list[tuple[int, int]]]:
    """What the headers say (rate, payload), and the place and length of each video frame; ({}, []) for other bytes."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return {}, []
    info: dict = {"rate": float(RATE)}
    movi, index = None, None
    at, stop = 12, len(data)
    while at + 8 <= stop:
        name, size = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if name == b"LIST" and data[body:body + 4] == b"hdrl":
            at = body + 4  # its chunks are read like those beside it
            continue
        if name == b"LIST" and data[body:body + 4] == b"movi":
            movi = (body, min(body + size, stop))
        elif name == b"avih" and size >= 4 and body + 4 <= stop:
            micro = struct.unpack_from("<I", data, body)[0]
            info["rate"] = 1e6 / micro if micro else float(RATE)
        elif name == b"plen" and body + 8 <= stop:
            info["payload"] = struct.unpack_from("<Q", data, body)[0]
        elif name == b"idx1":
            index = np.frombuffer(data[body:body + (min(size, stop - body) // 16) * 16], dtype=[("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
        at = body + size + size % 2
    if movi is None:
        return info, []
    if index is not None and len(index):
        video = index[np.isin(index["id"], [b"00dc", b"00db", b"01dc", b"01db"])]
        base = movi[0] if len(video) and video["at"][0] < movi[0] else 0  # offsets count from the list or from the file
        return info, [(base + int(a) + 8, int(s)) for a, s in zip(video["at"], video["size"]) if base + int(a) + 8 + int(s) <= stop]
    frames, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        name, size = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST":
            at += 12
            continue
        if name[2:] in (b"dc", b"db") and at + 8 + size <= stop:
            frames.append((at + 8, size))
        at += 8 + size + size % 2
    return info, frames


def _tables(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    at = 0
    while at + 17 <= len(body):
        kind, counts = body[at], body[at + 1:at + 17]
        at += 17
        codes, code = {}, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                codes[length, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        yield kind, codes


def parse_jpeg(data: bytes) -> dict | None:
    """The headers of a baseline JPEG and where its scan starts; None if it isn't one."""
    if data[:2] != b"\xff\xd8":
        return None
    out: dict = {"quant": {}, "huff": {}, "restart": 0}
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4:at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                out["quant"][body[i] & 15] = np.frombuffer(body, dtype=">u2" if wide else np.uint8, count=64, offset=i + 1).astype(np.float32)
                i += 1 + 64 * (1 + bool(wide))
        elif marker in (0xC0, 0xC1):
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xC4:
            out["huff"].update(_tables(body))
        elif marker == 0xDD:
            out["restart"] = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            out["scan"] = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            out["at"] = at
            return out if "parts" in out else None
        elif 0xC2 <= marker <= 0xCF:
            return None  # progressive, lossless or arithmetic
    return None


_ONE = {(1, 0): 8}


def coefficients(data: bytes, head: dict) -> np.ndarray:
    """Quantised coefficients of the first component's blocks, in the order of the scan: (blocks, 64) in zigzag order."""
    parts = head["parts"]
    if len(parts) == 1 and head["restart"] == 1 and all(t == _ONE for t in head["huff"].values()):
        n = -(-head["height"] // 8) * -(-head["width"] // 8)
        body = data[head["at"]:-2] + b"\xff\xd0"
        if len(body) != n * 74:  # some bytes are stuffed: cut at the restart markers
            cut = body.replace(b"\xff\0", b"\xff\0\0")
            for r in range(0xD0, 0xD8):
                cut = cut.replace(bytes([0xFF, r]), b"\xff\xd0")
            body = b"".join(x.replace(b"\xff\0\0", b"\xff") + b"\xff\xd0" for x in cut.split(b"\xff\xd0")[:-1])
        rows = np.frombuffer(body, dtype=np.uint8).reshape(n, 74)[:, :72]
        raw = np.packbits(np.unpackbits(rows, axis=1).reshape(n, 64, 9)[:, :, 1:], axis=2)[:, :, 0].astype(np.int16)
        return np.where(raw >= 128, raw, raw - 255)
    return _slow(data, head)


def _slow(data: bytes, head: dict) -> np.ndarray:
    """Any baseline scan, bit by bit; only the first component is kept."""
    parts, out = head["parts"], []
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    alone = len(parts) == 1
    if not wide or not high:
        raise ValueError("no samples")
    across = -(-head["width"] // (8 if alone else 8 * wide))
    down = -(-head["height"] // (8 if alone else 8 * high))
    if across * down > 8 * len(data):
        raise ValueError("more blocks than bits")
    raw, bits, have, at, last = data, 0, 0, head["at"], [0] * len(parts)

    def more() -> None:
        nonlocal bits, have, at
        b = raw[at] if at < len(raw) else 0
        if b == 0xFF and at + 1 < len(raw) and raw[at + 1] != 0:
            b = 0  # a marker: zeros follow
        else:
            at += 2 if b == 0xFF else 1
        bits, have = (bits << 8 | b) & 0xFFFFFFFF, have + 8

    def take(n: int) -> int:
        nonlocal have
        while have < n:
            more()
        have -= n
        return bits >> have & ((1 << n) - 1)

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad Huffman code")

    def value(n: int) -> int:
        v = take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    for mcu in range(across * down):
        if head["restart"] and mcu and mcu % head["restart"] == 0:
            have, last = 0, [0] * len(parts)
            while at + 1 < len(raw) and not (raw[at] == 0xFF and 0xD0 <= raw[at + 1] <= 0xD7):
                at += 1
            at += 2
        for c, (ident, h, v, _) in enumerate(parts):
            t = head["scan"][ident]
            dc, ac = head["huff"][t >> 4], head["huff"][16 + (t & 15)]
            for _ in range(1 if alone else h * v):
                block = [0] * 64
                last[c] += value(symbol(dc))
                block[0], k = last[c], 1
                while k < 64:
                    s = symbol(ac)
                    if s & 15 == 0:
                        if s != 0xF0:
                            break
                        k += 16
                        continue
                    k += s >> 4
                    if k > 63:
                        break
                    block[k] = value(s & 15)
                    k += 1
                if c == 0:
                    out.append(block)
    got = np.array(out, dtype=np.int16).reshape(-1, 64)
    h, v = (1, 1) if alone else parts[0][1:3]
    return got.reshape(down, across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)


def pixels(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Gray samples of blocks: (blocks, 8, 8)."""
    flat = np.empty((len(coefs), 64), dtype=np.float32)
    flat[:, ZIGZAG] = coefs * quant
    return np.clip(np.rint(_C @ flat.reshape(-1, 8, 8) @ _C.T + 128), 0, 255).astype(np.uint8)


def read_frames(data: bytes, histogram: bool = True) -> tuple[dict, list[tuple[dict, np.ndarray, np.ndarray]]]:
    """The headers, and for each readable frame its JPEG headers, coefficients and 32-bin gray histogram."""
    info, places = parse_avi(data)
    out = []
    kept: tuple[bytes, dict] | None = None
    for at, size in places:
        frame = data[at:at + size]
        try:
            if kept and frame.startswith(kept[0]):
                head = kept[1]
            elif (head := parse_jpeg(frame)) is None:
                continue
            else:
                head["shades"] = head["quant"][head["parts"][0][3]]
                kept = (frame[:head["at"]], head)
            out.append((head, coefficients(frame, head), None))
        except (ValueError, KeyError, IndexError, OverflowError, struct.error):
            continue  # damaged: an intra frame is lost alone
    if histogram and out:
        for i in range(0, len(out), 64):
            some = out[i:i + 64]
            shade = pixels(np.concatenate([c for _, c, _ in some]), some[0][0]["shades"]) if len({id(h) for h, _, _ in some}) == 1 else None
            at = 0
            for j, (head, c, _) in enumerate(some):
                p = shade[at:at + len(c)] if shade is not None else pixels(c, head["shades"])
                at += len(c)
                out[i + j] = (head, c, np.bincount(p.reshape(-1) >> 3, minlength=32) / max(1, p.size))
    return info, out


def read_payload(data: bytes) -> bytes:
    """The payload that write_avi stored, read back from the frames."""
    info, frames = read_frames(data, histogram=False)
    return payload_of(info, frames)


def payload_of(info: dict, frames: list) -> bytes:
    raw = np.concatenate([c for _, c, _ in frames]) if frames else np.zeros((0, 64), dtype=np.int16)
    return np.where(raw < 0, raw + 255, raw).astype(np.uint8).tobytes()[:info.get("payload", 0)]


def shots(histograms: list[np.ndarray], k: float = 2.0, window: int = 8, floor: float = 0.1) -> list[tuple[int, int, float]]:
    """(first frame, frame after the last, distance at its start) of each shot."""
    out, start, size, recent = [], 0, 0.0, []
    for i in range(1, len(histograms)):
        d = float(np.abs(histograms[i] - histograms[i - 1]).sum() / 2)
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(floor, mean + k * spread):
            out.append((start, i, size))
            start, size, recent = i, d, []
        else:
            recent = [*recent, d][-window:]
    if histograms:
        out.append((start, len(histograms), size))
    return out


def store(text: Column | str, side: int = 4) -> Column:
    """The AVI (binary) that holds a text's UTF-8 bytes, filled with bytes 0 up to a positive multiple of 64."""

    @F.pandas_udf("binary")
    def put(col: pd.Series) -> pd.Series:
        raw = [("" if t is None else t).encode("utf-8", "replace") for t in col]
        return pd.Series([write_avi(r.ljust(max(64, -(-len(r) // 64) * 64), b"\0"), side) for r in raw], dtype=object)

    return put(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


CLIP = "clip:int,first_frame:int,n_frames:int,start_s:double,end_s:double,cut:double"
CLIP_NAMES = [c.split(":")[0] for c in CLIP.split(",")]


def clip_rows(found: list[tuple[int, int, float]], rate: float) -> list[tuple]:
    """CLIP of each shot."""
    return [(n, a, z - a, a / rate, z / rate, d) for n, (a, z, d) in enumerate(found)]


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", k: float = 2.0, window: int = 8, floor: float = 0.1) -> DataFrame:
    """Timed clip rows: id_col and the fields of CLIP."""
    picked = media.select(F.col(id_col), F.col(media_col).alias("_media"))
    kind = picked.schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, data in zip(b.iloc[:, 0], b["_media"]):
                info, frames = read_frames(bytes(data)) if data is not None else ({}, [])
                found = shots([h for _, _, h in frames], k, window, floor)
                rows += [(key, *c) for c in clip_rows(found, info["rate"])] if found else []
            yield pd.DataFrame(rows, columns=[id_col, *CLIP_NAMES])

    return picked.mapInPandas(run, f"`{id_col}` {kind}, " + CLIP.replace(":", " "))


def digests(media: Column) -> Column:
    """What is read back from stored media, as a struct: payload length and hashes, media hash, frames, shots, clips."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]

    @F.pandas_udf(f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<{CLIP}>>")
    def get(col: pd.Series) -> pd.DataFrame:
        rows = []
        for data in col:
            if data is None:
                rows.append((None,) * len(names))
                continue
            info, frames = read_frames(bytes(data))
            back = payload_of(info, frames)
            found = shots([h for _, _, h in frames])
            feature = f"frames={len(frames)};shots={len(found)};cut={max((d for _, _, d in found), default=0):.4f};seconds={len(frames) / info.get('rate', RATE):.2f}"
            timed = [dict(zip(CLIP_NAMES, c)) for c in clip_rows(found, info["rate"])] if found else []
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, timed))
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return get(media)

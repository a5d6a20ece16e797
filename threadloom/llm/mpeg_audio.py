"""MPEG audio columns: frame resynchronisation, tags, variable-bitrate tables, checksums, exact durations, seek offsets.

``inspect`` reads any MPEG-1/2/2.5 layer I-III stream: it skips ID3v2, finds the first header that a second one
confirms, walks from frame to frame, resynchronises after damage, verifies CRC-16 of protected frames (layer III),
and reads Xing/Info and VBRI tables. ``store`` puts a payload into the ancillary bytes of silent layer III frames: an
ID3v2 tag with the payload's size, a Xing frame with frame count, byte count and seek table, then full frames, one
frame of the least bitrate that holds the rest, and a closing frame without payload: it is longer than an ID3v1 tag, so
no payload stands where a parser looks for one. ``load`` reads the payload back from the parsed frames.

Work is per row inside Arrow batches; nothing is shuffled.

Layers I and II are walked and timed, but their checksums are not verified: only layer III covers a fixed number of bytes.

Defined results: a null text is empty; a very long text is one file in the memory of one task; its payload is one block of blanks; equal texts give equal bytes; a stream
without frames has no duration and no offsets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import light_batches, slices, table

#: Fixed values of the format: kbit/s by (MPEG-1?, layer), Hz by version bits.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}  # bytes by (MPEG-1?, mono?)
BLOCK, PAD = 192, 32


@lru_cache(65536)
def header(word: int) -> tuple | None:
    """(frame bytes, samples, Hz, layer, protected, side bytes, same-stream key) of a 32-bit header, None if it is none."""
    version, layer, rate, hz = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or word & 3 == 2:
        return None
    one, mono = version == 3, word >> 6 & 3 == 3
    kbit, hertz, pad = BITRATES[one, layer][rate - 1], RATES[version][hz], word >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    size = (12000 * kbit // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbit // hertz + pad
    return size, samples, hertz, layer, not word >> 16 & 1, SIDE[one, mono] if layer == 3 else 0, (version, layer, hz)


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """Polynomial 0x8005 from 0xFFFF, as the format's frames use it."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text frames of ID3v2 (and the names in ID3v1), where the audio starts, and where it ends."""
    tags, at, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        version, flags = data[3], data[5]
        whole = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
        stop, k = min(len(data), 10 + whole(data[6:10])), 10
        if flags & 0x40 and version >= 3:
            k += whole(data[10:14]) if version == 4 else 4 + int.from_bytes(data[10:14], "big")
        while version >= 3 and k + 10 <= stop and data[k]:
            size = whole(data[k + 4 : k + 8]) if version == 4 else int.from_bytes(data[k + 4 : k + 8], "big")
            name, body = data[k : k + 4].decode("latin-1"), data[k + 10 : min(stop, k + 10 + size)]
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value.rstrip("\0")
            k += 10 + size
        at = stop + (10 if flags & 0x10 else 0)
    if len(data) - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        tags |= {k: v.rstrip(b"\0 ").decode("latin-1") for k, v in (("v1_title", data[-125:-95]), ("v1_artist", data[-95:-65])) if v.rstrip(b"\0 ")}
    return tags, at, end


def _table(data: bytes, at: int, size: int, side: int, protected: bool) -> dict | None:
    """A Xing/Info or VBRI table in the frame at ``at``."""
    k = at + 4 + 2 * protected + side
    if data[k : k + 4] not in (b"Xing", b"Info"):
        k = at + 4 + side  # some writers leave no room for the checksum
    if data[k : k + 4] in (b"Xing", b"Info"):
        flags, found, p = int.from_bytes(data[k + 4 : k + 8], "big"), {"kind": data[k : k + 4].decode()}, k + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            found["seek"] = list(data[p : p + 100])
        return found
    k = at + 36
    if data[k : k + 4] == b"VBRI" and size >= 62:
        total, frames, n, scale, width, step = struct.unpack(">IIHHHH", data[k + 10 : k + 26])
        steps = [int.from_bytes(data[k + 26 + i * width : k + 26 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "frames": frames, "bytes": total, "seek": steps, "frames_a_step": step}
    return None


def inspect(data: bytes) -> dict:
    """tags, table, frames [(offset, size, protected, side bytes)], samples, hertz, duration (exact seconds), crc_good, crc_bad, skipped bytes, seek [(sample, offset)]."""
    tags, at, end = _tags(data)
    out = {"tags": tags, "table": None, "frames": [], "samples": 0, "hertz": None, "duration": Fraction(0), "crc_good": 0, "crc_bad": 0, "skipped": 0}
    seek, stream, sure = [], None, False
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        ok = h is not None and at + h[0] <= end and stream in (None, h[6])
        if ok and not sure:  # after a start or damage a second header, or the end, has to confirm the first
            after = at + h[0]
            nxt = header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else None
            ok = after == end or nxt is not None and nxt[6] == h[6]
        if not ok:
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out["skipped"], at, sure = out["skipped"] + to - at, to, False
            continue
        size, samples, hertz, layer, protected, side, stream = h
        first, sure = not out["frames"] and out["table"] is None, True
        if protected and layer == 3:
            good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]) == int.from_bytes(data[at + 4 : at + 6], "big")
            out["crc_good" if good else "crc_bad"] += 1
        if first and layer == 3 and (found := _table(data, at, size, side, protected)):
            out["table"] = found
        else:
            seek.append((out["samples"], at))
            out["frames"].append((at, size, protected, side))
            out["samples"] += samples
        out["hertz"], at = hertz, at + size
    out["skipped"] += max(0, end - at)
    if out["hertz"]:
        out["duration"] = Fraction(out["samples"], out["hertz"])
    return out | {"seek": seek}


#: Frames that are written: MPEG-1 layer III, protected, 48 kHz, mono; whole bytes at each bitrate.
HZ, HEAD, CLOSING = 48000, 4 + 2 + 17, 4  # the closing frame's 56 kbit/s make 168 bytes
ROOM = [(3 * k - HEAD, i + 1) for i, k in enumerate(BITRATES[True, 3])]


@lru_cache(16)
def _head(rate: int) -> bytes:
    word = (0xFFFA << 16 | rate << 12 | 1 << 10 | 3 << 6).to_bytes(4, "big")
    return word + crc16(word[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


def store(payload: bytes) -> bytes:
    """The payload as a variable-bitrate layer III file."""
    size = str(len(payload)).encode()
    body = b"\x03payload_bytes\0" + size
    frame = b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame
    full, parts = ROOM[-1][0], []
    for k in range(0, len(payload), full):
        part = payload[k : k + full]
        room, rate = next(x for x in ROOM if x[0] >= len(part))
        parts.append(_head(rate) + part + bytes(room - len(part)))
    parts.append(_head(CLOSING) + bytes(3 * BITRATES[True, 3][CLOSING - 1] - HEAD))
    total, rate = sum(map(len, parts)), 5  # 64 kbit/s hold the table
    n = len(parts)
    seek = bytes(min(255, 256 * (i * n // 100) * len(parts[0]) // total) for i in range(100))
    table_ = b"Xing" + struct.pack(">III", 7, n, total + 3 * 64) + seek
    return tag + _head(rate) + table_ + bytes(3 * 64 - HEAD - len(table_)) + b"".join(parts)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def load(data: bytes, seen: dict | None = None) -> bytes:
    """The payload from the bytes of a file that ``store`` made."""
    seen = seen or inspect(data)
    whole = b"".join(data[at + 4 + 2 * protected + side : at + size] for at, size, protected, side in seen["frames"])
    return whole[: int(seen["tags"]["payload_bytes"])]


def feature(seen: dict) -> str:
    """Exact duration, frames, checksums, table and a checksum over the seek offsets."""
    places = zlib.crc32(b"".join(struct.pack("<QQ", *x) for x in seen["seek"]))
    t = seen["table"] or {}
    return f"frames={len(seen['frames'])};seconds={seen['duration']};crc={seen['crc_good']}/{seen['crc_good'] + seen['crc_bad']};table={t.get('kind', '')}:{t.get('frames', '')}:{t.get('bytes', '')};skipped={seen['skipped']};seek={places:08x}"


COLUMNS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("duration_s", pa.float64()), ("media", pa.binary()), ("seek_offsets", pa.list_(pa.int64()))]
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, media binary, seek_offsets array<long>"


def media_columns(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Each text as a media column with its features, all but n_bytes read back from the stored bytes."""
    keep = COLUMNS if with_media else COLUMNS[:-2]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = store(raw + bytes([PAD]) * (BLOCK - len(raw) if len(raw) < BLOCK else -len(raw) % BLOCK))
                seen = inspect(media)
                back = load(media, seen)
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(seen), float(seen["duration"]), media, [k for _, k in seen["seek"]])[: len(keep)])
            columns = list(zip(*rows, strict=True)) or [[]] * len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, keep, strict=True)], [n for n, _ in keep])

    return light_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(make, ", ".join(SCHEMA.split(", ")[: len(keep)]))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), with_media=False)

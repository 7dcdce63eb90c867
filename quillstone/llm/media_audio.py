"""MPEG audio media columns: encode bytes as frames, and index any MPEG audio stream.

``index_audio`` resynchronises frame headers (versions 1, 2 and 2.5, layers I to III), parses ID3v2, ID3v1 and APE tags and
Xing/Info and VBRI variable-bitrate tables, verifies frame checksums (of all three layers) and returns exact durations, as
sums of samples over their sampling rates, and the byte offset of every frame. Version, layer and rate may change within a stream, to
another that two frames in a row agree in.

``payload_frames`` stores bytes without loss: each 576 bytes travel as the ancillary data of one MPEG-2 layer III frame of
576 samples (16 kHz, mono, 144 kbit/s, 648 bytes) with no audio bits, behind a checksum. A player hears silence; the frames
are valid, so the reader must find them by header, length and checksum although payload bytes may imitate sync words.

Defined results: a null text or media value is empty; empty input gives one frame of padding on encoding and no frame on
indexing; every input row gives one output row, repeated rows and equal or null ids included; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.shared import map_arrow, table

UNIT, FRAME, DATA_AT = 576, 648, 15
_HEADER = b"\xff\xf2\xd8\xc4"
_TAG_HEADER = b"\xff\xf3\xd8\xc4"

# Fixed values of the MPEG audio header (kbit/s by version group and layer, Hz by version, samples by version group and layer).
_BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
_SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, (out << 1) ^ 0x8005, out << 1) & 0xFFFF
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The MPEG checksum (0x8005, from 0xFFFF) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ column]
    return crc


def header(word: bytes) -> dict | None:
    """The fields of a frame header, or None where the four bytes are none. Free-format frames are not taken."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate_at, bitrate_at = word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer == 4 or rate_at == 3 or bitrate_at in (0, 15) or word[3] & 3 == 2:
        return None
    group = 1 if version == 3 else 2
    kbps, rate, samples = _BITRATES[group, layer][bitrate_at], _RATES[version][rate_at], _SAMPLES[group, layer]
    pad = word[2] >> 1 & 1
    length = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    mono = word[3] >> 6 == 3
    side = {True: 17 if group == 1 else 9, False: 32 if group == 1 else 17}[mono] if layer == 3 else 0
    return {"version": version, "layer": layer, "kbps": kbps, "rate": rate, "samples": samples, "length": length, "mono": mono, "side": side, "protected": not word[1] & 1, "bound": 4 * ((word[3] >> 4 & 3) + 1) if word[3] >> 6 == 1 else 32}


def _covered(h: dict) -> int | None:
    """Bytes after the checksum that it covers, where their number follows from the header."""
    if h["layer"] == 3:
        return h["side"]
    if h["layer"] == 1:
        return 16 if h["mono"] else (32 + h["bound"]) // 2  # four bits a band and channel; above the bound channels share them
    return None


# Fixed values of layer II: bits of a band's allocation, from the lowest band on, by table; the lower sampling rates have their own.
_ALLOCATION = {
    "a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19,
}


@functools.cache
def _layer2_fields(version: int, rate: int, kbps: int, mono: bool, bound: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(bits, fields) of a layer II frame's allocation: for each field its distance from the end, its mask, and how many channels it is for."""
    per_channel = kbps if mono else kbps // 2
    name = "low" if version != 3 else ("d" if rate == 32000 else "c") if per_channel < 56 else "a" if rate == 48000 or per_channel <= 80 else "b"
    widths = []
    for band, bits in enumerate(_ALLOCATION[name]):
        widths += [(bits, 1)] if mono else [(bits, 1), (bits, 1)] if band < bound else [(bits, 2)]
    total, at, fields = sum(w for w, _ in widths), 0, []
    for bits, channels in widths:
        at += bits
        fields.append((total - at, (1 << bits) - 1, channels))
    return total, fields


@functools.cache
def _crc_byte(value: int) -> int:
    crc = value << 8
    for _ in range(8):
        crc = crc << 1 & 0xFFFF ^ (0x8005 if crc & 0x8000 else 0)
    return crc


def layer2_good(frame: bytes, h: dict) -> bool:
    """Whether the checksum of a layer II frame is that of its header, its allocation and its scale factor selection, two bits for each allocated band and channel."""
    total, fields = _layer2_fields(h["version"], h["rate"], h["kbps"], h["mono"], h["bound"])
    held = (total + 7) // 8
    allocation = int.from_bytes(frame[6 : 6 + held], "big") >> (8 * held - total)
    bits = total + 2 * sum(channels for shift, mask, channels in fields if allocation >> shift & mask)
    if len(frame) < 6 + (bits + 7) // 8:
        return False
    crc = 0xFFFF
    for byte in frame[2:4] + frame[6 : 6 + bits // 8]:
        crc = crc << 8 & 0xFFFF ^ _crc_byte(crc >> 8 ^ byte)
    for i in range(bits % 8):
        bit = frame[6 + bits // 8] >> (7 - i) & 1
        crc = crc << 1 & 0xFFFF ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc == int.from_bytes(frame[4:6], "big")


def id3v2(data: bytes, at: int = 0) -> tuple[int, dict]:
    """The length of a tag at a place (0: none) and its text frames: versions 2.2 to 2.4, with extended headers and unsynchronisation."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return 0, {}
    synchsafe = lambda b: sum((x & 0x7F) << 7 * i for i, x in enumerate(reversed(b)))
    major, flags, size = data[at + 3], data[at + 5], synchsafe(data[at + 6 : at + 10])
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    p, tags = 0, {}
    if flags & 0x40 and major >= 3 and len(body) >= 4:
        p = synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    name_bytes, head = (3, 6) if major == 2 else (4, 10)
    while p + head <= len(body) and body[p : p + name_bytes].strip(b"\0"):
        sized = body[p + name_bytes : p + 2 * name_bytes]
        n = synchsafe(sized) if major == 4 else int.from_bytes(sized, "big")
        name, value = body[p : p + name_bytes].decode("latin-1"), body[p + head : p + head + n]
        if major == 4 and body[p + 9] & 2:
            value = value.replace(b"\xff\x00", b"\xff")
        if major == 4 and body[p + 9] & 1:
            value = value[4:]  # the frame's own length stands ahead of it
        if name[0] == "T" and value:
            text = value[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), "replace").rstrip("\0")
            key, _, said = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = said
        p += head + n
    return 10 + size + (10 if flags & 0x10 else 0), tags


def vbr_table(frame: bytes, h: dict) -> dict | None:
    """A Xing, Info or VBRI table in a frame: frames, bytes and seek entries where given."""
    at = 4 + h["side"]
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, p, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode()}
        for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit and p + n <= len(frame):
                out[key] = list(frame[p : p + n]) if key == "toc" else int.from_bytes(frame[p : p + n], "big")
                p += n
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        word = lambda a, n: int.from_bytes(frame[a : a + n], "big")
        entries, scale, width = word(54, 2), word(56, 2), word(58, 2)
        toc = [word(62 + i * width, width) * scale for i in range(entries) if 62 + (i + 1) * width <= len(frame)] if 0 < width <= 4 else []
        return {"kind": "VBRI", "bytes": word(46, 4), "frames": word(50, 4), "quality": word(44, 2), "toc": toc}
    return None


def _equal_headers(rows: np.ndarray) -> int:
    """How many rows from the first on begin with its four bytes; looks at no more than twice as many."""
    done, step = 1, 1
    while done < len(rows):
        equal = (rows[done : done + step, :4] == rows[0, :4]).all(1)
        if not equal.all():
            return done + int(equal.argmin())
        done, step = done + len(equal), 2 * step
    return len(rows)


def index_stream(data: bytes) -> dict:
    """Frames, tags, tables, checksums and exact duration of a stream; junk between frames is skipped and counted."""
    tags, start, end = {}, 0, len(data)
    while (got := id3v2(data, start))[0]:
        start, tags = start + got[0], tags | got[1]
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        fields = data[end - 128 : end]
        tags |= {k: v for k, (a, b) in {"title": (3, 33), "artist": (33, 63), "album": (63, 93)}.items() if (v := fields[a:b].rstrip(b"\0 ").decode("latin-1"))}
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little")
        end = max(start, end - size - (32 if data[end - 9] & 0x80 else 0))
    view = np.frombuffer(data, np.uint8)
    offsets: list[np.ndarray] = []
    out = {"tags": tags, "vbr": None, "frames": 0, "samples": 0, "rate": 0, "checked": 0, "bad": 0, "skipped": 0, "kbps": set()}
    p, base, first, at_end = start, None, True, end
    seconds = Fraction(0)
    reach = 16  # frames taken together; doubled while all are good, so that damaged streams are not looked at again and again
    while p + 4 <= at_end:
        h = header(data[p : p + 4])
        same = h and (base is None or (h["version"], h["layer"], h["rate"]) == base)
        if h and not same or same and base is None:  # a first frame, or a first of another kind, must be followed by one like it
            n = header(data[p + h["length"] : p + h["length"] + 4])
            alone = base is None and p + h["length"] + 4 > at_end
            same = alone or bool(n) and (n["version"], n["layer"], n["rate"]) == (h["version"], h["layer"], h["rate"])
        if not same or p + h["length"] > at_end:
            nxt = data.find(b"\xff", p + 1, at_end)
            nxt = at_end if nxt < 0 else nxt
            out["skipped"], p = out["skipped"] + nxt - p, nxt
            continue
        length = h["length"]
        run = 1
        if (most := min(reach, (at_end - p) // length)) > 1:  # frames with this very header stand in a row of equal strides
            run = _equal_headers(view[p : p + most * length].reshape(most, length))
        if first and (vbr := vbr_table(data[p : p + length], h)):
            out["vbr"], run, first, base = vbr, 1, False, (h["version"], h["layer"], h["rate"])
            p += length
            continue
        first, base = False, (h["version"], h["layer"], h["rate"])
        rows = view[p : p + run * length].reshape(run, length)
        good = np.ones(run, bool)
        if h["protected"] and (n := _covered(h)) is not None and length >= 6 + n:
            good = crc16(np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + n]], axis=1)) == rows[:, 4].astype(np.uint32) * 256 + rows[:, 5]
            out["checked"] += run
        elif h["protected"] and h["layer"] == 2:
            good = np.array([layer2_good(rows[i].tobytes(), h) for i in range(run)])
            out["checked"] += run
        reach = 2 * reach if good.all() else 16
        if not good.all():  # a false sync or a damaged frame: take what stands before it, then look on from the next byte
            run = int(good.argmin())
            out["bad"] += 1
        if run:
            offsets.append(p + length * np.arange(run, dtype=np.int64))
            out["frames"], out["samples"], out["rate"] = out["frames"] + run, out["samples"] + run * h["samples"], h["rate"]
            out["kbps"].add(h["kbps"])
            seconds += Fraction(run * h["samples"], h["rate"])
            p += run * length
        if not good.all():
            nxt = data.find(b"\xff", p + 1, at_end)
            nxt = at_end if nxt < 0 else nxt
            out["skipped"], p = out["skipped"] + nxt - p, nxt
    out["skipped"] += at_end - p if p < at_end else 0
    out["offsets"] = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
    out["kbps"] = sorted(out["kbps"])
    out["seconds"] = float(seconds)
    return out


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def payload_frames(payload: bytes, n_bytes: int) -> bytes:
    """A stream of one frame for each 576 bytes, behind an ID3v2 tag with the unpadded length and an Info table."""
    n = len(payload) // UNIT
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(_HEADER, np.uint8)
    frames[:, DATA_AT : DATA_AT + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    crc = int(crc16(np.concatenate([frames[:1, 2:4], frames[:1, 6:DATA_AT]], axis=1))[0])
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    body = b"\0unpadded_bytes\0" + str(n_bytes).encode()
    frame = b"TXXX" + len(body).to_bytes(4, "big") + b"\0\0" + body
    size = len(frame)
    tag = b"ID3\x03\0\0" + bytes(size >> s & 0x7F for s in (21, 14, 7, 0)) + frame
    toc = bytes(min(255, i * 256 // 100) for i in range(100))
    info = _TAG_HEADER + bytes(9) + b"Info" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * FRAME).to_bytes(4, "big") + toc + (100).to_bytes(4, "big")
    return tag + info.ljust(FRAME, b"\0") + frames.tobytes()


def payload_of(media: bytes, index: dict) -> bytes:
    """The stored bytes, read from the ancillary data of the indexed frames."""
    view = np.frombuffer(media, np.uint8)
    return view[(index["offsets"][:, None] + np.arange(DATA_AT, DATA_AT + UNIT)).ravel()].tobytes() if len(index["offsets"]) else b""


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as an MPEG audio stream."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_bytes": [len(t) for t in texts], "media": [payload_frames(padded(t), len(t)) for t in texts]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary")


def index_audio(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """For each row: exact duration (samples over rate), frame seek offsets, tags, table and checksum counts."""
    kind = media.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        got = [index_stream(x or b"") for x in batch.column(1).to_pylist()]
        return {key: batch.column(0)} | {k: [g[k] for g in got] for k in ("frames", "samples", "rate", "checked", "bad", "skipped")} | {
            "seconds": [g["seconds"] for g in got], "seek_offsets": [g["offsets"] for g in got], "tags": [list(g["tags"].items()) for g in got],
            "vbr_kind": [g["vbr"] and g["vbr"]["kind"] for g in got], "vbr_frames": [g["vbr"] and g["vbr"].get("frames") for g in got],
        }

    return map_arrow(media.select(key, column), run, f"{key} {kind}, frames long, samples long, rate long, checked long, bad long, skipped long, seconds double, seek_offsets array<long>, tags map<string,string>, vbr_kind string, vbr_frames long")


def digest_audio(media: DataFrame) -> DataFrame:
    """Digests of the payload that the stored streams hold and of the streams, with the index as a short feature."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_bytes")}
        for media in batch.column(1).to_pylist():
            g = index_stream(media)
            payload = payload_of(media, g)
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
            row += (f"frames={g['frames']};samples={g['samples']};rate={g['rate']};crc_checked={g['checked']};crc_bad={g['bad']};skipped={g['skipped']};table={g['vbr']['kind'] if g['vbr'] else None}:{g['vbr']['frames'] if g['vbr'] else None};seek_crc32={zlib.crc32(g['offsets'].tobytes())}",)
            for k, v in zip(out, (*row, int(g["tags"].get("unpadded_bytes", "0"))), strict=True):
                out[k].append(v)
        return {"doc_id": batch.column(0)} | out

    return map_arrow(media.select("doc_id", "media"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as MPEG audio, read back and digested."""
    return digest_audio(encode_texts(table(spark, sf_dir, "documents")))

"""AVI motion-JPEG columns: bytes kept as transform coefficients of intra frames, RIFF indexes read back, frames decoded, shots found by adaptive histogram differences."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import text_or_empty

SIDE, FPS = 32, 25
BLOCKS = (SIDE // 8) ** 2
COEFS = 63
PER_FRAME = BLOCKS * COEFS


def _zigzag() -> np.ndarray:
    """Place in the 8x8 block of each coefficient in scan order: along the diagonals, in turn up and down."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
_k, _n = np.mgrid[:8, :8]
_basis = np.cos((2 * _n + 1) * _k * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)
#: From 64 coefficients in scan order to 64 pixels.
INVERSE = np.kron(_basis, _basis)[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, symbols_by_length: dict[int, bytes]) -> bytes:
    lengths = bytes(len(symbols_by_length.get(n, b"")) for n in range(1, 17))
    return bytes([kind]) + lengths + b"".join(symbols_by_length.get(n, b"") for n in range(1, 17))


#: A frame's head. All quantisers are 1. DC: code 0 for no difference. AC: code 0 for (no zeros, 8 bits), whose 8 bits tell exactly 256 values apart, so each coefficient keeps one byte; code 10 ends a block.
HEAD = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00") + _segment(0xC4, _huffman(0x00, {1: b"\x00"})) + _segment(0xC4, _huffman(0x10, {1: b"\x08", 2: b"\x00"})) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def encode_frame(data: np.ndarray) -> bytes:
    """JPEG that holds at most PER_FRAME bytes, 63 in a block; blocks after the last byte are empty."""
    full = len(data) // COEFS
    bits = np.zeros((full, COEFS, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(data[: full * COEFS]).reshape(full, COEFS, 8)
    scan = np.packbits(np.concatenate([np.zeros((full, 1), np.uint8), bits.reshape(full, 9 * COEFS)], axis=1), axis=1).reshape(-1)
    if full < BLOCKS:
        rest = data[full * COEFS :]
        last = np.zeros((len(rest), 9), np.uint8)
        last[:, 1:] = np.unpackbits(rest).reshape(-1, 8)
        tail = [np.zeros(1, np.uint8), last.reshape(-1), np.array([1, 0], np.uint8), np.tile(np.array([0, 1, 0], np.uint8), BLOCKS - full - 1)]
        tail = np.concatenate(tail)
        tail = np.concatenate([tail, np.ones(-len(tail) % 8, np.uint8)])
        scan = np.concatenate([scan, np.packbits(tail)])
    return HEAD + scan.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """An AVI 1.0 file with one video stream and an idx1 index."""
    data = np.frombuffer(payload, np.uint8)
    frames = [encode_frame(data[at : at + PER_FRAME]) for at in range(0, len(data), PER_FRAME)]
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I", 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0) + struct.pack("<4H", 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl) + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def read_index(media: bytes) -> tuple[list[bytes], float]:
    """The frames that idx1 points to, in its order, and the seconds of one. Offsets count from the movi tag, or from the file's start as some writers do."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, seconds = None, b"", 1 / FPS
    stack = [(12, 8 + struct.unpack_from("<I", media, 4)[0])]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                stack.append((at + 12, at + 8 + size))
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + size]
            elif name == b"avih":
                seconds = struct.unpack_from("<I", media, at + 8)[0] / 1e6
            at += 8 + size + size % 2
    if movi is None or not index:
        raise ValueError("no movi list or no index")
    frames = []
    for at in range(0, len(index), 16):
        name, _, offset, size = struct.unpack_from("<4sIII", index, at)
        if name[2:] in (b"dc", b"db"):
            base = movi if media[movi + offset : movi + offset + 4] == name else 0
            frames.append(media[base + offset + 8 : base + offset + 8 + size])
    return frames, seconds


def _codes(body: bytes) -> dict[tuple[int, int], int]:
    """{(length, code): symbol}"""
    out, code, at = {}, 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[n, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


BYTE_CODES = {(1, 0): 0x08, (2, 2): 0x00}


def _standard(counts: str, head: str, rest: range | None = None) -> dict[tuple[int, int], int]:
    """A table of the standard from how many codes each length has and its first symbols; the others, by runs of 0 to 15 zeros and sizes 1 to 10, follow in order."""
    first = bytes.fromhex(head)
    more = bytes(x for x in rest or () if 1 <= x & 15 <= 10 and x not in first)
    return _codes(bytes.fromhex(counts) + first + more)


#: The standard's tables, by class and number, which frames of motion JPEG use without holding them.
TABLES = {
    0x00: _standard("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: _standard("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: _standard("0002010303020403050504040000017d", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282", range(256)),
    0x11: _standard("00020102040403040705040400010277", "0001020311040521310612415107617113223281081442" + "91a1b1c109233352f0156272d10a162434e125f1", range(256)),
}
#: What a malformed file raises.
MALFORMED = (ValueError, IndexError, KeyError, struct.error)


class _Bits:
    """Bits of a scan's piece, from the front."""

    def __init__(self, piece: bytes, skip: int = 0):
        piece = piece.replace(b"\xff\x00", b"\xff")
        self.text, self.at = bin(int.from_bytes(b"\1" + piece[skip // 8 :]))[3 + skip % 8 :], 0

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        for n in range(1, 17):
            if (found := codes.get((n, int(self.text[self.at : self.at + n], 2)))) is not None:
                self.at += n
                return found
        raise ValueError("no such code")

    def value(self, n: int) -> int:
        v = int(self.text[self.at : self.at + n], 2) if n else 0
        self.at += n
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def block(self, row: np.ndarray, before: int, dc: dict, ac: dict) -> int:
        """Fills row with a block's coefficients, the first one told as a difference to `before`; how many stand after it."""
        row[0], k, count = before + self.value(self.symbol(dc)), 1, 0
        while k < 64:
            s = self.symbol(ac)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                row[k] = self.value(s & 15)
                count += 1
            k += 1
        return count


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(coefficients (blocks, 64) in scan order, quantisers in scan order, how many coefficients after DC its blocks have, as their sum) of the first component, the brightness, of a baseline JPEG.

    Frames may lack tables of codes (the standard's hold then), have up to four components of different sampling, and restart marks. Blocks of a frame with one component stand in rows
    of the picture; of one with more, in rows of its picture filled up to whole units. Other kinds of JPEG are an error.
    """
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, tables, parts, every = 2, {}, dict(TABLES), [], 0
    while True:
        if jpeg[at] != 0xFF:
            raise ValueError("no marker")
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15], body = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32), body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = _codes(body[1:n]), body[n:]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            used = {body[1 + 2 * k]: (tables[body[2 + 2 * k] >> 4], tables[16 + (body[2 + 2 * k] & 15)]) for k in range(body[0])}
            break
    if not parts or set(used) != {x[0] for x in parts}:
        raise ValueError("a scan of some components only")
    end = jpeg.rfind(b"\xff\xd9")
    scan = jpeg[at : end if end >= at else len(jpeg)]
    if len(parts) == 1:
        return (*_one_component(scan, height, width, *used[parts[0][0]], every, quant[parts[0][3]]),)
    most_h, most_v = max(x[1] for x in parts), max(x[2] for x in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    coefs, count, spare = np.zeros((down * parts[0][2], across * parts[0][1], 64), np.int16), 0, np.zeros(64, np.int16)
    for first, piece in _pieces(scan, every, across * down):
        bits, last = _Bits(piece), [0] * len(parts)
        for unit in range(first, min(across * down, first + (every or across * down))):
            for k, (name, h, v, _) in enumerate(parts):
                for y in range(v):
                    for x in range(h):
                        row = spare if k else coefs[unit // across * v + y, unit % across * h + x]
                        n = bits.block(row, last[k], *used[name])
                        last[k] = int(row[0])
                        count += 0 if k else n
    return coefs.reshape(-1, 64), quant[parts[0][3]], count


def _pieces(scan: bytes, every: int, units: int) -> list[tuple[int, bytes]]:
    """(its first unit, bytes) of what lies between restart marks."""
    found = re.split(rb"\xff[\xd0-\xd7]", scan) if every else [scan]
    return [(k * every, piece) for k, piece in enumerate(found) if k * every < units]


def _one_component(scan: bytes, height: int, width: int, dc: dict, ac: dict, every: int, quant: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    blocks = -(-height // 8) * -(-width // 8)
    coefs, count = np.zeros((blocks, 64), np.int16), 0
    for first, piece in _pieces(scan, every, blocks):
        end, done = min(blocks, first + (every or blocks)), first
        wide = 1 + 9 * COEFS
        if dc == {(1, 0): 0} and ac == BYTE_CODES:  # blocks of 63 coefficients of 8 bits have all codes at fixed places
            bits = np.unpackbits(np.frombuffer(piece.replace(b"\xff\x00", b"\xff"), np.uint8))
            rows = bits[: min(end - first, len(bits) // wide) * wide].reshape(-1, wide)
            whole = ~rows[:, :1].any(axis=1) & ~rows[:, 1::9].any(axis=1)
            n = len(whole) if whole.all() else int(whole.argmin())
            values = np.packbits(rows[:n, 1:].reshape(-1, 9)[:, 1:]).reshape(n, COEFS).astype(np.int16)
            coefs[first : first + n, 1:] = np.where(values < 128, values - 255, values)
            count, done = count + n * COEFS, first + n
        if done < end:
            read, last = _Bits(piece, (done - first) * wide if done > first else 0), 0
            for b in range(done, end):
                count += read.block(coefs[b], last, dc, ac)
                last = int(coefs[b, 0])
    return coefs, quant, count


def frame_bytes(coefs: np.ndarray, count: int) -> bytes:
    """The bytes that encode_frame was given."""
    v = coefs[:, 1:].reshape(-1)[:count]
    return np.where(v < 0, v + 255, v).astype(np.uint8).tobytes()


def histograms(blocks: np.ndarray, per_frame: list[int]) -> np.ndarray:
    """16-bin histogram, as shares, of each frame's decoded pixels."""
    pixels = np.clip(blocks.astype(np.float32) @ INVERSE + 128, 0, 255).astype(np.uint8) >> 4
    frame = np.repeat(np.arange(len(per_frame)), per_frame)
    counts = np.bincount((frame[:, None] * 16 + pixels).reshape(-1), minlength=16 * len(per_frame)).reshape(-1, 16)
    return counts / counts.sum(axis=1, keepdims=True)


def shots(shares: np.ndarray, memory: int = 8, factor: float = 3.0, floor: float = 0.08) -> list[tuple[int, int]]:
    """(first frame, past the last) of each shot. A cut lies where the histogram's difference exceeds the mean of the shot's last differences by factor deviations, and the floor."""
    jumps = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    cuts, seen = [0], []
    for i, d in enumerate(jumps.tolist(), 1):
        recent = seen[-memory:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(floor, mean + factor * spread) and len(recent) >= 2:
            cuts.append(i)
            seen = []
        else:
            seen.append(d)
    return list(zip(cuts, [*cuts[1:], len(shares)], strict=True))


MEDIA = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<clip:int,first_frame:int,end_frame:int,start_s:double,end_s:double>>, problem string"


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            raw = [t.encode("utf-8") for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "n_bytes": [len(r) for r in raw], "media": [encode_avi(r + b"\0" * (-len(r) % 64 if r else 64)) for r in raw]})


def _one_file(media: bytes) -> tuple:
    frames, seconds = read_index(media)
    decoded = [decode_frame(f) for f in frames]
    if not decoded:
        raise ValueError("no frames")
    payload = b"".join(frame_bytes(c, k) for c, _, k in decoded)
    shares = histograms(np.concatenate([c * q for c, q, _ in decoded]), [len(c) for c, _, _ in decoded])
    clips = [(i, a, b, round(a * seconds, 3), round(b * seconds, 3)) for i, (a, b) in enumerate(shots(shares))]
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), clips


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, n, media in zip(batch["doc_id"], batch["n_bytes"], batch["media"], strict=True):
            media, problem = media or b"", None
            try:
                size, digest, crc, clips = _one_file(media)
            except MALFORMED as e:
                size, digest, crc, clips, problem = None, None, None, None, f"{type(e).__name__}: {e}"
            rows.append((doc, n, size, digest, crc, len(media), hashlib.sha256(media).hexdigest(), clips, problem))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips", "problem"])
        yield out.astype({c: "Int64" for c in ("doc_id", "n_bytes", "payload_bytes", "tail_crc32")})


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text in UTF-8, filled with zeros to a positive multiple of 64, as an AVI file. A null text is empty; null and repeated ids and rows keep a row each."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(_store, MEDIA)


def read_media(media: DataFrame) -> DataFrame:
    """READ rows of media (doc_id, n_bytes, media): digests of the payload read back and of the file, and the clips found. A file that can't be read, null or empty ones included, has a problem and nulls instead; it stops nothing. An empty table gives an empty result."""
    return media.select("doc_id", "n_bytes", "media").mapInPandas(_read, READ)


def clip_rows(read: DataFrame) -> DataFrame:
    """One row for each clip: (doc_id, clip, first_frame, end_frame, start_s, end_s). Files with a problem have none."""
    return read.select("doc_id", F.inline("clips"))


def media_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), a row for each row of docs: each text stored and read back. feature: from and to of each clip in seconds. Null text is empty; null and repeated ids keep a row each; an empty table gives an empty result."""
    feature = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["start_s"].cast("string"), c["end_s"].cast("string"))), ",")
    return read_media(store_documents(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))

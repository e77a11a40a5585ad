"""Media columns: bytes stored losslessly as FLAC streams of 8-bit samples, with every frame's checksum checked on reading.

A byte b is the sample b - 128. Frames have 192 samples; each predicts by the fixed polynomial of order 0, 1 or 2 that leaves the
least, and codes what is left by Rice codes (or is stored verbatim where that is shorter). A seek table lists each frame's first sample and place, so
any block of samples is read alone. All frames of a batch are coded and decoded side by side, sample by sample,
as columns of arrays. The reader also takes constant subframes, linear predictors and partitioned Rice codes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lists, rows_of, texts

BLOCK = 192
RATE = 8000
#: Bytes of media that are decoded side by side.
CHUNK = 1 << 20
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _table(polynomial: int, width: int) -> np.ndarray:
    top, full = 1 << (width - 1), (1 << width) - 1
    out = []
    for x in range(256):
        x <<= width - 8
        for _ in range(8):
            x = ((x << 1) ^ (polynomial if x & top else 0)) & full
        out.append(x)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Checksums of data[start:start+length], side by side."""
    order = np.argsort(-length, kind="stable")
    at, left = start[order], -length[order]
    crc = np.zeros(len(start), np.uint16)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    for j in range(int(length.max(initial=0))):
        n = int(np.searchsorted(left, -j))  # those longer than j
        now = crc[:n]
        byte = padded[at[:n] + j]
        crc[:n] = _CRC8[now ^ byte] if width == 8 else (now << np.uint16(8)) ^ _CRC16[(now >> np.uint16(8)) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the stream's own extension of UTF-8."""
    if n < 128:
        return bytes([n])
    tail = []
    limit = 64
    while n >= limit:
        tail.append(0x80 | n & 63)
        n >>= 6
        limit = limit >> 1 if tail[1:] else 32
    size = len(tail) + 1
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *reversed(tail)])


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of the block size."""
    frames = np.array([len(p) // BLOCK for p in payloads])
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int32) - 128
    total = len(x)
    number = np.arange(total) - np.repeat(np.cumsum(frames) - frames, frames)
    residuals = [x]
    for _ in range(2):
        residuals.append(np.diff(residuals[-1], axis=1))
    coded, best_bits, best, rice = [], None, np.zeros(total, np.int64), np.zeros(total, np.int64)
    for order, r in enumerate(residuals):
        u = np.where(r < 0, -2 * r - 1, 2 * r).astype(np.int32)
        coded.append(u)
        k = np.clip(np.floor(np.log2(np.maximum(u.mean(axis=1) * 0.7, 1))), 0, 14).astype(np.int64)
        bits = (u >> k[:, None].astype(np.int32)).sum(axis=1) + (k + 1) * u.shape[1] + 8 * order + 10
        better = np.ones(total, bool) if best_bits is None else bits < best_bits
        best_bits = np.where(better, bits, best_bits) if best_bits is not None else bits
        best[better], rice[better] = order, k[better]
    verbatim = best_bits >= 8 * BLOCK
    heads = [b"\xff\xf8\x10\x02" + _number(n) for n in range(int(frames.max(initial=0)))]
    head_size = np.array([len(h) for h in heads], np.int64)[number] + 1
    size = head_size + 1 + np.where(verbatim, BLOCK, -(-best_bits // 8)) + 2
    start = np.cumsum(size) - size
    bits = np.zeros(8 * int(size.sum()), np.uint8)
    out = np.zeros(int(size.sum()), np.uint8)
    body = 8 * (start + head_size)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[at + b] = (value >> (width - 1 - b)) & 1

    put(body, np.where(verbatim, 1 << 1, (8 + best) << 1), 8)
    samples = (x & 255).astype(np.int64)
    if verbatim.any():
        put((body[verbatim][:, None] + 8 + 8 * np.arange(BLOCK)).ravel(), samples[verbatim].ravel(), 8)
    for order, u in enumerate(coded):
        lane = np.flatnonzero(~verbatim & (best == order))
        if not len(lane):
            continue
        at = body[lane] + 8
        for w in range(order):
            put(at + 8 * w, samples[lane, w], 8)
        at = at + 8 * order
        k = rice[lane]
        put(at, k, 10)  # method 0, one partition, its parameter
        part = u[lane].astype(np.int64)
        q = part >> k[:, None]
        place = at[:, None] + 10 + np.cumsum(q + 1 + k[:, None], axis=1) - 1 - k[:, None]  # where the stop bit stands
        bits[place.ravel()] = 1
        for b in range(int(k.max(initial=0))):
            has = np.flatnonzero(k > b)
            bits[(place[has] + 1 + b).ravel()] = ((part[has] >> (k[has] - 1 - b)[:, None]) & 1).ravel()
    out = np.packbits(bits)
    longest = int(head_size.max(initial=1)) - 1
    padded = np.zeros((len(heads), longest), np.uint8)
    for i, h in enumerate(heads):
        padded[i, : len(h)] = np.frombuffer(h, np.uint8)
    for j in range(longest):
        has = head_size - 1 > j
        out[start[has] + j] = padded[number[has], j]
    out[start + head_size - 1] = _crc(out, start, head_size - 1, 8).astype(np.uint8)
    crc = _crc(out, start, size - 2, 16)
    out[start + size - 2], out[start + size - 1] = (crc >> 8).astype(np.uint8), (crc & 255).astype(np.uint8)
    stream = out.tobytes()
    made, lane = [], 0
    for payload, n in zip(payloads, frames.tolist()):
        lo, hi = start[lane], start[lane + n - 1] + size[lane + n - 1]
        sizes = size[lane : lane + n]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(bytes(np.frombuffer(payload, np.uint8) ^ 0x80)).digest()
        seek = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        seek["sample"], seek["offset"], seek["count"] = np.arange(n) * BLOCK, start[lane : lane + n] - lo, BLOCK
        made.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + (18 * n).to_bytes(3, "big") + seek.tobytes() + stream[lo:hi])
        lane += n
    return made


class BadMedia(ValueError):
    """A stream that is damaged or not of the kind that is read here."""


def _index(media: bytes) -> tuple[int, int, bytes, np.ndarray]:
    """(samples, where the frames begin, checksum of the samples, seek table)."""
    if media[:4] != b"fLaC":
        raise BadMedia("no FLAC stream")
    at, last, samples, md5, seek = 4, False, 0, b"", None
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 36 & 31 != 7 or packed >> 41 & 7:
                raise BadMedia("not one channel of 8 bits")
            samples, md5 = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            seek = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        at += 4 + size
    if seek is None:
        raise BadMedia("no seek table")
    return samples, at, md5, seek


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Samples of frames of ``BLOCK`` samples at data[start:end], a row each; checks both checksums of each."""
    if not len(start):
        return np.zeros((0, BLOCK), np.int32)
    if not ((data[start] == 0xFF) & (data[start + 1] == 0xF8) & (data[start + 2] >> 4 == 1) & (data[start + 3] == 2)).all():
        raise BadMedia("no frame where the seek table has one")
    first = data[start + 4]
    more = np.select([first < 0x80, first < 0xE0, first < 0xF0, first < 0xF8, first < 0xFC, first < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    head = 5 + more
    if (_crc(data, start, head, 8) != data[start + head]).any():
        raise BadMedia("header checksum")
    if (_crc(data, start, end - start - 2, 16) != (data[end - 2].astype(np.uint16) << 8 | data[end - 1])).any():
        raise BadMedia("frame checksum")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    set_bits = np.unpackbits(padded)
    at = np.where(set_bits == 1, np.arange(len(set_bits), dtype=np.int32), np.iinfo(np.int32).max)
    following = np.minimum.accumulate(at[::-1])[::-1]

    def take(p: np.ndarray, width) -> np.ndarray:
        """``width`` <= 17 bits at bit p."""
        b = p >> 3
        word = padded[b].astype(np.int64) << 16 | padded[b + 1].astype(np.int64) << 8 | padded[b + 2]
        return (word >> (24 - (p & 7) - width)) & ((1 << width) - 1)

    p = 8 * (start + head + 1).astype(np.int64)
    kind = take(p, 8) >> 1
    p = p + 8
    x = np.zeros((len(start), BLOCK), np.int32)
    signed = lambda v, w: v - ((v >> (w - 1)) << w)
    lane = np.flatnonzero(kind == 0)
    x[lane] = signed(take(p[lane], 8), 8)[:, None]
    lane = np.flatnonzero(kind == 1)
    x[lane] = signed(take(p[lane][:, None] + 8 * np.arange(BLOCK), 8), 8)
    predicted = (kind >= 8) & (kind <= 12) | (kind >= 32)
    if not (predicted | (kind <= 1)).all():
        raise BadMedia("unknown subframe")
    for form in np.unique(kind[predicted]):
        lane = np.flatnonzero(kind == form)
        order = int(form) - 8 if form < 32 else int(form) - 31
        at = p[lane]
        for j in range(order):
            x[lane, j] = signed(take(at, 8), 8)
            at = at + 8
        shift = np.zeros(len(lane), np.int64)
        if form < 32:
            weights = np.tile(np.array(_FIXED[order], np.int64), (len(lane), 1))
        else:
            width, shift = take(at, 4) + 1, signed(take(at + 4, 5), 5)
            at = at + 9
            weights = np.zeros((len(lane), order), np.int64)
            for j in range(order):
                weights[:, j] = signed(take(at, width), width)
                at = at + width
        escape = np.where(take(at, 2) == 0, 4, 5)
        parts = take(at + 2, 4)
        at = at + 6
        span = BLOCK >> parts
        k = np.zeros(len(lane), np.int64)
        r = np.zeros((len(lane), BLOCK), np.int64)
        for j in range(order, BLOCK):
            fresh = np.flatnonzero((j == order) | (j % span == 0)) if j == order or (j % span == 0).any() else ()
            if len(fresh):
                k[fresh] = take(at[fresh], escape[fresh])
                at[fresh] += escape[fresh]
                if (k[fresh] == (1 << escape[fresh]) - 1).any():
                    raise BadMedia("escaped partition")
            stop = following[at].astype(np.int64)
            r[:, j] = ((stop - at) << k) | take(stop + 1, k)
            at = stop + 1 + k
        r = (r >> 1) ^ -(r & 1)
        y = x[lane].astype(np.int64)
        if form == 8:
            y[:] = r
        elif form == 9:
            y[:, 1:] = y[:, :1] + np.cumsum(r[:, 1:], axis=1)
        else:
            for j in range(order, BLOCK):
                y[:, j] = r[:, j] + ((weights * y[:, j - order : j][:, ::-1]).sum(axis=1) >> shift)
        x[lane] = y
    return x


def decode_all(media: list[bytes]) -> list[np.ndarray]:
    """Samples of the streams, with all checksums checked."""
    data = np.frombuffer(b"".join(media), np.uint8)
    bases = np.cumsum([0, *map(len, media)])
    index = [_index(m) for m in media]
    starts = [b + at + seek["offset"].astype(np.int64) for b, (_, at, _, seek) in zip(bases, index)]
    ends = [np.append(s[1:], b) for s, b in zip(starts, bases[1:])]
    x = decode_frames(data, np.concatenate(starts), np.concatenate(ends))
    out, lane = [], 0
    for (samples, _, md5, _), s in zip(index, starts):
        own = x[lane : lane + len(s)].reshape(-1)
        lane += len(s)
        if len(own) != samples or hashlib.md5(own.astype(np.int8).tobytes()).digest() != md5:
            raise BadMedia("checksum of the samples")
        out.append(own)
    return out


def read_samples(media: bytes, first: int, count: int) -> np.ndarray:
    """``count`` samples from ``first``, decoding only the frames that hold them."""
    samples, at, _, seek = _index(media)
    if first < 0 or count < 0 or first + count > samples:
        raise BadMedia("beyond the stream")
    data = np.frombuffer(media, np.uint8)
    starts = at + seek["offset"].astype(np.int64)
    ends = np.append(starts[1:], len(media))
    lo = int(np.searchsorted(seek["sample"], first, side="right")) - 1
    hi = int(np.searchsorted(seek["sample"], first + count))
    block = decode_frames(data, starts[lo:hi], ends[lo:hi]).reshape(-1)
    return block[first - int(seek["sample"][lo]) :][:count]


def _pad(text: bytes) -> bytes:
    return text + b" " * (BLOCK - len(text) % BLOCK if len(text) % BLOCK or not text else 0)


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, chunk in rows_of(batches, CHUNK):
        media = encode_all([_pad(t) for t in chunk])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in chunk], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, media (a FLAC stream of the text's UTF-8 bytes, with spaces up to whole blocks).

    Null and empty texts give a block of spaces. Equal texts give equal streams. Ids and rows may repeat, other columns are ignored.
    """
    return texts(docs, text, doc_id).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, tail_crc32 long, offsets array<long>, features struct<sum: long, energy: long, crossings: long, peak: long>"


def _load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lo = 0
        sizes = [len(x.as_buffer()) for x in batch.column("media")]
        while lo < batch.num_rows:
            hi, total = lo, 0
            while hi < batch.num_rows and (hi == lo or total + sizes[hi] <= CHUNK):
                total += sizes[hi]
                hi += 1
            part = batch.slice(lo, hi - lo)
            media = part.column("media").to_pylist()
            samples = decode_all(media)
            payloads = [(x + 128).astype(np.uint8).tobytes() for x in samples]
            features = [
                {"sum": int(x.sum()), "energy": int(np.dot(y := x.astype(np.int64), y)), "crossings": int(np.count_nonzero((x[1:] < -32) != (x[:-1] < -32))), "peak": int(np.abs(x).max())}
                for x in samples
            ]
            counts = [len(x) // BLOCK for x in samples]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("n_bytes"),
                    pa.array(payloads, pa.binary()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                    lists(np.cumsum([0, *counts]), np.concatenate([np.arange(c) * BLOCK for c in counts])),
                    pa.array(features, pa.struct([(n, pa.int64()) for n in ("sum", "energy", "crossings", "peak")])),
                ],
                names=["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", "tail_crc32", "offsets", "features"],
            )
            lo = hi


def load(media: DataFrame) -> DataFrame:
    """Reads a table made by ``store`` back: the payload, sample offsets of its blocks, digests, and features of the samples.

    A stream with any wrong checksum fails the job rather than giving wrong bytes.
    """
    return media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media").mapInArrow(_load, _READ)

"""Lossless FLAC columns for byte payloads (8-bit mono), and PCM blocks with seekable sample offsets.

Streams follow the public FLAC format (RFC 9639): STREAMINFO with the MD5 of the samples, a seek point every 32 frames, frames of
576 samples with CRC-8 and CRC-16. A frame is constant, verbatim, or a fixed (order 0 to 4) or quantised (order 1 to 8) linear
predictor with a Rice-coded residual, whichever is shortest. Coding and decoding run over all frames of a batch at once: a step of
the loop handles one sample of every frame. `decode_any` is the plain reader for streams of other encoders: other block sizes, Rice
partitions, escape codes and wasted bits.

Decoded streams are written as rows of PCM (`pcm_blocks`), each with its first sample, so that any range of samples is read from the
blocks it touches alone (`pcm_range`).

A payload is the text's UTF-8 bytes, padded with 255 up to a positive multiple of 576; byte b is the
sample b - 110, wrapped to 8 bits, so that letters lie near zero. Null is empty. A wrong checksum, length or MD5 raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, id_text

BLOCK = 576
CENTRE = 110
SEEK = 32
RATE = 8000


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table, top, mask = np.arange(256, dtype=np.uint32) << (bits - 8), 1 << (bits - 1), (1 << bits) - 1
    for _ in range(8):
        table = np.where(table & top, table << 1 ^ poly, table << 1) & mask
    return table


POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


#: Fixed predictors as weights of the last samples, by order.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: Bytes of a frame number by its first byte.
LEADS = np.array([max(1, 8 - (~b & 0xFF).bit_length()) for b in range(256)])


def crc_rows(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of data[start:start+length] for every row at once."""
    crc = np.zeros(len(start), np.uint32)
    order = np.argsort(-length, kind="stable")
    start, ends = start[order], length[order]
    live, out = len(order), np.zeros(len(order), np.uint32)
    falling = -ends
    for i in range(int(ends[0]) if len(ends) else 0):
        live = int(np.searchsorted(falling, -i, "left"))  # rows longer than i
        c = crc[:live]
        crc[:live] = (c << 8 & (1 << bits) - 1) ^ table[(c >> (bits - 8)) ^ data[start[:live] + i]]
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """Frame number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    tail: list[int] = []
    while n > 0x3F >> len(tail):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *reversed(tail)])


def _fields(bits: np.ndarray, at: np.ndarray, value: np.ndarray | int, width: int) -> None:
    """Write value into `width` bits at every position of at."""
    value = np.broadcast_to(value, at.shape)
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


#: Highest order and bits of a weight of quantised linear predictors; what a weight and its warm-up sample cost, as a factor of the error.
ORDERS, PRECISION = 8, 8
DEAR = 2.0 ** (2 * (PRECISION + 8) * np.arange(ORDERS + 1) / BLOCK)


def linear_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, weights, shift) for each row of samples: Levinson's recursion over exact autocorrelations, weights rounded to PRECISION bits.
    Each step works on a row alone, so equal rows get equal predictors in any batch; order 0 where there is none."""
    n, y = len(x), x.astype(np.int64)
    lags = np.stack([(y[:, j:] * y[:, : BLOCK - j]).sum(1) for j in range(ORDERS + 1)], axis=1).astype(np.float64)
    weights, error = np.zeros((n, ORDERS)), lags[:, 0].copy()
    best, order, chosen = error * DEAR[0], np.zeros(n, np.int64), np.zeros((n, ORDERS))
    for m in range(1, ORDERS + 1):
        gap = lags[:, m].copy()
        for j in range(m - 1):
            gap -= weights[:, j] * lags[:, m - 1 - j]
        k = np.divide(gap, error, out=np.zeros(n), where=error > 0)
        turned = weights[:, : m - 1][:, ::-1].copy()
        weights[:, : m - 1] -= k[:, None] * turned
        weights[:, m - 1] = k
        error = error * (1 - k * k)
        better = (error > 0) & (error * DEAR[m] < best)
        best[better], order[better], chosen[better] = (error * DEAR[m])[better], m, weights[better]
    _, exponent = np.frexp(np.abs(chosen).max(1))
    shift = np.minimum(15, PRECISION - 1 - exponent).astype(np.int64)
    order[shift < 0] = 0
    top = 1 << (PRECISION - 1)
    whole = np.clip(np.rint(np.ldexp(chosen, np.maximum(shift, 0)[:, None])), -top, top - 1).astype(np.int32)
    return order, whole, shift


def _rice(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded residual, cheapest parameter, its bits) for each row."""
    u = (r << 1) ^ (r >> 31)
    costs = np.stack([(u >> k).sum(1) + (k + 1) * u.shape[1] for k in range(9)])
    return u, np.argmin(costs, axis=0), costs.min(0)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """One FLAC frame for each row of samples (n x 576, -128..127)."""
    n = len(samples)
    x = samples.astype(np.int32)
    residuals = [x]
    for _ in range(4):
        residuals.append(np.diff(residuals[-1], axis=1))
    order = np.argmin([np.abs(r).sum(1) + o * 8 for o, r in enumerate(residuals)], axis=0)
    rice, size, kind = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    coded = []
    for o in range(5):
        rows = np.flatnonzero(order == o)
        if len(rows):
            u, rice[rows], cost = _rice(residuals[o][rows])
            size[rows], kind[rows] = 8 + o * 8 + 10 + cost, 8 + o
            coded.append((8 + o, o, 8 + 8 * o, rows, u))
    order, weights, shift = linear_predictors(x)
    for o in range(1, ORDERS + 1):
        rows = np.flatnonzero(order == o)
        if not len(rows):
            continue
        own = x[rows]
        guess = sum(weights[rows, j, None] * own[:, o - 1 - j : BLOCK - 1 - j] for j in range(o)) >> shift[rows, None]
        u, k, cost = _rice((own[:, o:] - guess).astype(np.int32))
        lead = 8 + (8 + PRECISION) * o + 9
        some = lead + 10 + cost < size[rows]
        rows = rows[some]
        rice[rows], size[rows], kind[rows] = k[some], (lead + 10 + cost)[some], 31 + o
        coded.append((31 + o, o, lead, rows, u[some]))
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (size >= 8 + 8 * BLOCK)
    size[constant], size[verbatim] = 16, 8 + 8 * BLOCK
    kind[constant], kind[verbatim] = 0, 1
    heads = [b"\xff\xf8\x20\x02" + _number(int(i)) for i in numbers]
    head = np.array([len(h) + 1 for h in heads], np.int64)
    length = head + (size + 7) // 8
    begin = np.cumsum(length + 2) - length - 2
    bits = np.zeros(int((length + 2).sum()) * 8, np.uint8)
    at = (begin + head) * 8
    _fields(bits, at, kind << 1, 8)
    _fields(bits, at[constant] + 8, x[constant, 0] & 0xFF, 8)
    if verbatim.any():
        places = at[verbatim][:, None] + 8 + 8 * np.arange(BLOCK)
        _fields(bits, places, x[verbatim] & 0xFF, 8)
    for name, o, lead, rows, u in coded:
        use = kind[rows] == name
        rows, u = rows[use], u[use]
        if not len(rows):
            continue
        k = rice[rows]
        for j in range(o):
            _fields(bits, at[rows] + 8 + 8 * j, x[rows, j] & 0xFF, 8)
        if name > 31:
            _fields(bits, at[rows] + 8 + 8 * o, PRECISION - 1, 4)
            _fields(bits, at[rows] + 12 + 8 * o, shift[rows], 5)
            for j in range(o):
                _fields(bits, at[rows] + 17 + 8 * o + PRECISION * j, weights[rows, j] & (1 << PRECISION) - 1, PRECISION)
        _fields(bits, at[rows] + lead + 6, k, 4)
        q = u >> k[:, None]
        stop = np.cumsum(q + 1 + k[:, None], axis=1) - k[:, None] - 1 + (at[rows] + lead + 10)[:, None]
        bits[stop] = 1
        for kk in range(1, 9):
            some = k == kk
            if some.any():
                s, v = stop[some], u[some]
                for j in range(kk):
                    bits[s + 1 + j] = v >> (kk - 1 - j) & 1
    data = np.packbits(bits)
    for i, h in enumerate(heads):
        data[begin[i] : begin[i] + len(h)] = np.frombuffer(h, np.uint8)
    data[begin + head - 1] = crc_rows(data, begin, head - 1, CRC8, 8)
    crc = crc_rows(data, begin, length, CRC16, 16)
    data[begin + length], data[begin + length + 1] = crc >> 8, crc & 0xFF
    whole = data.tobytes()
    return [whole[a : a + m] for a, m in zip(begin.tolist(), (length + 2).tolist())]


def pad(payload: bytes) -> bytes:
    n = max(BLOCK, -(-len(payload) // BLOCK) * BLOCK)
    return payload + b"\xff" * (n - len(payload))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each padded payload."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    samples = (np.frombuffer(b"".join(payloads), np.uint8) - np.uint8(CENTRE)).view(np.int8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts])
    frames = [f for a in range(0, len(samples), 1024) for f in encode_frames(samples[a : a + 1024], numbers[a : a + 1024])]
    out, at = [], 0
    for c in counts.tolist():
        own, pcm = frames[at : at + c], samples[at : at + c]
        sizes = [len(f) for f in own]
        packed = RATE << 44 | 7 << 36 | c * BLOCK
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(pcm.tobytes()).digest()
        points = np.zeros(-(-c // SEEK), POINT)
        points["sample"], points["offset"], points["n"] = np.arange(c)[::SEEK] * BLOCK, np.cumsum([0, *sizes])[:-1:SEEK], BLOCK
        seek = points.tobytes()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
        at += c
    return out


def _layout(stream: bytes) -> tuple[dict, int]:
    """(stream facts and seek points, where frames begin)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, facts = 4, False, {"points": None}
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            facts |= {"block": struct.unpack(">HH", body[:4]), "bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "total": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            facts["points"] = np.frombuffer(body, POINT)
        at += 4 + n
    return facts, at


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Samples (n x 576) of frames data[start:end] as encode_frames writes them; both checksums are verified."""
    n = len(start)
    lead = data[start + 4]
    head = 5 + LEADS[lead]
    if (data[start] != 0xFF).any() or (data[start + 1] != 0xF8).any() or (crc_rows(data, start, head, CRC8, 8) != 0).any():
        raise ValueError("bad frame header")
    if (crc_rows(data, start, end - start, CRC16, 16) != 0).any():
        raise ValueError("bad frame checksum")
    kind = data[start + head] >> 1
    out = np.zeros((n, BLOCK), np.int32)
    rows = np.flatnonzero(kind == 0)
    out[rows] = data[start[rows] + head[rows] + 1].view(np.int8)[:, None]
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        out[rows] = data[(start[rows] + head[rows] + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
    rows = np.flatnonzero(kind > 1)
    if not len(rows):
        return out
    kind = kind[rows].astype(np.int64)
    order = np.where(kind < 32, kind - 8, kind - 31)
    if (order < 0).any() or ((kind < 32) & (order > 4)).any():
        raise ValueError("unknown kind of frame")
    n, most = len(rows), int(order.max())
    body = start[rows] + head[rows] + 1
    width = int((end[rows] - body).max())
    grid = np.zeros((n, width + 3), np.uint8)
    inside = np.arange(width) < (end[rows] - body)[:, None]
    grid[:, :width][inside] = data[np.minimum(body[:, None] + np.arange(width), len(data) - 1)][inside]
    bits = np.unpackbits(grid, axis=1)
    total = bits.shape[1]
    ahead = np.where(bits, np.arange(total, dtype=np.int32), np.int32(total - 1))
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1].ravel()  # position of the next 1
    warm = grid[:, :most].view(np.int8).astype(np.int32)
    grid = grid.astype(np.uint32)
    window = (grid[:, :-2] << 16 | grid[:, 1:-1] << 8 | grid[:, 2:]).ravel()
    base, base_w = np.arange(n) * total, np.arange(n) * (width + 1)

    def take(at: np.ndarray, size: int) -> np.ndarray:
        return (window[base_w + (at >> 3)] >> (24 - size - (at & 7)).astype(np.uint32)).astype(np.int32) & (1 << size) - 1

    pos = 8 * order.astype(np.int32)
    linear = kind >= 32
    precision, shift = np.where(linear, take(pos, 4) + 1, 1), np.where(linear, take(pos + 4, 5), 0)
    if (shift > 15).any():
        raise ValueError("negative shift")
    back = np.zeros((most, n), np.int32)  # weights, of the sample before last
    for j in range(most):
        some = np.flatnonzero(linear & (j < order))
        raw = take(np.where(linear & (j < order), pos + 9 + precision * j, 0), 15)[some] >> (15 - precision[some])
        back[most - 1 - j, some] = raw - ((raw >> (precision[some] - 1)) << precision[some])
    for o, weights in enumerate(FIXED[: most + 1]):
        for j, w in enumerate(weights):
            back[most - 1 - j, ~linear & (order == o)] = w
    pos = np.where(linear, pos + 9 + precision * order, pos).astype(np.int32)
    if take(pos, 6).any():
        raise ValueError("several Rice partitions")
    k = take(pos + 6, 4)
    pos = pos + 10
    low, codes, close = (1 << k) - 1, np.zeros((BLOCK, n), np.int32), np.int32(width * 8)
    for i in range(BLOCK):  # frames with warm-up samples end earlier and then read nothing that counts
        stop = np.minimum(ahead[base + pos], close)
        after = stop + 1
        codes[i] = (stop - pos << k) | (window[base_w + (after >> 3)].astype(np.int32) >> (24 - k - (after & 7))) & low
        pos = np.minimum(after + k, close)
    r = (codes >> 1) ^ -(codes & 1)
    x = np.zeros((most + BLOCK, n), np.int32)  # a row a sample, zeros before the first
    for o in np.unique(order).tolist():
        some = np.flatnonzero(order == o)
        x[most + o :, some] = r[: BLOCK - o, some]
        x[most : most + o, some] = warm[some, :o].T
    for i in range(BLOCK):
        guess = np.add.reduce(x[i : i + most] * back, axis=0, dtype=np.int32) >> shift
        x[most + i] += guess if i >= most else np.where(i >= order, guess, 0)
    out[rows] = x[most:].T
    return out


def frame_starts(data: np.ndarray, begin: np.ndarray, end: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where the frames lie: places of the sync code whose header checksum holds and whose numbers follow each other from 0 in every stream."""
    at = np.flatnonzero((data[:-5] == 0xFF) & (data[1:-4] == 0xF8) & (data[2:-3] == 0x20) & (data[3:-2] == 0x02))
    stream = np.searchsorted(begin, at, "right") - 1
    lead = data[at + 4]
    extra = LEADS[lead] - 1
    fits = (stream >= 0) & (at + 6 + extra <= end[np.maximum(stream, 0)])
    at, stream, lead, extra = at[fits], stream[fits], lead[fits], extra[fits]
    number = np.where(extra > 0, lead & (0x3F >> extra), lead).astype(np.int64)
    for j in range(1, int(extra.max(initial=0)) + 1):
        some = extra >= j
        number[some] = number[some] << 6 | data[at[some] + 4 + j] & 0x3F
    good = crc_rows(data, at, 6 + extra, CRC8, 8) == 0
    at, stream, number = at[good], stream[good], number[good]
    if len(at) != counts.sum() or (number != np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)).any():
        kept, want = [], 0  # a chance match inside a frame: keep those that continue the numbering
        for a, s, n in zip(at.tolist(), stream.tolist(), number.tolist()):
            want = 0 if not kept or s != kept[-1][1] else want
            if n == want:
                kept.append((a, s))
                want += 1
        if [s for _, s in kept] != np.repeat(np.arange(len(counts)), counts).tolist():
            raise ValueError("frames are missing")
        at = np.array([a for a, _ in kept], np.int64)
    return at.astype(np.int64)


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """Padded payloads of streams written by encode_payloads, checked against checksums, counts and MD5."""
    if not streams:
        return []
    layouts = [_layout(s) for s in streams]
    sizes = np.array([len(s) for s in streams])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(streams), np.uint8)
    facts = [f for f, _ in layouts]
    counts = np.array([f["total"] // BLOCK for f in facts])
    start = frame_starts(data, base + [b for _, b in layouts], base + sizes, counts)
    last = np.cumsum(counts) - 1
    end = np.append(start[1:], 0)
    end[last] = base + sizes
    starts = np.split(start, last[:-1] + 1)
    samples = np.concatenate([decode_frames(data, start[a : a + 1024], end[a : a + 1024]) for a in range(0, len(start), 1024)]).astype(np.int8)
    out, at = [], 0
    for f, own in zip(facts, starts):
        pcm = samples[at : at + len(own)].tobytes()
        if len(pcm) != f["total"] or hashlib.md5(pcm).digest() != f["md5"]:
            raise ValueError("bad samples")
        out.append((np.frombuffer(pcm, np.uint8) + np.uint8(CENTRE)).tobytes())
        at += len(own)
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        a, b = self.at, self.at + n
        self.at = b
        return int.from_bytes(self.data[a >> 3 : (b + 7) >> 3], "big") >> (-b & 7) & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _residual(bits: _Bits, block: int, order: int) -> list[int]:
    width = 5 if bits.take(2) else 4
    parts, out = bits.take(4), []
    for p in range(1 << parts):
        k, n = bits.take(width), (block >> parts) - (order if p == 0 else 0)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                u = bits.zeros() << k
                u |= bits.take(k) if k else 0
                out.append(u >> 1 ^ -(u & 1))
    return out


def decode_any(stream: bytes) -> np.ndarray:
    """Samples of any mono FLAC stream of up to 16 bits, frame after frame (the plain path; checksums verified)."""
    facts, at = _layout(stream)
    out: list[int] = []
    while at < len(stream):
        bits = _Bits(stream[at:])
        if bits.take(15) != 0x7FFC:
            raise ValueError("bad frame header")
        bits.take(1)
        size_code, rate_code = bits.take(4), bits.take(4)
        bits.take(8)
        lead = bits.take(8)
        for _ in range(max(0, 8 - (~lead & 0xFF).bit_length() - 1)):
            bits.take(8)
        if size_code in (6, 7):
            block = bits.take(8 * (size_code - 5)) + 1
        else:
            block = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 1 << size_code
        if rate_code in (12, 13, 14):
            bits.take(8 if rate_code == 12 else 16)
        raw = np.frombuffer(bits.data, np.uint8)
        bits.take(8)
        if crc_rows(raw, np.array([0]), np.array([bits.at >> 3]), CRC8, 8)[0]:
            raise ValueError("bad frame header")
        bits.take(1)
        kind, wasted, depth = bits.take(6), bits.take(1), facts["bits"]
        if wasted:
            wasted = bits.zeros() + 1
            depth -= wasted
        if kind == 0:
            x = [bits.signed(depth)] * block
        elif kind == 1:
            x = [bits.signed(depth) for _ in range(block)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [bits.signed(depth) for _ in range(order)]
            shift, weights = 0, FIXED[order] if kind < 32 else None
            if weights is None:
                precision, shift = bits.take(4) + 1, bits.signed(5)
                weights = [bits.signed(precision) for _ in range(order)]
            for r in _residual(bits, block, order):
                x.append(r + (sum(w * v for w, v in zip(weights, reversed(x[-order:]))) >> shift if order else 0))
        bits.at = -(-bits.at // 8) * 8
        if crc_rows(raw, np.array([0]), np.array([(bits.at >> 3) + 2]), CRC16, 16)[0]:
            raise ValueError("bad frame checksum")
        out += [v << wasted for v in x]
        at += (bits.at >> 3) + 2
    samples = np.array(out, np.int64)
    kind = np.dtype("i1") if facts["bits"] <= 8 else np.dtype("<i2")
    if any(facts["md5"]) and hashlib.md5(samples.astype(kind).tobytes()).digest() != facts["md5"]:
        raise ValueError("bad samples")
    return samples


def feature_of(payload: bytes) -> str:
    """Mean, energy, zero crossings and peak of the samples, in whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero(np.diff(x < 0))};peak={np.abs(x).max()}"


def read_streams(streams: list[bytes]) -> list[bytes]:
    """Payloads of any streams of 8-bit mono: those written here all at once, those of other encoders (other block sizes, quantised linear
    predictors, several Rice partitions) one by one. Broken streams of either kind raise ValueError."""
    foreign = [i for i, s in enumerate(streams) if not _own(s)]
    if not foreign:
        return decode_streams(streams)
    rest = iter(decode_streams([s for s in streams if _own(s)]))
    return [(decode_any(s).astype(np.int8).view(np.uint8) + np.uint8(CENTRE)).tobytes() if i in set(foreign) else next(rest) for i, s in enumerate(streams)]


def _own(stream: bytes) -> bool:
    """Whether encode_payloads has written a stream: its block size, and seek points every SEEK frames from the first on."""
    facts, at = _layout(stream)
    points = facts["points"]
    return facts["block"] == (BLOCK, BLOCK) and points is not None and len(points) > 0 and bool((points["sample"] == np.arange(len(points)) * BLOCK * SEEK).all()) and stream[at + 2 : at + 4] == b"\x20\x02"


def blocks_of(payload: bytes, frames: int = 1) -> Iterator[tuple[int, bytes]]:
    """PCM blocks of a payload, of so many frames each: (first sample, bytes)."""
    for first in range(0, len(payload), BLOCK * frames):
        yield first, payload[first : first + BLOCK * frames]


def _parts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of about `most` bytes of a text or binary column, null as empty."""
    run: list[bytes] = []
    size = first = 0
    for i, v in enumerate(column.cast(pa.binary()).to_pylist()):
        if run and size + len(v or b"") > most:
            yield first, run
            run, size, first = [], 0, i
        run.append(v or b"")
        size += len(run[-1])
    if run:
        yield first, run


def flac_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, raw in _parts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(raw)), pa.array([len(r) for r in raw], pa.int64()), pa.array(encode_payloads([pad(r) for r in raw]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, frames: int = 1) -> DataFrame:
    """(stream, doc_id, n_bytes, block, first_sample, n_samples, n_total, pcm, pcm_crc32, facts) of (doc_id, n_bytes, media): blocks of so many
    frames, each sought by its first sample; pcm is 8-bit unsigned. `stream` numbers the rows of media, which may share ids; facts of
    the stream and of its decoded payload stand with block 0. Pass a written table: a stream is decoded once, its checksums verified."""
    facts = "struct<payload_sha256: binary, media_bytes: long, media_sha256: binary, feature: string>"
    schema = f"stream long, doc_id long, n_bytes long, block int, first_sample long, n_samples int, n_total long, pcm binary, pcm_crc32 long, facts {facts}"
    kinds = pa.struct([("payload_sha256", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("feature", pa.string())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            for a, streams in _parts(batch.column(3)):
                rows = []
                for own, payload, s in zip(ids[a : a + len(streams)], read_streams(streams), streams):
                    of_all = {"payload_sha256": hashlib.sha256(payload).digest(), "media_bytes": len(s), "media_sha256": hashlib.sha256(s).digest(), "feature": feature_of(payload)}
                    for i, (first, pcm) in enumerate(blocks_of(payload, frames)):
                        rows.append((*own, i, first, len(pcm), len(payload), pcm, zlib.crc32(pcm), None if i else of_all))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in schema.split(", ", 9)])

    return media.select(F.monotonically_increasing_id().alias("stream"), "doc_id", "n_bytes", "media").mapInArrow(run, schema)


def pcm_range(blocks: DataFrame, first: Column, length: int) -> DataFrame:
    """(stream, doc_id, first_sample, pcm): samples first to first + length of every stream (a column of blocks, such as n_total - 32), from
    the blocks they touch; shorter where the stream ends, no row where it has no such sample. length bounds what a row gathers."""
    cut = F.greatest(first - F.col("first_sample"), F.lit(0))
    end = F.least(first + length - F.col("first_sample"), F.col("n_samples"))
    touched = blocks.where((F.col("first_sample") < first + length) & (F.col("first_sample") + F.col("n_samples") > first))
    part = F.struct((F.col("first_sample") + cut).alias("at"), F.substring("pcm", cut.cast("int") + 1, (end - cut).cast("int")).alias("pcm"))
    found = touched.select("stream", "doc_id", part.alias("part")).groupBy("stream").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list("part")).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["pcm"]))
    return found.select("stream", "doc_id", F.col("parts")[0]["at"].alias("first_sample"), joined.alias("pcm"))


def media_digest(blocks: DataFrame) -> DataFrame:
    """Facts of stored streams from their written PCM blocks: every block is read back and must have its checksum, a stream's blocks must
    add up to its samples, and the tail's checksum is that of the last 32 samples, sought in the last block."""
    whole = F.when(F.crc32("pcm") == F.col("pcm_crc32"), F.col("n_samples")).otherwise(F.raise_error(F.lit("bad block")))
    last = F.col("first_sample") + F.col("n_samples") == F.col("n_total")
    tail = F.when(last, F.crc32(F.expr("substring(pcm, n_samples - 31, 32)")))
    sums = blocks.groupBy("stream").agg(F.sum(whole).alias("payload_bytes"), F.max(tail).alias("tail_crc32"))  # numbers alone: a hash aggregate, no sort of pcm
    rows = blocks.where("block = 0").select("stream", "doc_id", "n_bytes", "n_total", "facts.*").join(sums, "stream")
    length = F.when(F.col("payload_bytes") == F.col("n_total"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("blocks are missing")))
    shown = lambda name: F.lower(F.hex(name)).alias(name)
    return rows.select("doc_id", "n_bytes", length.cast("long").alias("payload_bytes"), shown("payload_sha256"), "tail_crc32", "media_bytes", shown("media_sha256"), "feature")


def digest_in_parts(media: DataFrame, parts: int = 8, frames: int = SEEK) -> DataFrame:
    """media_digest of written streams, a part of their files at a time: a part's PCM blocks are written, read back and digested, then the
    next part's take their place. So beside all streams lie the blocks of one part alone; without files, all rows are one part."""
    spark = media.sparkSession
    names = sorted({unquote(f.rsplit("/", 1)[1]) for f in media.inputFiles()})
    parts = max(1, min(parts, len(names)))
    name, blocks_at, digests_at = F.col("_metadata.file_name"), fresh_path(spark, "pcm"), fresh_path(spark, "digests")
    for k in range(parts):
        others = [f for i, f in enumerate(names) if i % parts]  # the first part is what is in no other
        own = media if parts == 1 else media.where(name.isin(names[k::parts]) if k else ~name.isin(others))
        blocks = pcm_blocks(own, frames)
        blocks.write.mode("overwrite").option("compression", "zstd").parquet(blocks_at)
        digest = media_digest(spark.read.schema(blocks.schema).parquet(blocks_at))
        digest.write.mode("append").option("compression", "zstd").parquet(digests_at)
    return spark.read.schema(digest.schema).parquet(digests_at)

"""FLAC media columns: lossless coding of 8-bit samples, decoding with all checks, and PCM blocks with sample offsets.

Encoder: mono, 8 bits, frames of BLOCK samples, for each frame the shortest of a constant, a fixed linear predictor of
order 0 to 2, a quantised linear predictor of order LPC_ORDER, and verbatim samples, residuals in Rice codes; a seek
point for each frame; MD5 of the samples in the stream's head. Decoder: constant, verbatim, fixed (0 to 4) and quantised
linear predictors (1 to 32), Rice partitions of both parameter sizes with raw escapes, mono up to 16 bits; it verifies
each frame head's CRC-8, each frame's CRC-16 and, of whole streams, the MD5, and raises ValueError on any damage.

Many frames are worked on at once with numpy: Rice codes of all frames of a batch are read in step, one code of each
frame at a time, which the seek points allow, and so are the samples that linear predictors give. A batch is GROUP bytes
of frames, so working memory follows neither the batch of rows nor the length of a text. ``samples`` and ``pcm_blocks`` decode
only the frames that the seek points name.

Nulls and empty texts are 64 zero bytes. A very long text is many frames and costs its length. Rows don't depend on each
other; repeated rows get equal results; empty tables give no rows. Extra columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import runs, table

BLOCK = 4096
SAMPLE_RATE = 8000
#: Bytes that are coded at a time, which bounds working memory at about 100 MB; whole blocks.
GROUP = 256 * BLOCK
#: Order of quantised predictors, the samples from which a frame may have one, and bits of each coefficient.
LPC_ORDER, LPC_LEAST, PRECISION = 4, 512, 12
_RICE_MOST = 14
_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for b in range(256):
        v = b << (bits - 8)
        for _ in range(8):
            v = (v << 1) ^ (poly if v >> (bits - 1) else 0)
            v &= (1 << bits) - 1
        out.append(v)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), np.array(_crc_table(0x8005, 16), np.uint16)


@lru_cache(maxsize=8192)
def crc8(head: bytes) -> int:
    v = 0
    for b in head:
        v = _CRC8[v ^ b]
    return v


class _Crc16:
    """CRC-16 of many byte runs at once: the check is linear, so each byte adds what it alone, so far before the end, would give."""

    def __init__(self):
        self.at = np.zeros((1, 256), np.uint16)
        self.at[0] = _CRC16

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        longest = int((ends - starts).max())
        if longest > 1 << 15:  # few frames are so long; bytes one by one
            return np.array([self._plain(data[s:e]) for s, e in zip(starts, ends)], np.uint16)
        if longest > len(self.at):
            rows = [self.at[-1]]
            for _ in range(longest - len(self.at)):
                rows.append((rows[-1] << 8) ^ _CRC16[rows[-1] >> 8])
            self.at = np.concatenate([self.at, np.array(rows[1:], np.uint16)])
        n = ends - starts
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(starts - first, n)
        values = self.at[np.repeat(ends - 1, n) - at, data[at]]  # row: distance from the run's end
        return np.bitwise_xor.reduceat(values, first)

    @staticmethod
    def _plain(run: np.ndarray) -> int:
        v = 0
        for b in run.tolist():
            v = ((v << 8) & 0xFFFF) ^ int(_CRC16[(v >> 8) ^ b])
        return v


_crc16 = _Crc16()


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ..."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def _number(v: int) -> bytes:
    """A frame number in the format's UTF-8-like coding."""
    if v < 0x80:
        return bytes([v])
    n = 2
    while v >= 1 << (5 * n + 1):
        n += 1
    tail = [0x80 | (v >> (6 * k)) & 0x3F for k in range(n - 1)]
    return bytes([(0xFF << (8 - n)) & 0xFF | v >> (6 * (n - 1)), *tail[::-1]])


@lru_cache(maxsize=8192)
def _frame_head(number: int, n: int) -> bytes:
    head = b"\xff\xf8\x70\x02" + _number(number) + (n - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


# ---- encoding

def _predictors(x: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of frames (rows of x, zeros after n samples): whether there is a predictor, its coefficients, shift, and residuals
    from sample ``order`` on. The autocorrelation method, all frames at once."""
    at = np.arange(x.shape[1], dtype=np.float32)
    half = ((n - 1) / 2).astype(np.float32)[:, None]
    y = x * np.maximum(1 - ((at - half) / (half + 1)) ** 2, 0)
    r = np.stack([np.einsum("ij,ij->i", y[:, k:], y[:, : x.shape[1] - k], dtype=np.float64) for k in range(order + 1)])
    a, err = np.zeros((0, len(n))), r[0]
    ok = err > 0
    for k in range(order):
        ref = (r[k + 1] - (a * r[k:0:-1]).sum(axis=0)) / np.where(ok, err, 1)
        a = np.concatenate([a - ref * a[::-1], ref[None]])
        err = err * (1 - ref * ref)
        ok &= (err > 0) & np.isfinite(ref)
    top = np.abs(np.where(ok, a, 1)).max(axis=0)
    shift = np.minimum(15, PRECISION - 2 - np.ceil(np.log2(top + 1e-12))).astype(np.int32)
    ok &= shift >= 0
    most = 1 << (PRECISION - 1)
    q = np.clip(np.round(np.where(ok, a, 0) * 2.0 ** np.maximum(shift, 0)), -most, most - 1).astype(np.int32).T
    guess = np.zeros((len(n), x.shape[1] - order), np.int32)
    for k in range(order):
        guess += q[:, k : k + 1] * x[:, order - 1 - k : x.shape[1] - 1 - k]
    return ok, q, np.maximum(shift, 0), x[:, order:] - (guess >> np.maximum(shift, 0)[:, None])


def _encoded(raw: np.ndarray, start: np.ndarray, n: np.ndarray, number: np.ndarray, lpc_order: int) -> tuple[bytes, np.ndarray]:
    """(the frames one after the other, the size of each); frames are n samples from start, together all of raw."""
    x = raw.astype(np.int32) - 128
    total = lambda values: np.add.reduceat(values, start)
    # residuals of orders 0 to 2; a frame's first samples belong to no residual
    fixed = [x]
    for o in (1, 2):
        d = np.diff(fixed[-1], prepend=np.int32(0))
        for j in range(o):
            d[start[n > j] + j] = 0
        fixed.append(d)
    sums = np.stack([total(np.abs(d)) for d in fixed])
    order, least = sums.argmin(axis=0), sums.min(axis=0)
    per = np.repeat(order, n)
    res = np.where(per == 0, x, np.where(per == 1, fixed[1], fixed[2]))
    lpc = np.zeros(len(n), bool)
    coefs, shift = np.zeros((len(n), lpc_order), np.int32), np.zeros(len(n), np.int32)
    some = np.flatnonzero(n >= max(LPC_LEAST, 2 * lpc_order)) if lpc_order else np.zeros(0, int)
    if len(some):
        there = np.arange(int(n[some].max())) < n[some][:, None]
        rows = np.zeros(there.shape, np.int32)
        at = np.repeat(start[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(int(n[some].sum()))
        rows[there] = x[at]
        ok, q, by, r = _predictors(rows, n[some], lpc_order)
        cost = np.where(there[:, lpc_order:], np.abs(r), 0).sum(axis=1)
        # a Rice code grows by the logarithm of the mean residual
        gain = (n[some] - lpc_order) * (np.log2(least[some] + 1) - np.log2(cost + 1)) - (9 + PRECISION * lpc_order + 8 * (lpc_order - order[some]))
        use = ok & (gain > 0)
        f = some[use]
        lpc[f], coefs[f], shift[f], order[f] = True, q[use], by[use], lpc_order
        inside = np.zeros(there.shape, bool)
        inside[:, lpc_order:] = there[:, lpc_order:]
        inside &= use[:, None]
        whole = np.zeros(there.shape, np.int32)
        whole[:, lpc_order:] = r
        res[at[inside[there]]] = whole[inside]
    coded = np.ones(len(x), bool)
    for j in range(int(order.max(initial=0))):
        coded[start[(order > j) & (n > j)] + j] = False
    u = (res << 1) ^ (res >> 31)
    u[~coded] = 0
    codes = n - order
    near = np.floor(np.log2(np.maximum(total(u.astype(np.int64)) / np.maximum(codes, 1) * 0.69, 1))).astype(np.int64)
    tries = [np.clip(near + j, 0, _RICE_MOST) for j in (-1, 0, 1)]
    costs = np.stack([codes * (t + 1) + total((u >> np.repeat(t, n)).astype(np.int64)) for t in tries])
    k = np.stack(tries)[costs.argmin(axis=0), np.arange(len(n))]
    head = np.array([len(_frame_head(int(i), int(m))) for i, m in zip(number, n)])
    front = 8 + 8 * order + np.where(lpc, 9 + PRECISION * lpc_order, 0)  # bits before the residual
    bits = front + 10 + costs.min(axis=0)
    constant = np.minimum.reduceat(x, start) == np.maximum.reduceat(x, start)
    verbatim = ~constant & (bits >= 8 + 8 * n)
    rice = ~constant & ~verbatim
    size = head + np.where(constant, 2, np.where(verbatim, 1 + n, -(-bits // 8))) + 2
    ends = np.cumsum(size)
    begin = ends - size

    # fields of all frames as (last bit, value of at most 16 bits), put into 32-bit words by sums, as no two share a bit
    keep = coded & np.repeat(rice, n)
    uk, kk = u[keep], np.repeat(k, n)[keep]
    length = (uk >> kk) + 1 + kk
    many = np.where(rice, codes, 0)
    last = np.cumsum(length)
    body = (begin + head) * 8
    before = np.concatenate([[0], last])[np.cumsum(many) - many]
    fields = [(last - 1 + np.repeat(body + front + 10 - before, many), (uk & ((1 << kk) - 1)) | (1 << kk)), ((body + front + 9)[rice], k[rice])]
    f = np.flatnonzero(rice & lpc)
    if len(f):
        at = body[f] + 8 + 8 * lpc_order
        fields += [(at + 3, np.full(len(f), PRECISION - 1)), (at + 8, shift[f])]
        fields += [(at + 8 + PRECISION * (j + 1), coefs[f, j] & ((1 << PRECISION) - 1)) for j in range(lpc_order)]
    at, value = (np.concatenate([np.asarray(x[i], np.int64) for x in fields]) for i in (0, 1))
    word, value = at >> 5, value << (31 - (at & 31))
    words = np.bincount(word, value & 0xFFFFFFFF, int(ends[-1]) // 4 + 2)
    high = value >> 32
    some = np.flatnonzero(high)
    words += np.bincount(word[some] - 1, high[some], len(words))
    data = words.astype(">u4").view(np.uint8)[: int(ends[-1])]

    samples = raw ^ 0x80  # two's complement
    for f, (b, h, s, m, o) in enumerate(zip(begin.tolist(), head.tolist(), start.tolist(), n.tolist(), order.tolist())):
        data[b : b + h] = np.frombuffer(_frame_head(int(number[f]), m), np.uint8)
        b += h
        if constant[f]:
            data[b : b + 2] = 0, samples[s]
        elif verbatim[f]:
            data[b] = 2
            data[b + 1 : b + 1 + m] = samples[s : s + m]
        else:
            data[b] = (32 + o - 1 if lpc[f] else 8 + o) << 1
            data[b + 1 : b + 1 + o] = samples[s : s + o]
    crc = _crc16.of(data, begin, ends - 2)
    data[ends - 2], data[ends - 1] = crc >> 8, crc & 0xFF
    return data.tobytes(), size


def encode(payloads: list[bytes], lpc_order: int = LPC_ORDER) -> list[bytes]:
    """A FLAC stream for each payload, which must not be empty; byte b is sample b - 128."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    frames_of = -(-lengths // BLOCK)
    frame_n = np.minimum(BLOCK, np.repeat(lengths, frames_of) - _within(frames_of) * BLOCK)
    number = _within(frames_of)
    whole = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.cumsum(frame_n)
    blobs, sizes, f = [], [], 0
    while f < len(frame_n):
        first = int(ends[f] - frame_n[f])
        g = max(f + 1, int(np.searchsorted(ends, first + GROUP, "right")))
        blob, size = _encoded(whole[first : int(ends[g - 1])], ends[f:g] - frame_n[f:g] - first, frame_n[f:g], number[f:g], lpc_order)
        blobs.append(blob)
        sizes.append(size)
        f = g
    frames, size = b"".join(blobs), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    at = np.cumsum(size) - size
    streams, f, s = [], 0, 0
    for length, count in zip(lengths.tolist(), frames_of.tolist()):
        g = f + count
        own = size[f:g]
        info = BLOCK.to_bytes(2, "big") * 2 + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += ((SAMPLE_RATE << 44) | (0 << 41) | (7 << 36) | length).to_bytes(8, "big") + hashlib.md5(whole[s : s + length] ^ np.uint8(0x80)).digest()
        points = np.zeros(count, _POINT)
        points["sample"], points["offset"], points["n"] = number[f:g] * BLOCK, at[f:g] - at[f], frame_n[f:g]
        # a metadata block has at most 2^24 - 1 bytes; of more frames than that, evenly spaced ones get points
        seek = points[:: -(-count * 18 // 0xFFFFF0)].tobytes()
        streams.append(b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frames[at[f] : at[g - 1] + size[g - 1]])
        f, s = g, s + length
    return streams


# ---- decoding

class _Bits:
    """Reads bit fields of one frame's head parts."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n - 1) >> 3
        v = int.from_bytes(self.data[first : last + 1], "big") >> (8 * (last + 1) - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v


class Stream:
    """Head and seek points of a FLAC stream."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.points = 4, False, None
        while not last:
            kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            last, block = kind >> 7 == 1, data[at + 4 : at + 4 + n]
            if len(block) != n:
                raise ValueError("the stream's head ends early")
            if kind & 127 == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.block = int.from_bytes(block[2:4], "big")
                self.rate, self.channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
                self.md5 = block[18:34]
            elif kind & 127 == 3:
                self.points = np.frombuffer(block, _POINT)
            at += 4 + n
        self.data, self.first = data, at


_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_DEPTHS = {1: 8, 2: 12, 4: 16}


def _head(s: Stream, d: bytes, at: int = 0) -> tuple[int, int, int]:
    """(samples, bits of a sample, end) of the frame head at ``at``."""
    if d[at : at + 1] != b"\xff" or d[at + 1 : at + 2] not in (b"\xf8", b"\xf9"):
        raise ValueError("no frame where one is due")
    size, rate, channels, depth = d[at + 2] >> 4, d[at + 2] & 15, d[at + 3] >> 4, d[at + 3] >> 1 & 7
    lead = d[at + 4]
    p = at + 5 + (0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1)
    if size in (6, 7):
        w = size - 5
        n = int.from_bytes(d[p : p + w], "big") + 1
        p += w
    else:
        n = _SIZES[size]
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(d[at:p]) != d[p]:
        raise ValueError("a frame head's CRC-8 differs")
    if channels + 1 != s.channels or channels > 7:
        raise ValueError("channels that depend on each other aren't read here")
    return n, _DEPTHS[depth] if depth else s.bits, p + 1


def decode(streams: list[bytes], verify: bool = True) -> list[bytes]:
    """The samples of each mono 8-bit stream as bytes (sample + 128). Raises ValueError where a check fails."""
    return [(x + 128).astype(np.uint8).tobytes() for x in decode_samples(streams, verify)]


def decode_samples(streams: list[bytes], verify: bool = True) -> list[np.ndarray]:
    """The samples of each mono stream as integers."""
    heads = [_mono(x) for x in streams]
    found: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in heads]  # (begin, end, samples) of each frame, in order
    # frames at seek points are read together; frames between or without points, one after the other
    todo = [(i, h.first + int(o)) for i, h in enumerate(heads) for o in (h.points["offset"] if h.points is not None and len(h.points) else [0]) if h.samples]
    while todo:
        again = []
        for (i, at), (end, x) in zip(todo, _read(heads, todo, verify)):
            found[i].append((at, end, x))
            if end < len(heads[i].data) and not _has_point(heads[i], end):
                again.append((i, end))
        todo = again
    out = []
    for i, h in enumerate(heads):
        rows = sorted(found[i], key=lambda r: r[0])
        at = h.first
        for a, e, _ in rows:
            if a != at:
                raise ValueError("frames don't follow each other")
            at = e
        if at != len(h.data):
            raise ValueError("bytes follow the last frame")
        x = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int32)
        if len(x) != h.samples:
            raise ValueError("the number of samples differs")
        if verify and h.md5 != bytes(16) and hashlib.md5(x.astype(f"<i{-(-h.bits // 8)}").tobytes()).digest() != h.md5:
            raise ValueError("the MD5 of the samples differs")
        out.append(x)
    return out


def samples(wanted: list[tuple[bytes, int, int]]) -> list[bytes]:
    """For each (stream of 8-bit samples, first sample, end) the samples between as bytes, from the frames that hold them alone."""
    heads, todo, firsts = [_mono(x) for x, _, _ in wanted], [], []
    for i, (h, (_, first, end)) in enumerate(zip(heads, wanted)):
        points = h.points if h.points is not None and len(h.points) else np.zeros(1, _POINT)
        a = max(0, int(np.searchsorted(points["sample"], first, "right")) - 1)
        z = max(a + 1, int(np.searchsorted(points["sample"], min(end, h.samples), "left"))) if h.samples else a
        todo += [(i, h.first + int(o)) for o in points["offset"][a:z]]
        firsts.append(int(points["sample"][a]))
    parts: list[list[np.ndarray]] = [[] for _ in heads]
    at: list[int] = [h.first for h in heads]
    for (i, _), (end, x) in zip(todo, _read(heads, todo, True)):
        parts[i].append(x)
        at[i] = end
        # without a point for each frame, the frames up to the next one follow
        while end < len(heads[i].data) and not _has_point(heads[i], end) and firsts[i] + sum(map(len, parts[i])) < wanted[i][2]:
            [(end, x)] = _read(heads, [(i, end)], True)
            parts[i].append(x)
    out = []
    for p, first, (_, a, z) in zip(parts, firsts, wanted):
        x = np.concatenate(p) if p else np.zeros(0, np.int32)
        out.append((x[max(0, a - first) : max(0, z - first)] + 128).astype(np.uint8).tobytes())
    return out


def _mono(data: bytes) -> Stream:
    out = Stream(data)
    if out.channels != 1:
        raise ValueError("only mono streams are read here")
    return out


def _read(heads: list[Stream], todo: list[tuple[int, int]], verify: bool) -> list[tuple[int, np.ndarray]]:
    """(end, samples) of the frame at each (stream, position), GROUP bytes of frames at a time."""
    stops = []
    for i, at in todo:
        h, stop = heads[i], len(heads[i].data)
        if h.points is not None and len(h.points):
            k = int(np.searchsorted(h.points["offset"], at - h.first, "right"))
            stop = h.first + int(h.points["offset"][k]) if k < len(h.points) else stop
        stops.append(stop)
    out: list[tuple[int, np.ndarray]] = []
    j = 0
    while j < len(todo):
        parts, base, size, first = [], [], 0, j
        while j < len(todo) and (j == first or size + stops[j] - todo[j][1] <= GROUP):
            i, at = todo[j]
            parts.append(heads[i].data[at : stops[j]])
            base.append(size)
            size += len(parts[-1])
            j += 1
        data = np.frombuffer(b"".join(parts), np.uint8)
        frames = _read_frames([heads[i] for i, _ in todo[first:j]], parts, data, base, _next_ones(data))
        if verify:
            starts, ends = np.array(base), np.array(base) + np.array([e - 2 for e, _ in frames])
            if (ends + 1 >= len(data)).any() or (_crc16.of(data, starts, ends) != (data[ends].astype(np.uint16) << 8 | data[ends + 1])).any():
                raise ValueError("a frame's CRC-16 differs")
        out += [(at + e, x) for (_, at), (e, x) in zip(todo[first:j], frames)]
    return out


def _next_ones(data: np.ndarray) -> np.ndarray:
    """For each bit the place of the first 1 at or after it; the number of bits if there is none."""
    bits = np.unpackbits(data)
    kind = np.int32 if len(bits) < 2**31 else np.int64
    out = np.full(len(bits) + 1, len(bits), kind)
    np.copyto(out[:-1], np.arange(len(bits), dtype=kind), where=bits.view(bool))
    np.minimum.accumulate(out[::-1], out=out[::-1])
    return out


def _has_point(h: Stream, at: int) -> bool:
    if h.points is None or not len(h.points):
        return False
    p = h.points["offset"]
    k = int(np.searchsorted(p, at - h.first))
    return k < len(p) and int(p[k]) == at - h.first


def _read_frames(heads: list[Stream], parts: list[bytes], data: np.ndarray, base: list[int], nxt: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(size, samples) of the frame that each part begins with; part j is data from base[j] on."""
    lanes, out = [], [None] * len(parts)
    for j, (s, part) in enumerate(zip(heads, parts)):
        n, depth, p = _head(s, part)
        b = _Bits(part, 8 * p)
        if b.take(1):
            raise ValueError("a subframe's head is damaged")
        kind, wasted = b.take(6), 0
        if b.take(1):
            wasted = 1
            while not b.take(1):
                wasted += 1
        depth -= wasted
        if kind == 0:
            x = np.full(n, b.signed(depth), np.int32)
        elif kind == 1:
            if depth == 8 and not b.at & 7:
                x = np.frombuffer(part, np.int8, n, b.at >> 3).astype(np.int32)
                b.at += 8 * n
            else:
                x = np.array([b.signed(depth) for _ in range(n)], np.int32)
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            warm = [b.signed(depth) for _ in range(order)]
            coefs = shift = None
            if kind >= 32:
                precision = b.take(4) + 1
                shift = b.signed(5)
                coefs = [b.signed(precision) for _ in range(order)]
                if shift < 0:
                    raise ValueError("a predictor's shift is damaged")
            method, pieces = b.take(2), b.take(4)
            if method > 1 or n % (1 << pieces) or n >> pieces < order:
                raise ValueError("a residual's head is damaged")
            lanes.append([j, n, order, warm, coefs, shift, 4 + method, 1 << pieces, b.at + 8 * base[j], wasted])
            continue
        else:
            raise ValueError("a subframe of a reserved kind")
        out[j] = (-(-b.at // 8) + 2, x << wasted)
    if lanes:
        ends, res = _residuals(lanes, data, nxt)
        for lane, at, x in zip(lanes, ends, _predicted(lanes, res)):
            out[lane[0]] = (-(-(at - 8 * base[lane[0]]) // 8) + 2, x << lane[9] if lane[9] else x)
    return out


def _fields(data: np.ndarray) -> np.ndarray:
    """The 32 bits from each byte on."""
    wide = np.zeros(len(data) + 4, np.int64)
    wide[: len(data)] = data
    return wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]


def _field(words: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits (at most 24) at each bit position."""
    return words.take(at >> 3, mode="clip") >> (32 - n - (at & 7)) & ((1 << n) - 1)


def _residuals(lanes, data, nxt) -> tuple[list[int], list[np.ndarray]]:
    """Bit position after, and residuals, of each lane. Partition by partition, all lanes in step, the longest first."""
    words = _fields(data)
    at = np.array([x[8] for x in lanes], np.int64)
    res = [np.zeros(x[1] - x[2], np.int32) for x in lanes]
    filled = [0] * len(lanes)
    limit = len(nxt) - 1
    for part in range(max(x[7] for x in lanes)):
        own = np.array([j for j, x in enumerate(lanes) if part < x[7]])
        width = np.array([lanes[j][6] for j in own])
        k = _field(words, at[own], width)
        at[own] += width
        count = np.array([lanes[j][1] // lanes[j][7] - (lanes[j][2] if not part else 0) for j in own])
        escaped = k == (1 << width) - 1
        for j, c in zip(own[escaped], count[escaped]):
            n = int(_field(words, at[j : j + 1], np.array([5]))[0])
            pos = at[j] + 5 + n * np.arange(c)
            v = _field(words, pos, np.full(c, n)) if n else np.zeros(c, np.int64)
            res[j][filled[j] : filled[j] + c] = np.where(v >> max(n - 1, 0), v - (1 << n), v) if n else 0
            at[j] += 5 + n * c
            filled[j] += int(c)
        rest = np.flatnonzero(~escaped)
        if not len(rest):
            continue
        rest = rest[np.argsort(-count[rest], kind="stable")]
        lane, counts, kk = own[rest], count[rest], k[rest].astype(nxt.dtype)
        most = int(counts[0])
        active = (len(rest) - np.searchsorted(counts[::-1], np.arange(most), "right")).tolist()
        stop = np.zeros((most, len(rest)), nxt.dtype)
        first = at[lane].astype(nxt.dtype)
        pos, step = first.copy(), kk + 1
        for t, m in enumerate(active):
            if m < len(pos):
                at[lane[m : len(pos)]] = pos[m:]
                pos, step = pos[:m], step[:m]
            nxt.take(pos, out=stop[t, :m], mode="clip")
            np.add(stop[t, :m], step, out=pos)
        at[lane[: len(pos)]] = pos
        if (at[lane] > limit).any():
            raise ValueError("a residual runs past the end")
        stop = np.ascontiguousarray(stop.T)
        begin = np.empty_like(stop)
        begin[:, 0] = first
        np.add(stop[:, :-1], (kk + 1)[:, None], out=begin[:, 1:])
        kk = kk[:, None]
        u = (stop - begin) << kk | _field(words, stop + 1, kk).astype(nxt.dtype)
        v = ((u >> 1) ^ -(u & 1)).astype(np.int32)
        for c, (j, n) in enumerate(zip(lane.tolist(), counts.tolist())):
            res[j][filled[j] : filled[j] + n] = v[c, :n]
            filled[j] += n
    return at.tolist(), res


def _predicted(lanes, res: list[np.ndarray]) -> list[np.ndarray]:
    """The samples of each lane."""
    out: list = [None] * len(lanes)
    by_order: dict[int, list[int]] = {}
    for i, (lane, r) in enumerate(zip(lanes, res)):
        _, n, order, warm, coefs, *_ = lane
        if coefs is not None:
            by_order.setdefault(order, []).append(i)
            continue
        # undo the differences, each with its first value from the warm-up samples
        firsts = []
        while warm:
            firsts.append(warm[0])
            warm = [z - a for a, z in zip(warm, warm[1:])]
        x = np.empty(n, np.int32)
        x[order:] = r
        for o in range(order - 1, -1, -1):
            x[o] = firsts[o]
            np.cumsum(x[o:], out=x[o:])
        out[i] = x
    for order, group in by_order.items():
        # all lanes of an order in step, the longest first
        group.sort(key=lambda i: -lanes[i][1])
        counts = np.array([lanes[i][1] for i in group])
        x = np.zeros((int(counts[0]), len(group)), np.int64)
        for c, i in enumerate(group):
            x[:order, c], x[order : lanes[i][1], c] = lanes[i][3], res[i]
        q = np.array([lanes[i][4][::-1] for i in group], np.int64).T.copy()
        shift = np.array([lanes[i][5] for i in group])
        active = (len(group) - np.searchsorted(counts[::-1], np.arange(len(x)), "right")).tolist()
        for t in range(order, len(x)):
            m = active[t]
            guess = np.einsum("kl,kl->l", q[:, :m], x[t - order : t, :m])
            guess >>= shift[:m]
            x[t, :m] += guess
        x = np.ascontiguousarray(x.T).astype(np.int32)
        for c, i in enumerate(group):
            out[i] = x[c, : lanes[i][1]]
    return out


def pcm_blocks(stream: bytes, block: int = BLOCK, run: int = GROUP) -> Iterator[tuple[int, bytes]]:
    """(sample offset, samples) of each PCM block of a mono 8-bit stream; about ``run`` samples are decoded at a time."""
    head = _mono(stream)
    run = max(1, run // block) * block
    digest = hashlib.md5()
    for first in range(0, head.samples, run):
        raw = samples([(stream, first, min(first + run, head.samples))])[0]
        digest.update(np.frombuffer(raw, np.uint8) ^ np.uint8(0x80))
        yield from ((first + i, raw[i : i + block]) for i in range(0, len(raw), block))
    if head.md5 != bytes(16) and digest.digest() != head.md5:
        raise ValueError("the MD5 of the samples differs")


# ---- data frames

def payload(text: str | None) -> bytes:
    """The text in UTF-8 and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def feature(raw: bytes) -> str:
    """Level, peak and zero crossings of the samples."""
    x = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"rms={int(x @ x) / len(x):.4f};peak={int(np.abs(x).max())};crossings={crossings}"


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a FLAC stream."""
    id_type = docs.select(F.col(id_col).alias("doc_id")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            for s, e in runs(b.column(1), GROUP):
                rows = [payload(x) for x in b.column(1).slice(s, e - s).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), sizes.slice(s, e - s), pa.array(encode(rows), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary")


def blocks(media: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, sample_offset, pcm: the decoded PCM blocks of each stream of ``with_media``."""
    id_type = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(1).to_pylist()):
                parts = pcm_blocks(data, block)
                while some := list(islice(parts, max(1, GROUP // block))):
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0).slice(i, 1)] * len(some)), pa.array([o for o, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], ["doc_id", "sample_offset", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {id_type}, sample_offset long, pcm binary")


def _tails(streams: list[bytes], raw: list[bytes], n: int = 64) -> list[bytes]:
    """The last samples of each stream, which has n or more; of streams with several frames by their seek points."""
    far = [i for i, x in enumerate(raw) if len(x) > BLOCK]
    found = dict(zip(far, samples([(streams[i], len(raw[i]) - n, len(raw[i])) for i in far])))
    return [found.get(i, x[-n:]) for i, x in enumerate(raw)]


def digests(media: DataFrame) -> DataFrame:
    """What each stream of ``with_media`` decodes to, after all checks."""
    id_type = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in runs(b.column(2), GROUP):
                streams = b.column(2).slice(s, e - s).to_pylist()
                raw = decode(streams)
                columns = [[len(x) for x in raw], [hashlib.sha256(x).hexdigest() for x in raw], list(map(zlib.crc32, _tails(streams, raw))), [len(x) for x in streams], [hashlib.sha256(x).hexdigest() for x in streams], [feature(x) for x in raw]]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_flac(spark, sf_dir: str) -> DataFrame:
    # text hardly shrinks as sound: written, the streams take 1.57 times the documents' Parquet, so they stay a column here
    return digests(with_media(table(spark, sf_dir, "documents")))

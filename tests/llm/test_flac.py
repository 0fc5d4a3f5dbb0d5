import hashlib
import random
import zlib

import numpy as np
import pytest

from maskwright.llm import flac as C


def payloads(seed=1):
    r = random.Random(seed)
    text = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(6000))
    return [C.payload(x) for x in ("", None, "a", text, text[:4096], text[:4097], "é" * 300, "\x00\xff" * 40, "".join(chr(r.randint(0, 255)) for _ in range(9000)), "x" * 20_000)]


@pytest.mark.parametrize("order", [0, 1, 4, 8])
def test_round_trip(order):
    raw = payloads()
    streams = C.encode(raw, lpc_order=order)
    assert C.decode(streams) == raw
    assert [C.decode([x])[0] for x in streams] == raw
    assert C.encode(raw[3:4], lpc_order=order)[0] == streams[3]  # not a matter of the batch
    assert len(streams[3]) < len(raw[3]) and len(streams[9]) < 800


def test_smooth_signal_uses_predictors():
    x = (128 + 90 * np.sin(np.arange(20_000) / 40)).astype(np.uint8).tobytes()
    plain, lpc = C.encode([x])[0], C.encode([x], lpc_order=8)[0]
    assert len(plain) < 0.5 * len(x) and C.decode([plain, lpc]) == [x, x]


def test_damage_is_found():
    raw = payloads()[3]
    good = C.encode([raw])[0]
    r = random.Random(2)
    for _ in range(60):
        at = r.randrange(42 + 4, len(good))
        bad = good[:at] + bytes([good[at] ^ (1 << r.randrange(8))]) + good[at + 1 :]
        try:
            assert C.decode([bad])[0] == raw  # only unused bits of a seek point
        except (ValueError, KeyError, IndexError):
            pass
    with pytest.raises(ValueError):
        C.decode([good[:-1] + bytes([good[-1] ^ 1])])


def test_partitions_escapes_and_no_seek_table():
    """A stream put together by hand: two frames, no seek points, Rice partitions, one of them raw."""
    x = [5, -3, 0, 7, 1, 1, -120, 90] * 2

    def frame(number):
        bits = "0" + "001001" + "0" + format(x[0] & 255, "08b")  # fixed, order 1
        res = [b - a for a, b in zip(x, x[1:])]
        bits += "00" + "0001"  # 4-bit parameters, 2 partitions
        k = 3
        bits += format(k, "04b")
        for v in res[:7]:
            u = (v << 1) ^ (v >> 31)
            bits += "0" * (u >> k) + "1" + format(u & 7, "03b")
        bits += "1111" + format(9, "05b") + "".join(format(v & 511, "09b") for v in res[7:])
        bits += "0" * (-len(bits) % 8)
        body = C._frame_head(number, 16) + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        return body + C._Crc16._plain(np.frombuffer(body, np.uint8)).to_bytes(2, "big")

    info = (16).to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | 32).to_bytes(8, "big") + hashlib.md5(np.array(x * 2, np.int8).tobytes()).digest()
    stream = b"fLaC\x80" + (34).to_bytes(3, "big") + info + frame(0) + frame(1)
    assert C.decode_samples([stream])[0].tolist() == x * 2


def test_crc16_known_value():
    run = np.frombuffer(b"123456789", np.uint8)
    assert C._Crc16._plain(run) == 0xFEE8
    assert C._crc16.of(run, np.array([0, 0]), np.array([9, 4]))[0] == 0xFEE8
    assert C.crc8(b"123456789") == 0xF4


def test_frames(spark):
    rows = [(1, None, b""), (2, "", b""), (None, "ab" * 5000, b"x"), (4, "ab" * 5000, b"y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    out = {r["doc_id"]: r for r in C.digests(C.with_media(df)).collect()}
    assert out[1]["payload_bytes"] == 64 and out[1][1:] == out[2][1:] and out[None][1:] == out[4][1:]
    raw = C.payload("ab" * 5000)
    assert (out[4]["n_bytes"], out[4]["payload_sha256"], out[4]["tail_crc32"]) == (10_000, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    parts = sorted((r["sample_offset"], bytes(r["pcm"])) for r in C.blocks(C.with_media(df.where("doc_id = 4"))).collect())
    assert [o for o, _ in parts] == [0, 4096, 8192] and b"".join(x for _, x in parts) == raw
    assert C.digests(C.with_media(df.limit(0))).count() == 0


def read_plainly(stream):
    """A second reader of the format, bit by bit: (samples, kinds of subframes)."""
    bits = "".join(format(b, "08b") for b in stream)
    at = 32

    def take(n, signed=False):
        nonlocal at
        v = int(bits[at : at + n] or "0", 2)
        at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    assert stream[:4] == b"fLaC"
    last = total = 0
    while not last:
        last, kind, size = take(1), take(7), take(24)
        if kind == 0:
            at += 80 + 20 + 3 + 5
            total = take(36)
            at += 128
        else:
            at += 8 * size
    out, kinds = [], []
    while len(out) < total:
        begin = at // 8
        assert take(16) == 0xFFF8 and take(16) == 0x7002
        lead = take(8)
        at += 8 * (0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1)
        n = take(16) + 1
        at += 8 + 1
        kind = take(6)
        assert not take(1)
        kinds.append(kind)
        if kind == 0:
            x = [take(8, True)] * n
        elif kind == 1:
            x = [take(8, True) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [take(8, True) for _ in range(order)]
            q, shift = {0: [], 1: [1], 2: [2, -1]}.get(order if kind < 32 else None), 0
            if kind >= 32:
                width = take(4) + 1
                shift = take(5, True)
                q = [take(width, True) for _ in range(order)]
            assert take(2) == 0 and take(4) == 0
            k = take(4)
            while len(x) < n:
                one = bits.index("1", at)
                u, at = one - at, one + 1
                u = u << k | take(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(c * v for c, v in zip(q, x[::-1])) >> shift))
        at += -at % 8
        assert C._Crc16._plain(np.frombuffer(stream[begin : at // 8], np.uint8)) == take(16)
        out += x
    return bytes(v + 128 for v in out), kinds


def test_a_second_reader_agrees():
    raw = payloads()
    read = [read_plainly(x) for x in C.encode(raw)]
    assert [x for x, _ in read] == raw
    kinds = {k for _, ks in read for k in ks}
    assert {0, 1, 31 + C.LPC_ORDER} <= kinds and kinds & {8, 9, 10}


def test_seek():
    raw = payloads()
    streams = C.encode(raw)
    wanted = [(s, a, z) for s, x in zip(streams, raw) for a, z in ((0, 1), (len(x) - 64, len(x)), (len(x) // 3, len(x) // 3 + 5000))]
    assert C.samples(wanted) == [dict(zip(streams, raw))[s][a:z] for s, a, z in wanted]
    # only the frames that hold them are read: damage elsewhere isn't seen, damage there is
    head = C.Stream(streams[3])
    third = head.first + int(head.points["offset"][2]) + 20
    bad = streams[3][:third] + bytes([streams[3][third] ^ 1]) + streams[3][third + 1 :]
    assert C.samples([(bad, 0, 8192)]) == [raw[3][:8192]]
    with pytest.raises(ValueError):
        C.samples([(bad, 8192, 8193)])
    assert b"".join(x for _, x in C.pcm_blocks(streams[3], 1000, 3000)) == raw[3]
    with pytest.raises(ValueError):
        list(C.pcm_blocks(bad))


def test_small_groups_give_the_same(monkeypatch):
    raw = payloads()
    whole = C.encode(raw)
    monkeypatch.setattr(C, "GROUP", 2 * C.BLOCK)
    assert C.encode(raw) == whole and C.decode(whole) == raw


def test_no_payloads():
    assert C.encode([]) == [] and C.decode([]) == [] and C.samples([]) == []

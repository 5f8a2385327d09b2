import hashlib
import random
import zlib

import numpy as np
import pytest

from veilspark.llm import flac


class Bits:
    def __init__(self, data):
        self.v, self.n, self.at = int.from_bytes(data), len(data) * 8, 0

    def take(self, k):
        self.at += k
        return self.v >> (self.n - self.at) & ((1 << k) - 1)

    def signed(self, k):
        v = self.take(k)
        return v - (1 << k) if v >> (k - 1) else v


def slow_crc(data, poly, bits):
    crc = 0
    for b in data:
        crc ^= b << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc >> (bits - 1) else crc << 1) & ((1 << bits) - 1)
    return crc


def slow_decode(stream):
    """A plain reader of the published format, one bit after the other."""
    assert stream[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        size = int.from_bytes(stream[at + 1 : at + 4])
        if stream[at] & 127 == 0:
            total = int.from_bytes(stream[at + 14 : at + 22]) & (1 << 36) - 1
        last, at = stream[at] >= 128, at + 4 + size
    out, frame = [], 0
    while at < len(stream):
        b = Bits(stream[at : at + 2000] + bytes(8))
        assert b.take(16) == 0xFFF8 and b.take(4) == 2
        b.take(12)
        lead = b.take(8)
        number = lead
        if lead >= 0xC0:
            n = 8 - (lead ^ 0xFF).bit_length()
            number = lead & (0x7F >> n)
            for _ in range(n - 1):
                number = number << 6 | b.take(8) & 63
        assert number == frame
        head = b.at // 8
        assert b.take(8) == slow_crc(stream[at : at + head], 7, 8)
        kind = b.take(8) >> 1
        x = []
        if kind == 0:
            x = [b.signed(8)] * 576
        elif kind == 1:
            x = [b.signed(8) for _ in range(576)]
        else:
            order = kind - 8 if kind < 16 else kind - 31
            x = [b.signed(8) for _ in range(order)]
            shift, coef = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 16 else None
            if kind >= 32:
                width = b.take(4) + 1
                shift = b.take(5)
                coef = [b.signed(width) for _ in range(order)]
            assert b.take(6) == 0
            k = b.take(4)
            while len(x) < 576:
                q = 0
                while not b.take(1):
                    q += 1
                u = q << k | b.take(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(c * v for c, v in zip(coef, x[::-1])) >> shift))
        out += x
        size = (b.at + 7) // 8
        assert int.from_bytes(stream[at + size : at + size + 2]) == slow_crc(stream[at : at + size], 0x8005, 16)
        at += size + 2
        frame += 1
    assert total == len(out)
    return bytes(v + 128 for v in out)


def payloads():
    rng = np.random.default_rng(1)
    ramp = bytes((i * i // 300) % 256 for i in range(576))
    tone = bytes(int(128 + 90 * np.sin(i / 9) + 20 * np.sin(i / 2.3)) for i in range(1152))
    return [flac.pad(x) for x in (b"", b"a", "héllo wörld ".encode() * 100, bytes(1000), rng.bytes(1500), ramp, tone, b"the cat " * 20000)]


def test_round_trip_and_format():
    own = payloads()
    media = flac.encode_payloads(own)
    assert flac.decode_streams(media) == own
    for p, m in zip(own[:7], media):
        assert slow_decode(m) == p
    assert len(media[6]) < len(own[6])  # prediction pays on a tone
    assert flac.encode_payloads([]) == flac.decode_streams([]) == []


def test_damage_is_found():
    media = flac.encode_payloads(payloads())[2]
    for i in range(len(media) - 400, len(media), 37):
        with pytest.raises(ValueError):
            flac.decode_streams([media[:i] + bytes([media[i] ^ 4]) + media[i + 1 :]])


def test_blocks():
    p = payloads()[-1]
    m = flac.encode_payloads([p])[0]
    got = list(flac.blocks(m))
    assert [b[0] for b in got] == list(range(0, len(p), 576 * flac.SEEK))
    assert b"".join((np.frombuffer(b[2], np.uint8) ^ 0x80).tobytes() for b in got) == p


def test_columns(spark):
    random.seed(2)
    texts = [None, "", "abc", "a" * 576, "é日本" * 5000, "abc"] + ["".join(random.choices("abcdef \n", k=700)) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r.doc_id: r for r in flac.round_trip(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = flac.pad(raw)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert len(p) % 576 == 0 and len(p) >= 576
    assert rows[0][1:] == rows[1][1:] and rows[2][1:] == rows[5][1:]
    assert flac.round_trip(df.limit(0)).collect() == []
    made = flac.encode(df.drop("feature"))
    back = flac.pcm_blocks(made).where("doc_id = 4").orderBy("sample_offset").collect()
    assert b"".join((np.frombuffer(r.pcm, np.uint8) ^ 0x80).tobytes() for r in back) == flac.pad(texts[4].encode())

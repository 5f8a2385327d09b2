"""FLAC media columns: 8-bit mono streams, written, read back and indexed.

``encode_payloads`` and ``decode_streams`` work on many frames side by side:
step i of a recurrence (Rice codes, linear prediction, checksums) is done for
all frames of a block at once. The encoder picks the shortest of constant,
fixed (orders 0 to 4), linear-predictive (order 8, quantised) and verbatim
subframes; the decoder reads all of these, checks the CRC-8 of every header,
the CRC-16 of every frame and the MD5 of the whole stream, and gives PCM blocks
with their sample offsets, which are also the stream's seek table.

A byte b is stored as the sample b - 128. Frames hold 576 samples.

Defined cases: null and empty texts are one frame of padding; equal payloads
give equal streams; a stream that fails a checksum raises ``ValueError``. One
payload must fit into a worker's memory; frames are worked on in blocks of
bounded size however long the payload is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import sha256, slices, small_batches

SIZE = 576
#: Frames that are worked on side by side.
LANES = 4096
#: A seek point every so many frames.
SEEK = 64
RATE = 8000
_LPC, _PRECISION = 8, 12
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint32)


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc(rows: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Checksum of the first ``lengths`` bytes of every row."""
    table, crc = (_CRC8, np.zeros(len(rows), np.uint32)) if bits == 8 else (_CRC16, np.zeros(len(rows), np.uint32))
    across = np.ascontiguousarray(rows.T)
    least = int(lengths.min(initial=0))
    for i in range(int(lengths.max(initial=0))):
        new = table[crc ^ across[i]] if bits == 8 else (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ across[i]]
        crc = new if i < least else np.where(i < lengths, new, crc)
    return crc


def _coded(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | n >> 6 * i & 0x3F for i in reversed(range(size - 1))]
    lead = (0xFF << (8 - size)) & 0xFF | n >> 6 * (size - 1)
    return bytes([lead, *tail])


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients, shifts and validity for rows of samples (Levinson-Durbin on a windowed autocorrelation)."""
    n = x.shape[1]
    w = x.astype(np.float64) * (1 - ((np.arange(n) - (n - 1) / 2) / ((n + 1) / 2)) ** 2)
    r = np.stack([np.einsum("ij,ij->i", w[:, : n - k], w[:, k:]) for k in range(_LPC + 1)], 1)
    a, err = np.zeros((len(x), _LPC)), r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(_LPC):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        new = a.copy()
        new[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        new[:, i] = k
        a, err = new, np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(_PRECISION - 1 - np.floor(np.log2(top)).astype(np.int64) - 1, 0, 15)
    q = np.rint(a * 2.0 ** shift[:, None]).astype(np.int64)
    limit = 1 << (_PRECISION - 1)
    ok = (np.abs(q) < limit).all(1) & (r[:, 0] > 0)
    return np.clip(q, -limit, limit - 1), shift, ok


def _rice(res: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Good parameter of each row of residuals, and the bits it takes."""
    u = res << 1 ^ res >> 31
    mean = u.sum(1, dtype=np.int64) // u.shape[1]
    near = np.frexp(np.maximum(mean, 1).astype(np.float64))[1] - 1
    best, bits = np.zeros(len(u), np.int64), np.full(len(u), 1 << 60, np.int64)
    for step in (-1, 0, 1):
        k = np.clip(near + step, 0, 14)
        cost = (u >> k[:, None].astype(np.int32)).sum(1, dtype=np.int64) + (k + 1) * u.shape[1]
        better = cost < bits
        best, bits = np.where(better, k, best), np.where(better, cost, bits)
    return best, bits


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


def _frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """FLAC frames of rows of samples (int32, -128 to 127)."""
    n = len(x)
    header = [b"\xff\xf8\x24\x02" + _coded(i) for i in numbers.tolist()]  # 576 samples, 8 kHz, mono, 8 bits
    wide = np.zeros((n, 12), np.uint8)
    size = np.fromiter(map(len, header), np.int64, n)
    for i, h in enumerate(header):
        wide[i, : len(h)] = np.frombuffer(h, np.uint8)
    crc8 = _crc(wide, size, 8)
    coefs, shift, ok = _lpc(x)
    coefs, shift = coefs.astype(np.int32), shift.astype(np.int32)
    # kinds 0..4: fixed of that order; 5: linear predictive; 6: verbatim; 7: constant
    residual = [x]
    for _ in range(4):
        residual.append(np.diff(residual[-1], axis=1))
    fixed = np.stack([np.abs(r).sum(1, dtype=np.int64) for r in residual], 1).argmin(1)
    pred = coefs[:, :1] * x[:, _LPC - 1 : SIZE - 1]
    for j in range(1, _LPC):
        pred += coefs[:, j : j + 1] * x[:, _LPC - 1 - j : SIZE - 1 - j]
    residual.append(x[:, _LPC:] - (pred >> shift[:, None]))
    head = [8 * k for k in range(5)] + [8 * _LPC + 9 + _LPC * _PRECISION]
    param, bits_of = np.zeros((n, 6), np.int64), np.full((n, 7), 1 << 60, np.int64)
    for k in range(6):
        rows = np.flatnonzero(fixed == k) if k < 5 else np.flatnonzero(ok)
        if len(rows):
            param[rows, k], bits_of[rows, k] = _rice(residual[k][rows])
            bits_of[rows, k] += head[k] + 10
    bits_of[:, 6] = 8 * SIZE
    kind = bits_of.argmin(1)
    kind[(x == x[:, :1]).all(1)] = 7
    out: list[bytes] = [b""] * n
    for k in range(8):
        rows = np.flatnonzero(kind == k)
        if not len(rows):
            continue
        order = k if k < 5 else _LPC if k == 5 else 0
        base = 8 * size[rows] + 8
        own = x[rows] & 0xFF
        if k == 7:
            total = base + 16
        elif k == 6:
            total = base + 8 + 8 * SIZE
        else:
            own_param = param[rows, k]
            total = base + 8 + bits_of[rows, k]
        total = (total + 7) // 8 * 8
        start = np.concatenate([[0], np.cumsum(total + 16)])  # the checksum follows
        bits = np.zeros(int(start[-1]), np.uint8)
        at = start[:-1] + base
        _put(bits, at, np.full(len(rows), {7: 0, 6: 2}.get(k, (8 + k) << 1 if k < 5 else (32 + _LPC - 1) << 1)), 8)
        at = at + 8
        if k == 7:
            _put(bits, at, own[:, 0], 8)
        elif k == 6:
            for i in range(SIZE):
                _put(bits, at + 8 * i, own[:, i], 8)
        else:
            for i in range(order):
                _put(bits, at, own[:, i], 8)
                at = at + 8
            if k == 5:
                _put(bits, at, np.full(len(rows), _PRECISION - 1), 4)
                _put(bits, at + 4, shift[rows], 5)
                at = at + 9
                for j in range(_LPC):
                    _put(bits, at, coefs[rows, j] & ((1 << _PRECISION) - 1), _PRECISION)
                    at = at + _PRECISION
            _put(bits, at + 6, own_param, 4)  # method 0, one partition
            at = at + 10
            res = residual[k][rows]
            u = (res << 1 ^ res >> 31).astype(np.int64)
            for p in np.unique(own_param).tolist():
                some = np.flatnonzero(own_param == p)
                v = u[some]
                q = v >> p
                one = np.cumsum(q + (1 + p), 1)
                one += at[some][:, None] - (1 + p)  # where each unary part ends
                bits[one.ravel()] = 1
                for j in range(p):
                    bits[(one + (1 + j)).ravel()] = (v >> (p - 1 - j) & 1).ravel()
        packed = np.packbits(bits)
        ends = (total // 8).astype(np.int64)
        offset = start[:-1] // 8
        most = int(ends.max())
        grid = np.zeros((len(rows), most + 2), np.uint8)
        for j, (i, o, e) in enumerate(zip(rows.tolist(), offset.tolist(), ends.tolist(), strict=True)):
            grid[j, :e] = packed[o : o + e]
            h = header[i]
            grid[j, : len(h)] = np.frombuffer(h, np.uint8)
            grid[j, len(h)] = crc8[i]
        crc = _crc(grid, ends, 16)
        line = np.arange(len(rows))
        grid[line, ends] = crc >> 8
        grid[line, ends + 1] = crc & 0xFF
        for j, (i, e) in enumerate(zip(rows.tolist(), ends.tolist(), strict=True)):
            out[i] = grid[j, : e + 2].tobytes()
    return out


def pad(data: bytes) -> bytes:
    """The payload: bytes 255 appended up to a positive multiple of the frame size."""
    return data + b"\xff" * (-len(data) % SIZE if data else SIZE)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, whose lengths are positive multiples of the frame size."""
    counts = [len(p) // SIZE for p in payloads]
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIZE)
    frames: list[bytes] = []
    for i in range(0, len(raw), LANES):
        frames += _frames(raw[i : i + LANES].astype(np.int32) - 128, numbers[i : i + LANES])
    out, done = [], 0
    for p, c in zip(payloads, counts, strict=True):
        own = frames[done : done + c]
        done += c
        sizes = [len(f) for f in own]
        pcm = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = SIZE.to_bytes(2) * 2 + min(sizes).to_bytes(3) + max(sizes).to_bytes(3)
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8) + hashlib.md5(pcm).digest()
        offsets = np.cumsum([0, *sizes]).tolist()
        seek = b"".join((i * SIZE).to_bytes(8) + offsets[i].to_bytes(8) + SIZE.to_bytes(2) for i in range(0, c, SEEK))
        out.append(b"fLaC\x00" + len(info).to_bytes(3) + info + b"\x83" + len(seek).to_bytes(3) + seek + b"".join(own))
    return out


class _Reader:
    """A bit cursor per lane over one buffer."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    def take(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The next bits of these lanes as an unsigned number (up to 24 bits)."""
        p = self.at[rows]
        byte = p >> 3
        word = self.data[byte] << 24 | self.data[byte + 1] << 16 | self.data[byte + 2] << 8 | self.data[byte + 3]
        self.at[rows] = p + width
        return word >> (32 - width - (p & 7)) & ((1 << width) - 1)

    def signed(self, rows: np.ndarray, width: int) -> np.ndarray:
        v = self.take(rows, width)
        return np.where(v >> (width - 1), v - (1 << width), v)


#: Zero bits before the first one in a byte.
_ZEROS = np.array([8 - b.bit_length() for b in range(256)], np.int64)


def _unary(r: _Reader, rows: np.ndarray) -> np.ndarray:
    """Zeros before the next one bit of each lane; the cursor ends after the one."""
    count = np.zeros(len(rows), np.int64)
    todo = np.arange(len(rows))
    while len(todo):
        own = rows[todo]
        p = r.at[own]
        bits = r.data[p >> 3] << 8 | r.data[(p >> 3) + 1]
        zeros = _ZEROS[bits >> (8 - (p & 7)) & 0xFF]
        count[todo] += zeros
        r.at[own] = p + np.minimum(zeros + 1, 8)
        todo = todo[zeros == 8]
    return count


def _decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Samples of the frames data[start:end], checksums verified."""
    n, sizes = len(start), end - start
    grid = np.zeros((n, int(sizes.max()) + 1), np.uint8)
    for j, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        grid[j, : e - s] = data[s:e]
    line = np.arange(n)
    told = grid[line, sizes - 2].astype(np.uint32) << 8 | grid[line, sizes - 1]
    if (_crc(grid, sizes - 2, 16) != told).any():
        raise ValueError("a frame's checksum does not match")
    heads = [b"\xff\xf8\x24\x02" + _coded(i) for i in numbers.tolist()]
    head = np.fromiter(map(len, heads), np.int64, n)
    if (_crc(grid[:, :12], head, 8) != grid[line, head]).any() or any(grid[j, : len(h)].tobytes() != h for j, h in enumerate(heads)):
        raise ValueError("a frame's header does not match")
    r = _Reader(np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64), 8 * (start + head + 1))
    kind = r.take(line, 8) >> 1
    x = np.zeros((SIZE, n), np.int64)
    constant, verbatim = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if len(constant):
        x[:, constant] = r.signed(constant, 8)
    for i in range(SIZE if len(verbatim) else 0):
        x[i, verbatim] = r.signed(verbatim, 8)
    rest = np.flatnonzero(kind >= 8)
    if ((kind > 1) & ((kind < 8) | (kind > 12) & (kind < 32))).any():
        raise ValueError("an unknown kind of subframe")
    order = np.where(kind >= 32, kind - 31, kind - 8)
    coefs, shift = np.zeros((32, n), np.int64), np.zeros(n, np.int64)
    for o in range(1, 5):
        coefs[:o, kind == 8 + o] = np.array(_FIXED[o])[:, None]
    for i in range(int(order[rest].max(initial=0))):
        rows = rest[order[rest] > i]
        x[i, rows] = r.signed(rows, 8)
    lpc = np.flatnonzero(kind >= 32)
    if len(lpc):
        precision = r.take(lpc, 4) + 1
        shift[lpc] = r.take(lpc, 5)
        for j in range(int(order[lpc].max())):
            for p in np.unique(precision):
                rows = lpc[(order[lpc] > j) & (precision == p)]
                coefs[j, rows] = r.signed(rows, int(p))
    if len(rest):
        if r.take(rest, 6).any():
            raise ValueError("an unknown kind of residual")
        param = np.zeros(n, np.int64)
        param[rest] = r.take(rest, 4)
        most = int(order[rest].max())
        whole = param[rest]
        for i in range(SIZE):
            rows, k = (rest, whole) if i >= most else ((live := rest[order[rest] <= i]), param[live])
            if not len(rows):
                continue
            u = _unary(r, rows) << k
            p = r.at[rows]
            byte = p >> 3
            word = r.data[byte] << 16 | r.data[byte + 1] << 8 | r.data[byte + 2]
            u |= word >> (24 - k - (p & 7)) & ((1 << k) - 1)
            r.at[rows] = p + k
            value = u >> 1 ^ -(u & 1)
            top = min(i, most)
            if top:
                value = value + ((coefs[:top, rows] * x[i - top : i, rows][::-1]).sum(0) >> shift[rows])
            x[i, rows] = value
    return x.T


def _layout(stream: bytes) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """First frame's offset, samples, MD5 and seek points (sample, offset)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, b"", []
    while not last:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        last, at = kind >= 128, at + 4 + size
        if kind & 127 == 0:
            info = body
        elif kind & 127 == 3:
            points = [(int.from_bytes(body[i : i + 8]), int.from_bytes(body[i + 8 : i + 16])) for i in range(0, size, 18)]
    packed = int.from_bytes(info[10:18])
    if info[:4] != SIZE.to_bytes(2) * 2 or packed >> 36 & 31 != 7 or packed >> 41 & 7:
        raise ValueError("not 8-bit mono in frames of the expected size")
    return at, packed & (1 << 36) - 1, info[18:34], points


def _bounds(stream: bytes, first: int, number: int, frames: int, end: int) -> list[int]:
    """Frame starts and the end: sync code and number, the header's checksum, then that of the frame before."""
    out, at = [first], first
    for i in range(number + 1, number + frames):
        head = b"\xff\xf8\x24\x02" + _coded(i)
        head += bytes([_crc_of(head, 8)])
        at = stream.find(head, at + len(head), end)
        while at >= 0 and _crc_of(stream[out[-1] : at - 2], 16) != int.from_bytes(stream[at - 2 : at]):
            at = stream.find(head, at + 1, end)
        if at < 0:
            raise ValueError("a frame is missing")
        out.append(at)
    return [*out, end]


def _crc_of(data: bytes, bits: int) -> int:
    if bits == 8:
        crc = 0
        for b in data:
            crc = int(_CRC8[crc ^ b])
        return crc
    crc = 0
    table = _CRC16_LIST
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ b]
    return crc


_CRC16_LIST = _CRC16.tolist()


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """Payloads of streams, read block by block through their seek points; every checksum is verified."""
    starts, ends, numbers, sizes, sums, base = [], [], [], [], [], 0
    for s in streams:
        samples, md5, found = _seek(s)
        for sample, _, edge in found:
            starts += [base + e for e in edge[:-1]]
            ends += [base + e for e in edge[1:]]
            numbers += range(sample // SIZE, sample // SIZE + len(edge) - 1)
        sizes.append(samples)
        sums.append(md5)
        base += len(s)
    data = np.frombuffer(b"".join(streams), np.uint8)
    parts = []
    a, b, c = np.array(starts, np.int64), np.array(ends, np.int64), np.array(numbers, np.int64)
    for i in range(0, len(a), LANES):
        low, high = int(a[i]), int(b[min(i + LANES, len(b)) - 1])
        parts.append(_decode_frames(data[low:high], a[i : i + LANES] - low, b[i : i + LANES] - low, c[i : i + LANES]))
    pcm = (np.concatenate(parts).astype(np.int8).view(np.uint8) if parts else np.zeros(0, np.uint8)).tobytes()
    out, at = [], 0
    for n, md5 in zip(sizes, sums, strict=True):
        own = pcm[at : at + n]
        at += n
        if hashlib.md5(own).digest() != md5:
            raise ValueError("the stream's MD5 does not match")
        out.append((np.frombuffer(own, np.uint8) ^ 0x80).tobytes())
    return out


def _find(stream: bytes, first: int, number: int, frames: int, end: int) -> list[int]:
    """Starts of the frames from ``number`` on, which lie between two offsets, and the end.

    A header that is not followed by a frame fails its checksum later. The quick way takes the first place of each
    expected header. Where the payload happens to contain such a header, frames fail and the careful way checks the
    frame before each candidate.
    """
    out, at = [first], first
    for i in range(number + 1, number + frames):
        head = _head(i)
        at = stream.find(head, at + 8, end)
        if at < 0 or stream.find(head, at + 1, min(end, at + 2 * SIZE)) >= 0:
            return _bounds(stream, first, number, frames, end)
        out.append(at)
    return [*out, end]


def _seek(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, list[int]]]]:
    """Samples, MD5 and, for each seek point, its sample, its offset and the starts of the frames up to the next one.

    Each point is gone to by its offset; nothing before it is looked at.
    """
    first, samples, md5, points = _layout(stream)
    out = []
    for k, (sample, offset) in enumerate(points):
        stop, end = (points[k + 1][0], first + points[k + 1][1]) if k + 1 < len(points) else (samples, len(stream))
        number = sample // SIZE
        if not stream.startswith(_head(number), first + offset):
            raise ValueError("a seek point does not lead to its frame")
        out.append((sample, first + offset, _find(stream, first + offset, number, stop // SIZE - number, end)))
    return samples, md5, out


_HEADS: dict[int, bytes] = {}


def _head(i: int) -> bytes:
    if i not in _HEADS:
        head = b"\xff\xf8\x24\x02" + _coded(i)
        if len(_HEADS) > 1 << 16:
            _HEADS.clear()
        _HEADS[i] = head + bytes([_crc_of(head, 8)])
    return _HEADS[i]


def blocks(stream: bytes) -> Iterator[tuple[int, int, bytes]]:
    """PCM blocks (sample offset, stream offset of the first frame, signed samples), one per seek point.

    Any block can be read by itself from its stream offset on.
    """
    data = np.frombuffer(stream, np.uint8)
    for sample, offset, edge in _seek(stream)[2]:
        at = np.array(edge) - offset
        x = _decode_frames(data[offset : edge[-1]], at[:-1], at[1:], np.arange(len(at) - 1) + sample // SIZE)
        yield sample, offset, x.astype(np.int8).tobytes()


def encode(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Adds the stream of each text's payload."""
    keep = [f for f in df.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = encode_payloads([pad((t or "").encode()) for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(made, pa.binary())], names=[f.name for f in keep] + [out])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` binary"]))


def pcm_blocks(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per PCM block: the key, sample_offset, stream_offset, pcm. A null stream has no blocks."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, stream in zip(batch.column(key), batch.column(media), strict=True):
                if stream.is_valid:
                    for sample, offset, pcm in blocks(stream.as_py()):
                        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], batch.schema.field(key).type), pa.array([sample], pa.int64()), pa.array([offset], pa.int64()), pa.array([pcm], pa.binary())], names=[key, "sample_offset", "stream_offset", "pcm"])

    return df.mapInArrow(run, f"`{key}` {kind}, sample_offset long, stream_offset long, pcm binary")


def feature(payload: bytes) -> str:
    """Blocks, mean, energy and sign changes of the samples, as integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"blocks={len(x) // SIZE};sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def round_trip(df: DataFrame, text: str = "text") -> DataFrame:
    """Stores each text, reads the stored stream back, and returns sizes, digests and a feature of what was read."""
    made = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pcm_blocks long"
    names = [x.split()[0] for x in made.split(", ")]
    keep = [f for f in df.schema if f.name not in (text, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            raw = [(t or "").encode() for t in batch.column(text).to_pylist()]
            media = encode_payloads([pad(r) for r in raw])
            back = decode_streams(media)
            rows = [(len(r), len(b), sha256(b), zlib.crc32(b[-32:]), len(m), sha256(m), feature(b), len(_layout(m)[3])) for r, m, b in zip(raw, media, back, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(c) for c in zip(*rows, strict=True)], names=[f.name for f in keep] + names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [made]))

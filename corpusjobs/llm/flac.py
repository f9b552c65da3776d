"""Media columns: FLAC streams of 8-bit mono samples, coded and decoded by numpy inside Spark tasks.

The decoder reads constant, verbatim, fixed and linear-predictor subframes with Rice-coded residuals of any
partition order and escape codes, for mono streams of up to 16 bits, verifies the CRC-8 of every frame header, the CRC-16 of every
frame and the MD5 of the samples, and gives the samples as PCM blocks with their sample offsets. Frames are
found by the seek table, which has a point for every frame; all frames of a batch are decoded side by side,
one residual of each frame per step.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: Fixed values of the format: CRC polynomials, coefficients of the fixed predictors, coded block sizes.
CRC8, CRC16 = 0x07, 0x8005
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
#: Samples of a frame, and the unit that payloads are filled up to.
FRAME, UNIT, RATE = 4608, 192, 8000
#: The linear predictor that streams of texts try beside the fixed ones, as (coefficients, their precision, shift): the mean of eight samples.
MEAN = ((1,) * 8, 2, 3)


# -- checksums ------------------------------------------------------------------------------------


@cache
def crc_table(poly: int, width: int, n: int) -> np.ndarray:
    """CRC of a byte that has i bytes behind it, for i below n; a CRC is the union of those of its bytes."""
    kind = np.uint16 if width == 16 else np.uint8
    first = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        first = np.where(first >> (width - 1) & 1, first << 1 ^ poly, first << 1) & ((1 << width) - 1)
    rows = np.empty((n, 256), kind)
    rows[0] = first
    for i in range(1, n):
        last = rows[i - 1].astype(np.uint32)
        rows[i] = (last << 8 & ((1 << width) - 1)) ^ first[last >> (width - 8)]
    return rows


def crc(data: np.ndarray, poly: int, width: int) -> int:
    step = 64 if len(data) <= 64 else 8192
    table, out = crc_table(poly, width, step), 0
    for at in range(len(data) % step - step if len(data) % step else 0, len(data), step):
        part = data[max(at, 0) : at + step]
        if at > 0 or at == 0 and out:  # the remainder so far goes into the first bytes of what follows
            part = part.copy()
            part[: width // 8] ^= np.frombuffer(out.to_bytes(width // 8, "big"), np.uint8)
        out = int(np.bitwise_xor.reduce(table[np.arange(len(part) - 1, -1, -1), part], initial=0))
    return out


# -- coding ---------------------------------------------------------------------------------------


def utf8_number(n: int) -> bytes:
    """The extended UTF-8 coding of a frame number (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    size = next(i for i in range(2, 8) if n < 1 << (5 * i + 1))
    return bytes([0xFF << (8 - size) & 0xFF | n >> 6 * (size - 1), *(0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1))])


def pack_bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bits (0 or 1) of the values, each most significant bit first in its own width."""
    total = int(widths.sum())
    starts = np.cumsum(widths) - widths
    place = np.arange(total) - np.repeat(starts, widths)
    return (np.repeat(values, widths) >> (np.repeat(widths, widths) - 1 - place) & 1).astype(np.uint8)


def rice_bits(zigzag: np.ndarray, k: int) -> np.ndarray:
    """Bits of Rice codes: the quotient in unary, a one, then k bits."""
    quotient = zigzag >> k
    ends = np.cumsum(quotient + 1 + k)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    one = ends - k - 1
    bits[one] = 1
    for j in range(k):
        bits[one + 1 + j] = zigzag >> (k - 1 - j) & 1
    return bits


def best_k(zigzag: np.ndarray) -> tuple[int, int]:
    """(bits, k) of the cheapest Rice parameter."""
    mean = zigzag.mean() if len(zigzag) else 0
    near = max(0, int(np.log2(mean + 1)))
    return min((len(zigzag) * (1 + k) + int((zigzag >> k).sum()), k) for k in {max(0, near - 1), min(14, near), min(14, near + 1)})


def predicted(samples: np.ndarray, taps: tuple[int, ...], shift: int = 0) -> np.ndarray:
    """Residuals after the first len(taps) samples."""
    n = len(taps)
    if set(taps) == {1}:
        totals = np.concatenate((np.zeros(1, samples.dtype), np.cumsum(samples, dtype=samples.dtype)))
        return samples[n:] - (totals[n:-1] - totals[: -n - 1] >> shift)
    guess = sum((c * samples[n - 1 - i : len(samples) - 1 - i] for i, c in enumerate(taps)), np.zeros(len(samples) - n, samples.dtype))
    return samples[n:] - (guess >> shift)


def subframe(samples: np.ndarray, bits: int, order: int = 0, lpc: tuple[tuple[int, ...], int, int] | None = None, choose: bool = False) -> np.ndarray:
    """Bits of the cheapest subframe among constant, verbatim and the fixed predictors, or that of the linear
    predictor lpc = (coefficients, their precision, shift): always, or with `choose` where it is cheaper than all others.
    order: partition order of the residuals."""
    unsigned = samples & ((1 << bits) - 1)
    plain = lpc is None or choose
    linear = lpc is not None and len(samples) > len(lpc[0])
    if plain and (samples == samples[0]).all():
        return pack_bits(np.array([0, unsigned[0]]), np.array([8, bits]))
    if plain:
        tries = [samples]  # a fixed predictor of order n leaves the n-th differences
        for _ in FIXED[1 : len(samples)]:
            tries.append(np.diff(tries[-1]))
        n = min(range(len(tries)), key=lambda i: int(np.abs(tries[i]).sum()))
        z = zigzag(tries[n])
        cost = n * bits + best_k(z)[0] + 10
        if linear:
            guessed = zigzag(predicted(samples, lpc[0], lpc[2]))
            linear = len(lpc[0]) * (bits + lpc[1]) + 9 + best_k(guessed)[0] + 10 < min(cost, bits * len(samples))
        if not linear and cost >= bits * len(samples):
            return np.concatenate((pack_bits(np.array([2]), np.array([8])), pack_bits(unsigned, np.full(len(samples), bits))))
        head = [np.array([(8 + n) << 1]), np.array([8])]
        warm = n
        extra = np.zeros(0, np.uint8)
    if linear:
        taps, precision, shift = lpc
        warm = len(taps)
        z = guessed if plain else zigzag(predicted(samples, taps, shift))
        head = [np.array([(32 + warm - 1) << 1]), np.array([8])]
        extra = np.concatenate((pack_bits(np.array([precision - 1, shift]), np.array([4, 5])), pack_bits(np.array(taps) & ((1 << precision) - 1), np.full(warm, precision))))
    out = [pack_bits(*head), pack_bits(unsigned[:warm], np.full(warm, bits)), extra, pack_bits(np.array([0, order]), np.array([2, 4]))]
    each = len(samples) >> order
    for i in range(1 << order):
        part = z[max(0, i * each - warm) : (i + 1) * each - warm]
        k = best_k(part)[1]
        out += [pack_bits(np.array([k]), np.array([4])), rice_bits(part, k)]
    return np.concatenate(out)


def zigzag(residuals: np.ndarray) -> np.ndarray:
    return (residuals << 1) ^ (residuals >> 31)


def encode(payload: bytes, frame: int = FRAME, order: int = 0, lpc: tuple[tuple[int, ...], int, int] | None = None, choose: bool = False) -> bytes:
    """A FLAC stream whose 8-bit samples are the bytes of the payload less 128; see subframe() for the choices."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    frames, points, at = [], [], 0
    for number, start in enumerate(range(0, len(samples), frame)):
        part = samples[start : start + frame]
        head = struct.pack(">HBB", 0xFFF8, 0x70, 1 << 1) + utf8_number(number) + struct.pack(">H", len(part) - 1)
        head += bytes([crc(np.frombuffer(head, np.uint8), CRC8, 8)])
        body = head + np.packbits(subframe(part, 8, order, lpc, choose)).tobytes()
        body += struct.pack(">H", crc(np.frombuffer(body, np.uint8), CRC16, 16))
        frames.append(body)
        points.append(struct.pack(">QQH", start, at, len(part)))
        at += len(body)
    least, most = (min(map(len, frames)), max(map(len, frames))) if frames else (0, 0)
    info = struct.pack(">HH", frame, frame) + least.to_bytes(3, "big") + most.to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5((samples.astype(np.int8)).tobytes()).digest()
    seek = b"".join(points)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


# -- decoding -------------------------------------------------------------------------------------


class Corrupt(ValueError):
    """A stream that fails a check."""


class Stream:
    """Metadata of a FLAC stream: sample width, count, MD5, and its frames' (sample offset, byte offset)."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise Corrupt("no FLAC marker")
        at, last, points = 4, False, []
        while not last:
            last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + n]
            if kind == 0:
                self.block = int.from_bytes(body[:2], "big")
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
                self.md5 = body[18:34]
            elif kind == 3:
                points = [struct.unpack_from(">QQH", body, i) for i in range(0, n, 18)]
            at += 4 + n
        if self.channels != 1 or self.bits > 16:
            raise Corrupt("only mono streams of up to 16 bits are read")
        self.first = at
        self.points = [p for p in points if p[0] != (1 << 64) - 1]
        if sum(p[2] for p in self.points) != self.total:
            raise Corrupt("the seek table does not name every frame")


def header(data: bytes, at: int) -> tuple[int, int]:
    """(block size, bytes of the header) of the frame at an offset; checks the sync code and the CRC-8."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise Corrupt("no frame at a seek point")
    coded, rate = data[at + 2] >> 4, data[at + 2] & 15
    end = at + 4 + max(1, 8 - (255 - data[at + 4]).bit_length())
    if coded in (6, 7):
        n, end = int.from_bytes(data[end : end + coded - 5], "big") + 1, end + coded - 5
    elif coded in SIZES:
        n = SIZES[coded]
    else:
        raise Corrupt("reserved block size")
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc(np.frombuffer(data, np.uint8, end - at, at), CRC8, 8) != data[end]:
        raise Corrupt("header checksum")
    return n, end + 1 - at


@cache
def zeros16() -> np.ndarray:
    """Leading zeros of 16-bit numbers; 16 for zero."""
    out = np.full(1 << 16, 16, np.uint8)
    for i in range(16):
        out[1 << i : 2 << i] = 15 - i
    return out


def bits_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next 25 bits or more at each bit position, at the top of 32."""
    return words[at >> 3] << (at & 7).astype(np.uint32)


def take(words: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unsigned numbers of n (0 to 25) bits."""
    return (bits_at(words, at) >> np.uint32(1) >> (31 - n).astype(np.uint32)).astype(np.int64)


def signed(values: np.ndarray, n) -> np.ndarray:
    half = np.left_shift(1, n - 1)
    return (values ^ half) - half


def decode_all(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream, checked; the frames of all streams advance together."""
    metas = [Stream(x) for x in streams]
    buffer = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    b32 = buffer.astype(np.uint32)
    words = b32[:-3] << 24 | b32[1:-2] << 16 | b32[2:-1] << 8 | b32[3:]
    offsets = np.cumsum([0, *map(len, streams)])
    sizes, starts, widths, owners, stops = [], [], [], [], []
    for i, (m, data) in enumerate(zip(metas, streams, strict=True)):
        for j, (_, at, n) in enumerate(m.points):
            size, skip = header(data, m.first + at)
            if size != n:
                raise Corrupt("block size differs from the seek point")
            end = m.first + m.points[j + 1][1] if j + 1 < len(m.points) else len(data)
            if crc(buffer[offsets[i] + m.first + at : offsets[i] + end - 2], CRC16, 16) != int.from_bytes(data[end - 2 : end], "big"):
                raise Corrupt("frame checksum")
            sizes.append(size)
            starts.append(8 * (offsets[i] + m.first + at + skip))
            stops.append(8 * (offsets[i] + end - 2))
            widths.append(m.bits)
            owners.append(i)
    owners = np.array(owners, np.int64)
    samples = frames_samples(words, np.array(sizes, np.int64), np.array(starts, np.int64), np.array(widths, np.int64), np.array(stops, np.int64))
    out = []
    for i, m in enumerate(metas):
        own = np.concatenate([np.zeros(0, np.int64), *samples[slice(*np.searchsorted(owners, [i, i + 1]))]])
        if len(own) != m.total or m.md5 != bytes(16) and hashlib.md5(own.astype(np.int8 if m.bits <= 8 else "<i2").tobytes()).digest() != m.md5:
            raise Corrupt("sample checksum")
        out.append(own)
    return out


def frames_samples(words: np.ndarray, sizes: np.ndarray, at: np.ndarray, bits: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Samples of each frame; `at` are the bit positions of the subframes."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sizes)
    kinds = take(words, at, np.full(len(at), 8)) >> 1
    if (take(words, at, np.full(len(at), 8)) & 1).any():
        raise Corrupt("wasted bits are not read")
    at = at + 8
    for i in np.flatnonzero(kinds == 0):
        out[i] = np.full(sizes[i], signed(take(words, at[i : i + 1], bits[i : i + 1]), bits[i])[0])
    for i in np.flatnonzero(kinds == 1):
        where = at[i] + bits[i] * np.arange(sizes[i])
        out[i] = signed(take(words, where, np.full(len(where), bits[i])), bits[i])
    order = np.where(kinds >= 32, kinds - 31, np.where((kinds >= 8) & (kinds <= 12), kinds - 8, -1))
    if ((order < 0) & (kinds > 1)).any():
        raise Corrupt("reserved subframe")
    rest = np.flatnonzero(order >= 0)
    rest = rest[np.argsort(-sizes[rest], kind="stable")]  # the longest first: those at work are always a prefix
    if not len(rest):
        return out
    at, order, size, bits, linear, stops = at[rest], order[rest], sizes[rest], bits[rest], kinds[rest] >= 32, stops[rest]
    n, most = len(rest), int(size[0])
    x = np.zeros((most, n), np.int64)
    for j in range(int(order.max())):
        own = order > j
        x[j, own] = signed(take(words, at[own], bits[own]), bits[own])
        at[own] += bits[own]
    taps = np.zeros((32, n), np.int64)
    shift = np.zeros(n, np.int64)
    for o, coefficients in enumerate(FIXED):
        for j, c in enumerate(coefficients):
            taps[j, ~linear & (order == o)] = c
    if linear.any():
        own = np.flatnonzero(linear)
        precision = take(words, at[own], np.full(len(own), 4)) + 1
        shift[own] = signed(take(words, at[own] + 4, np.full(len(own), 5)), 5)
        if (precision > 15).any() or (shift < 0).any():
            raise Corrupt("reserved predictor")
        at[own] += 9
        for j in range(int(order[own].max())):
            sub = order[own] > j
            taps[j, own[sub]] = signed(take(words, at[own[sub]], precision[sub]), precision[sub])
            at[own[sub]] += precision[sub]
    method = take(words, at, np.full(n, 2))
    if (method > 1).any():
        raise Corrupt("reserved residual coding")
    wide = 4 + method
    each = size >> take(words, at + 2, np.full(n, 4))
    at = at + 6
    residuals(words, x, at, order, size, each, wide, stops)
    restore(x, order, taps, shift, linear)
    for i, k in enumerate(rest):
        out[k] = x[: size[i], i]
    return out


def residuals(words: np.ndarray, x: np.ndarray, at: np.ndarray, order: np.ndarray, size: np.ndarray, each: np.ndarray, wide: np.ndarray, stops: np.ndarray) -> None:
    """Fills x[i] with residual i of every frame that has one."""
    n, k, raw = len(at), np.zeros(len(at), np.int64), np.full(len(at), -1)
    lead, last, escaped = zeros16(), len(words) - 1, False
    fresh_every = int(np.gcd.reduce(each)) or 1
    for i in range(len(x)):
        live = int(np.searchsorted(-size, -i, side="left"))
        if i % fresh_every == 0 or i <= 32:
            own = np.flatnonzero((i % each[:live] == 0) & (i >= order[:live]) | (i == order[:live]))
            if len(own):
                k[own] = take(words, np.minimum(at[own], 8 * last), wide[own])
                at[own] += wide[own]
                escape = k[own] == (1 << wide[own]) - 1
                raw[own] = -1
                if escape.any():
                    escaped, esc = True, own[escape]
                    raw[esc] = take(words, at[esc], np.full(len(esc), 5))
                    at[esc] += 5
        a = at[:live]
        if (a > stops[:live]).any():
            raise Corrupt("residuals run over the frame")
        if i < 32 and (order[:live] > i).any() or escaped and (raw[:live] >= 0).any():
            one_by_one(words, x, i, np.flatnonzero(order[:live] <= i), at, k, raw, stops)
            continue
        q = lead[bits_at(words, a) >> 16].astype(np.int64)
        long = np.flatnonzero(q == 16)
        if len(long):
            q[long] = unary(words, a[long], stops[:live][long])
        a = a + q + 1
        z = q << k[:live] | take(words, np.minimum(a, 8 * last), k[:live])
        at[:live] = a + k[:live]
        x[i, :live] = (z >> 1) ^ -(z & 1)


def unary(words: np.ndarray, at: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Zeros before the next one at each position, however many."""
    q, lead = np.zeros(len(at), np.int64), zeros16()
    todo = np.arange(len(at))
    while len(todo):
        if (at[todo] + q[todo] > stops[todo]).any():
            raise Corrupt("residuals run over the frame")
        got = lead[bits_at(words, at[todo] + q[todo]) >> 16].astype(np.int64)
        q[todo] += got
        todo = todo[got == 16]
    return q


def one_by_one(words: np.ndarray, x: np.ndarray, i: int, own: np.ndarray, at: np.ndarray, k: np.ndarray, raw: np.ndarray, stops: np.ndarray) -> None:
    """One step of the frames `own`, some of them with escaped residuals."""
    esc = own[raw[own] >= 0]
    if len(esc):
        v = take(words, at[esc], raw[esc])
        x[i, esc] = np.where(raw[esc] > 0, signed(v, np.maximum(raw[esc], 1)), 0)
        at[esc] += raw[esc]
    own = own[raw[own] < 0]
    if len(own):
        q = unary(words, at[own], stops[own])
        at[own] += q + 1
        z = q << k[own] | take(words, at[own], k[own])
        at[own] += k[own]
        x[i, own] = (z >> 1) ^ -(z & 1)


def restore(x: np.ndarray, order: np.ndarray, taps: np.ndarray, shift: np.ndarray, linear: np.ndarray) -> None:
    """Adds the predictions to the residuals, in place."""
    for o in range(1, 5):
        own = np.flatnonzero(~linear & (order == o))
        if len(own):  # a fixed predictor of order o is undone by o running sums
            first, y = x[:o, own], x[o:, own]
            starts = [first[0]]
            for _ in range(1, o):
                first = np.diff(first, axis=0)
                starts.append(first[0])
            for start in reversed(starts):
                y = np.cumsum(np.concatenate((start[None], y)), axis=0)
            x[:, own] = y
    own = np.flatnonzero(linear)
    if len(own):
        y, t, s, o, most = x[:, own], taps[:, own], shift[own], order[own], int(order[own].max())
        for i in range(1, len(y)):
            n = min(i, most)
            guess = (t[:n] * y[i - n : i][::-1]).sum(axis=0) >> s
            y[i] += np.where(o <= i, guess, 0)
        x[:, own] = y


# -- jobs -----------------------------------------------------------------------------------------

#: Bytes of payload that a task codes or decodes at once.
AT_ONCE = 4 << 20


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text filled up with spaces to a positive multiple of the unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a FLAC stream, each frame by the cheapest of the predictors and MEAN.

    Null and empty texts become one unit of spaces. Repeated rows and null ids stay rows of their own; equal texts give
    equal streams. A very long text is one stream of many frames. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, AT_ONCE):
            n, loads = zip(*map(payload, batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([encode(x, frame, lpc=MEAN, choose=True) for x in loads], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(streams: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, sample_bytes, pcm): one row for each frame of each stream.

    pcm holds signed little-endian samples of sample_bytes bytes; sample_offset is where the block begins, so a
    reader seeks by a filter on it. A null stream gives no row; a stream that fails a check fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, AT_ONCE):
            rows = []
            own = [(d, m) for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if m is not None]
            for (doc, data), samples in zip(own, decode_all([m for _, m in own]), strict=True):
                rows += [(doc, *block) for block in blocks_of(data, samples)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "block", "sample_offset", "n_samples", "sample_bytes", "pcm"])

    return streams.select(F.col(id_col).cast("long"), media_col).mapInArrow(run, "doc_id long, block int, sample_offset long, n_samples int, sample_bytes int, pcm binary")


def feature(samples: np.ndarray) -> str:
    """Count, sum, energy, peak and zero crossings of the samples: whole numbers, so equal samples give equal text."""
    if not len(samples):
        return "n=0"
    return f"n={len(samples)} sum={int(samples.sum())} energy={int((samples * samples).sum())} peak={int(np.abs(samples).max())} crossings={int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())} steps={int(np.abs(np.diff(samples)).sum())}"


def blocks_of(data: bytes, samples: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(block, sample_offset, n_samples, sample_bytes, pcm) of the frames of a decoded stream."""
    meta = Stream(data)
    wide = 1 if meta.bits <= 8 else 2
    for i, (start, _, n) in enumerate(meta.points):
        yield i, start, n, wide, samples[start : start + n].astype(f"<i{wide}").tobytes()


def digests(streams: DataFrame) -> DataFrame:
    """What the streams of media() hold, from their PCM blocks, put together by sample offset: one row for each of its rows."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, AT_ONCE):
            rows, data = [], batch.column(2).to_pylist()
            for doc, n, stream, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), data, decode_all(data), strict=True):
                pcm = np.frombuffer(b"".join(block[4] for block in sorted(blocks_of(stream, samples), key=lambda b: b[1])), np.int8)
                raw = (pcm.view(np.uint8) ^ 128).tobytes()
                rows.append((doc, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return streams.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True)))

"""Progressive JPEG: a decoder that accumulates spectral-selection and successive-approximation scans into coefficient arrays,
inverse-transforms them in numpy, upsamples chroma and gives full-resolution RGB tensors; and an encoder that stores any payload
losslessly, one byte in each quantised coefficient (64 bytes a block, six blocks a 4:2:0 unit).

The decoder takes any Huffman tables, end-of-band runs, restart intervals and sampling factors. Scans whose tables hold a single
one-bit code, as the payload encoder writes them, have a fixed layout: they are read as arrays instead of symbol by symbol.
A stored byte never is a zero coefficient: 0..127 is +128..+255 and 128..255 is -128..-255, all of the same category.

The inverse transform works on integers held in doubles, exact in any order, so equal payloads give equal tensors anywhere.

Defined results: null and empty texts are one block of zeros; a payload's true length stands in a comment segment. Repeated rows, and rows without an id, give a row each; an empty table gives none."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMENT = b"payload:"


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: along anti-diagonals, turning at each."""
    return np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


ZIGZAG = _zigzag()
_SCALE = 12
_BASIS = np.round(np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * (1 << _SCALE))
#: Zigzag coefficients to row-major samples, times 2^24.
_INVERSE = np.kron(_BASIS, _BASIS)[ZIGZAG]


# --- reading -------------------------------------------------------------------------------------------------------------

class _Table:
    def __init__(self, counts: bytes, symbols: bytes):
        self.look: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.look[(length, code)] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


class _Bits:
    """Bits of entropy-coded bytes without stuffing, one after the other; zeros after the end."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n]:
            out = out << 1 | b
        short = max(0, self.at + n - len(self.bits))
        self.at += n
        return out << short

    def symbol(self, table: _Table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table.look:
                return table.look[(length, code)]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class _Part:
    """A component: its sampling, quantisation table and coefficients (zigzag) of all blocks of whole units."""

    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table


def _unstuff(data: bytes) -> bytes:
    return data.replace(b"\xff\x00", b"\xff")


def _segments(raw: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded bytes from `at`, one piece for each restart interval, and the place of the marker that ends them."""
    out, begin = [], at
    while True:
        k = raw.find(b"\xff", at)
        if k < 0 or k + 1 >= len(raw):
            return [*out, _unstuff(raw[begin:])], len(raw)
        nxt = raw[k + 1]
        if nxt == 0:
            at = k + 2
        elif 0xD0 <= nxt <= 0xD7:
            out.append(_unstuff(raw[begin:k]))
            begin = at = k + 2
        elif nxt == 0xFF:
            at = k + 1
        else:
            return [*out, _unstuff(raw[begin:k])], k


class Picture:
    """A progressive JPEG's coefficients by component, and what its headers say."""

    def __init__(self, raw: bytes):
        self.comment = b""
        self.quant: dict[int, np.ndarray] = {}
        self.parts: list[_Part] = []
        dc: dict[int, _Table] = {}
        ac: dict[int, _Table] = {}
        interval, at = 0, 2
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at + 1 < len(raw):
            marker = raw[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    n = 128 if wide else 64
                    self.quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                    k += 1 + n
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    (ac if body[k] >> 4 else dc)[body[k] & 15] = _Table(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                    k += 17 + n
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.parts = [_Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                self.h, self.v = max(p.h for p in self.parts), max(p.v for p in self.parts)
                self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
                for p in self.parts:
                    p.coef = np.zeros((self.down * p.v, self.across * p.h, 64), np.int32)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not a progressive Huffman JPEG")
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                n = body[0]
                chosen = [(next(p for p in self.parts if p.ident == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
                first, last, approx = body[1 + 2 * n : 4 + 2 * n]
                pieces, at = _segments(raw, at)
                self._scan(chosen, first, last, approx >> 4, approx & 15, pieces, interval, dc, ac)

    def _blocks(self, chosen: list) -> tuple[np.ndarray, int]:
        """(component, block) rows in coding order, and the rows of one unit."""
        if len(chosen) == 1:
            p = chosen[0][0]
            wide, high = -(-(-(-self.width * p.h // self.h)) // 8), -(-(-(-self.height * p.v // self.v)) // 8)
            at = (np.arange(high)[:, None] * p.coef.shape[1] + np.arange(wide)).ravel()
            return np.stack([np.zeros(len(at), np.int64), at], 1), 1
        unit = []
        for i, (p, _, _) in enumerate(chosen):
            y, x = np.arange(self.down)[:, None, None, None] * p.v + np.arange(p.v)[:, None], np.arange(self.across)[:, None, None] * p.h + np.arange(p.h)
            at = (y * p.coef.shape[1] + x).reshape(self.down * self.across, -1)
            unit.append(np.stack([np.full_like(at, i), at], 2))
        rows = np.concatenate(unit, 1)
        return rows.reshape(-1, 2), rows.shape[1]

    def _scan(self, chosen, first, last, high, low, pieces, interval, dc, ac) -> None:
        rows, unit = self._blocks(chosen)
        step = interval * unit or len(rows)
        for k, piece in enumerate(pieces):
            part = rows[k * step : (k + 1) * step]
            if not len(part):
                break
            if not self._uniform(chosen, part, first, last, high, low, piece, dc, ac):
                self._general(chosen, part, first, last, high, low, _Bits(piece), dc, ac)

    def _uniform(self, chosen, rows, first, last, high, low, piece, dc, ac) -> bool:
        """Scans of a fixed layout as arrays: one symbol of one bit before each value, or one-bit refinements of values that are all set."""
        n = len(rows)
        flat = [p.coef.reshape(-1, 64) for p, _, _ in chosen]
        bits = lambda width: np.unpackbits(np.frombuffer(piece, np.uint8), count=n * width).reshape(n, width)

        def number(b: np.ndarray) -> np.ndarray:
            v = b.astype(np.int32) @ (1 << np.arange(b.shape[-1] - 1, -1, -1)).astype(np.int32)
            return np.where(b[..., 0] > 0, v, v - (1 << b.shape[-1]) + 1)

        if first == 0 and high:
            b = bits(1)[:, 0].astype(np.int32) << low
            for i, c in enumerate(flat):
                own = rows[:, 0] == i
                c[rows[own, 1], 0] |= b[own]
            return True
        if first == 0:
            sizes = {dc[d].only for _, d, _ in chosen}
            if len(sizes) > 1 or None in sizes or not (size := sizes.pop()):
                return False
            diff = number(bits(1 + size)[:, 1:])
            for i, c in enumerate(flat):
                own = rows[:, 0] == i
                c[rows[own, 1], 0] = np.cumsum(diff[own]) << low
            return True
        table, c, band = ac[chosen[0][2]], flat[0], last - first + 1
        if not high and table.only is not None and table.only >> 4 == 0 and (size := table.only & 15):
            if size == 7:  # each coefficient is a byte
                v = np.frombuffer(piece, np.uint8, n * band).reshape(n, band).astype(np.int32)
                v = np.where(v & 64, v, v - 127)
            else:
                v = number(bits(band * (1 + size)).reshape(n, band, 1 + size)[..., 1:])
            c[rows[:, 1], first : last + 1] = v * (1 << low)
            return True
        if high and table.only == 0:
            old = c[rows[:, 1], first : last + 1]
            if not (old != 0).all():
                return False
            b = bits(1 + band)[:, 1:].astype(np.int32) << low
            c[rows[:, 1], first : last + 1] = old + np.where(old > 0, b, -b)
            return True
        return False

    def _general(self, chosen, rows, first, last, high, low, bits: _Bits, dc, ac) -> None:
        flat = [p.coef.reshape(-1, 64) for p, _, _ in chosen]
        before, run = [0] * len(chosen), 0
        for i, at in rows.tolist():
            block = flat[i][at]
            if first == 0:
                if high:
                    block[0] |= bits.take(1) << low
                else:
                    before[i] += bits.value(bits.symbol(dc[chosen[i][1]]))
                    block[0] = before[i] << low
                continue
            table, k = ac[chosen[0][2]], first

            def refine(j: int) -> None:
                if bits.take(1):
                    block[j] += (1 << low) if block[j] > 0 else -(1 << low)

            while k <= last and not run:
                s = bits.symbol(table)
                zeros, size = s >> 4, s & 15
                if not size and zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                new = (bits.value(size) if not high else (1 if bits.take(1) else -1)) * (1 << low) if size else 0
                while k <= last:
                    if high and block[k]:
                        refine(k)
                    elif not zeros:
                        if new:
                            block[k] = new
                        k += 1
                        break
                    else:
                        zeros -= 1
                    k += 1
            if run:
                if high:
                    for j in range(k, last + 1):
                        if block[j]:
                            refine(j)
                run -= 1

    def plane(self, part: _Part) -> np.ndarray:
        """Samples 0..255 of a component's blocks."""
        coef = part.coef.reshape(-1, 64)
        out = np.empty(coef.shape, np.uint8)
        for a in range(0, len(coef), 16_384):
            x = (coef[a : a + 16_384] * self.quant[part.table]) @ _INVERSE
            out[a : a + 16_384] = np.clip(np.floor(x / (1 << 2 * _SCALE) + 128.5), 0, 255)
        down, across = part.coef.shape[:2]
        return out.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)

    def rgb(self) -> np.ndarray:
        """height x width x 3; chroma is repeated to full resolution. Products are in 2^16ths, as integers."""
        planes = []
        for p in self.parts:
            s = self.plane(p)
            for axis, n in ((0, self.v // p.v), (1, self.h // p.h)):
                s = np.repeat(s, n, axis) if n > 1 else s
            planes.append(s[: self.height, : self.width].astype(np.int32))
        if len(planes) < 3:
            return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
        y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
        out = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], 2)
        return np.clip((out + 32768) >> 16, 0, 255).astype(np.uint8)


# --- writing -------------------------------------------------------------------------------------------------------------

def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _one_code(kind: int, ident: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | ident, 1, *[0] * 15, symbol]))


def _stuff(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _pack(bits: np.ndarray) -> bytes:
    """Bits of all blocks as bytes, filled with ones."""
    flat = bits.ravel()
    return _stuff(np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])).tobytes())


def _binary(v: np.ndarray, width: int) -> np.ndarray:
    return (v[..., None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload in its coefficients: DC and two AC bands without their last bit, then the last bits."""
    units = max(1, -(-len(payload) // 384))
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    data = np.zeros(across * down * 384, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    mcu = data.reshape(down, across, 6, 64)
    luma = mcu[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    parts = [luma, mcu[:, :, 4].reshape(-1, 64), mcu[:, :, 5].reshape(-1, 64)]
    # DC: the byte, and 768 more in every other block of its component in coding order, so all differences have one category
    level = np.empty((down * across, 6), np.int32)
    for cols in (slice(0, 4), slice(4, 5), slice(5, 6)):
        own = mcu.reshape(-1, 6, 64)[:, cols, 0].astype(np.int32)
        level[:, cols] = own + 768 * ((np.arange(own.size) + 1) % 2).reshape(own.shape)
    coarse = level >> 1
    diff = coarse.copy()
    for cols in (slice(0, 4), slice(4, 5), slice(5, 6)):
        own = coarse[:, cols].ravel()
        diff[:, cols] = np.diff(own, prepend=0).reshape(diff[:, cols].shape)
    dc_bits = np.concatenate([np.zeros((*diff.shape, 1), np.uint8), _binary(np.where(diff > 0, diff, diff + 511), 9)], 2)
    out = [
        b"\xff\xd8", _segment(0xFE, COMMENT + struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0] + [1] * 64)),
        _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _one_code(0, 0, 9), _one_code(1, 0, 7), _one_code(1, 1, 0),
        _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1])), _pack(dc_bits),
    ]
    for ident, part in enumerate(parts, 1):
        size = np.where(part < 128, part | 128, part)  # 128..255
        half = size >> 1
        code = np.where(part < 128, half, 127 - half).astype(np.uint8)  # '0', sign and 6 bits
        for a, b in ((1, 5), (6, 63)):
            out += [_segment(0xDA, bytes([1, ident, 0, a, b, 1])), code[:, a : b + 1].tobytes()]
    out += [_segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10])), _pack((level & 1).astype(np.uint8))]
    for ident, part in enumerate(parts, 1):
        last = part & 1
        last[:, 0] = 0  # the end-of-band code
        out += [_segment(0xDA, bytes([1, ident, 1, 1, 63, 0x10])), _pack(last)]
    return b"".join([*out, b"\xff\xd9"])


def read_payload(picture: Picture) -> bytes:
    """The payload that encode_payload stored, from the coefficients."""
    if not picture.comment.startswith(COMMENT):
        raise ValueError("the picture holds no payload")
    size = struct.unpack(">Q", picture.comment[len(COMMENT) :])[0]
    down, across = picture.down, picture.across
    mcu = np.empty((down, across, 6, 64), np.int32)
    mcu[:, :, :4] = picture.parts[0].coef.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    mcu[:, :, 4], mcu[:, :, 5] = picture.parts[1].coef, picture.parts[2].coef
    data = np.where(mcu > 0, mcu - 128, -mcu)
    data[..., 0] = mcu[..., 0] & 255
    return data.astype(np.uint8).tobytes()[:size]


# --- Spark ---------------------------------------------------------------------------------------------------------------

def text_payload(text: bytes) -> bytes:
    """The bytes, and zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def feature_of(rgb: np.ndarray) -> str:
    """Size, means and deviations of the channels, and the tensor's checksum."""
    v = rgb.reshape(-1, 3)
    n, s = len(v), v.sum(0, dtype=np.int64)
    q = np.array([int(np.dot(c, c)) for c in v.T.astype(np.float64)], np.int64)  # whole numbers, exact
    mean, var = s / n, np.maximum(q / n - (s / n) ** 2, 0)
    return f"{rgb.shape[0]}x{rgb.shape[1]} mean {' '.join(f'{x:.3f}' for x in mean)} sd {' '.join(f'{x:.3f}' for x in np.sqrt(var))} crc {zlib.crc32(rgb.tobytes()):08x}"


def encode_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [(t.as_py() or "").encode() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_payload(text_payload(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, height, width, rgb: the tensor of each picture, row by row, three bytes a pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                tensors = [Picture(m.as_py()).rgb() for m in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t.shape[0] for t in tensors], pa.int32()), pa.array([t.shape[1] for t in tensors], pa.int32()), pa.array([t.tobytes() for t in tensors], pa.binary())],
                    names=["doc_id", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """Per stored picture: its payload's size, hash and tail, read back from the coefficients; its own size and hash; a feature of its tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column(2):
                raw = m.as_py()
                picture = Picture(raw)
                payload = read_payload(picture)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(picture.rgb())))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGESTS)


def text_media(docs: DataFrame) -> DataFrame:
    """What media_digests says of each whole text, stored as a picture and read back. Nothing is shuffled."""
    return media_digests(encode_text(docs))

"""Media columns: progressive JPEG to and from coefficient arrays, and full-resolution RGB tensors.

``decode`` reads any progressive or sequential Huffman file of 8-bit samples: every scan (spectral selection and
successive approximation, with restart intervals) adds to the coefficient arrays. ``to_rgb`` dequantises, transforms
back in numpy with integers only, repeats chroma to full size and converts. A scan whose table has one code has a fixed
width for each coefficient and is read as an array; all other scans are read bit by bit.

``encode`` stores bytes losslessly in the format's unit, the quantised coefficient: a byte b is b - 128 as a block's
first coefficient and 256 + b as any other, so the quantisation tables are all 1. Its scans are: first coefficients
without their last bit; luma 1-5 without their last bit; luma 6-63; chroma 1-63; the last bits of the first two.

Defined results: an empty or null payload is stored as no blocks but one; repeated rows give equal files; a file that
can't be read raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from disputa.llm.common import steps, table, utf8

#: The zigzag order of the format, and unit steps of its tables.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
#: Payloads are filled up with 255 to a multiple of this.
UNIT = 576
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks by row and rows of blocks that scans of this component alone hold
    high: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    notes: dict[int, bytes] = field(default_factory=dict)

    @property
    def most(self) -> tuple[int, int]:
        return max(c.h for c in self.components), max(c.v for c in self.components)


class Huffman:
    """Codes by length, and a table from the next 16 bits to (symbol, length)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[int, tuple[int, int]] = {}
        self.look = np.full(1 << 16, -1, np.int32)
        code = at = 0
        for length, count in enumerate(counts, 1):
            for symbol in symbols[at : at + count]:
                self.codes[symbol] = code, length
                self.look[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 5 | length
                code += 1
            at += count
            code <<= 1
        self.table = self.look.tolist()


_TABLES: dict[bytes, Huffman] = {}


class Bits:
    """Reads bits of one restart interval, first bit first; 1s follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.n = data, 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.n < n:
            chunk = self.data[self.at : self.at + 4]
            self.at += 4
            self.hold = (self.hold << 32) | int.from_bytes(chunk + b"\xff" * (4 - len(chunk)), "big")
            self.n += 32

    def take(self, n: int) -> int:
        if not n:
            return 0
        self._fill(n)
        self.n -= n
        out = self.hold >> self.n
        self.hold &= (1 << self.n) - 1
        return out

    def symbol(self, huffman: Huffman) -> int:
        self._fill(16)
        got = huffman.table[(self.hold >> (self.n - 16)) & 0xFFFF]
        if got < 0:
            raise ValueError("no such code")
        self.n -= got & 31
        self.hold &= (1 << self.n) - 1
        return got >> 5

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


@dataclass
class Scan:
    parts: list[tuple[Component, Huffman | None, Huffman | None]]
    first: int
    last: int
    high: int
    low: int
    progressive: bool


@lru_cache(512)
def _mixed_units(across: int, down: int, shape: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of an interleaved scan: the part of each block in order, and for each part where its blocks stand in the scan and in its own rows."""
    inner = [(k, y, x) for k, (h, v) in enumerate(shape) for y in range(v) for x in range(h)]
    part, dy, dx = (np.array(v) for v in zip(*inner))
    hs, vs = np.array([h for h, _ in shape]), np.array([v for _, v in shape])
    row, column = np.divmod(np.arange(across * down), across)
    rows, columns = (row[:, None] * vs[part] + dy).reshape(-1), (column[:, None] * hs[part] + dx).reshape(-1)
    parts = np.tile(part, across * down)
    return parts, [(own := np.flatnonzero(parts == k), rows[own] * (across * h) + columns[own]) for k, (h, _) in enumerate(shape)]


@lru_cache(8)
def _word_places(width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For fields of ``width`` bits in a row: the byte in which each begins, and how far a 24-bit word from there is shifted."""
    bit = np.arange(size) * width
    return bit >> 3, (24 - width - (bit & 7)).astype(np.int32)


def _fields(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` fields of ``width`` (up to 17) bits."""
    raw = np.zeros(len(data) + 2, np.int32)
    raw[:-2] = np.frombuffer(data, np.uint8)
    place, shift = _word_places(width, 1 << max(12, (count - 1).bit_length()))
    return ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])[place[:count]] >> shift[:count]) & ((1 << width) - 1)


def _fixed(scan: Scan, block: np.ndarray, data: bytes) -> bool:
    """Reads a scan of coefficients whose table has one code, as arrays; False if it is not of that kind."""
    _, _, ac = scan.parts[0]
    if scan.high or not ac or len(ac.codes) != 1:
        return False
    (symbol, (code, length)), n = next(iter(ac.codes.items())), scan.last - scan.first + 1
    size = symbol & 15
    if symbol >> 4 or not size or code:
        return False
    width, count = length + size, len(block) * n
    if width > 17 or 8 * len(data) < count * width:
        return False
    value = _fields(data, width, count)
    if count and int(value.max()) >> size:
        return False
    value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
    block[:, scan.first : scan.last + 1] = (value << scan.low).reshape(len(block), n)
    return True


def _refined_whole(scan: Scan, block: np.ndarray, data: bytes) -> bool:
    """Reads last bits of coefficients that are all set already, as arrays; False if the scan is not of that kind."""
    part = block[:, scan.first : scan.last + 1]
    if not scan.high or scan.first == 0 or not (part != 0).all():
        return False
    bits, flat, at, done = np.unpackbits(np.frombuffer(data, np.uint8)), part.reshape(-1), 0, 0
    n = part.shape[1]
    while done < len(part):
        window = int("".join(map(str, bits[at : at + 16])).ljust(16, "1"), 2)
        got = scan.parts[0][2].table[window]
        symbol, length = got >> 5, got & 31
        if got < 0 or symbol & 15 or symbol >> 4 == 15:
            return False
        size = symbol >> 4
        at += length
        run = (1 << size) + (int("".join(map(str, bits[at : at + size])), 2) if size else 0)
        at += size
        run = min(run, len(part) - done)
        extra = bits[at : at + run * n].astype(np.int32)
        here = flat[done * n : (done + run) * n]
        here += np.where(here > 0, extra << scan.low, -(extra << scan.low))
        at, done = at + run * n, done + run
    block[:, scan.first : scan.last + 1] = flat.reshape(part.shape)
    return True


_SHIFTS = 8 - np.arange(8, dtype=np.int32)


def _first_fast(scan: Scan, parts: np.ndarray, blocks: np.ndarray, data: bytes) -> bool:
    """Reads first coefficients: symbols at all bits at once, then a walk from one to the next."""
    if scan.first or scan.last or scan.high:
        return False
    if len({id(dc) for _, dc, _ in scan.parts}) != 1:
        return False
    raw = np.full(len(data) + 4, 255, np.int32)
    raw[:-4] = np.frombuffer(data, np.uint8)
    window = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])[:, None] >> _SHIFTS & 0xFFFF).reshape(-1)
    got = scan.parts[0][1].look[window]
    hop = np.where(got < 0, 0, (got >> 5) + (got & 31)).tolist()
    at, where = 0, []
    for _ in range(len(blocks)):
        if at >= len(hop) or not hop[at]:
            return False
        where.append(at)
        at += hop[at]
    if at > 8 * len(data):
        return False
    size, begin = got[where] >> 5, np.array(where) + (got[where] & 31)
    value = window[begin] >> (16 - size)
    value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
    for k in range(len(scan.parts)):
        own = np.flatnonzero(parts == k)
        blocks[own, 0] = np.cumsum(value[own]) << scan.low
    return True


def _read(scan: Scan, parts: np.ndarray, blocks: np.ndarray, data: bytes) -> None:
    """Reads one restart interval bit by bit into ``blocks``."""
    bits, before, run = Bits(data), [0] * len(scan.parts), 0
    low = 1 << scan.low
    for k, out in zip(parts.tolist(), blocks):
        _, dc, ac = scan.parts[k]
        at = scan.first
        if at == 0:
            if scan.high:
                out[0] |= bits.take(1) << scan.low
            else:
                before[k] += bits.signed(bits.symbol(dc))
                out[0] = before[k] << scan.low
            at = 1
        if at > scan.last:
            continue
        if not scan.high:
            if run:
                run -= 1
                continue
            while at <= scan.last:
                symbol = bits.symbol(ac)
                skip, size = symbol >> 4, symbol & 15
                if size:
                    at += skip
                    out[at] = bits.signed(size) * low
                    at += 1
                elif skip == 15:
                    at += 16
                else:
                    run = (1 << skip) - 1 + bits.take(skip) if scan.progressive else 0
                    break
            continue
        if not run:
            while at <= scan.last:
                symbol = bits.symbol(ac)
                skip, size, new = symbol >> 4, symbol & 15, 0
                if size:
                    new = low if bits.take(1) else -low
                elif skip < 15:
                    run = (1 << skip) + bits.take(skip)
                    break
                while at <= scan.last:
                    if out[at]:
                        if bits.take(1):
                            out[at] += low if out[at] > 0 else -low
                    elif skip:
                        skip -= 1
                    else:
                        if new:
                            out[at] = new
                        at += 1
                        break
                    at += 1
        if run:
            while at <= scan.last:
                if out[at] and bits.take(1):
                    out[at] += low if out[at] > 0 else -low
                at += 1
            run -= 1


def decode(data: bytes) -> Image:
    """The coefficient arrays (in zigzag order) of a file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, dc, ac, at, interval, progressive = Image(), {}, {}, 2, 0, False
    while at < len(data) - 1:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return image
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                image.quant[ident] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                raw = body[1 : 17 + n]
                if raw not in _TABLES:
                    if len(_TABLES) > 64:
                        _TABLES.clear()
                    _TABLES[raw] = Huffman(raw[:16], raw[16:])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _TABLES[raw]
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError("only 8-bit samples can be read")
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            mh, mv = image.most
            across, down = -(-image.width // (8 * mh)), -(-image.height // (8 * mv))
            for c in image.components:
                c.wide, c.high = -(-(-(-image.width * c.h // mh)) // 8), -(-(-(-image.height * c.v // mv)) // 8)
                c.blocks = np.zeros((down * c.v, across * c.h, 64), np.int32)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif 0xE0 <= marker <= 0xEF:
            image.notes[marker & 15] = body
        elif marker == 0xDA:
            n = body[0]
            by = {c.ident: c for c in image.components}
            parts = [(by[body[1 + 2 * k]], dc.get(body[2 + 2 * k] >> 4), ac.get(body[2 + 2 * k] & 15)) for k in range(n)]
            scan = Scan(parts, body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15, progressive)
            found = _MARKER.search(data, at)
            end = found.start() if found else len(data)
            pieces = re.split(rb"\xff[\xd0-\xd7]", data[at:end]) if interval else [data[at:end]]
            at = end
            if n == 1:
                c = parts[0][0]
                whole = c.blocks.shape[:2] == (c.high, c.wide)
                everything = c.blocks.reshape(-1, 64) if whole else c.blocks[: c.high, : c.wide].reshape(-1, 64)
                part, places, unit = np.zeros(len(everything), np.int64), [], 1
            else:
                mh, mv = image.most
                shape = tuple((c.h, c.v) for c, _, _ in parts)
                part, places = _mixed_units(-(-image.width // (8 * mh)), -(-image.height // (8 * mv)), shape)
                everything, unit = np.empty((len(part), 64), np.int32), sum(h * v for h, v in shape)
                for (c, _, _), (where, own) in zip(parts, places):
                    everything[where] = c.blocks.reshape(-1, 64)[own]
            step = interval * unit or max(1, len(part))
            for i, piece in enumerate(pieces):
                piece, p, blocks = piece.replace(b"\xff\x00", b"\xff"), part[i * step : (i + 1) * step], everything[i * step : (i + 1) * step]
                if not len(p):
                    continue
                if scan.first == 0 and scan.high and scan.last == 0:
                    blocks[:, 0] |= np.unpackbits(np.frombuffer(piece, np.uint8))[: len(p)].astype(np.int32) << scan.low
                elif not (progressive and (_first_fast(scan, p, blocks, piece) or n == 1 and scan.first and (_fixed(scan, blocks, piece) or _refined_whole(scan, blocks, piece)))):
                    _read(scan, p, blocks, piece)
            if n == 1 and not whole:
                c.blocks[: c.high, : c.wide] = everything.reshape(c.high, c.wide, 64)
            for (c, _, _), (where, own) in zip(parts, places):
                c.blocks.reshape(-1, 64)[own] = everything[where]
        elif marker in (0xC3, *range(0xC5, 0xD0)) and marker != 0xC8:
            raise ValueError("this kind of coding can't be read")
    return image


def _basis() -> np.ndarray:
    """The inverse transform of a block in zigzag order as whole numbers, 2**14 for 1; sums stay exact in doubles."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.round(both[ZIGZAG] * (1 << 14))


BASIS = _basis()


def samples(image: Image) -> list[np.ndarray]:
    """Each component's plane of 8-bit samples, all from one product with the basis."""
    plane = np.concatenate([c.blocks.reshape(-1, 64) * image.quant[c.quant] for c in image.components]).astype(np.float64) @ BASIS
    plane = np.clip(np.floor(plane * (1 / (1 << 14)) + 128.5), 0, 255).astype(np.uint8)
    out, at = [], 0
    for c in image.components:
        high, wide, _ = c.blocks.shape
        out.append(plane[at : at + high * wide].reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8))
        at += high * wide
    return out


def to_rgb(image: Image) -> np.ndarray:
    """The (height, width, 3) tensor of bytes; a grey image has three equal channels."""
    mh, mv = image.most
    planes = []
    for c, plane in zip(image.components, samples(image)):
        for axis, times in ((0, mv // c.v), (1, mh // c.h)):
            if times > 1:
                plane = np.repeat(plane, times, axis)
        planes.append(plane[: image.height, : image.width].astype(np.int32))
    if len(planes) < 3:
        return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip((y + 91881 * cr + half) >> 16, 0, 255)
    out[..., 1] = np.clip((y - 22554 * cb - 46802 * cr + half) >> 16, 0, 255)
    out[..., 2] = np.clip((y + 116130 * cb + half) >> 16, 0, 255)
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, ident: int, length: int, symbols: list[int]) -> bytes:
    return bytes([kind << 4 | ident, *(len(symbols) if k == length else 0 for k in range(1, 17)), *symbols])


#: First coefficients: ten sizes of 4 bits. Others: one code of 1 bit for size 8 (luma 1-5) or 9, fifteen of 4 bits for runs.
_TABLE_BYTES = _segment(0xC4, b"".join(_table(*x) for x in ((0, 0, 4, list(range(10))), (1, 0, 1, [8]), (1, 1, 1, [9]), (1, 2, 4, [k << 4 for k in range(15)]))))
_QUANT = _segment(0xDB, bytes([0]) + bytes([1] * 64))
_NOTE = b"bytes\0"


def _packed(bits: np.ndarray) -> bytes:
    short = -len(bits) % 8
    if short:
        bits = np.concatenate([bits, np.ones(short, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _tens(values: np.ndarray) -> bytes:
    """Fields of 10 bits: a code of 0, a 1, and the byte; four fields are five bytes."""
    n = len(values)
    fields = np.full(-(-n // 4) * 4, 256, np.uint16)
    fields[:n] += values
    a, b, c, d = fields.reshape(-1, 4).T
    out = np.stack([a >> 2, (a & 3) << 6 | b >> 4, (b & 15) << 4 | c >> 6, (c & 63) << 2 | d >> 8, d & 255], 1).astype(np.uint8).reshape(-1)
    used = 10 * n
    out = out[: -(-used // 8)]
    if used % 8:
        out[-1] |= (1 << (8 - used % 8)) - 1
    return out.tobytes().replace(b"\xff", b"\xff\x00")


def _last_bits(bits: np.ndarray, each: int) -> np.ndarray:
    """A refinement scan's bits: runs of blocks that have no new coefficients, each followed by its blocks' last bits."""
    out, blocks, at = [], len(bits) // each, 0
    while at < blocks:
        run = min(blocks - at, (1 << 15) - 1)
        size = run.bit_length() - 1
        head = f"{size:04b}" + (f"{run - (1 << size):0{size}b}" if size else "")
        out += [np.frombuffer(head.encode(), np.uint8) - 48, bits[at * each : (at + run) * each]]
        at += run
    return np.concatenate(out)


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 file that holds ``payload`` in its coefficients."""
    units = max(1, -(-len(payload) // 384))
    across = min(4095, max(1, int(np.ceil(np.sqrt(units)))))
    down = -(-units // across)
    if down > 4095:
        raise ValueError("the payload is longer than an image can hold")
    data = np.zeros(across * down * 384, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, 64)
    n = across * down
    out = [b"\xff\xd8", _segment(0xE9, _NOTE + struct.pack(">Q", len(payload))), _QUANT, _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLE_BYTES]
    # First coefficients, without the last bit, in units of four luma and two chroma blocks.
    first = data[:, 0].astype(np.int32) - 128
    luma = first[: 4 * n].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(n, 4)
    mixed = np.concatenate([luma, first[4 * n : 5 * n, None], first[5 * n :, None]], 1)
    high = mixed >> 1
    step = np.diff(np.concatenate([high[:, :4].reshape(-1)]), prepend=0).reshape(n, 4)
    step = np.concatenate([step, np.diff(high[:, 4], prepend=0)[:, None], np.diff(high[:, 5], prepend=0)[:, None]], 1).reshape(-1)
    size = np.ceil(np.log2(np.abs(step) + 1)).astype(np.int64)
    value = (size << 9) | np.where(step < 0, step + (1 << size) - 1, step)
    wide = np.unpackbits(np.stack([value >> 8, value & 255], 1).astype(np.uint8), axis=1)  # 0 0 0 s s s s v ... v: 3 + 4 + 9
    place = np.arange(16)
    keep = (place >= 3) & (place < 7) | (place >= 16 - size[:, None])
    scan = lambda parts, a, b, h, low: _segment(0xDA, bytes([len(parts), *(x for c, t in parts for x in (c, t)), a, b, h << 4 | low]))
    every = [(1, 0), (2, 0), (3, 0)]
    out += [scan(every, 0, 0, 0, 1), _packed(wide[keep])]
    luma = data[: 4 * n]
    bits = np.unpackbits(luma[:, 1:6].reshape(-1)).reshape(len(luma), 5, 8)
    low = np.zeros((len(luma), 5, 9), np.uint8)
    low[..., 1], low[..., 2:] = 1, bits[..., :7]
    out += [scan([(1, 0)], 1, 5, 0, 1), _packed(low.reshape(-1)), scan([(1, 1)], 6, 63, 0, 0), _tens(luma[:, 6:].reshape(-1))]
    for k in (2, 3):
        out += [scan([(k, 1)], 1, 63, 0, 0), _tens(data[(k + 2) * n : (k + 3) * n, 1:].reshape(-1))]
    out += [scan(every, 0, 0, 1, 0), _packed((mixed & 1).astype(np.uint8).reshape(-1))]
    out += [scan([(1, 2)], 1, 5, 1, 0), _packed(_last_bits(np.ascontiguousarray(bits[..., 7]).reshape(-1), 5))]
    return b"".join(out) + b"\xff\xd9"


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode`` stored."""
    note = image.notes.get(9, b"")
    if not note.startswith(_NOTE):
        raise ValueError("the file holds no payload")
    flat = np.concatenate([c.blocks.reshape(-1, 64) for c in image.components])
    flat = flat - 256
    flat[:, 0] += 384
    return flat.reshape(-1)[: struct.unpack(">Q", note[len(_NOTE) :])[0]].astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and 64 bits that tell which cells of an 8 x 8 grid are brighter than the image."""
    height, width, _ = rgb.shape
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    rows = np.add.reduceat(rgb[..., 1], np.arange(8) * height // 8, 0, dtype=np.int64)
    cells = np.add.reduceat(rows, np.arange(8) * width // 8, 1)
    sizes = np.outer(np.diff(np.arange(9) * height // 8), np.diff(np.arange(9) * width // 8))
    brighter = (cells * (height * width) > sums[1] * sizes).reshape(-1)
    return f"{width}x{height} " + " ".join(f"{s / (height * width):.3f}" for s in sums.tolist()) + f" {int.from_bytes(np.packbits(brighter).tobytes(), 'big'):016x}"


def tensors(files: DataFrame, jpeg: str = "jpeg") -> DataFrame:
    """All columns of ``files`` with height, width and the RGB tensor (bytes, row by row); null for a null file."""
    from pyspark.sql import types as T

    new = ("height", "width", "rgb")
    keep = [c for c in files.columns if c not in new]
    schema = T.StructType([*(files.schema[c] for c in keep), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [None if x is None else to_rgb(decode(x)) for x in part.column(jpeg).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([None if r is None else r.shape[0] for r in rows], pa.int32()), pa.array([None if r is None else r.shape[1] for r in rows], pa.int32()), pa.array([None if r is None else r.tobytes() for r in rows], pa.binary())], names=[*keep, *new])

    return files.select(*keep).mapInArrow(run, schema)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_features(docs: DataFrame) -> DataFrame:
    """Stores each text as a file, reads it back, and returns digests of both and the tensor's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                data, spans = utf8(part.column("text"))
                raw, rows = data.tobytes(), []
                for a, b in zip(spans.tolist(), spans[1:].tolist()):
                    text = raw[a:b]
                    file = encode(text + b"\xff" * (-len(text) % UNIT if text else UNIT))
                    image = decode(file)
                    payload = payload_of(image)
                    rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(to_rgb(image))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(x) for x in zip(*rows))], names=[f.split()[0] for f in FEATURES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(table(spark, sf_dir, "documents"))

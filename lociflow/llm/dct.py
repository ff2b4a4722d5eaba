"""Baseline JPEG frames (sequential DCT, Huffman codes, 8 bits), as motion-JPEG files have them: the luma plane.

Frames without tables of codes, which many AVI files have, are read with the usual ones of the JPEG standard. Restart
intervals, any sampling factors and one interleaved scan are read; other frames raise ValueError.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Rows and columns in the order of coefficients: along the diagonals, in turn down and up.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
COSINES = np.array([[(0.5 if u else 0.5 / np.sqrt(2)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

#: The standard's usual codes, as the number of codes of each length from 1 on and the first symbols; the
#: symbols after them are those left, ascending.
_DC = [(0, 1, 5, 1, 1, 1, 1, 1, 1), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1)]
_AC = [
    ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
]


@lru_cache(maxsize=1)
def usual_tables() -> dict[int, tuple[bytes, bytes]]:
    """Numbers of codes and symbols, by class (0 DC, 16 AC) and number."""
    found = {i: (bytes(n).ljust(16, b"\0"), bytes(range(12))) for i, n in enumerate(_DC)}
    every = [run << 4 | size for run in range(16) for size in range(11) if size or run in (0, 15)]
    for i, (n, first) in enumerate(_AC):
        head = list(bytes.fromhex(first))
        found[16 + i] = (bytes(n), bytes(head + [s for s in every if s not in head]))
    return found


def code_words(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a table."""
    found, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            found.append((s, code, length))
            code += 1
        at += n
        code <<= 1
    return found


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For the next 16 bits, the symbol and its code's length in one number; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in code_words(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table.tolist()


class Bits:
    """The bits of an entropy-coded piece."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        piece = self.data[self.at : self.at + 8]
        self.at += 8
        self.held = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(piece.ljust(8, b"\xff"), "big")
        self.n += 64

    def symbol(self, table: list[int]) -> int:
        if self.n < 32:
            self._fill()
        entry = table[self.held >> (self.n - 16) & 0xFFFF]
        if not entry:
            raise ValueError("no such code")
        self.n -= entry >> 8
        return entry & 255

    def number(self, size: int) -> int:
        """The signed value of size more bits."""
        if not size:
            return 0
        if self.n < 32:
            self._fill()
        self.n -= size
        value = self.held >> self.n & ((1 << size) - 1)
        return value if value >> (size - 1) else value - (1 << size) + 1


def _block(bits: Bits, dc: list[int], ac: list[int], out: np.ndarray, before: int) -> int:
    """Reads a block's coefficients into out, in their coded order; gives its first one."""
    first = before + bits.number(bits.symbol(dc))
    out[0], k = first, 1
    while k < 64:
        s = bits.symbol(ac)
        run, size = s >> 4, s & 15
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a run beyond the block")
        out[k] = bits.number(size)
        k += 1
    return first


def decode_baseline(jpeg: bytes) -> np.ndarray:
    """The luma samples of a baseline frame, as uint8 rows and columns."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    codes, steps, interval, parts, at = dict(usual_tables()), {}, 0, None, 2
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("no scan")
        if jpeg[at + 1] == 0xFF:
            at += 1
            continue
        marker, length = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                steps[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(float)
                body = body[1 + 64 * wide :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            precision, rows, columns, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit frames are read")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline and own lossless frames are read")
        elif marker == 0xDA:
            break
    if parts is None or body[0] != len(parts):
        raise ValueError("only one interleaved scan is read")
    tables = {body[1 + 2 * i]: (_lookup(*codes[body[2 + 2 * i] >> 4]), _lookup(*codes[16 + (body[2 + 2 * i] & 15)])) for i in range(body[0])}
    high, wide = (max(p[i] for p in parts) for i in (2, 1))
    if len(parts) == 1:  # a scan of one part has its blocks in plain order
        parts, high, wide = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    down, across = -(-rows // (8 * high)), -(-columns // (8 * wide))
    _, h, v, q = parts[0]
    luma = np.zeros((down * v, across * h, 64))
    end = jpeg.rindex(b"\xff\xd9")
    pieces, start = [], at
    for i in range(8 * (down * across // interval + 1) if interval else 0):
        mark = jpeg.find(bytes([0xFF, 0xD0 + i % 8]), start, end)
        if mark < 0:
            break
        pieces.append(jpeg[start:mark])
        start = mark + 2
    pieces.append(jpeg[start:end])
    unit, spare = 0, np.zeros(64)
    for piece in pieces:
        bits, before = Bits(piece.replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        for _ in range(min(interval or down * across, down * across - unit)):
            y, x = divmod(unit, across)
            for i, (name, a, b, _) in enumerate(parts):
                for j in range(a * b):
                    out = luma[y * v + j // a, x * h + j % a] if i == 0 else spare
                    before[i] = _block(bits, *tables[name], out, before[i])
            unit += 1
    if q not in steps:
        raise ValueError("no table of steps")
    plain = np.zeros_like(luma)
    plain[:, :, ZIGZAG] = luma * steps[q]
    blocks = np.einsum("ux,abuv,vy->abxy", COSINES, plain.reshape(*plain.shape[:2], 8, 8), COSINES)
    image = blocks.transpose(0, 2, 1, 3).reshape(8 * luma.shape[0], 8 * luma.shape[1])
    return np.clip(np.round(image + 128), 0, 255).astype(np.uint8)[: -(-rows * v // high), : -(-columns * h // wide)]

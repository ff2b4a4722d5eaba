"""Whole batches of texts as arrays of code points, and hashes of their words, for the operators that use numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: A chunk has so many code points, or one longer text.
CHUNK = 1 << 18
#: A longer text is looked at in pieces of about so many code points, cut at white space.
LONG = 1 << 21
_BASE = 0x9E3779B97F4A7C15
#: Space and the code points 9 to 13.
SPACES = np.zeros(33, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def chunks(texts: Iterable[str | None], size: int = CHUNK) -> Iterator[list[str]]:
    """Lists of texts of about size code points; null is empty."""
    held: list[str] = []
    n = 0
    for text in texts:
        held.append(text or "")
        n += len(held[-1]) + 1
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def pieces(text: str, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Start and end of the pieces of a text; each but the last ends before white space. A longer word is one piece."""
    size, start = size or LONG, 0
    while start < len(text):
        end = start + size
        while end < len(text) and text[end] not in " \t\n\x0b\x0c\r":
            end += 1
        yield start, min(end, len(text))
        start = end


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts with a line break after each, and where each text begins; one more place at the end."""
    c = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    return c, np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])


def lower(c: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return c + np.uint32(32) * ((c >= 65) & (c <= 90))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(CHUNK * 2, 1 << (n - 1).bit_length() if n > 1 else 1))
    return up[:n], down[:n]


def words(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, and where each begins."""
    space = np.ones(len(c) + 2, np.int8)
    low = c <= 32
    space[1:-1] = 0
    space[1:-1][low] = SPACES[c[low]]
    turn = np.diff(space)
    starts, ends = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    up, down = powers(len(c))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of one long text, A-Z lower-cased, with memory for a piece and eight bytes a word."""
    return np.concatenate([np.zeros(0, np.uint64), *[words(lower(points([text[a:b]])[0]))[0] for a, b in pieces(text)]])

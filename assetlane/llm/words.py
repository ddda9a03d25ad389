"""Words of many texts at once, as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Because separators are ASCII, splitting the
UTF-8 bytes gives the same words as splitting the characters. Hashes are 64-bit polynomial sums over
the bytes (or over word hashes, for spans of words), so a span of any length costs one subtraction
of prefix sums. The multipliers are odd, hence invertible, so two spans that differ in one
place never share a hash.

Memory: per-byte work is done in tiles of about 1 MB; what grows with a text is some 20 numbers
per word, so a chunk (see ``chunks``) needs about 30 times its bytes at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

TILE = 1 << 20
CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32
LETTER = np.zeros(256, dtype=bool)
LETTER[ord("a"):ord("z") + 1] = LETTER[ord("A"):ord("Z") + 1] = True
LETTER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & _MASK, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@dataclass
class Words:
    """Words of texts joined by line feeds; ``first[d]:first[d + 1]`` are the words of text d."""

    buf: np.ndarray      # bytes of all texts, a line feed after each
    offset: np.ndarray   # where each text begins, and the end
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray     # 64-bit hash of each word

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.first))


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def split(texts: list[bytes], fold: bool = False, letters: bool = False) -> Words:
    """All words of the texts. ``fold`` lower-cases A-Z; ``letters`` takes runs of letters instead."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", dtype=np.uint8)
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    if fold:
        buf = FOLD[buf]
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = LETTER[buf] if letters else ~SPACE[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(start, offset)
    return Words(buf, offset, start, end, first, codes_of(buf, start, end))


def codes_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of slices of a buffer; the slices are in order and do not overlap."""
    code = np.empty(len(start), dtype=np.uint64)
    lo = 0
    while lo < len(start):
        base = start[lo]
        hi = max(lo + 1, int(np.searchsorted(end, base + TILE, side="right")))
        n = int(end[hi - 1] - base)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CODES[buf[base:base + n]] * powers(_BYTE_BASE, n), out=sums[1:])
        a, b = start[lo:hi] - base, end[lo:hi] - base
        code[lo:hi] = (sums[b] - sums[a]) * powers(inverse(_BYTE_BASE), n + 1)[a]
        lo = hi
    return mix(code + (end - start).astype(np.uint64))


class Spans:
    """Hashes of any spans of a sequence of word hashes. ``seed`` gives independent families."""

    def __init__(self, code: np.ndarray, seed: int = 0):
        self.base = _WORD_BASE + 2 * seed * 0x5851F42D4C957F2D & _MASK | 1
        n = len(code)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        if seed:
            code = mix(code + np.uint64(seed * 0x632BE59BD9B4E019 & _MASK))
        np.cumsum(code * powers(self.base, n), out=self.sums[1:])
        self.back = powers(inverse(self.base), n + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        span = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mix(span + np.asarray(length, dtype=np.uint64))


def normal_text(w: Words, lo: int, hi: int, keep: np.ndarray | None = None) -> bytes:
    """Words lo..hi (those kept), joined by one space."""
    if hi <= lo:
        return b""
    a, b = w.start[lo:hi], w.end[lo:hi]
    if keep is not None:
        a, b = a[keep], b[keep]
        if not len(a):
            return b""
    base = int(a[0])
    mark = np.zeros(int(b[-1]) - base + 2, dtype=np.int8)
    mark[a - base] += 1
    mark[b - base + 1] -= 1  # one separator after each word
    take = np.cumsum(mark[:-1]).astype(bool)
    out = np.append(w.buf[base:int(b[-1])], np.uint8(32))
    out[b - base] = 32
    return out[take].tobytes()[:-1]

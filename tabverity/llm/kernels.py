"""Vectorised word and window hashing over a batch of UTF-8 texts (runs inside Spark tasks)."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator (fixed constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


BASES = [int(v) | 1 for v in _stream(11, 4)]
INVERSES = [_inverse(b) for b in BASES]
BYTE_CODES = _stream(101, 256)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n, kept between calls."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = (INVERSES if inverse else BASES)[which]
        factors = np.full(max(n, 1 << 16), base, dtype=U)
        factors[0] = U(1)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(factors)
        if n <= 1 << 23:
            _POWERS[which, inverse] = have
    return have[:n]


#: Byte classes. White space: \x20 and \x09-\x0D. Benchmark words: 0-9, A-Z, a-z and everything beyond ASCII.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of a batch of texts: byte spans, the text of each word, and the first word of each text."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, lower: bool) -> None:
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, dtype=np.uint8)
        self.bytes = LOWER[raw] if lower else raw
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths + 1)
        inside = is_word[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends)]).astype(np.int64)
        self.text_starts = ends - lengths - 1
        self.n = len(self.starts)

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text())

    def hashes(self, which: int = 0) -> np.ndarray:
        n = len(self.bytes)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(BYTE_CODES[self.bytes] * powers(which, n))])
            return mix64((sums[self.ends] - sums[self.starts]) * powers(which, n, inverse=True)[self.starts] + U(which + 1))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of ``width`` words that stay inside one text, and the text of each."""
        counts = np.maximum(self.per_text() - width + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        skipped = self.first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else self.first[:-1]
        return np.arange(len(text)) + skipped[text], text

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes()

    def sequence(self, i: int, j: int) -> bytes:
        """Words i to j joined by one space."""
        return b" ".join(self.word(k) for k in range(i, j))


def window_hashes(word_hashes: np.ndarray, starts: np.ndarray, width: int | np.ndarray, which: int = 1) -> np.ndarray:
    """Hash of the ``width`` words from each start; independent of the place in the batch."""
    n = len(word_hashes)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(word_hashes * powers(which, n))])
        return mix64((sums[starts + width] - sums[starts]) * powers(which, n + 1, inverse=True)[starts] + U(which + 17))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges ``starts[i] .. starts[i] + counts[i] - 1``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def window_hashes_at(word_hashes: np.ndarray, starts: np.ndarray, width: int, which: int = 1) -> np.ndarray:
    """``window_hashes`` for a few starts: reads only the words of these windows."""
    total = np.zeros(len(starts), dtype=U)
    with np.errstate(over="ignore"):
        for k, p in enumerate(powers(which, width)):
            total += word_hashes[starts + k] * p
        return mix64(total + U(which + 17))

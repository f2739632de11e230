"""Vectorised hashes of words, word windows and byte windows over blocks of texts.

A block is a list of UTF-8 texts joined by line feeds; everything here is numpy on one block, so
the cost is a few nanoseconds a byte and the memory a small multiple of the block. Sums of
``value * base**position`` modulo 2**64 are built once as prefix sums; any window's hash is then one
subtraction and one multiplication with the inverse power (the bases are odd, so they have one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Target size of a block of texts. A longer text is a block of its own.
BLOCK_BYTES = 4 << 20

_U = np.uint64
_BASES = (0x9E3779B97F4A7C17 | 3, 0xD1B54A32D192ED07 | 3)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 7919 + 1))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; kept for the usual block size only."""
    have = _POWERS.get(seed)
    if have is not None and len(have[0]) >= n:
        return have[0][:n], have[1][:n]
    base = _BASES[seed]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, _U)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=_U))
    if n <= 2 * BLOCK_BYTES:
        _POWERS[seed] = (out[0], out[1])
    return out[0], out[1]


class Ranges:
    """Hashes of values[start:end] for any positions, before mixing."""

    def __init__(self, values: np.ndarray, seed: int):
        power, self.inverse = _powers(seed, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    return Ranges(values, seed)(starts, ends)


class Block:
    """Texts joined for vector work. ``words`` come as byte ranges with the text each is in."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.cumsum(lengths + 1) - lengths - 1
        self.text_length = lengths

    def split_words(self, separator: np.ndarray = _SEPARATOR) -> None:
        """Set word_start, word_end, word_text and first (index of each text's first word)."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = ~separator[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.word_start, self.word_end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.word_start, np.append(self.text_start, len(self.data) + 1))
        self.n_words = np.diff(self.first)
        self.word_text = np.repeat(np.arange(self.n), self.n_words)

    def word_hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        table = byte_table(seed)
        if lower:
            table = table.copy()
            table[65:91] = table[97:123]
        sums = range_sums(table[self.data], self.word_start, self.word_end, seed)
        return mix(sums + (self.word_end - self.word_start).astype(_U))

    def windows(self, width: int) -> np.ndarray:
        """Index of the first word of every run of ``width`` words inside one text."""
        at = np.arange(max(0, len(self.word_text) - width + 1))
        return at[self.word_text[at] == self.word_text[at + width - 1]]

    def byte_values(self, seed: int = 0) -> np.ndarray:
        return byte_table(seed)[self.data]


def window_hashes(word_hashes: np.ndarray, at: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    return mix(range_sums(word_hashes, at, at + width, seed))


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a list into consecutive ranges of about ``limit`` bytes."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def encoded(texts: list[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in texts]


def sums_by(mask: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of mask[begin:end] for each range; empty ranges give 0."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[end] - total[begin]

"""Vectorised words, shingles and hashes of many texts at once."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd 64-bit number and of its inverse, at least ``n`` of each, kept for later calls."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_P, _P_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = (out[0], out[1])
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, 64-bit hash) of every run of a-z and 0-9 in the lower-cased texts, in order.

    Letters are lower-cased one by one, so a dotted capital I is an i and no word ends behind it.
    """
    data = [text.replace("\u0130", "i").lower().encode("utf-8", "surrogatepass") for text in texts]
    buffer = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    inside = _WORD_BYTES[buffer]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    begins, ends = edges[::2], edges[1::2]
    up, down = powers(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    limits = np.cumsum([len(d) + 1 for d in data])
    return np.searchsorted(limits, begins, side="right"), hashes


def shingles(owner: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the different runs of ``size`` words of each text, sorted by both."""
    n = len(words) - size + 1
    if n <= 0:
        return owner[:0], words[:0], np.zeros(0, np.int64)
    whole = owner[:n] == owner[size - 1 :]
    hashes = np.zeros(n, np.uint64)
    for i in range(size):
        hashes = mix(hashes * _P + words[i : i + n] + np.uint64(i))
    owner, hashes = owner[:n][whole], hashes[whole]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def groups_of(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """(from, to) of runs of items whose sizes add up to ``most`` or little more."""
    out, start, held = [], 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            out.append((start, i + 1))
            start, held = i + 1, 0
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out

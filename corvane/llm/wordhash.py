"""Vectorised word splitting and hashing of UTF-8 texts.

Texts of a batch are laid end to end as bytes; words are found with a byte
table and hashed with numpy, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text worked on at once; one longer text forms a block of its own.
BLOCK_BYTES = 1 << 21

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_KEYS = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_WORD_KEYS = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_KEYS = _BYTE_KEYS[_LOWER]


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for bytes in the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of shingle words: space and the controls tab to carriage return.
SPACE = byte_table((0x20, 0x20), (0x09, 0x0D))
#: Separators of benchmark words: every ASCII byte but digits and letters (read after lower-casing).
NOT_ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of an odd number modulo 2^64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _STEP, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Words:
    """The words of a block of texts.

    ``hashes[bounds[i]:bounds[i + 1]]`` are those of text ``i``; ``starts`` and
    ``ends`` are byte places in ``data``.
    """

    __slots__ = ("bounds", "data", "ends", "hashes", "starts")

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, bounds: np.ndarray):
        self.data, self.starts, self.ends, self.hashes, self.bounds = data, starts, ends, hashes, bounds


def split(texts: Sequence[bytes], separators: np.ndarray) -> Words:
    """Words of each text, A-Z lower-cased for the hash; an empty text has none."""
    data = b" ".join(texts)
    n = len(data)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    text_starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64))
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.empty(n + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(separators[raw], out=inside[1:-1].view(bool))
    change = np.diff(inside)
    starts = np.flatnonzero(change == 1)
    ends = np.flatnonzero(change == -1)
    if len(starts) == 0:
        return Words(data, starts, ends, np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64))
    # position inside the word, only over word bytes
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    total = int(sizes.sum())
    place = np.arange(total, dtype=np.int64) - np.repeat(first, sizes)
    keys = _LOWER_KEYS[raw[inside[1:-1].view(bool)]]
    keys *= powers(int(sizes.max()))[place]
    hashes = mix(np.add.reduceat(keys, first) + sizes.astype(np.uint64))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, text_starts))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; runs cross texts and must be masked by the caller."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:count] * _WORD_KEYS[0]
    for j in range(1, size):
        out += hashes[j : j + count] * _WORD_KEYS[j]
    return mix(out + np.uint64(size))


def blocks(texts: Sequence[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``limit`` bytes."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(texts: Sequence[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles.

    A text with fewer words gives one hash of its whole sequence, one without
    words an empty array.
    """
    for begin, end in blocks(texts):
        words = split(texts[begin:end], SPACE)
        runs = windows(words.hashes, width)
        bounds = words.bounds
        for i in range(end - begin):
            low, high = int(bounds[i]), int(bounds[i + 1])
            n = high - low
            if n >= width:
                yield np.unique(runs[low : high - width + 1])
            elif n:
                yield windows(words.hashes[low:high], n)
            else:
                yield np.zeros(0, dtype=np.uint64)

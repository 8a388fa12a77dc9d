"""Sets of hashed five-word shingles, computed for many texts at once with numpy.

A word's hash is a polynomial over its bytes, a shingle's a mix of its five
words' hashes; both are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Words in a shingle.
WIDTH = 5
#: Bytes of text hashed together; a longer text is taken alone.
BLOCK_BYTES = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _ODD)


_OF_BYTE = stream(1, 256)
_OF_BYTE[65:91] = _OF_BYTE[97:123]  # A-Z as a-z
_OF_PLACE = stream(2, WIDTH) | np.uint64(1)
_OF_COUNT = stream(3, WIDTH + 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2^64, and those of its inverse."""
    base = 0x5851F42D4C957F2D
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of some texts, in order: bytes, bounds, hashes, and how many lie before each text's end."""

    def __init__(self, texts: Sequence[bytes]) -> None:
        self.raw = raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        n = len(raw)
        up, down = powers(1 << max(20, (n + 1).bit_length()))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw])).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_OF_BYTE[raw] * up[:n], out=sums[1:])
        lengths = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + lengths * _ODD)
        #: Where each text ends in ``raw``; one line feed follows it.
        self.text_ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        self.until = np.searchsorted(self.starts, self.text_ends)


def blocks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts that are hashed together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A text of fewer than five words has one, of its whole sequence; a text
    without words has none.
    """
    with np.errstate(over="ignore"):
        for i, j in blocks(texts):
            found = Words(texts[i:j])
            words, until = found.hashes, found.until
            if len(words) >= WIDTH:
                sums = words[: len(words) - WIDTH + 1] * _OF_PLACE[0]
                for k in range(1, WIDTH):
                    sums = sums + words[k : len(words) - WIDTH + 1 + k] * _OF_PLACE[k]
                whole = mix(sums + _OF_COUNT[WIDTH])
            start = 0
            for end in until.tolist():
                n = end - start
                if n >= WIDTH:
                    yield np.unique(whole[start : end - WIDTH + 1])
                elif n:
                    yield mix((words[start:end] * _OF_PLACE[:n]).sum(keepdims=True) + _OF_COUNT[n])
                else:
                    yield np.empty(0, dtype=np.uint64)
                start = end

"""Words of a batch of texts as numpy arrays: no Python object per word.

Texts come as the byte buffer and offsets of an Arrow string column. A word is a run of bytes other than white space;
its hash is a polynomial of its bytes modulo 2**64, taken from prefix sums, then mixed. Such polynomials can be made to
collide by words of a thousand bytes and more, so words over LONG bytes take xxhash instead. Hashes of runs of words
(shingles, k-grams) are made from word hashes as polynomials, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
LONG = 256
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that they have inverses modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 ... n) modulo 2**64; kept, as the next batch asks for about as many."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(n + n // 4 + 2, base, U64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U64)
    return have


def _runs(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """For each first <= i < last: the sum of values[i] * base ** (i - first), modulo 2**64."""
    n = len(values)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * _power(base, n)[:n], dtype=U64, out=sums[1:])
    return (sums[last] - sums[first]) * _power(pow(base, -1, 1 << 64), n)[first]


class Words:
    """starts, ends (in bytes), hashes and text numbers of the words of some texts; edges: text t has words edges[t]:edges[t + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> None:
        space = _SPACE[data]
        begin, end = ~space, ~space
        begin[1:] &= space[:-1]
        end[:-1] &= space[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begin[cuts] |= ~space[cuts]
        end[cuts - 1] |= ~space[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.edges = np.searchsorted(self.starts, offsets)
        data = _LOWER[data] if lower else data
        values = data.astype(U64) + U64(1)
        self.hashes = mix64(_runs(values, self.starts, self.ends, _BASE) + (self.ends - self.starts).astype(U64))
        for i in np.flatnonzero(self.ends - self.starts > LONG):
            self.hashes[i] = xxhash.xxh3_64_intdigest(data[self.starts[i] : self.ends[i]].tobytes())

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words that begin at each word; those that run past the last word are left out."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, U64)
        at = np.arange(n)
        return mix64(_runs(self.hashes, at, at + k, _WORD_BASE) + U64(k))


def pieces(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string column (null: empty) into runs of whole texts of about most_bytes: first text, bytes, offsets."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        to = min(to, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to

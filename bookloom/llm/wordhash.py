"""Words of many texts as flat arrays, with 64-bit hashes of words and of runs of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 2**64, 256, np.uint64)
P, Q1, Q2 = 0x9E3779B97F4A7C13, 0xD6E8FEB86659FD93, 0xA0761D6478BD642B
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**n modulo 2**64, kept and grown as needed."""
    old = _powers.get(base)
    if old is None or len(old) <= n:
        size = 1 << max(16, n.bit_length())
        steps = np.full(size + 1, base, np.uint64)
        steps[0] = 1
        _powers[base] = old = np.cumprod(steps, dtype=np.uint64)
        if size > 1 << 24:  # of one very long text; not worth keeping
            del _powers[base]
    return old[:n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span, by differences of one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[:-1], out=total[1:])
    inverse = pow(base, -1, 2**64)
    return mix((total[ends] - total[starts]) * powers(inverse, len(values))[starts])


@dataclass
class Words:
    """Flat words of several texts: text i has words first[i] to first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        return spans_hash(BYTE[self.data], self.starts, self.ends, P)

    def runs(self, n: int, base: int = Q1, salt: int = 0) -> np.ndarray:
        """Hash of each run of n words, also of those that cross texts."""
        m = max(0, len(self.starts) - n + 1)
        at = np.arange(m)
        return spans_hash(mix(self.hashes ^ np.uint64(salt)), at, at + n, base)

    def inside(self, n: int) -> np.ndarray:
        """Whether the run of n words from each place stays within its text."""
        m = max(0, len(self.starts) - n + 1)
        return np.repeat(self.first[1:], np.diff(self.first))[:m] >= np.arange(m) + n


def cut(texts: list[bytes], blank: np.ndarray = BLANK) -> Words:
    """Words are what stands between blank bytes."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = blank[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, starts, ends, np.searchsorted(starts, at))


def portions(batch: pa.RecordBatch, column: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each, at least one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]

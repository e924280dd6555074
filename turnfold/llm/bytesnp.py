"""Vectorised byte and word work on Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_A, _B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: \x20 and \x09-\x0D, the only separators of words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def times(n: int) -> np.uint64:
    """n times a fixed odd constant, modulo 2^64."""
    return U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on a fresh array."""
    x = x ^ (x >> U(30))
    x *= _A
    x ^= x >> U(27)
    x *= _B
    x ^= x >> U(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random words."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_BYTE = seeded(256, 77)
_BASE = U(0x2545F4914F6CDD1D)
_INV = U(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, U)
_ipow = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, 1 << 20)
        for name, base in (("_pow", _BASE), ("_ipow", _INV)):
            x = np.full(size, base, U)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _pow, _ipow


class Chunk(NamedTuple):
    first: int
    data: np.ndarray
    offs: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[Chunk]:
    """Rows of a text column as byte runs of about `limit` bytes (or one longer row); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Chunk(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes for which `inside` (256 booleans) holds; runs never cross rows."""
    on = inside[data]
    n = len(on)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, U))
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], on[:-1])) & ~edge[:n]
    after = np.concatenate((on[1:], [False])) & ~edge[1:]
    start, end = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    p, q = _powers(n + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[data] * p[:n], dtype=U)))
    h = mix((total[end] - total[start]) * q[start] + (end - start).astype(U))
    return Words(start, end, np.searchsorted(offs, start, "right") - 1, h)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Flat values as one list for each row."""
    offs = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))

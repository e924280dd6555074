"""Content-defined chunking with a gear hash."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .blake3 import blake3

#: Names the table; peers must agree on it to cut alike.
DOMAIN = b"turnfold-gear"


@lru_cache
def gear(domain: bytes = DOMAIN) -> np.ndarray:
    """256 words: the first 8 bytes of BLAKE3 of the domain and the number, both little-endian."""
    return np.array([int.from_bytes(blake3(domain + i.to_bytes(4, "little"))[:8], "little") for i in range(256)], np.uint64)


def cuts(data: bytes, least: int, most: int, bits: int, domain: bytes = DOMAIN) -> list[tuple[int, int]]:
    """Chunks (start, end) that tile `data`.

    The hash doubles and adds the byte's word, and is never reset, so its low `bits` bits depend on the
    last `bits` bytes only: they are a sum of shifted words, computed for all places at once. A chunk
    ends where they are all 0 and it has `least` bytes, or at `most`.
    """
    if not data:
        return []
    bits = min(bits, 40)
    words = gear(domain)[np.frombuffer(data, np.uint8)]
    h = np.zeros(len(data), np.uint64)
    for k in range(min(bits, len(data))):
        h[k:] += words[: len(words) - k] << np.uint64(k)
    ends = np.flatnonzero(h & np.uint64((1 << bits) - 1) == 0) + 1
    out, start = [], 0
    while start < len(data):
        i = np.searchsorted(ends, start + least)
        end = min(int(ends[i]) if i < len(ends) else len(data), start + max(most, least), len(data))
        out.append((start, end))
        start = end
    return out

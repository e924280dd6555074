"""BLAKE3 (hash mode) in plain Python, from its specification; for short inputs and tables."""

from __future__ import annotations

import struct

# fixed values
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
START, END, PARENT, ROOT = 1, 2, 4, 8
COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
M = 0xFFFFFFFF


def _compress(cv, block, counter, size, flags):
    v = [*cv, *IV[:4], counter & M, counter >> 32, size, flags]
    for r in range(7):
        for i, (a, b, c, d) in enumerate(COLUMNS):
            for word, x, y in ((block[2 * i], 16, 12), (block[2 * i + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & M
                t = v[d] ^ v[a]
                v[d] = (t >> x | t << 32 - x) & M
                v[c] = (v[c] + v[d]) & M
                t = v[b] ^ v[c]
                v[b] = (t >> y | t << 32 - y) & M
        block = [block[k] for k in ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _node(data: bytes, counter: int, root: int):
    """Chaining value of a tree over `data`, whose first chunk has number `counter`."""
    if len(data) <= 1024:
        cv, blocks = IV, range(0, max(1, len(data)), 64)
        for at in blocks:
            part = data[at : at + 64]
            flags = START * (at == 0) | (END | root) * (at == blocks[-1])
            cv = _compress(cv, struct.unpack("<16I", part.ljust(64, b"\0")), counter, len(part), flags)
        return cv
    left = 1024 << (((len(data) - 1) // 1024).bit_length() - 1)
    pair = _node(data[:left], counter, 0) + _node(data[left:], counter + left // 1024, 0)
    return _compress(IV, pair, 0, 64, PARENT | root)


def blake3(data: bytes) -> bytes:
    return struct.pack("<8I", *_node(data, 0, ROOT))

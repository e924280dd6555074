"""Varints, frames, programs, blocks and digests lists as bytes, and gated compression."""

from __future__ import annotations

import json
from enum import IntEnum

LIT, REF = 0, 1
ZSTD_LEVEL, ZSTD_LEAST, ZSTD_CAP = 3, 512, 64 << 20
MAX_FRAME = 64 << 20
#: What a frame is counted as beside its payload.
FRAME_COST = 12

# fixed values: what frames carry
Tag = IntEnum(
    "Tag",
    """HELLO HELLO_ACK REQUEST_HEAD PROGRAM BLOCK_BYTES BLOCK_PROGRAM NEED BLOOM RESPONSE_HEAD RESPONSE_BODY RESPONSE_END PEER_STATS
    PING PONG RESET CANCEL END_OF_BODY REQUEST_BODY FAIL PROGRAM_Z BLOCK_BYTES_Z BLOCK_PROGRAM_Z REQUEST_BODY_Z""".split(),
)
#: Uploads, and what they are when compressed.
PACKED = {t: Tag[f"{t.name}_Z"] for t in Tag if f"{t.name}_Z" in Tag.__members__}
UNPACKED = {z: t for t, z in PACKED.items()}


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(b: bytes, at: int) -> tuple[int, int]:
    n = 0
    for k in range(10):
        if at >= len(b):
            raise ValueError("truncated")
        n |= (b[at] & 127) << 7 * k
        at += 1
        if b[at - 1] < 128:
            if n >> 64:
                raise ValueError("overflow")
            return n, at
    raise ValueError("too long")


def _take(b: bytes, at: int, n: int) -> tuple[bytes, int]:
    if n > len(b) - at:
        raise ValueError("truncated")
    return b[at : at + n], at + n


def encode_frame(tag: int, stream: int, payload: bytes) -> bytes:
    return bytes([tag]) + put_varint(stream) + put_varint(len(payload)) + payload


def decode_frames(b: bytes) -> list[tuple[int, int, bytes]]:
    out, at = [], 0
    while at < len(b):
        tag = b[at]
        stream, at = get_varint(b, at + 1)
        n, at = get_varint(b, at)
        if n > MAX_FRAME:
            raise ValueError("frame too large")
        payload, at = _take(b, at, n)
        out.append((Tag(tag), stream, payload))
    return out


def upload(tag: Tag, payload: bytes, shrink: bool) -> tuple[Tag, bytes]:
    """What is sent of an upload: compressed, under the tag that says so, where that pays."""
    z = compress(payload) if shrink and tag in PACKED else None
    return (tag, payload) if z is None else (PACKED[tag], z)


def received(tag: Tag, payload: bytes) -> tuple[Tag, bytes]:
    return (UNPACKED[tag], decompress(payload)) if tag in UNPACKED else (tag, payload)


def encode_control(fields: dict) -> bytes:
    """A control message: JSON without its absent members."""
    return json.dumps({k: v for k, v in fields.items() if v is not None}, separators=(",", ":"), ensure_ascii=False).encode()


def decode_control(b: bytes) -> dict:
    out = json.loads(b)
    if not isinstance(out, dict):
        raise ValueError("not an object")
    return out


def encode_bloom(epoch: int, blocks: int, bloom: bytes) -> bytes:
    return put_varint(epoch) + put_varint(blocks) + bloom


def decode_bloom(b: bytes) -> tuple[int, int, bytes]:
    epoch, at = get_varint(b, 0)
    blocks, at = get_varint(b, at)
    return epoch, blocks, b[at:]


def encode_program(instrs) -> bytes:
    """instrs: bytes for a literal, (digest, length) for a reference."""
    out = [put_varint(len(instrs))]
    for x in instrs:
        out.append(bytes([LIT]) + put_varint(len(x)) + x if isinstance(x, bytes) else bytes([REF]) + x[0] + put_varint(x[1]))
    return b"".join(out)


def decode_program(b: bytes) -> list:
    n, at = get_varint(b, 0)
    out = []
    for _ in range(n):
        op, at = _take(b, at, 1)
        if op[0] == LIT:
            size, at = get_varint(b, at)
            x, at = _take(b, at, size)
        elif op[0] == REF:
            d, at = _take(b, at, 16)
            size, at = get_varint(b, at)
            x = (d, size)
        else:
            raise ValueError("operation")
        out.append(x)
    if at != len(b):
        raise ValueError("trailing bytes")
    return out


def encode_block(digest: bytes, kind: int, size: int, body) -> bytes:
    """body: bytes, or the instructions of a nested program, which is marked by a byte of ones."""
    mark, raw = (b"", body) if isinstance(body, bytes) else (b"\xff", encode_program(body))
    return digest + mark + bytes([kind]) + put_varint(size) + raw


def decode_block(b: bytes) -> tuple[bytes, int, int, object]:
    digest, at = _take(b, 0, 16)
    nested = b[at : at + 1] == b"\xff"
    kind, at = _take(b, at + nested, 1)
    size, at = get_varint(b, at)
    return digest, kind[0], size, decode_program(b[at:]) if nested else b[at:]


def encode_digests(digests: list[bytes]) -> bytes:
    return put_varint(len(digests)) + b"".join(digests)


def decode_digests(b: bytes) -> list[bytes]:
    n, at = get_varint(b, 0)
    if len(b) - at != 16 * n:
        raise ValueError("length")
    return [b[at + 16 * i : at + 16 * i + 16] for i in range(n)]


def compress(b: bytes) -> bytes | None:
    """The zstandard form if the text is long enough and saves a tenth."""
    import zstandard

    if len(b) < ZSTD_LEAST:
        return None
    z = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(b)
    return z if len(z) * 10 <= len(b) * 9 else None


def decompress(b: bytes) -> bytes:
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(b) as r:
        out = r.read(ZSTD_CAP + 1)
    if len(out) > ZSTD_CAP:
        raise ValueError("too large")
    return out

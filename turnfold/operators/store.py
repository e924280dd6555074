"""The block store: least recently used within bytes and counts, lazy expiry, and a bloom filter."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blake3 import blake3

BLOOM_DOMAIN, BLOOM_K, BLOOM_LEAST, BLOOM_CAP = b"turnfold-bloom", 6, 1024, 1 << 26
MAX_BYTES, MAX_BLOCKS, MAX_BLOCK, TTL = 200 << 20, 2_000_000, 200 << 20, 14 * 86_400


@dataclass
class Store:
    """One peer's blocks. Expiry is looked at only when a ceiling is passed."""

    max_bytes: int = MAX_BYTES
    max_blocks: int = MAX_BLOCKS
    max_block: int = MAX_BLOCK
    ttl: int = TTL
    entries: OrderedDict = field(default_factory=OrderedDict)  # digest -> (size, at), oldest use first
    size: int = 0
    hits: int = 0
    misses: int = 0
    stored: int = 0
    evictions: int = 0
    rejected: int = 0
    forget: Callable = lambda digest: None  # told of each block that a prune drops

    def insert(self, digest, size: int, now: int, sound: bool = True) -> bool:
        if not sound or size > self.max_block:
            self.rejected += 1
            return False
        if digest in self.entries:
            return False
        self.entries[digest] = (size, now)
        self.size += size
        self.stored += 1
        if self.size > self.max_bytes or len(self.entries) > self.max_blocks:
            self._prune(now)
        return True

    def get(self, digest, now: int) -> bool:
        if digest not in self.entries:
            self.misses += 1
            return False
        self.hits += 1
        self.touch(digest, now)
        return True

    def touch(self, digest, now: int) -> None:
        if digest in self.entries:
            self.entries[digest] = (self.entries[digest][0], now)
            self.entries.move_to_end(digest)

    def clear(self) -> int:
        n = len(self.entries)
        self.evictions += n
        self.entries.clear()
        self.size = 0
        return n

    def _prune(self, now: int) -> None:
        over_bytes, over_blocks = self.size - self.max_bytes, len(self.entries) - self.max_blocks
        gone = {d for d, (_, at) in self.entries.items() if self.ttl and now - at > self.ttl}
        freed = count = 0
        for d, (n, _) in self.entries.items():
            if d in gone:
                continue
            if freed >= over_bytes and count >= over_blocks:
                break
            gone.add(d)
            freed, count = freed + n, count + 1
        for d in gone:
            self.size -= self.entries.pop(d)[0]
            self.forget(d)
        self.evictions += len(gone)


class Blocks(dict):
    """Blocks by digest without a bound: digest -> (kind, size, block)."""

    def put(self, digest: bytes, kind: int, size: int, block) -> bool:
        """Whether the digest is new; a known one is written over."""
        new = digest not in self
        self[digest] = (kind, size, block)
        return new

    def remove(self, *digests: bytes) -> int:
        return sum(self.pop(d, None) is not None for d in digests)

    @property
    def bytes(self) -> int:
        return sum(size for _, size, _ in self.values())


def pruned(entries: DataFrame, max_bytes: int, max_blocks: int, ttl: int, now: int, peer: str = "peer") -> DataFrame:
    """entries (peer, digest, len, seq, at) with what one prune does to each: expired, evicted or kept.

    Running sums go over the peer's own entries in order of last use; a store is bounded by its byte
    ceiling, and so is a window's partition.
    """
    own = Window.partitionBy(peer)
    older = own.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    old = F.lit(ttl > 0) & (F.lit(now) - F.col("at") > ttl)
    live = lambda x: F.when(~F.col("_old"), x).otherwise(0)
    out = entries.withColumn("_old", old)
    out = out.withColumns({"_over": F.sum("len").over(own) - max_bytes, "_many": F.count("*").over(own) - max_blocks})
    out = out.withColumns({"_bytes": F.coalesce(F.sum(live(F.col("len"))).over(older), F.lit(0)), "_count": F.coalesce(F.sum(live(F.lit(1))).over(older), F.lit(0))})
    full = (F.col("_over") > 0) | (F.col("_many") > 0)
    evicted = (F.col("_bytes") < F.col("_over")) | (F.col("_count") < F.col("_many"))
    state = F.when(full & F.col("_old"), "expired").when(full & evicted, "evicted").otherwise("kept")
    return out.withColumn("state", state).drop("_old", "_over", "_many", "_bytes", "_count")


class Bloom:
    def __init__(self, capacity: int, k: int = BLOOM_K):
        self.m = 1 << (max(capacity, 64) * 10 - 1).bit_length()
        self.k = min(max(k, 1), 12)
        self.bits = bytearray(self.m // 8)

    def places(self, digest: bytes) -> list[int]:
        h = blake3(BLOOM_DOMAIN + digest)
        a, c = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:16], "little")
        return [((a + c * (i + 1)) & (1 << 64) - 1) % self.m for i in range(self.k)]

    def add(self, digest: bytes) -> None:
        for p in self.places(digest):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, digest: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(digest))

    def to_bytes(self) -> bytes:
        return self.m.to_bytes(8, "little") + self.k.to_bytes(4, "little") + bytes(self.bits)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Bloom:
        if len(raw) < 12:
            raise ValueError("short")
        out = cls.__new__(cls)
        out.m, out.k, out.bits = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:12], "little"), bytearray(raw[12:])
        if not out.k or out.m % 64 or not out.m or out.m > BLOOM_CAP or len(out.bits) * 8 != out.m:
            raise ValueError("header")
        return out

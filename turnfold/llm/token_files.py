"""Operator 7: token ids in binary shards of independent zstandard frames with a trailing seek table.

A shard: one frame for each document (its ids as little-endian unsigned 32-bit integers, with
zstandard's own checksum), in ascending doc_id order; then the seek table, an array of ENTRY; then
FOOTER. A reader opens the end of the file, and decompresses only the frames it wants.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ENTRY = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u4"), ("crc32", "<u4")])
#: Number of entries, crc32 of the seek table, tokens of the shard, magic.
FOOTER = struct.Struct("<QIQ4s")
MAGIC = b"TFS1"
END_ID = 2
LEVEL = 1
#: Stretches whose ids a worker remembers, at least; at twice as many the older half goes.
MEMORY = 600_000
#: Bytes of text for each shard, about.
SHARD_BYTES = 32 << 20


class Encoder:
    """Ids by the tokenizers library, each distinct stretch of text encoded once and remembered.

    The pattern never lets a pre-token run on into white space, and byte-level BPE never merges across
    pre-tokens. So a text may be cut before each space and each line feed that follows no white space,
    which is wherever they stand alone; texts with longer runs of them are cut into pre-tokens.
    """

    def __init__(self, path: str, pattern: str, memory: int = MEMORY):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(pattern).findall
        self.memory, self.known, self.older = memory, {}, {}
        self.marks = {"": b""}
        self.feed_ids = array("I", self.tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()

    def _learn(self, keys: list[str]) -> None:
        """A key is a text whose first character tells how it goes on: see _cut.

        A word of common letters, with marks after it or none, is one pre-token for its letters and one
        for its marks; the letters go to the library's model, without its pre-tokenizer.
        """
        known, older, tokenize = self.known, self.older, self.tokenizer.model.tokenize
        if len(self.marks) > self.memory:
            self.marks = {"": b""}
        marks, other = self.marks, []
        for k in keys:
            if (x := older.get(k)) is not None:
                known[k] = x
            elif m := WORD.fullmatch(k):
                if (end := marks.get(m[3])) is None:
                    end = marks[m[3]] = array("I", self.tokenizer.encode(m[3], add_special_tokens=False).ids).tobytes()
                ids = array("I", [t.id for t in tokenize(_letters(m))]).tobytes() + end
                known[k] = self.feed_ids + ids if m[1] == "\n" else ids
            else:
                other.append(k)
        for k, e in zip(other, self.tokenizer.encode_batch_fast(list(map(_piece, other)), add_special_tokens=False), strict=True):
            known[k] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Arrays of uint32, the same as the library's for the whole texts."""
        special = [any(s in t for s in self.special) for t in texts]
        cuts = [[] if s else _cut(t, self.find) for s, t in zip(special, texts, strict=True)]
        if len(self.known) > self.memory:
            self.known, self.older = {}, self.known
        if new := set().union(*cuts).difference(self.known):
            self._learn(list(new))
        get = self.known.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if s else np.frombuffer(b"".join(map(get, x)), np.uint32) for s, t, x in zip(special, texts, cuts, strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process, so that later tasks find the words of earlier ones."""
    return Encoder(path, pattern)


#: Marks a key that is a text by itself; other keys follow a space, or start with their line feed.
ITSELF = "\0"
#: How a key starts, Latin letters, ASCII marks.
WORD = re.compile(r"([\0\n]?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")
#: Byte-level vocabularies write a byte as itself where it prints, the others from 256 on in order.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTS))}


def _letters(m: re.Match) -> str:
    """The vocabulary's writing of the letters of a WORD, with the space before them if there is one."""
    w = m[2] if m[1] else " " + m[2]
    return w.encode().decode("latin-1").translate(_BYTES) if not m[2].isascii() else w if m[1] else SPACE + m[2]


SPACE = chr(_BYTES[0x20])


def _cut(text: str, find) -> list[str]:
    if not text:
        return []
    if "  " in text or " \n" in text or "\n\n" in text or ITSELF in text:
        return [ITSELF + p for p in find(text)]
    keys = text.replace("\n", " \n").split(" ")
    if keys[0]:
        keys[0] = ITSELF + keys[0]
    else:
        del keys[0]  # the text begins with a space or a line feed
    return keys


def _piece(key: str) -> str:
    if key[:1] == ITSELF:
        return key[1:]
    return key if key[:1] == "\n" else " " + key


def write_shard(sink, docs: Iterator[tuple[int | None, np.ndarray]], level: int = LEVEL) -> tuple[int, int]:
    """Frames, seek table and footer to an open file; returns the numbers of documents and ids."""
    import zstandard

    z = zstandard.ZstdCompressor(level=level, write_checksum=True)
    entries, at, tokens = [], 0, 0
    for doc_id, ids in docs:
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        frame = z.compress(raw)
        sink.write(frame)
        entries.append((doc_id or 0, doc_id is None, at, len(frame), len(ids), zlib.crc32(raw)))
        at, tokens = at + len(frame), tokens + len(ids)
    seek = np.array(entries, ENTRY).tobytes()
    sink.write(seek)
    sink.write(FOOTER.pack(len(entries), zlib.crc32(seek), tokens, MAGIC))
    return len(entries), tokens


class Shard:
    """Random access to one shard; every read is held against the checksums."""

    def __init__(self, file):
        import zstandard

        self.file, self.z = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, crc, self.n_tokens, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        seek = self._at(size - FOOTER.size - n * ENTRY.itemsize, n * ENTRY.itemsize)
        if zlib.crc32(seek) != crc:
            raise ValueError("the seek table is damaged")
        self.entries = np.frombuffer(seek, ENTRY)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(n))

    def ids(self, i: int) -> np.ndarray:
        e = self.entries[i]
        raw = self.z.decompress(self._at(e["offset"], e["size"]), max_output_size=int(e["n_tokens"]) * 4 or 1)
        if zlib.crc32(raw) != e["crc32"]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, "<u4")


def write_tokens(docs: DataFrame, tokenizer: str, pattern: str, at: str, shards: int) -> DataFrame:
    """Writes `docs` (doc_id, text) as shards under the folder `at`; one row for each shard.

    Range partitions on doc_id give ascending order over the shards and in them. A shard is written
    under a name of its own attempt and then renamed, so a retried task does no harm. Null texts are
    empty; null ids come first; rows of one id stand in the order of their texts.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = encoder(tokenizer, pattern), TaskContext.get().partitionId()
        store, folder = fs.FileSystem.from_uri(at)
        end = np.array([END_ID], np.uint32)

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for i in range(0, len(ids), 64):
                    for doc_id, x in zip(ids[i : i + 64], own.encode(texts.slice(i, 64).fill_null("").to_pylist()), strict=True):
                        yield doc_id, np.concatenate((x, end))

        name = f"{folder}/shard-{part:06d}.tfs"
        draft = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as sink:
            n, tokens = write_shard(sink, rows())
        store.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (name, pa.string()), (n, pa.int64()), (tokens, pa.int64()))], names=["shard", "file", "n_docs", "n_shard"])

    store, folder = fs.FileSystem.from_uri(at)
    store.create_dir(folder)
    put = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return put.mapInArrow(write, "shard int, file string, n_docs long, n_shard long")


def read_tokens(spark: SparkSession, at: str, shards: list[tuple[str, int]]) -> DataFrame:
    """One row for each document of the shards, from the files: doc_id, start, n_tokens, ids_crc32.

    `shards`: name and first position of each, in order; as many as there were write tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(at)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(name) as file:
                    shard = Shard(file)
                    e = shard.entries
                    ids = [shard.ids(i) for i in range(len(e))]
                    n = np.array([len(x) for x in ids], np.int64)
                    crc = np.array([zlib.crc32(x.tobytes()) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e["doc_id"], mask=e["null_id"].astype(bool)), pa.array(first + np.cumsum(n) - n), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(shards, "file string, first long").repartition(max(1, len(shards)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, pattern: str, at: str | None = None) -> DataFrame:
    """Encodes, writes and reads back; see write_tokens and read_tokens. Empty tables give no rows."""
    spark = docs.sparkSession
    at = at or f"{C.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in at and ":/" not in at:
        at = f"file://{at}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    shards = write_tokens(docs, tokenizer, pattern, at, max(1, -(-size // SHARD_BYTES))).filter("n_docs > 0").collect()  # one row for each write task
    firsts, total = [], 0
    for s in sorted(shards, key=lambda s: s.shard):
        firsts.append((s.file, total))
        total += s.n_shard
    return read_tokens(spark, at, firsts)

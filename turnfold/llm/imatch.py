"""Operator 8: I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms of an inverse-document-frequency band, counted over all documents. A
fingerprint has one 16-bit hash for each of 64 random subsets of the lexicon: of the sorted distinct
terms of the text that are in the subset. Subsets come at four rates, so that short and long texts,
and small and large edits, both leave some hashes equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesnp as B
from . import common as C

#: Share of documents that a term of the lexicon is in. The lexicon has at most (mean number of
#: distinct terms of a document) / LEAST entries of 4 bytes, however many documents there are.
LEAST, MOST = 0.0005, 0.1
RATES, PER_RATE = (1 / 4, 1 / 16, 1 / 64, 1 / 256), 16
#: A rate with fewer subsets that have terms says little.
ENOUGH = 6
SUBSETS = len(RATES) * PER_RATE
#: Slices of the term space that are counted apart.
SLICES = 256
#: Entries a task counts before it merges them.
PENDING = 1 << 21
SHARD_BYTES = 16 << 20
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, 32-bit term) pairs in order. Terms: runs of letters, digits and non-ASCII, A-Z lowered."""
    w = B.words(B.LOWER[data], offs, TERM)
    pair = np.unique(w.doc.astype(B.U) << B.U(32) | w.hash >> B.U(32))
    return (pair >> B.U(32)).astype(np.int64), pair.astype(np.uint32)


def _merge(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids, counts = ids[order], counts[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.add.reduceat(counts, first, dtype=np.int64) if len(ids) else counts


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted terms whose document frequency, exact over all of `docs`, lies in the band (and is 2 or more).

    Tasks count their own terms first and send one packed row for each slice of the term space.
    """
    n = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, held = np.zeros(0, np.uint32), np.zeros(0, np.int64), []
        waiting = 0

        def merged():
            got = np.unique(np.concatenate(held), return_counts=True)
            return _merge(np.concatenate((ids, got[0])), np.concatenate((counts, got[1].astype(np.int64))))

        for batch in batches:
            for c in B.chunks(batch.column(0)):
                held.append(terms(c.data, c.offs)[1])
                waiting += len(held[-1])
                if waiting > PENDING:
                    ids, counts = merged()
                    held, waiting = [], 0
        if held:
            ids, counts = merged()
        if not len(ids):
            return
        cut = np.searchsorted(ids >> np.uint32(24), np.arange(SLICES + 1))
        full = [k for k in range(SLICES) if cut[k] < cut[k + 1]]
        pack = lambda x: [x[cut[k] : cut[k + 1]].tobytes() for k in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(pack(ids), pa.binary()), pa.array(pack(counts), pa.binary())], names=["slice", "ids", "counts"])

    low, high = max(2, least * n), max(2, most * n)

    def band(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for a, b in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                ids, counts = _merge(np.concatenate((ids, np.frombuffer(a, np.uint32))), np.concatenate((counts, np.frombuffer(b, np.int64))))
        ids = ids[(counts >= low) & (counts <= high)]
        yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], names=["ids"])

    some = docs.select("text").mapInArrow(count, "slice int, ids binary, counts binary")
    got = some.groupBy("slice").applyInArrow(band, "ids binary").collect()  # of bounded size, see LEAST
    return np.sort(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r.ids, np.uint32) for r in got)]))


class Sketcher:
    def __init__(self, lex: np.ndarray):
        self.lex = lex
        member = []
        for s in range(SUBSETS):
            draw = B.mix(lex.astype(B.U) + B.seeded(SUBSETS, 3)[s])
            member.append(draw < B.U(int(RATES[s // PER_RATE] * 2**64)))
        at, subset = np.nonzero(np.array(member, bool).reshape(SUBSETS, -1).T)
        self.subset, self.first = subset, np.searchsorted(at, np.arange(len(lex) + 1))
        self.value = B.mix(lex.astype(B.U) * B.U(0x9E3779B97F4A7C15) + B.U(1))

    def hashes(self, texts: list[bytes]) -> np.ndarray:
        """(texts, SUBSETS) 16-bit hashes; 0 where a subset has no term of the text."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        doc, term = terms(data, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))
        out = np.zeros(len(texts) * SUBSETS, B.U)
        if len(self.lex):
            at = np.minimum(np.searchsorted(self.lex, term), len(self.lex) - 1)
            hit = self.lex[at] == term
            doc, at = doc[hit], at[hit]
            n = self.first[at + 1] - self.first[at]
            flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at], n)
            # terms come sorted; the sum of their mixed hashes names the same set
            np.add.at(out, np.repeat(doc, n) * SUBSETS + self.subset[flat], np.repeat(self.value[at], n))
        some = out != 0
        return np.where(some, np.maximum(B.mix(out) >> B.U(48), B.U(1)), B.U(0)).astype(np.uint16).reshape(len(texts), SUBSETS)


def printed(h: np.ndarray, text: bytes) -> str:
    """Hex of the hashes; a text without any term of the lexicon has the hash of the text itself."""
    return h.astype(">u2").tobytes().hex() if h.any() else "t" + hashlib.sha256(text).hexdigest()[:32]


def likeness(a: np.ndarray, b: np.ndarray, same: bool) -> float:
    """Of the subsets that either text has terms of, the share whose hashes are equal, at the rate
    where it is highest of those with ENOUGH such subsets (over all rates if none has); without any
    such subset, whether the texts are equal."""
    some = ((a != 0) | (b != 0)).reshape(len(RATES), PER_RATE)
    equal = (some & (a == b).reshape(some.shape)).sum(axis=1)
    n = some.sum(axis=1)
    if not n.any():
        return float(same)
    full = n >= ENOUGH
    return float((equal[full] / n[full]).max() if full.any() else equal.sum() / n.sum())


def below(bounds: list[int]) -> Column:
    """How many of the sorted bounds lie under doc_id: first by groups, then in one group of them."""
    if not bounds:
        return F.lit(0)
    side = isqrt(len(bounds)) + 1
    groups = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    listed = lambda x: f"array({', '.join(f'{b}L' for b in x)})"
    group = f"greatest(0, size(filter({listed([g[0] for g in groups])}, b -> b < doc_id)) - 1)"
    return F.expr(f"{group} * {side} + size(filter(get(array({', '.join(map(listed, groups))}), {group}), b -> b < doc_id))")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the beginning of the next document in descending doc_id; the last one is
    followed by the first. Null texts are empty; texts without terms of the lexicon are fingerprinted
    by their own hash. Rows of one id stand in descending order of their texts; null ids come last. A
    table of one row is its own next. Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lex = spark.sparkContext.broadcast(lexicon(docs))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, size // SHARD_BYTES)
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit((k + 1) / shards) for k in range(shards)]), max(10_000, 4 * shards))
    bounds = (docs.agg(cuts).first()[0] or [])[: shards - 1]
    put = docs.withColumn("_shard", F.when(F.col("doc_id").isNull(), -1).otherwise(below(sorted(set(bounds)))))
    # the last row of each shard (one id, then one text) goes before the first of the next, and the last of all before the first
    last = C.written(put.groupBy("_shard").agg(F.max("doc_id").alias("doc_id")), "last", shards)
    n, order = last.count(), Window.orderBy("_shard")
    follow = last.select("_shard", F.coalesce(F.lead("_shard").over(order), F.first("_shard").over(order)).alias("_next"))
    edge = put.join(C.light(last, n), put["doc_id"].eqNullSafe(last["doc_id"]) & (put["_shard"] == last["_shard"]), "left_semi").groupBy("_shard").agg(F.max("text").alias("text"))
    edge = C.written(edge.join(C.light(follow, n), "_shard").select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_next").alias("_shard")), "edges")
    put = put.withColumn("_own", F.lit(True)).unionByName(edge.withColumn("_own", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, prev = Sketcher(lex.value), b""
        for batch in batches:
            ids, at = batch.column(0), 0
            for c in B.chunks(batch.column(2)):
                n = len(c.offs) - 1
                own, texts, follow = batch.column(1).slice(at, n), [], []
                for k, emitted in enumerate(own.to_pylist()):
                    text = c.text(k)
                    if emitted:
                        texts.append(text)
                        follow.append(prev)
                    prev = text
                row, n, at = ids.slice(at, n).filter(own), len(texts), at + n
                if not n:
                    continue
                edited = []
                chars = []
                for t, f in zip(texts, follow, strict=True):
                    t = t.decode(errors="replace")
                    half = len(t) // 2
                    chars.append(len(t))
                    # so many code points are at most four times as many bytes
                    edited.append((t[: len(t) - half] + f[: 4 * half].decode(errors="ignore")[:half]).encode())
                h = sketcher.hashes([*texts, *edited, *follow])
                a, e, f = h[:n], h[n : 2 * n], h[2 * n :]
                cols = [
                    row,
                    pa.array(chars, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                    pa.array([printed(x, t) for x, t in zip(a, texts, strict=True)]),
                    pa.array([printed(x, t) for x, t in zip(e, edited, strict=True)]),
                    pa.array([likeness(x, y, t == u) for x, y, t, u in zip(a, e, texts, edited, strict=True)]),
                    pa.array([likeness(x, y, t == u) for x, y, t, u in zip(a, f, texts, follow, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=NAMES)

    put = put.repartitionByRange(shards, "_shard").sortWithinPartitions("_shard", "_own", "doc_id", "text").select("doc_id", "_own", "text")
    return put.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

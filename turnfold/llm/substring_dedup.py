"""Operator 4: removal of repeated byte strings by distributed prefix doubling.

Names stand for strings: equal names, equal strings. Names of length 2h come from the pairs of names
at p and p + h. Spark sorts and groups (name, position) pairs at growing lengths, and positions whose
name is unique take no part in the next round:

1. Length GRAM, at positions sampled by content: those of the least name in a neighbourhood of GRAM.
   Equal strings of LENGTH bytes have the same neighbourhoods inside, so a window with one whose
   sampled position is unique is unique. Names of this length are doubled from single bytes within a row, without Spark.
2. Sampled positions paired with the ones at growing offsets (1, 2, 4, ... of them) name whole
   stretches from a sampled position before a window to one after it. Windows inside a repeated stretch are repeated.
3. Length LENGTH, for windows that are still open, and, once for each repeated stretch, for windows
   of it that they may equal: pairs of names at p and p + LENGTH - 256.

Passages of over 50 words may have fewer than LENGTH bytes. They are not removed, but told in
n_passages: the same doubling over words names the strings of WORDS words, sampled by content, and
Spark groups them once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesnp as B
from . import common as C

LENGTH, GRAM = 400, 128
_GOLD = B.U(0x9E3779B97F4A7C15)
_PARTS = _GOLD * np.arange(1, 7, dtype=B.U)
#: Words of the strings that tell of passages, and how many neighbours one of them stands for: a
#: passage of WORDS + NEAR - 1 = 51 words holds a sampled string, wherever it begins.
WORDS, NEAR = 36, 16
#: A window holds the neighbourhoods that begin so many bytes after it, and those between.
ROOM = LENGTH - 2 * GRAM + 1


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = x * _GOLD
    x ^= x >> B.U(32)
    x += y
    return B.mix(x)


def _longer(h: np.ndarray, n: int, upto: int) -> np.ndarray:
    """Names of the strings of `upto` units at every position where one fits, from those of n (both powers of 2)."""
    while n < upto and len(h):
        h = _pair(h[:-n], h[n:])
        n *= 2
    return h


def _doubled(data: np.ndarray, upto: int) -> np.ndarray:
    """Names of the strings of `upto` (a power of 2, 8 at least) bytes; a string of 8 is its own number."""
    n = max(len(data) - 7, 0)
    return _longer(B.mix(np.ndarray(n, "<u8", np.ascontiguousarray(data), strides=(1,)).astype(B.U)), 8, upto) if n else np.zeros(0, B.U)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The first place of the least of x[i : i + n] for every i where that fits; n is a power of 2."""
    at, k = np.arange(len(x), dtype=np.int32), 1
    while k < n and len(x):
        right = x[k:] < x[:-k]
        x, at = np.where(right, x[k:], x[:-k]), np.where(right, at[k:], at[:-k])
        k *= 2
    return at


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of all rows, the names of GRAM bytes there, and the first and the last of the
    neighbourhoods (by their first position) that each is the least of."""
    h = _doubled(data, GRAM)
    if len(h) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, B.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = _least(h, GRAM)
    inside = np.zeros(len(data) + 1, np.int32)  # neighbourhoods have 2 * GRAM - 1 bytes, within one row
    full = np.diff(offs) >= 2 * GRAM - 1
    np.add.at(inside, offs[:-1][full], 1)
    np.add.at(inside, (offs[1:] - 2 * GRAM + 2)[full], -1)
    w = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
    q = at[w].astype(np.int64)
    if not len(w):
        return q, h[q], w, w
    new = np.r_[True, (q[1:] != q[:-1])]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(w) - 1]
    return q[new], h[q[new]], w[new], w[last]


#: Bytes of a chunk of texts: its arrays of 8 bytes a position stay in the processor's cache.
CHUNK = 1 << 16
#: Rows that a task holds before it combines them.
PENDING = 1 << 21
NAMED = "h long, k long, a long, b long, w tinyint"


class Combined:
    """Named rows (name h, row k, place a, b, whether they ask) of a task, combined by name.

    w: 1 a name seen once here, 2 the first of several, 3 one more of several. The last kind is known
    to be repeated and need not meet its name again; those that do not ask are not even kept.
    """

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, h, k, a, b, ask) -> Iterator[pa.RecordBatch]:
        self.held.append((h, k, a, b, ask))
        self.n += len(h)
        if self.n > PENDING:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, k, a, b, ask = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.argsort(h)
        name = h[order]
        new = np.r_[True, name[1:] != name[:-1]]
        size = np.diff(np.r_[np.flatnonzero(new), len(h)])
        w = np.empty(len(h), np.int8)
        w[order] = np.where(np.repeat(size > 1, size), np.where(new, 2, 3), 1)
        w = np.where(ask, w, -w).astype(np.int8)  # below 0: does not ask
        keep = np.flatnonzero(w != -3)  # in their first order: rows of a text stay together, and shrink well
        for i in range(0, len(keep), 1 << 17):
            on = keep[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (h.view(np.int64), k, a, b, w)], names=["h", "k", "a", "b", "w"])


def _met(named: DataFrame, surely: bool = False) -> DataFrame:
    """h, k, a, b, ask, sure, stands: whether a name is repeated, and one row of each that stands for it.
    With `surely`, only the rows that ask and whose name is repeated.

    A task sends each name once at most, so a common name brings no partition more rows than there are
    tasks; the others of several are spread evenly, and pass without being held.
    """
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    where = F.when(F.abs("w") == 3, F.xxhash64("k", "a")).otherwise(F.col("h"))

    def rows(h, k, a, b, ask, sure, stands) -> Iterator[pa.RecordBatch]:
        on = np.flatnonzero(sure & ask) if surely else np.arange(len(h))
        for i in range(0, len(on), 1 << 17):
            part = on[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (h, k, a, b, ask, sure, stands)], names=["h", "k", "a", "b", "ask", "sure", "stands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            alone = np.abs(cols[4]) == 3
            if alone.any():
                h, k, a, b, w = (x[alone] for x in cols)
                yield from rows(h, k, a, b, w > 0, np.ones(len(h), bool), np.zeros(len(h), bool))
            held.append([x[~alone] for x in cols])
        if not held:
            return
        h, k, a, b, w = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if not len(h):
            return
        order = np.argsort(h)
        name = h[order]
        new = np.r_[True, name[1:] != name[:-1]]
        first = np.flatnonzero(new)
        repeated = np.add.reduceat(np.abs(w[order]).astype(np.int64), first) > 1
        sure, stands = np.empty(len(h), bool), np.empty(len(h), bool)
        sure[order], stands[order] = np.repeat(repeated, np.diff(np.r_[first, len(h)])), new
        yield from rows(h, k, a, b, w > 0, sure, stands)

    return C.mapped(named.repartition(parts, where), run, "h long, k long, a long, b long, ask boolean, sure boolean, stands boolean")


def _sampled(docs: DataFrame) -> DataFrame:
    """A named row for each sampled position: its name and, as a, the position and how far back its
    neighbourhoods begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Combined()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for c in B.chunks(batch.column(1), CHUNK):
                at, g, first, last = anchors(c.data, c.offs)
                doc = np.searchsorted(c.offs, at, "right") - 1
                packed = (at - c.offs[doc]) << 16 | (at - first) << 8 | (at - last)
                yield from out.add(g, keys[c.first + doc], packed, np.zeros(len(at), np.int64), np.ones(len(at), bool))
        yield from out.flush()

    return C.mapped(docs.select("_k", "text"), run, NAMED)


def passage_samples(c: B.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and name of the sampled strings of WORDS words: of every NEAR neighbours, within
    one row, the one of the least name."""
    words = B.words(c.data, c.offs, ~B.SPACE)
    half = 1 << (WORDS.bit_length() - 1)
    h = _longer(words.hash, 1, half)
    rest = WORDS - half
    if len(words.hash) < WORDS + NEAR - 1:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, B.U)
    name = _pair(h[: len(h) - rest], h[rest:])
    at = _least(name, NEAR)
    at = at[words.doc[: len(at)] == words.doc[WORDS + NEAR - 2 :]].astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    return words.doc[at], at, name[at]


def repeated_passages(docs: DataFrame) -> DataFrame:
    """k, n_passages: how many sampled strings of WORDS words of a row also start elsewhere, where any do.

    docs: _k, text. Every row with a passage of 51 words or more that starts elsewhere too is there;
    no row without one of WORDS words is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Combined()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for c in B.chunks(batch.column(1), CHUNK):
                doc, at, name = passage_samples(c)
                yield from out.add(name, keys[c.first + doc], at, np.zeros(len(at), np.int64), np.ones(len(at), bool))
        yield from out.flush()

    return _met(C.mapped(docs.select("_k", "text"), run, NAMED), surely=True).groupBy("k").agg(F.count("*").alias("n_passages"))


def stretches(at: np.ndarray, g: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[tuple[int, int]]]:
    """From the repeated sampled positions of a row: (names, first windows, last windows) of the stretches
    that hold windows, and (first, last) of windows that no stretch of repeated positions holds.

    Both leave out windows that hold a neighbourhood whose sampled position is unique. (A position
    that is sampled only for a neighbourhood that reaches out of a window says nothing about it.)
    """
    order = np.argsort(at)
    at, g = at[order], g[order]
    pos = at >> 16
    first, last = pos - (at >> 8 & 255), pos - (at & 255)
    firsts = np.flatnonzero(np.r_[True, last[:-1] + 1 != first[1:]])
    closed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_: list[tuple[int, int]] = []
    span = LENGTH - GRAM
    for u, v in zip(firsts, np.r_[firsts[1:], len(pos)] - 1, strict=True):
        lo, hi = int(first[u]), int(last[v]) - ROOM
        if lo > hi:
            continue
        p = pos[u : v + 1]
        c_lo, c_hi = max(lo, int(p[0])), min(hi, int(p[-1]) - span)
        if c_lo > c_hi:
            open_.append((lo, hi))
            continue
        if lo < c_lo:
            open_.append((lo, c_lo - 1))
        if c_hi < hi:
            open_.append((c_hi + 1, hi))
        names = [g[u : v + 1]]  # of 1, 2, 4, ... sampled positions
        while 1 << len(names) <= len(p):
            h, n = names[-1], 1 << (len(names) - 1)
            names.append(_pair(h[:-n] + (p[n:] - p[:-n])[: len(h) - n].astype(B.U), h[n:]))
        # windows between two cuts have the same sampled positions around
        cuts = np.unique(np.r_[c_lo, p[(p > c_lo) & (p <= c_hi)], p[(p - span >= c_lo) & (p - span < c_hi)] - span + 1])
        ends = np.r_[cuts[1:] - 1, c_hi]
        i, j = np.searchsorted(p, cuts, "right") - 1, np.searchsorted(p, ends + span, "left")
        level = np.frexp((j - i + 1).astype(np.float64))[1] - 1  # of the longest names that fit
        base = np.cumsum([0, *map(len, names[:-1])])[level]
        names, far = np.concatenate(names), j - (1 << level) + 1
        parts = np.stack([names[base + i], names[base + far], *(x.astype(B.U) for x in (p[far] - p[i], j - i, cuts - p[i], ends - cuts))], axis=1)
        name = np.add.reduce(B.mix(parts + _PARTS) * (parts | B.U(1)), axis=1)
        closed.append((name, cuts, ends))
    return closed, open_


def _stretches(found: DataFrame) -> DataFrame:
    """Named rows of the ranges of windows; names of open ones are made up and do not matter.

    found: k, list (a, h). b: the last window, below 0 (and one less) if the range is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Combined()
        for batch in batches:
            lists = batch.column(1)
            offs = lists.offsets.to_numpy()
            at, g = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for k, i, j in zip(batch.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                closed, open_ = stretches(at[i:j], g[i:j].view(B.U))
                if open_:
                    a, b = np.array(open_, np.int64).T
                    made_up = (a * 2654435761 + k) & 0x7FFFFFFFFFFFFFFF
                    closed.append((made_up.view(B.U), a, -b - 1))
                if closed:
                    name, a, b = (np.concatenate(x) for x in zip(*closed, strict=True))
                    yield from out.add(name, np.full(len(a), k), a, b, np.ones(len(a), bool))
        yield from out.flush()

    return C.mapped(found, run, NAMED)


def _windows(texts: DataFrame) -> DataFrame:
    """Named rows of windows; those that only stand for a repeated stretch do not ask.

    texts: _k, text, list of (a, b, open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Combined()
        for batch in batches:
            lists = batch.column(2)
            offs = lists.offsets.to_numpy()
            first, last, opens = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts = batch.column(1).cast(pa.large_binary())
            for k, text, i, j in zip(batch.column(0).to_pylist(), texts, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                if len(data) < LENGTH:
                    continue
                half = _doubled(data, 256)
                name = _pair(half[: len(data) - LENGTH + 1], half[LENGTH - 256 :])
                size = last[i:j] - first[i:j] + 1
                p = np.arange(size.sum()) + np.repeat(first[i:j] - (np.cumsum(size) - size), size)
                asks = np.repeat(opens[i:j], size)
                yield from out.add(name[p], np.full(len(p), k), p, p, asks)
        yield from out.flush()

    return C.mapped(texts, run, NAMED)


def _joined(found: DataFrame) -> DataFrame:
    """k, spans: the byte runs that the windows of each row cover, in order, as start * 2^32 + end.

    found: k, list of first * 2^32 + last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offs = lists.offsets.to_numpy()
            v = lists.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
            if not len(v):
                continue
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs)) << 33  # no run reaches the next row's
            start, end = row + (v >> 32), row + (v & 0xFFFFFFFF) + LENGTH
            order = np.argsort(start)
            start, end = start[order], np.maximum.accumulate(end[order])
            first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
            start, end = start[first], end[np.r_[first[1:] - 1, len(end) - 1]]
            counts = np.bincount(start >> 33, minlength=len(offs) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), B.lists((start & (1 << 33) - 1) << 32 | end & (1 << 33) - 1, counts, pa.int64())], names=["k", "spans"])

    return C.mapped(found, run, "k long, spans array<long>")


def _cut(texts: DataFrame) -> DataFrame:
    """_k and the digest columns; texts: _k, text, list of byte runs, as start * 2^32 + end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            texts = batch.column(1).cast(pa.large_binary())
            for k, text, own in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                raw = text.as_py() or b""
                kept, at, removed = hashlib.sha256(), 0, 0
                for v in own:
                    start, end = v >> 32, v & 0xFFFFFFFF
                    kept.update(raw[at:start])
                    removed += end - start
                    at = end
                kept.update(raw[at:])
                out.append((k, removed, len(own), kept.hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["_k", "n_removed", "n_spans", "kept_sha256"])

    return C.mapped(texts, run, "_k long, n_removed long, n_spans long, kept_sha256 string")


def repeated_windows(docs: DataFrame, n: int) -> DataFrame:
    """k, spans: the byte runs of the windows of LENGTH bytes that also start elsewhere in `docs`.

    docs: _k, text, every text once. n: about how many rows; only the number of files goes by it."""
    found = _met(_sampled(docs), surely=True).groupBy("k").agg(F.collect_set(F.struct("a", "h")).alias("items"))
    ranges = _met(_stretches(found.select("k", "items")))
    last = F.when(F.col("b") < 0, -F.col("b") - 1).otherwise(F.col("b"))
    sure = F.col("sure") & (F.col("b") >= 0)
    ranges = C.written(ranges.select("k", "a", last.alias("b"), sure.alias("sure"), (~sure | F.col("stands")).alias("out")), "ranges", 8 * n)
    wanted = ranges.filter("out").groupBy(F.col("k").alias("_k")).agg(F.collect_list(F.struct("a", "b", (~F.col("sure")).alias("open"))).alias("own"))
    some = C.with_maybe(docs.select("_k", "text"), "_k", ranges.filter("out"), "k", "_maybe").filter("_maybe").drop("_maybe")
    open_ = _met(_windows(some.join(wanted, "_k").select("_k", "text", "own")), surely=True)
    span = F.expr("shiftleft(a, 32) + b").alias("r")
    both = ranges.filter("sure").select("k", span).union(open_.select("k", span))
    return _joined(both.groupBy("k").agg(F.collect_list("r").alias("spans")))


def substring_deduplicated(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id) of every row, n_bytes, n_removed, n_spans, kept_sha256, n_passages.

    Null and empty texts, and texts under LENGTH bytes, lose nothing (0, 0, 0 bytes for null). Texts
    that come more than once lose everything if they have LENGTH bytes; so they stand for each other
    and only one of them is searched. Ties play no part: all places of a repeated string lose it.
    Empty tables give no rows. n_passages is that of repeated_passages, else 0; rows that agree in
    text and `keep` columns are told their sum.
    """
    keep = keep or ["doc_id"]
    size, k, text = C.free_name(docs, "_n"), "_k", F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], text.alias("text"))
    base = base.withColumn(k, F.xxhash64(*[f"_keep{i}" for i in range(len(keep))], "text")).withColumn(size, F.octet_length("text").cast("long"))
    n_docs, long_ = docs.count(), base.filter(F.col(size) >= LENGTH)
    ids = C.written(long_.select(k, size, F.md5("text").alias("digest")).groupBy(k, "digest").agg(F.max(size).alias("n_bytes"), F.count("*").alias("rows")), "digests", n_docs)
    n_ids = ids.count()
    groups = ids.groupBy("digest").agg(F.min(k).alias("first"), F.sum("rows").alias("times")).filter("times > 1")
    copies = C.written(ids.join(groups, "digest").select(F.col(k).alias("k"), "first", "n_bytes", "rows"), "copies", n_ids)
    # each text once: rows that surely are no copies, and the first of each group
    split = C.with_maybe(long_.select(k, "text"), k, copies, "k", "_maybe")
    rest = split.filter("_maybe").drop("_maybe").join(copies.filter("k <> first").select(F.col("k").alias(k)), k, "left_anti")
    rest = rest.join(copies.filter("rows > 1").select(F.col("k").alias(k)), k, "left_anti").union(
        split.filter("_maybe").drop("_maybe").join(copies.filter("k = first and rows > 1").select(F.col("k").alias(k)), k, "left_semi").dropDuplicates([k])
    )
    spans = C.written(repeated_windows(split.filter("not _maybe").drop("_maybe").union(rest), n_ids), "spans", 4 * n_ids)
    passages = C.written(repeated_passages(base), "passages", n_docs)
    copies = copies.select("k", "n_bytes")
    partly = spans.join(copies.select("k"), "k", "left_anti").withColumnRenamed("k", k)
    cols = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]
    flagged = C.with_maybe(base, k, partly.select(k).union(copies.select("k")).union(passages.select("k")), k, "_maybe")
    nothing = [F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(0).cast("long").alias("n_passages")]
    clean = flagged.filter("not _maybe").select(*cols, F.col(size).alias("n_bytes"), *nothing)
    some = flagged.filter("_maybe")
    cut = _cut(some.join(partly, k).select(k, "text", "spans")).dropDuplicates([k])
    light = some.select(*[f"_keep{i}" for i in range(len(keep))], k, size, F.sha2("text", 256).alias("own"))
    light = light.join(cut, k, "left").join(copies.select(F.col("k").alias(k), F.lit(True).alias("all")), k, "left").join(passages.withColumnRenamed("k", k), k, "left")
    gone = F.coalesce("all", F.lit(False))
    zero = F.lit(0).cast("long")
    touched = light.select(
        *cols, F.col(size).alias("n_bytes"), F.when(gone, F.col(size)).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
        F.coalesce("n_passages", zero).alias("n_passages"),
    )
    return clean.union(touched)

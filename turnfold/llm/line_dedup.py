"""Operator 6: line dedup within an edit distance of 1, by a deletion-neighbourhood join.

Two lines at distance 1 become equal by deleting one character from both at one place, or from one of
them. So a line emits, hashed, each of its deletions with the place and without, and itself; equal
keys meet. Before that, a cheaper join on halves drops lines that can have no partner: one edit
leaves the first or the second half alone, so a partner shares a half and the lesser length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesnp as B
from . import common as C

#: Lines of fewer characters (without surrounding white space) are never dropped: only blank ones.
MIN_CHARS = 1
#: Keys in an Arrow batch, and characters of candidate lines that a task makes keys of.
KEY_ROWS, TASK_CHARS = 1 << 17, 1 << 19
#: Occurrences from which on a line's are not joined in one place, and shares that they are dealt to.
HOT, SALTS = 1000, 64
_BASE = int(B.seeded(1, 21)[0]) | 1
_GOLD = B.U(0x9E3779B97F4A7C15)


class _Powers:
    up = np.ones(1, B.U)
    down = np.ones(1, B.U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(max(n, 1 << 16), base, B.U)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up, cls.down


def _prefix(line: str) -> np.ndarray:
    """Hashes of the beginnings of a line, by code points."""
    c = B.mix(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(B.U) + B.U(7))
    return np.concatenate((np.zeros(1, B.U), np.cumsum(c * _Powers.of(len(c) + 1)[0][: len(c)], dtype=B.U)))


class Lines:
    """The lines that count of some texts: their text and number, characters, and hashes of their parts."""

    def __init__(self, texts: list[str]):
        self.whole = "\n".join(texts)
        codes = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        feeds = np.flatnonzero(codes == 10)
        start, end = np.r_[0, feeds + 1], np.r_[feeds, len(codes)]
        per = np.array([t.count("\n") + 1 for t in texts], np.int64)
        doc = np.repeat(np.arange(len(texts)), per)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        long_ = np.flatnonzero(end[: len(doc)] - start[: len(doc)] >= MIN_CHARS)
        plain = lambda at: (codes[at] > 32) & (codes[at] < 127)
        sure = plain(start[long_]) & plain(end[long_] - 1)
        for i in np.flatnonzero(~sure):
            sure[i] = len(self.whole[start[long_[i]] : end[long_[i]]].strip()) >= MIN_CHARS
        at = long_[sure]
        self.doc, self.number, self.start, self.end = doc[at], number[at].astype(np.int32), start[at], end[at]
        up, self.down = _Powers.of(len(codes) + 1)
        c = B.mix(codes.astype(B.U) + B.U(7))
        self.total = np.concatenate((np.zeros(1, B.U), np.cumsum(c * up[: len(c)], dtype=B.U)))

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def hashes(self) -> np.ndarray:
        return B.mix((self.part(self.start, self.end) ^ (self.end - self.start).astype(B.U) << B.U(1)) * _GOLD + B.U(1)).view(np.int64)

    def half_keys(self) -> np.ndarray:
        """For each line keys of its halves for a partner as long or longer, and for one that is shorter."""
        out, n = [], self.end - self.start
        for m in (n, n - 1):
            h = m // 2
            for side, (s, e) in enumerate(((self.start, self.start + h), (self.end - h, self.end))):
                out.append(B.mix((self.part(s, e) ^ (m.astype(B.U) << B.U(2) | B.U(side))) * _GOLD + B.U(2)))
        return np.stack(out, axis=1).view(np.int64) if len(n) else np.zeros((0, 4), np.int64)

    def texts(self) -> list[str]:
        return [self.whole[s:e] for s, e in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def variants(line: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the deletions with their places, without them, and of the line itself."""
    p = _prefix(line)
    n = len(p) - 1
    down = _Powers.of(n + 1)[1]
    i = np.arange(n)
    cut = p[:n] + (p[n] - p[1:]) * down[1]
    placed = B.mix(B.mix(cut + B.U(n)) * _GOLD + i.astype(B.U) + B.U(2))
    plain = B.mix(cut + B.times(n - 1) + B.U(5))
    own = B.mix(p[n:] + B.times(n) + B.U(5))
    return placed.view(np.int64), plain.view(np.int64), int(own.view(np.int64)[0])


def _chunked(column: pa.Array) -> Iterator[tuple[int, Lines]]:
    for c in B.chunks(column):
        yield c.first, Lines([c.text(j).decode(errors="replace") for j in range(len(c.offs) - 1)])


def _occurrences(docs: DataFrame) -> DataFrame:
    """k, doc_id, line, h, keys of every line that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in _chunked(batch.column(2)):
                row, keys = pa.array(first + x.doc), x.half_keys()
                cols = [batch.column(0).take(row), batch.column(1).take(row), pa.array(x.number), pa.array(x.hashes()), B.lists(keys.ravel(), np.full(len(keys), 4))]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "doc_id", "line", "h", "keys"])

    return C.mapped(docs.select("_k", "doc_id", "text"), run, "k long, doc_id long, line int, h long, keys array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    """h, text of every line of `docs` that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _chunked(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(x.hashes()), pa.array(x.texts(), pa.string())], names=["h", "line_text"])

    return C.mapped(docs.select("text"), run, "h long, line_text string")


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """v, p of every key of `lines` (id, line_text): p is 4 times the id plus the kind of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                placed, plain, own = variants(text)
                held += [(placed, 4 * i), (plain, 4 * i + 1), (np.array([own]), 4 * i + 2)]
                n += 2 * len(placed) + 1
                if n > KEY_ROWS:
                    yield from _sliced(held)
                    held, n = [], 0
            yield from _sliced(held)

    return C.mapped(lines.select("id", "line_text"), run, "v long, p long")


def _sliced(held: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    if held:
        v = np.concatenate([x for x, _ in held])
        p = np.repeat(np.array([y for _, y in held], np.int64), [len(x) for x, _ in held])
        for k in range(0, len(v), KEY_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(v[k : k + KEY_ROWS]), pa.array(p[k : k + KEY_ROWS])], names=["v", "p"])


def one_edit(a: str, b: str) -> bool:
    """Whether an edit distance is 1 at most, in time linear in the lines."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    unequal = np.flatnonzero(x[: len(y)] != y[: len(x)])
    i = int(unequal[0]) if len(unequal) else min(len(a), len(b))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _confirmed(pairs: DataFrame) -> DataFrame:
    """h of the pairs (h, one, two) of lines that an edit makes equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [one_edit(a.as_py(), b.as_py()) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(on, pa.bool_()))], names=["h"])

    return C.mapped(pairs.select("h", "one", "two"), run, "h long")


def _near(docs: DataFrame, occ: DataFrame, firsts: DataFrame, n: int) -> DataFrame:
    """h of the lines that lie at an edit distance of 1 from a line that first occurs earlier.

    n: how many different lines there are."""
    keys = occ.select("h", F.explode("keys").alias("key"))
    # a line has four keys, and a shared key two lines at least: so they are 2 * n at most
    shared = C.written(keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a != b").select("key"), "shared", 2 * n)
    some = C.with_maybe(keys, "key", shared, "key", "_maybe").filter("_maybe").drop("_maybe").join(shared, "key", "left_semi")
    # numbered in the order of first occurrence: a key of the join is then two numbers wide
    some = some.select("h").distinct().join(firsts, "h").select("h", "first").orderBy("first")
    some = C.written(some.select("h", "first", F.monotonically_increasing_id().alias("id")), "candidates", n)
    n_some = some.count()
    own = C.with_maybe(docs.select("_k", "text"), "_k", some.select(F.col("first.k").alias("k")), "k", "_maybe").filter("_maybe")
    # all lines of their texts are read for that: more files than for the candidates alone
    text = C.written(_texts(own).join(some.select("h", "id"), "h").dropDuplicates(["h"]).select("id", "h", "line_text"), "candidate-lines", 16 * n_some)
    chars = text.agg(F.sum(F.length("line_text"))).first()[0] or 0
    v = _neighbourhood(text.repartition(max(1, -(-chars // TASK_CHARS)), "id"))
    kind, at = F.col("p") % 4, F.shiftright("p", 2)
    per = Window.partitionBy("v")
    earliest = [F.min(F.when(kind == k, at)).over(per).alias(f"e{k}") for k in range(3)]
    # of equal length: the same place deleted. Else the longer line's deletion is the shorter line itself
    other = F.when(kind == 0, F.col("e0")).when(kind == 1, F.col("e2")).otherwise(F.col("e1"))
    pairs = v.select("p", *earliest).select(at.alias("id"), other.alias("other")).filter("other < id").groupBy("id").agg(F.min("other").alias("other"))
    a, b = text.select("id", "h", F.col("line_text").alias("one")), text.select(F.col("id").alias("other"), F.col("line_text").alias("two"))
    return C.written(_confirmed(pairs.join(a, "id").join(b, "other")), "near-lines", n_some)


def _found(occ: DataFrame, marked: DataFrame) -> DataFrame:
    """`occ` joined to `marked` (h, first, all, times) on h; lines of many occurrences are broadcast or, if they are many, salted."""
    hot = marked.filter(F.col("times") > HOT)
    n, cold = hot.count(), marked.filter(F.col("times") <= HOT).drop("times")
    if not n:
        return occ.join(cold, "h")
    split = C.with_maybe(occ, "h", hot, "h", "_maybe")
    some = split.filter("_maybe").drop("_maybe").withColumn("_salt", F.pmod(F.xxhash64("k", "line"), F.lit(SALTS)))
    on = hot.drop("times")
    if n <= C.LIGHT_ROWS:
        some = some.drop("_salt").join(F.broadcast(on), "h", "left")
    else:
        some = some.join(on.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "_salt"], "left").drop("_salt")
    rest = split.filter(~F.col("_maybe")).drop("_maybe").unionByName(some.filter("first is null").select(occ.columns))
    return some.filter("first is not null").unionByName(rest.join(cold, "h"))


def dropped_lines(docs: DataFrame, exact_only: bool = False) -> DataFrame:
    """k, drops: the numbers of the lines to drop, for each row (by its key _k) that loses any.

    Earliest goes by doc_id (nulls first), then the row's key, then the line number. A line is dropped
    if an equal line, or one whose text first occurs earlier and is at edit distance 1, precedes it.
    """
    occ = C.written(_occurrences(docs), "lines")
    n_occ = occ.count()
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("k"), F.col("line"))
    firsts = C.written(occ.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("times")), "firsts", n_occ)
    n = firsts.count()
    marked = firsts.filter("times > 1").withColumn("all", F.lit(False))
    if not exact_only:
        near = _near(docs, occ, firsts, n)
        marked = marked.join(near, "h", "left_anti").unionByName(near.join(firsts, "h").withColumn("all", F.lit(True)))
    hit = _found(occ.select("h", "k", "doc_id", "line"), C.written(marked, "marked", n)).filter(F.col("all") | (place != F.col("first")))
    return C.written(hit.groupBy("k").agg(F.array_sort(F.collect_set("line")).alias("drops")), "drops", n_occ)


def line_deduplicated(docs: DataFrame, counts: tuple[str, str] | None = None) -> DataFrame:
    """`docs`, all rows and columns, with the repeated and nearly repeated lines cut out of `text`.

    n_chars, if there is such a column, follows the new text. `counts` names two columns that are
    added: the lines of the text as it was, and how many of them were dropped; columns of these names
    are replaced. Null texts stay null, empty ones empty; a text that loses all lines is empty. A row
    that repeats another (same id and text) loses the lines that the other keeps or loses: both
    count as one occurrence. Empty tables stay empty.
    """
    k, flag, cut, all_ = (C.free_name(docs, x) for x in ("_row", "_maybe", "_cut", "_all"))
    keyed = docs.withColumn(k, C.row_key(docs, "doc_id", "text"))
    drops = dropped_lines(keyed.select(F.col(k).alias("_k"), "doc_id", "text")).withColumnRenamed("k", k)
    drops = drops.withColumnRenamed("drops", gone := C.free_name(docs, "_drops"))
    split = C.with_maybe(keyed, k, drops, k, flag)
    hit = split.filter(flag).join(drops, k, "left")
    lines = F.split("text", "\n")
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    hit = hit.withColumn(cut, F.coalesce(F.size(gone), F.lit(0))).withColumn(all_, F.size(lines))
    hit = hit.withColumn("text", F.when(F.col(cut) > 0, rest).otherwise(F.col("text"))).drop(gone)
    out = split.filter(~F.col(flag)).withColumns({cut: F.lit(0), all_: F.size(lines)}).unionByName(hit)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    extra = [F.greatest(F.col(all_), F.lit(0)).alias(counts[0]), F.col(cut).alias(counts[1])] if counts else []
    taken = {c.lower() for c in counts or ()}
    return out.select(*[c for c in docs.columns if c.lower() not in taken], *extra)

"""Operator 5: quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesnp as B
from . import common as C

SYMBOLS = [ord(c) for c in "#*$%&|<>"]
#: Metric, side, slack: a document fails above q75 + WIDTH * (q75 - q25) + slack (below, for the low side).
RULES = [("symbol_ratio", "high", 0.05), ("dup_line_ratio", "high", 0.2), ("repeat_ratio", "high", 0.2), ("mean_word_chars", "high", 1.0), ("mean_word_chars", "low", 1.0)]
WIDTH = 3.0
#: Relative rank error of a sketch is 1 / ACCURACY.
ACCURACY = 2000
#: A group's quantiles are means of its own, weighted by its texts, and of those over all, weighted by so many texts.
PRIOR = 5
#: Up to so many rows of thresholds are broadcast; more are joined on salted keys.
BROADCAST_ROWS, SALTS = 20_000, 64
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def count_text(b: bytes) -> tuple[int, int, int, int, int, int]:
    """COUNTS of one text. Words are split at ASCII white space only, as bytes.split() does."""
    w = b.split()
    n = len(w)
    chars = sum(len(x) for x in w)
    if not b.isascii():  # continuation bytes are no characters
        chars -= sum((x & 0xC0) == 0x80 for x in b) if len(b) < 64 else int((B.np.frombuffer(b, "u1") & 0xC0 == 0x80).sum())
    symbols = sum(map(b.count, SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in b.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n > 2:
        tri = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(tri)) < len(tri):
            times, upto = Counter(tri), 0
            for i, t in enumerate(tri):
                if times[t] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return n, chars, symbols, dup, repeated, lines


def metrics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and COUNTS of each row of `docs`; a null text has no words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary()).fill_null(b"")
            rows = [count_text(x.as_py()) for x in texts]
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*keep, *COUNTS])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in COUNTS)])
    return docs.select(*keep, "text").mapInArrow(count, schema)


def with_ratios(m: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return m.withColumns({"symbol_ratio": per("n_symbols", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words"), "mean_word_chars": per("word_chars", "n_words")})


def _limits(q: Column, side: str, slack: float) -> Column:
    low, high = q[0], q[1]
    return high + WIDTH * (high - low) + slack if side == "high" else low - WIDTH * (high - low) - slack


def thresholds(m: DataFrame) -> DataFrame:
    """Limits per language and source from mergeable quantile sketches, combined before the shuffle.

    Null keys form groups of their own. Texts without words take no part. A group of n texts has the
    quantiles (n * its own + PRIOR * those over all) / (n + PRIOR), for every n.
    """
    names = list(dict.fromkeys(r[0] for r in RULES))
    sketch = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), ACCURACY).alias(f"q_{c}") for c in names]
    some = m.filter("n_words > 0")
    own = some.groupBy("lang", "source").agg(F.count("*").alias("n_group"), *sketch)
    whole = some.agg(*[s.alias(f"all_{c}") for s, c in zip(sketch, names, strict=True)])
    both = own.join(F.broadcast(whole))
    use = {c: F.zip_with(f"q_{c}", f"all_{c}", lambda own, whole: (F.col("n_group") * own + PRIOR * whole) / (F.col("n_group") + PRIOR)) for c in names}
    return both.select("lang", "source", "n_group", *[_limits(use[c], side, slack).alias(f"{side}_{c}") for c, side, slack in RULES])


def quality_rules(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: `keep` columns (doc_id), COUNTS, base_failed, kept.

    Null or empty texts: all counts 0, base_failed, not kept. Repeated rows are judged alike, each
    by itself. Empty tables give empty results. Other columns of `docs` are not touched. Rows of a
    language and source without any word have no thresholds and fail the base rule anyway.
    """
    keep = keep or ["doc_id"]
    m = C.written(metrics(docs, list(dict.fromkeys([*keep, "lang", "source"]))), "quality-metrics")
    limits = C.written(thresholds(with_ratios(m)), "quality-limits")
    m = with_ratios(m)
    on = ["lang", "source"]
    if limits.count() <= BROADCAST_ROWS:
        limits, extra = F.broadcast(limits), []
    else:
        m = m.withColumn("_salt", F.pmod(F.xxhash64("n_words", "word_chars", *keep), F.lit(SALTS)).cast("int"))
        limits, extra = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_salt"]
    a, b = m.alias("a"), limits.alias("b")
    cond = F.lit(True)
    for c in on:
        cond &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    for c in extra:
        cond &= F.col(f"a.{c}") == F.col(f"b.{c}")
    out = a.join(b, cond, "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = F.lit(False)
    for c, side, _ in RULES:
        x, limit = F.col(c), F.col(f"{side}_{c}")
        bad |= F.coalesce(x > limit if side == "high" else x < limit, F.lit(False))
    return out.select(*[F.col(f"a.{c}") for c in keep], *[c for c in COUNTS if c != "n_lines"], base.alias("base_failed"), (~base & ~bad).alias("kept"))

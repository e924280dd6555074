"""Operator 1: a quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything else is unlabelled, and labels of 0 are never
used. The class prior comes from best-bin estimation: the least ratio of unlabelled to positive
documents above a score. The classifier minimises the non-negative unbiased risk
prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]) with the logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesnp as B
from . import common as C

#: Documents of either kind that the model is fitted on, at most; every document is scored.
SAMPLE = 8000
STEPS, RATE, DECAY = 400, 0.03, 1e-3
KINDS = 16


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 15, np.intp)
    for k, chars in enumerate(("aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "#*$%&", "|<>", "@/\\_=+~^", "\"'`()[]{}-")):
        kind[[ord(c) for c in chars]] = k
    kind[0x80:0xC0], kind[0xC0:] = 13, 14
    return kind


KIND = _byte_kinds()
N_FEATURES = KINDS * KINDS + 6
_SOLID = ~B.SPACE


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row for each text: frequencies of pairs of byte kinds, lengths, and repetition."""
    n = len(offs) - 1
    size = np.diff(offs).astype(np.float64)
    out = np.zeros((n, N_FEATURES), np.float32)
    doc = np.repeat(np.arange(n), np.diff(offs))
    if len(data) > 1:
        kind = KIND[data]
        inside = doc[1:] == doc[:-1]
        code = (doc[1:] * KINDS + kind[:-1]) * KINDS + kind[1:]
        pairs = np.bincount(code[inside], minlength=n * KINDS * KINDS).reshape(n, -1)
        out[:, : KINDS * KINDS] = np.sqrt(pairs / np.maximum(size - 1, 1)[:, None])
    w = B.words(data, offs, _SOLID)
    words = np.bincount(w.doc, minlength=n).astype(np.float64)
    distinct = np.zeros(n)
    if len(w.doc):
        order = np.lexsort((w.hash, w.doc))
        h, d = w.hash[order], w.doc[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
        distinct = np.bincount(d[first], minlength=n)
    lines = np.bincount(doc[data == 10], minlength=n) + 1.0
    extra = (np.log1p(size), np.log1p(words), size / np.maximum(words, 1) / 10, distinct / np.maximum(words, 1), distinct / np.sqrt(np.maximum(words, 1)) / 10, np.log1p(words / lines))
    out[:, KINDS * KINDS :] = np.stack(extra, axis=1)
    return out


def _adam(loss_grad, w: np.ndarray, steps: int) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = loss_grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among scores `u`: least upper ratio over cuts that keep enough of `p`."""
    cuts = np.quantile(p, np.linspace(0.0, 0.9, 91))
    share_p = 1 - np.searchsorted(np.sort(p), cuts) / len(p)
    share_u = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    slack = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((share_u + slack) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


class Fitted:
    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None):
        """Either sample may be empty; then every score is 0.5."""
        self.weights, self.prior = np.zeros(N_FEATURES + 1), prior
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        if not len(positives) or not len(unlabelled):
            return
        both = np.concatenate((positives, unlabelled)).astype(np.float64)
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 0.01
        p, u = self._inputs(positives), self._inputs(unlabelled)
        keep = np.r_[np.full(N_FEATURES, DECAY), 0]
        if prior is None:
            fit_p, fit_u, val_p, val_u = p[::2], u[::2], p[1::2], u[1::2]

            def versus(w: np.ndarray) -> np.ndarray:
                return fit_p.T @ (_sigmoid(fit_p @ w) - 1) / len(fit_p) + fit_u.T @ _sigmoid(fit_u @ w) / len(fit_u) + keep * w

            w = _adam(versus, self.weights, STEPS // 2)
            self.prior = estimate_prior(val_p @ w, val_u @ w) if len(val_p) and len(val_u) else 0.5
        pi = self.prior

        def risk(w: np.ndarray) -> np.ndarray:
            fp, fu = p @ w, u @ w
            loss_n = np.logaddexp(0, fu).mean() - pi * np.logaddexp(0, fp).mean()
            g_neg = u.T @ _sigmoid(fu) / len(u) - pi * (p.T @ _sigmoid(fp)) / len(p)
            if loss_n < 0:
                return -g_neg
            return pi * (p.T @ (_sigmoid(fp) - 1)) / len(p) + g_neg + keep * w

        self.weights = _adam(risk, self.weights, STEPS)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((z, np.ones((len(z), 1))), axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._inputs(x) @ self.weights)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _sampled(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in B.chunks(batch.column(0)):
                x = features(c.data, c.offs)
                yield pa.RecordBatch.from_arrays([B.lists(x.ravel(), np.full(len(x), N_FEATURES), pa.float32())], names=["x"])

    some = C.mapped(docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text"), run, "x array<float>")
    got = some.toArrow().column("x")
    return np.asarray(got.combine_chunks().flatten() if len(got) else [], np.float32).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Fitted:
    """Fits on at most `sample` trusted positives and `sample` unlabelled documents, chosen by a hash
    of doc_id, none of them held out. Null ids and null labels take no part."""
    by_hash = lambda df: df.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    return Fitted(_sampled(docs, by_hash(labels.filter("quality = 1"))), _sampled(docs, by_hash(docs)))


def scored(docs: DataFrame, model: Fitted, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id) of every row with score in [0, 1]; null and empty texts alike have one."""
    keep = keep or ["doc_id"]
    name = C.free_name(docs, "_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.score(features(c.data, c.offs)) for c in B.chunks(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(x) if x else np.zeros(0))], names=[*keep, name])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"{name} double"])
    return C.mapped(docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text")), run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Repeated rows are scored alike, each by itself. Empty tables give no rows; without any label of 1
    outside the held-out fold every score is 0.5. lang, source and other columns are never read.
    """
    name = C.free_name(docs, "_score")
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier predicts to be good."""
    name = C.free_name(docs, "_score")
    return scored(docs, fit(docs, labels), docs.columns).filter(F.col(name) >= 0.5).drop(name)

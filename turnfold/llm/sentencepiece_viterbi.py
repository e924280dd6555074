"""Operator 2: SentencePiece encoding and decoding by a batched numpy Viterbi.

Words of equal length advance together. At each end position the hashes of all substrings that end
there probe the sorted hashes of the pieces, and one vectorised maximum over the starts stores the
best score and its backpointer. Scores are the model's own, added in 32 bits; of equal sums the
longest last piece wins, which is what the library does for unigram models.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesnp as B
from . import common as C

#: How much worse an unknown character is than the worst piece (fixed by the format).
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words whose ids a worker remembers, at least; at twice as many the older half goes.
MEMORY = 200_000
#: Slots of the table that is asked before the sorted keys; a power of 2.
TABLE = 1 << 20
#: Cells of substrings looked up at once.
CELLS = 1 << 18


class Model:
    def __init__(self, path: str, memory: int = MEMORY):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unknown = sp.unk_id()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_fallback = bool((self.byte_ids != self.unknown).all())
        self.widest = max(len(pieces[i]) for i in usable)
        self.base = B.seeded(1, 5)[0] | B.U(1)
        inverse = B.U(pow(int(self.base), -1, 1 << 64))
        self.power = np.multiply.accumulate(np.r_[B.U(1), np.full(63, self.base, B.U)])
        self.inverse = np.multiply.accumulate(np.r_[B.U(1), np.full(63, inverse, B.U)])
        keys = np.concatenate([self._hash_pieces([(pieces[i], i) for i in usable])])
        order = np.argsort(keys["h"])
        self.keys, self.ids = keys["h"][order], keys["id"][order]
        self.scores = np.array([sp.get_score(int(i)) for i in self.ids], np.float32)
        self.table = np.zeros(TABLE, bool)
        self.table[self.keys & B.U(TABLE - 1)] = True
        self.unknown_score = np.float32(self.scores.min() - UNKNOWN_PENALTY)
        self.split = None if any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in usable) else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.bytes = [p.replace(SPACE, " ").encode() for p in pieces]
        for i in range(n):
            if sp.is_control(i):
                self.bytes[i] = b""
        for b, i in enumerate(self.byte_ids):
            if self.byte_fallback:
                self.bytes[i] = bytes([b])
        self.memory, self.known, self.older = memory, {}, {}

    def _hash(self, prefix: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        """Of the substrings [start, end) of all rows; positions count modulo the table of powers."""
        return B.mix((prefix[:, end, None] - prefix[:, starts]) * self._inv[starts] + (end - starts).astype(B.U))

    def _prefix(self, chars: np.ndarray) -> np.ndarray:
        n = chars.shape[1]
        self._inv = np.multiply.accumulate(np.r_[B.U(1), np.full(n, self.inverse[1], B.U)])
        power = np.multiply.accumulate(np.r_[B.U(1), np.full(n, self.base, B.U)])
        out = np.zeros((len(chars), n + 1), B.U)
        np.cumsum(B.mix(chars.astype(B.U) + B.U(1)) * power[:n], axis=1, out=out[:, 1:])
        return out

    def _hash_pieces(self, pieces: list[tuple[str, int]]) -> np.ndarray:
        out, at = np.zeros(len(pieces), [("h", B.U), ("id", np.int32)]), 0
        by: dict[int, list[tuple[str, int]]] = {}
        for p in pieces:
            by.setdefault(len(p[0]), []).append(p)
        for n, some in by.items():
            chars = _chars([p for p, _ in some], n)
            out["h"][at : at + len(some)] = self._hash(self._prefix(chars), np.array([0]), n)[:, 0]
            out["id"][at : at + len(some)] = [i for _, i in some]
            at += len(some)
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, as int32 bytes."""
        n = len(words[0])
        step = max(1, CELLS // max(1, min(n, self.widest)))
        if len(words) > step:
            return [x for i in range(0, len(words), step) for x in self.viterbi(words[i : i + step])]
        chars = _chars(words, n)
        m, prefix = len(words), self._prefix(chars)
        best = np.full((m, n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, piece, rows = np.zeros((m, n + 1), np.int32), np.full((m, n + 1), -1, np.int32), np.arange(m)
        for end in range(1, n + 1):
            starts = np.arange(max(0, end - self.widest), end)
            h = self._hash(prefix, starts, end)
            at, hit = self._probe(h)
            score = best[:, starts] + np.where(hit, self.scores[at], np.float32(-np.inf))
            lone = ~hit[:, -1]
            score[lone, -1] = best[lone, end - 1] + self.unknown_score
            arg = score.argmax(axis=1)
            best[:, end], back[:, end] = score[rows, arg], starts[arg]
            piece[:, end] = np.where(hit[rows, arg], self.ids[at[rows, arg]], -1)
        return self._followed(words, back, piece)

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the sorted keys, and whether they hold; a small table turns most others away."""
        likely = np.flatnonzero(self.table[h & B.U(TABLE - 1)])
        flat = h.ravel()
        found = np.minimum(np.searchsorted(self.keys, flat[likely]), len(self.keys) - 1)
        same = self.keys[found] == flat[likely]
        at, hit = np.zeros(h.size, np.int64), np.zeros(h.size, bool)
        at[likely], hit[likely] = found, same
        return at.reshape(h.shape), hit.reshape(h.shape)

    def _followed(self, words: list[str], back: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """Ids along the backpointers, all words a step at a time; as int32 bytes."""
        m, n = len(words), back.shape[1] - 1
        rows, end, steps = np.arange(m), np.full(m, n), []
        while end.any():
            steps.append(np.where(end > 0, piece[rows, end], -2))
            end = back[rows, end]
        path = np.stack(steps[::-1], axis=1)
        on = path != -2
        raw, cut = path[on].astype(np.int32).tobytes(), np.r_[0, np.cumsum(on.sum(axis=1))].tolist()
        out = [raw[4 * a : 4 * b] for a, b in zip(cut, cut[1:], strict=False)]
        for i in np.flatnonzero((path == -1).any(axis=1)).tolist():
            out[i] = self._with_unknown(words[i], back[i].tolist(), piece[i].tolist())
        return out

    def _with_unknown(self, word: str, back: list[int], piece: list[int]) -> bytes:
        ids, end = [], len(word)
        while end:
            if piece[end] >= 0:
                ids.append(piece[end])
            elif self.byte_fallback:
                ids += self.byte_ids[list(word[back[end] : end].encode()[::-1])].tolist()
            elif not ids or ids[-1] != self.unknown:  # the library joins unknown characters
                ids.append(self.unknown)
            end = back[end]
        return np.array(ids[::-1], np.int32).tobytes()

    def learn(self, words: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for some in by.values():
            for w, ids in zip(some, self.viterbi(some), strict=True):
                self.known[w] = ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        norm = [self.lib.normalize(x) for x in texts]
        cut = [(self.split(x) if self.split else [x]) if x else [] for x in norm]
        if len(self.known) > self.memory:
            self.known, self.older = {}, self.known
        new = []
        for w in set().union(*cut).difference(self.known):
            if (x := self.older.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = x
        self.learn(new)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), np.int32) for x in cut]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode(errors="replace")


@lru_cache(maxsize=1)
def model_of(path: str) -> Model:
    """One for each worker process, so that later tasks find the words of earlier ones."""
    return Model(path)


def _chars(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)


def sentencepiece_encode(docs: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id) of every row, and n_tokens, ids, roundtrip (decoding gives the text).

    A null or empty text has no ids and comes back as an empty text. Repeated rows are encoded alike,
    each by itself; no row depends on another. Columns of `docs` named as the new ones are replaced.
    The character U+2581 decodes to a space, as in the library.
    """
    C.small_batches(docs.sparkSession)
    keep = [c for c in (keep or ["doc_id"]) if c not in ("n_tokens", "ids", "roundtrip")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model)
        for batch in batches:
            texts = batch.column(len(keep))
            at = 0
            for c in B.chunks(texts):
                n = len(c.offs) - 1
                part = [c.text(i).decode(errors="replace") for i in range(n)]
                ids = own.encode(part)
                same = [own.decode(x) == t for x, t in zip(ids, part, strict=True)]
                counts = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*(x.slice(at, n) for x in batch.columns[: len(keep)]), pa.array(counts), B.lists(flat, counts, pa.int32()), pa.array(same)], names=[*keep, "n_tokens", "ids", "roundtrip"])
                at += n
        own.older = {}  # the worker lives on; half of its memory is enough for the next task

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long", "ids array<int>", "roundtrip boolean"])
    text = C.F.col("text").cast("string")
    return C.mapped(docs.select(*[C.F.col(c) for c in keep], text.alias("_text")), encode, schema)

"""Quality scores by a factorisation machine.

Method. A text's features are its words, hashed to ``BUCKETS`` places (log counts, scaled to
length 1), structure statistics (shares of kinds of characters, line and word shapes,
repetition), and the metadata that a text carries with it, its length. The machine is
w0 + sum w_i x_i + the sum over pairs <v_i, v_j> x_i x_j with vectors of ``RANK`` numbers; the
pair term is half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so a text costs time linear
in its features. The score is its logistic. It is trained here by Adam on log loss.

Training learns from at most ``train_docs`` labelled rows, drawn by a hash of the id; only
their features reach the driver. Scoring is one narrow pass; each worker keeps the hash
places of words it has met, up to ``CACHE_WORDS``.

Defined results: a null text counts as empty and has a score like any other; rows without
a label are not learnt from; without labels every score is 0.5; repeated rows get equal
scores; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import pieces

BUCKETS, RANK = 1024, 8
CACHE_WORDS = 500_000
KINDS = 8


def _kinds() -> np.ndarray:
    """The kind of each byte: other, lower, upper, digit, space, line end, sign of sentences, other sign; bytes above 127 are 'other'."""
    kind = np.zeros(256, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 1, 2, 3
    kind[[9, 11, 12, 13, 32]], kind[10] = 4, 5
    for c in range(33, 127):
        if not chr(c).isalnum():
            kind[c] = 6 if chr(c) in ".,;:'\"()-?" else 7
    return kind


KIND = _kinds()


class _Places(dict):
    def __missing__(self, word: str) -> int:
        place = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        return place


class Features:
    """Rows of features of texts."""

    size = BUCKETS + KINDS + 10

    def __init__(self):
        self.places = _Places()

    def rows(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        if len(self.places) > CACHE_WORDS:
            self.places.clear()
        for k, t in enumerate(texts):
            t = t or ""
            raw = t.encode("utf-8", "surrogatepass")
            words, lines = t.split(), [x for x in t.split("\n") if x]
            share = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=KINDS) / max(1, len(raw))
            if words:
                count = np.log1p(np.bincount(list(map(self.places.__getitem__, words)), minlength=BUCKETS))
                out[k, :BUCKETS] = count / np.sqrt((count * count).sum())
            n, m = max(1, len(words)), max(1, len(lines))
            own = set(words)
            long = [len(x) for x in lines]
            rest = (
                np.log1p(len(t)), np.log1p(len(words)), np.log1p(len(lines)), len(t) / n, len(own) / n, np.log(len(own) + 1) / np.log(len(words) + 2),
                len(set(lines)) / m, np.log1p(max(long, default=0)), np.log1p(len(t) / m), sum(x < 20 for x in long) / m,
            )
            out[k, BUCKETS : BUCKETS + KINDS], out[k, BUCKETS + KINDS :] = share, rest
        return out


@dataclass
class Machine:
    """A factorisation machine over features whose statistics are standardised first."""

    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def standard(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - self.mean) / self.scale, -6, 6) * 0.3
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        x = self.standard(x).astype(np.float64)
        sums = x @ self.v
        z = self.w0 + x @ self.w + 0.5 * (sums * sums - (x * x) @ (self.v * self.v)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on mean log loss; deterministic for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    stats = x[:, BUCKETS:]
    m = Machine(stats.mean(0), stats.std(0) + 1e-6, 0.0, np.zeros(x.shape[1]), rng.normal(0, 0.05, (x.shape[1], RANK)))
    x = m.standard(x).astype(np.float32)
    squares = x * x
    p = np.clip(y.mean(), 0.01, 0.99)
    m.w0 = float(np.log(p / (1 - p)))
    params = [np.array([m.w0], np.float32), m.w.astype(np.float32), m.v.astype(np.float32)]
    first, second, t = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params], 0
    size = 256
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), size):
            b = order[lo : lo + size]
            xb, x2 = x[b], squares[b]
            sums = xb @ params[2]
            z = params[0][0] + xb @ params[1] + 0.5 * (sums * sums - x2 @ (params[2] * params[2])).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[b]) / len(b)).astype(np.float32)
            grads = [np.array([g.sum()]), xb.T @ g + decay * params[1], xb.T @ (g[:, None] * sums) - (x2.T @ g)[:, None] * params[2] + decay * params[2]]
            t += 1
            for q, d, a, c in zip(params, grads, first, second, strict=True):
                a += 0.1 * (d - a)
                c += 0.001 * (d * d - c)
                q -= rate * (1 - 0.9 * epoch / epochs) * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
    m.w0, m.w, m.v = float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64)
    return m


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine | None:
    """A machine from at most train_docs labelled rows; None without any. Of an id that repeats in docs or labels one row counts: that of the least label, then of the least features."""
    drawn = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).alias("label"))
    drawn = drawn.orderBy(F.xxhash64(F.lit("quality"), id_col), id_col, "label").limit(train_docs)
    rows = docs.select(id_col, text_col).join(F.broadcast(drawn), id_col).select(id_col, "label", text_col)  # train_docs rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in pieces(batches, text_col):
            yield pa.record_batch([b.column(0).cast(pa.string()), b.column(1).cast(pa.int32()), pa.array([r.tobytes() for r in f.rows(b.column(2).to_pylist())], pa.binary())], names=["id", "label", "x"])

    one = rows.mapInArrow(run, "id string, label int, x binary").groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.*")
    found = sorted(one.collect())  # an id of drawn each, at most
    if not found:
        return None
    return fit(np.stack([np.frombuffer(r["x"], np.float32) for r in found]), np.array([r["label"] for r in found], np.float64))


def score(docs: DataFrame, machine: Machine | None, at_least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, m = Features(), shared.value
        for b in pieces(batches, text_col, 2 << 20):
            for part in (b.slice(lo, 512) for lo in range(0, b.num_rows, 512)):
                s = m.score(f.rows(part.column(1).to_pylist())) if m else np.full(part.num_rows, 0.5)
                yield pa.record_batch([part.column(0), pa.array(s, pa.float64()), pa.array((s >= at_least).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, predicted int")

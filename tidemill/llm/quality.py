"""Operator 10: a quality classifier by naive Bayes support vectors.

Features are indicators of word n-grams (one and two words, letters A-Z lower-cased) and of shape n-grams (one to
three words, each word replaced by its letter case, its trailing signs and whether it repeats the word before), hashed
into ``1 << BITS`` buckets. Each indicator is scaled by its class log-count ratio, log((p / |p|) / (q / |q|)) with one
added to the counts, and a linear model with hinge loss is fitted on the scaled features by dual coordinate
descent. A logistic curve fitted to the training margins turns a margin into a score from 0 to 1.

Only the fit is bounded: about ``sample`` labelled rows, picked by a hash of the id, from the rows in training. Their
features (not their texts) come to the driver. Scoring reads every whole text, in one map pass without a shuffle.

Defined results: rows without an id are neither learned from nor held out; a repeated id is learned from once, by the
text that sorts first; empty and null texts have no features and get the score of the bias alone. Without any labelled row
the score is 0.5; with one class only it is that class's share with one added to each side. Repeated rows get repeated
results, extra columns pass through, columns that clash with output names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.langid import held_out, is_training

SAMPLE = 4000
BITS = 18
EPOCHS = 12
COST = 0.5
CUT = 0.3

_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _shape(word: bytes) -> bytes:
    """Letter case and trailing signs of a word: ``U`` all capitals, ``T`` first capital, ``l`` other, ``s`` signs only."""
    core = word.rstrip(_SIGNS)
    tail = word[len(core) :][:3]
    if not core:
        return b"s" + tail
    if len(core) > 1 and core.isupper():
        return b"U" + tail
    return (b"T" if core[:1].isupper() else b"l") + tail


class _Hashes(dict):
    """Hash and shape of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> tuple[int, bytes]:
        if len(self) > 300_000:
            self.clear()
        value = (xxhash.xxh3_64_intdigest(word.lower()), _shape(word))
        if len(word) <= 64:
            self[word] = value
        return value


_hashes = _Hashes()
_shapes: dict[tuple, int] = {}


def _mix(h: np.ndarray, step: int) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) ^ (h >> np.uint64(29))


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The sorted distinct buckets of a text's n-grams."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, dtype=np.int32)
    found = [_hashes[w] for w in words]
    h = np.array([f[0] for f in found], dtype=np.uint64)
    parts = [h, _mix(h[:-1], 1) + h[1:]]
    same = h[1:] == h[:-1]
    names = [f[1] for f in found]
    shape = [names[0]] + [b"=" if s else n for s, n in zip(same.tolist(), names[1:], strict=True)]
    grams = set(shape) | set(zip(shape, shape[1:], strict=False)) | set(zip(shape, shape[1:], shape[2:], strict=False))
    extra = []
    for gram in grams:
        code = _shapes.get(gram)
        if code is None:
            if len(_shapes) > 300_000:
                _shapes.clear()
            code = _shapes[gram] = xxhash.xxh3_64_intdigest(repr(gram).encode())
        extra.append(code)
    parts.append(np.array(extra, dtype=np.uint64))
    return np.unique((np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int32))


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, log-count ratio included
    bias: float
    slope: float
    offset: float

    def margin(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum() / np.sqrt(max(1, len(buckets)))) + self.bias

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(buckets) + self.offset, -40, 40))))


def fit(rows: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = EPOCHS, cost: float = COST) -> Model:
    """Log-count ratios, then dual coordinate descent (L2-regularised hinge loss), then the logistic curve."""
    y = np.array([1.0 if v == 1 else -1.0 for v in labels])
    positive, negative = float((y > 0).sum()), float((y < 0).sum())
    width = 1 << bits
    if not positive or not negative:
        return Model(np.zeros(width), 0.0, 0.0, float(np.log((positive + 1) / (negative + 1))))
    p, q = np.ones(width), np.ones(width)
    for row, sign in zip(rows, y, strict=True):
        (p if sign > 0 else q)[row] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    caps = np.where(y > 0, cost * len(y) / (2 * positive), cost * len(y) / (2 * negative))  # classes weigh the same
    norms = np.array([float(v @ v) + 1.0 for v in values])
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(caps[i], max(0.0, alpha[i] - gradient / norms[i]))
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    margins = np.array([float(w[r] @ v) + bias for r, v in zip(rows, values, strict=True)])
    slope, offset = _logistic(margins, (y > 0).astype(float))
    return Model(w * ratio, bias, slope, offset)


def _logistic(margins: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on the log loss with a little regularisation."""
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-2 * (theta - np.array([1.0, 0.0]))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2
        theta = theta - np.linalg.solve(hessian, gradient)
    return float(max(theta[0], 0.0)), float(theta[1])


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` rows of ``labels`` (doc_id, quality) that are in training and have a text in ``df``."""
    known = labels.filter(is_training()).groupBy("doc_id").agg(F.max("quality").alias("quality")).filter(F.col("quality").isNotNull())
    total = known.count()
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.filter(rank < int(min(1.0, sample / max(1, total)) * (1 << 30)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = [features(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["buckets", "quality", "doc_id"]
            )

    rows = (
        df.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most about ``sample`` rows, whatever the corpus
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))  # a repeated id once
        .select("text", F.col("quality").cast("int").alias("quality"), "doc_id")
        .mapInArrow(extract, "buckets array<int>, quality int, doc_id long")
        .collect()
    )
    rows.sort(key=lambda r: (r.doc_id, r.quality))
    return fit([np.array(r.buckets, dtype=np.int32) for r in rows], [r.quality for r in rows])


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` without its text, with the score of each whole text."""
    kept = [c for c in df.columns if c not in (out, text)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 MB, fixed by BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(features(t.as_py())) for t in batch.column(len(kept))]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*kept, out])

    return df.select(*kept, F.col(text).cast("string")).mapInArrow(run, schema)


def predictions(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract columns of the query."""
    out = score(df.select("doc_id", "text"), train(df, labels))
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted")
    )

"""Quality of a document by attention over its passages (multiple-instance learning).

Every passage of every text is described by shares of bytes, hashed byte pairs and word
statistics, and encoded by a learned layer. A gated attention (a tanh branch times a
sigmoid branch) weighs the passages; the weighted sum is scored by a logistic layer. All
weights are learned together from labels of whole documents.

Training takes at most ``sample`` labelled documents (those with the smallest hashes), a
documented bound, and all their passages, whose features reach a file of the driver's and are
read from there one batch of documents at a time; scoring covers every passage of every text
in one pass without a shuffle.

Null and empty texts are one passage without words. Labels that are null, or documents with
both labels, teach nothing. Without labels of both kinds every score is the share of label 1
(0.5 without labels).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, python_tasks, row_key

PASSAGE = 64
#: Passages of a text that are described at a time.
STRETCH = 512
PAIRS = 256
N_FEATURES = 256 + PAIRS + 6


def passages(text: str | None, size: int = PASSAGE, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """One row of features a passage of ``size`` words, for ``stretch`` passages at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    distinct = len(set(words)) / max(1, len(words))
    for at in range(0, max(1, len(words)), size * stretch):
        yield _described(words[at : at + size * stretch], size, distinct)


def _described(words: list[bytes], size: int, distinct: float) -> np.ndarray:
    n = max(1, -(-len(words) // size))
    raw = np.frombuffer(b" ".join(words) or b" ", np.uint8)
    blanks = np.flatnonzero(raw == 32)
    place = np.zeros(len(raw), np.int64)
    place[blanks[size - 1 :: size][: n - 1]] = 1
    place = np.cumsum(place)
    total = np.bincount(place, minlength=n).astype(np.float32)[:, None]
    single = np.bincount(place * 256 + raw, minlength=n * 256).reshape(n, 256) / total
    pair = (raw[:-1].astype(np.int64) * 31 + raw[1:]) * 2654435761 >> 8 & (PAIRS - 1)
    double = np.bincount(place[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / total
    rest = np.zeros((n, 6), np.float32)
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    for i in range(n):
        part = number[i * size : (i + 1) * size]
        if len(part):
            u = len(np.unique(part))
            rest[i] = u / len(part), np.log1p(len(part)), (part[1:] == part[:-1]).mean() if len(part) > 1 else 0, total[i, 0] / len(part) / 10, distinct, 1
    return np.hstack([single, double, rest]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # features x hidden, with its bias as the last row
    tanh: np.ndarray  # hidden x attention
    gate: np.ndarray
    attend: np.ndarray
    score: np.ndarray  # hidden + bias
    share: float | None = None

    def __call__(self, x: np.ndarray | Iterable[np.ndarray]) -> float:
        """The score of a text from the features of its passages, in one array or by stretches."""
        if self.share is not None:
            return self.share
        h = np.vstack([np.tanh(((b - self.mean) * self.scale) @ self.encode[:-1] + self.encode[-1]) for b in ([x] if isinstance(x, np.ndarray) else x)])
        a = (np.tanh(h @ self.tanh) / (1 + np.exp(-(h @ self.gate)))) @ self.attend
        a = np.exp(a - a.max())
        z = (a / a.sum()) @ h
        return float(1 / (1 + np.exp(-np.clip(z @ self.score[:-1] + self.score[-1], -30, 30))))


def train(bags: Sequence[np.ndarray], labels: Sequence[int], hidden: int = 24, attention: int = 12, epochs: int = 15, rate: float = 0.01, seed: int = 5) -> Model:
    """Adam over mini-batches of bags, of which one at a time is in memory as 32-bit numbers; the loss weighs both labels alike in sum, softened by a square root."""
    y_all = np.array(labels, float)
    share = float(y_all.mean()) if len(y_all) else 0.5
    rng = np.random.default_rng(seed)
    init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    w = {"encode": np.vstack([init(N_FEATURES, hidden), np.zeros((1, hidden), np.float32)]), "tanh": init(hidden, attention), "gate": init(hidden, attention), "attend": init(attention, 1)[:, 0], "score": np.zeros(hidden + 1, np.float32)}
    if share in (0.0, 1.0) or not len(y_all):
        return Model(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), *w.values(), share=share)
    n = sum(map(len, bags))
    mean = sum(b.sum(0, dtype=float) for b in bags) / n
    spread = np.sqrt(sum(((b - mean) ** 2).sum(0) for b in bags) / n)
    mean, scale = mean.astype(np.float32), (1 / (spread + 0.02)).astype(np.float32)
    weight = np.where(y_all == 1, 1 / np.sqrt(share), 1 / np.sqrt(1 - share))
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            x = (np.vstack([bags[i] for i in own]).astype(np.float32) - mean) * scale
            sizes = np.array([len(bags[i]) for i in own])
            heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bag = np.repeat(np.arange(len(own)), sizes)
            h = np.tanh(x @ w["encode"][:-1] + w["encode"][-1])
            t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
            e = (t * g) @ w["attend"]
            e = np.exp(e - np.maximum.reduceat(e, heads)[bag])
            a = e / np.add.reduceat(e, heads)[bag]
            z = np.add.reduceat(a[:, None] * h, heads, axis=0)
            p = 1 / (1 + np.exp(-np.clip(z @ w["score"][:-1] + w["score"][-1], -30, 30)))
            dlogit = (p - y_all[own]) * weight[own] / len(own)
            dz = dlogit[:, None] * w["score"][:-1]
            da = (dz[bag] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, heads)[bag])
            dtg = de[:, None] * w["attend"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = (a[:, None] * dz[bag] + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - h * h)
            grad = {"encode": np.vstack([x.T @ dh, dh.sum(0)]), "tanh": h.T @ dt, "gate": h.T @ dg, "attend": (t * g).T @ de, "score": np.append(z.T @ dlogit, dlogit.sum())}
            step += 1
            for k in w:
                d = grad[k] + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, *w.values())


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = 3000) -> Model:
    """Learns from at most ``sample`` documents of ``docs`` that ``labels`` marks."""
    python_tasks(docs.sparkSession)
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("high")).where("y = high").select("doc_id", "y")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(F.col(doc_id), F.col(text)).alias("row"))
    # the hash order of rows picks the sample, with its labels, before texts move; equal rows count once
    few = rows.select("doc_id", "row").join(marks, "doc_id").select("row", "y").distinct().orderBy("row.a", "row.b").limit(sample)
    chosen = rows.join(F.broadcast(few), "row").dropDuplicates(["row"]).repartition(32)  # at most ``sample`` rows; spread, as the driver takes a task's result at once

    @F.pandas_udf("binary")
    def described(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([b"".join([x.astype(np.float16).tobytes() for x in passages(t)]) for t in texts], dtype=object)

    got = chosen.select("row.*", "y", described("text").alias("x")).toLocalIterator()
    with tempfile.TemporaryFile() as file:
        rows, end = [], 0
        for r in got:  # a text at a time
            rows.append((r["a"], r["b"], r["y"], end // (2 * N_FEATURES), len(r["x"]) // (2 * N_FEATURES)))
            end += file.write(r["x"])
        file.flush()
        rows.sort()
        data = np.memmap(file, np.float16, "r", 0, (end // (2 * N_FEATURES), N_FEATURES)) if end else np.zeros((0, N_FEATURES), np.float16)
        return train([data[at : at + n] for _, _, _, at, n in rows], [y for _, _, y, _, _ in rows])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All other columns of ``docs`` and ``out`` (in place of one of that name): the probability of label 1."""
    python_tasks(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        own = sent.value
        for texts in parts:
            yield pd.Series([own(passages(t)) for t in texts], dtype="float64")

    return docs.withColumn(out, scored(F.coalesce(F.col(text), F.lit(""))))

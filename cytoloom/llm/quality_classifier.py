"""Text quality by positive-unlabelled learning.

Trusted good texts and unlabelled web text train a numpy scorer that minimises the non-negative unbiased risk under an
estimated class prior (see pu.py). A text is described by shares of character classes, by repetition of words, word
triples and lines, and by word lengths; each measure is cut into bins at quantiles of the unlabelled sample, and the
scorer is linear in the bins.

Parameters: the fit sees at most about MAX_POSITIVE trusted and MAX_UNLABELLED unlabelled texts, chosen by hash. Every
text is measured and scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_pandas, materialize
from .pu import fit_with_prior, held_out, sigmoid, training_rows

MAX_POSITIVE, MAX_UNLABELLED, THRESHOLD = 6000, 12000, 0.3
#: Where measures are cut: fine in the tails, where poor texts lie.
QUANTILES = (0.005, 0.01, 0.02, 0.035, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.965, 0.98, 0.99, 0.995)
BINS = len(QUANTILES) + 1


def _classes() -> np.ndarray:
    """Bytes by class: lower, upper, digit, blank, line end, sentence mark, other ASCII mark, three kinds beyond."""
    kind = np.full(256, 6)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:'\"()-?")):
        kind[list(chars)] = k
    kind[ord("!")], kind[128:192], kind[192:] = 7, 8, 9
    return np.eye(10)[kind]


_CLASS = _classes()
MEASURES = 10 + 7


def measures(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), max(1, len(text))
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / size).tolist()
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 1.0
    distinct = len(set(words)) / n if n else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n if n else 0.0
    return [*shares, triples, distinct * np.sqrt(max(1, n)) / 10, again, len(set(lines)) / len(lines) if lines else 1.0, size / max(1, n), np.log1p(n), max(map(len, words), default=0) / 50]


@dataclass
class Model:
    cuts: np.ndarray  # (measures, bins - 1)
    weights: np.ndarray  # (measures, bins)
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(len(self.cuts)), self.bins(x)].sum(axis=1) + self.bias


def train(docs: DataFrame, labels: DataFrame, *, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, label: str = "quality") -> Model:
    """Fit on rows outside the held-out fold. Without trusted or unlabelled rows every text scores 0.5 and is kept."""
    rows = training_rows(docs, labels, label, max_positive=max_positive, max_unlabelled=max_unlabelled)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "positive": batch["positive"], "x": [list(map(float, measures(t.encode()))) for t in batch["text"]]})

    seen = map_pandas(rows, vectors, "doc_id long, positive boolean, x array<double>")
    seen = materialize(seen, "quality-sample").orderBy("doc_id", "positive").toPandas()
    positive = seen["positive"].to_numpy(bool)
    x = np.stack(seen["x"]) if len(seen) else np.zeros((0, MEASURES))
    if positive.all() or not positive.any():
        return Model(np.zeros((MEASURES, 1)), np.zeros((MEASURES, 2)), 0.0, 1.0)
    model = Model(np.quantile(x[~positive], QUANTILES, axis=0).T, np.zeros((MEASURES, BINS)), 0.0, 0.5)
    hot = np.zeros((len(x), MEASURES, BINS), np.float32)
    at = model.bins(x)
    for i in range(MEASURES):
        hot[np.arange(len(x)), i, at[:, i]] = 1
    hot = hot.reshape(len(x), -1)
    w, prior = fit_with_prior(hot[positive], hot[~positive], first=0.8, l2=1e-4, steps=1000)
    return Model(model.cuts, w[:-1].reshape(MEASURES, BINS), float(w[-1]), prior)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from 0.3 on), then the columns named in
    keep, as keep_0, keep_1 and so on.

    A null text is measured as an empty one. A null doc_id is held out. Repeated rows are scored alike; an empty table
    gives an empty result. Columns not named are not read."""
    keep = keep or []
    at = 3 + keep.index("text") if "text" in keep else 2  # a kept text is not sent a second time

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                texts = batch.column(at).cast(pa.large_binary())
                x = np.array([measures(texts[i].as_py() or b"") for i in range(len(texts))], float).reshape(-1, MEASURES)
                s = sigmoid(model.logits(x)) if len(x) else np.zeros(0)
                found = [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*found, *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", *(f"keep_{i}" for i in range(len(keep)))])

    text = F.lit(None).cast("string") if "text" in keep else F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text.alias("text"), *(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)))
    kinds = "".join(f", keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return map_arrow(rows, work, "doc_id long, held_out boolean, score double, predicted int" + kinds)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model predicts to be good, all columns as they were."""
    scored = score(docs, model, keep=docs.columns).filter("predicted = 1")
    return scored.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(docs.columns)))

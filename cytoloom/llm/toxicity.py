"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text train a numpy logistic scorer under the non-negative risk (see pu.py).
Features are the presence, once and twice, of words and of word beginnings (4 to 6 letters), lower-cased; the ones kept are those most
clearly commoner in the confirmed examples, MIN_LIFT times at least. The class prior is estimated, not given.

Parameters: the fit sees at most about MAX_POSITIVE confirmed and MAX_UNLABELLED unlabelled texts, chosen by hash, and
keeps MAX_FEATURES features, which bounds the model that goes to the workers. Every text is scored, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_pandas, materialize
from .pu import fit_with_prior, held_out, sigmoid, training_rows

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES, MIN_LIFT = 4000, 8000, 400, 3.0
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


def features(words: dict[str, int]) -> set[str]:
    """The words, their beginnings (marked with a trailing hyphen), and with a plus those found twice or more."""
    found = dict(words)
    for w, k in words.items():
        for n in BEGINNINGS:
            if len(w) > n:
                found[name] = found.get(name := f"{w[:n]}-", 0) + k
    return {*found, *(f"{x}+" for x, k in found.items() if k > 1)}


def occurrences(text: str) -> dict[str, int]:
    return Counter(WORD.findall(text.lower()))


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float
    prior: float

    def scorer(self):
        """text -> logit. Only words that start like some feature are looked at further."""
        by_name = dict(zip(self.names, self.weights.tolist(), strict=True))
        starts = {n.rstrip("-+")[:4] for n in self.names}

        def logit(text: str) -> float:
            near = {w: k for w, k in occurrences(text).items() if w[:4] in starts}
            return self.bias + sum(by_name[name] for name in sorted(features(near) & by_name.keys())) if near else self.bias

        return logit


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    p, u = Counter(), Counter()
    for batch in batches:
        for text, positive in zip(batch["text"], batch["positive"], strict=True):
            (p if positive else u).update(features(occurrences(text)))
    names = list(p.keys() | u.keys())
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pd.DataFrame({"name": part, "p": [p[x] for x in part], "u": [u[x] for x in part]})


def train(docs: DataFrame, labels: DataFrame, *, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, label: str = "toxic") -> Model:
    """Fit on rows outside the held-out fold. Without confirmed or unlabelled rows the model scores every text 0.5 or
    less: it has no features and the bias of an unknown prior."""
    rows = materialize(training_rows(docs, labels, label, max_positive=max_positive, max_unlabelled=max_unlabelled), "toxicity-sample")
    n = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = n.get(True, 0), n.get(False, 0)
    if not n_p or not n_u:
        return Model([], np.zeros(0), -1.0, 0.0)
    counts = map_pandas(rows.select("text", "positive"), _counts, "name string, p long, u long").groupBy("name").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    a, b = F.col("p") / float(n_p), F.col("u") / float(n_u)
    pooled = (F.col("p") + F.col("u")) / float(n_p + n_u)
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-9)
    best = counts.filter((F.col("p") >= 4) & (z >= 4) & (a >= MIN_LIFT * b)).orderBy(F.desc(z), "name").limit(max_features)
    names = [r["name"] for r in best.select("name").collect()]
    at = {x: i for i, x in enumerate(names)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "on": [sorted(at[x] for x in features(occurrences(t)) if x in at) for t in batch["text"]]})

    seen = map_pandas(rows.select("doc_id", "text", "positive").orderBy("doc_id").select("text", "positive"), vectors, "positive boolean, on array<int>").toPandas()
    x = np.zeros((len(seen), len(names)), np.float32)
    for i, on in enumerate(seen["on"]):
        x[i, np.asarray(on, int)] = 1
    positive = seen["positive"].to_numpy(bool)
    w, prior = fit_with_prior(x[positive], x[~positive], first=0.2, l2=1e-4, steps=600)
    return Model(names, w[:-1], float(w[-1]), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    A null text is empty and, like any text without words, has the score of the bias alone. A null doc_id is held out.
    Repeated rows are scored alike. Only doc_id and text are read; an empty table gives an empty result."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = model.scorer()
        for batch in batches:
            texts = batch.column(2)
            s = sigmoid(np.array([logit(texts[i].as_py()) for i in range(len(texts))], float))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_arrow(rows, work, "doc_id long, held_out boolean, score double, predicted int")

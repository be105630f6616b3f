"""Learning from positives and unlabelled rows: sampling, class-prior estimation and the non-negative risk.

The risk of a scorer f on positives P and unlabelled U with class prior p is p R+(P) + max(0, R-(U) - p R-(P)), where
R+ and R- are mean losses with label + and -. The part under the max estimates the loss on negatives; where it falls
below zero the model has begun to fit noise, and the step goes the other way instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text is divisible by 5: such rows' labels are never learned. No id counts as ''."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, *, max_positive: int, max_unlabelled: int, seed: int = 11) -> DataFrame:
    """(positive boolean, text): a bounded sample of confirmed positives and one of all texts, both outside the held-out
    fold. Rows are chosen by a hash of doc_id; the ids of the positives, at most about max_positive, are broadcast. Labels
    that are null or not 1 confirm nothing; rows without an id can't be matched and are left out."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    ids = ids.filter((F.col("y") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    draw_u = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    chosen = ids.filter(draw < min(1.0, max_positive / max(1, ids.count()))).withColumn("positive", F.lit(True))
    share = min(1.0, max_unlabelled / max(1, rows.select("doc_id").count()))
    marked = rows.join(F.broadcast(chosen), "doc_id", "left")
    picked = F.concat(F.when(F.col("positive"), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")), F.when(draw_u < share, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    return marked.select("doc_id", "text", F.explode(picked).alias("positive"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(xp: np.ndarray, xu: np.ndarray, prior: float, *, steps: int = 300, rate: float = 0.05, l2: float = 1e-4) -> np.ndarray:
    """Weights of a linear scorer, bias last, by Adam on the non-negative risk with the logistic loss."""
    xp, xu = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (xp, xu))
    w = np.zeros(xp.shape[1], xp.dtype)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = xp @ w, xu @ w
        positive = -prior / len(xp) * (xp.T @ (1 - sigmoid(zp)))
        negative_loss = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = xu.T @ sigmoid(zu) / len(xu) - prior / len(xp) * (xp.T @ sigmoid(zp))
        grad = positive + negative if negative_loss >= 0 else -negative
        grad = grad + l2 * np.append(w[:-1], np.float32(0))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(xp.dtype)
    return w.astype(float)


def estimate_prior(zp: np.ndarray, zu: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Best-bin estimate of the share of positives among unlabelled scores: of all thresholds, that where the upper
    bound of (unlabelled above) / (positives above) is least."""
    cuts = np.unique(np.concatenate([zp, zu]))
    above_p = 1 - np.searchsorted(np.sort(zp), cuts, side="left") / len(zp)
    above_u = 1 - np.searchsorted(np.sort(zu), cuts, side="left") / len(zu)
    slack = sum(np.sqrt(np.log(4 / delta) / (2 * n)) for n in (len(zp), len(zu)))
    some = above_p > 0
    bound = (above_u[some] + (1 + gamma) * slack) / above_p[some]
    return float(np.clip(above_u[some][bound.argmin()] / above_p[some][bound.argmin()], 0.001, 0.999))


def fit_with_prior(xp: np.ndarray, xu: np.ndarray, first: float, rounds: int = 2, **options) -> tuple[np.ndarray, float]:
    """Weights and class prior. The prior is estimated on the half of the sample that the scorer hasn't seen, starting
    from a scorer fitted with `first`; then all of the sample is fitted."""
    prior = first
    if min(len(xp), len(xu)) >= 20:
        for _ in range(rounds):
            w = fit(xp[::2], xu[::2], prior, **options)
            prior = estimate_prior(xp[1::2] @ w[:-1], xu[1::2] @ w[:-1])
    return fit(xp, xu, prior, **options), prior

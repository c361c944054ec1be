"""Quality classifier by positive-unlabelled learning (Kiryo et al., 2017).

Trusted positives and unlabelled web text train a linear model over dense text features. With the logistic loss the
unbiased risk is prior * (-E_p[g]) + E_u[log(1 + e^g)], a convex function, so a few Newton steps minimise it; where the
part that stands for the negatives' risk falls below zero, steps go against its gradient instead (the non-negative
risk). The class prior is estimated from positives and unlabelled rows alone. All expectations are sums over all rows,
gathered by tasks as small arrays: nothing is sampled. Each whole text is read once, for its features; the score is a
DataFrame expression over them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, crc_mod, map_batches, saved

#: Newton steps at most, and the step of all weights below which they end.
STEPS, SETTLED = 12, 1e-4
#: Weight decay of the risk.
DECAY = 1e-3
#: Bins of a projection in which the class prior is looked for, and the least share of positives a tail must hold.
BINS, TAIL = 512, 0.1

THRESHOLD = 0.3

FEATURES = ("letters", "upper", "digits", "points", "signs", "bars", "shouts", "word_length", "caps_words", "distinct", "top_word", "echoes", "lines", "same_lines", "log_words")

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 . , ; : ' " ( ) -, 5 signs, 6 bar, 7 exclamation, 8 space, 9 first byte of a longer letter
for _kind, _bytes in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b".,;:'\"()-?"), (5, b"#$%&*+/<=>@[\\]^_`{}~"), (6, b"|"), (7, b"!"), (8, b" \t\r\n\v\f"), (9, bytes(range(0xC0, 0x100)))):
    _CLASS[list(_bytes)] = _kind


def features(text: str | None) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES; all 0 for null and for no words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256), 10)
    _, low, up, digit, point, sign, bar, shout, _, long = kinds.tolist()
    shown = max(1.0, low + up + digit + point + sign + bar + shout + long)
    letters = max(1.0, low + up + long)
    n, counts = len(words), Counter(words)
    lines = text.splitlines()
    return [
        (low + up + long) / shown, up / letters, digit / shown, point / shown, sign / shown, bar / shown, shout / shown,
        letters / n, sum(map(str.isupper, words)) / n, len(counts) / n**0.8, max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n)),
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and a double for each of FEATURES, from the whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in rows.T]], ["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


class Model(NamedTuple):
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    prior: float


#: What a task's sums are made from: rows of FEATURES and whether each is a trusted positive -> a flat array.
Sums = Callable[[np.ndarray, np.ndarray], np.ndarray]


def gathered(rows: DataFrame, sums: Sums) -> np.ndarray:
    """The sums over all rows of measured (FEATURES, trusted). A task gives one array; arrays are added place by place in a shuffle, and
    the driver gets one number a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
                own = sums(x, batch.column("trusted").to_numpy(zero_copy_only=False))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch({"place": pa.array(np.arange(len(total)), pa.int32()), "part": pa.array(total, pa.float64())})

    parts = rows.select(*FEATURES, "trusted").mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).collect()
    return np.array([r["part"] for r in sorted(parts, key=lambda r: r["place"])])


def gathered_here(x: np.ndarray, trusted: np.ndarray) -> Callable[[Sums], np.ndarray]:
    return lambda sums: sums(x, trusted)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from two histograms over one projection.

    A share of unlabelled rows in any region is at least the prior times the positives' share there, so the least quotient over the
    projection's upper tails bounds the prior from above, and where negatives are rare it is near it (Scott, 2015). Tails with less
    than TAIL of the positives are left out, and the counts' own uncertainty is allowed for.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    share_p, share_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    wide = share_p >= TAIL
    return float(np.clip(np.min((share_u[wide] + 1 / np.sqrt(n_u)) / share_p[wide]), 0.01, 0.99))


def fit(over: Callable[[Sums], np.ndarray], prior: float | None = None) -> Model:
    """A model from sums over all rows: over(sums) adds up sums(features, trusted).

    Passes: one for mean and covariance, one for the prior's histograms unless it is given, then one a Newton step. Without trusted or without
    any rows all scores are the prior, 0.5 unless given.
    """
    width = len(FEATURES)

    def moments(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        p = x[trusted]
        return np.concatenate([[len(x), len(p)], x.sum(axis=0), p.sum(axis=0), (x.T @ x).ravel()])

    found = over(moments)
    n_u, n_p = found[:2] if len(found) else (0.0, 0.0)
    if not n_p:
        share = 0.5 if prior is None else prior
        return Model([0.0] * width, [1.0] * width, [0.0] * width, float(np.log(share / (1 - share))), share)
    mean, mean_p = found[2 : 2 + width] / n_u, found[2 + width : 2 + 2 * width] / n_p
    covariance = found[2 + 2 * width :].reshape(width, width) / n_u - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 0))
    scale[scale < 1e-9] = 1.0
    if prior is None:
        inner = covariance / np.outer(scale, scale) + 0.01 * np.eye(width)
        axis = np.linalg.solve(inner, (mean_p - mean) / scale)

        def histograms(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
            at = _standard(x, mean, scale)[:, :-1] @ axis / max(float(np.sqrt(axis @ inner @ axis)), 1e-12)
            bins = np.clip(((at + 8) * BINS / 16).astype(np.int64), 0, BINS - 1)
            return np.concatenate([np.bincount(bins[trusted], minlength=BINS), np.bincount(bins, minlength=BINS)]).astype(float)

        both = over(histograms)
        prior = estimated_prior(both[:BINS], both[BINS:])
    w = np.append(np.zeros(width), np.log(prior / (1 - prior)))
    ridge = DECAY * np.append(np.ones(width), 0)

    def sums(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        z = _standard(x, mean, scale)
        g = z @ w
        rise = 0.5 * (1 + np.tanh(g / 2))
        p = z[trusted]
        return np.concatenate([z.T @ rise, p.sum(axis=0), p.T @ rise[trusted], [np.logaddexp(0, g).sum(), np.logaddexp(0, g[trusted]).sum()], ((z * (rise * (1 - rise))[:, None]).T @ z).ravel()])

    for _ in range(STEPS):
        found, k = over(sums), width + 1
        rise_u, mean_z, rise_p, (loss_u, loss_p), bend = found[:k] / n_u, found[k : 2 * k] / n_p, found[2 * k : 3 * k] / n_p, found[3 * k : 3 * k + 2], found[3 * k + 2 :].reshape(k, k) / n_u
        hessian = bend + np.diag(ridge) + 1e-9 * np.eye(k)
        negative = loss_u / n_u - prior * loss_p / n_p
        # the negatives' part below zero: against its gradient, else down the whole risk
        step = np.linalg.solve(hessian, prior * rise_p - rise_u if negative < 0 else rise_u - prior * mean_z + ridge * w)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < SETTLED:
            break
    return Model(mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]), float(prior))


def score_of(model: Model) -> Column:
    """The model's score over the feature columns: a logistic function of standardised features clipped to 8 deviations."""
    total = F.lit(model.bias)
    for name, mean, scale, weight in zip(FEATURES, model.mean, model.scale, model.weights, strict=True):
        total = total + F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(name) - mean) / scale)) * weight
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(measured: DataFrame, labels: DataFrame, label: str = "quality", prior: float | None = None) -> Model:
    """A model from features by doc_id and labels (doc_id, label 0/1) that may be learned from.

    Trusted positives are rows labelled 1; all rows count as unlabelled, and no other label is read. The prior is estimated from
    both unless given. Labels that are null or have a null doc_id are left out; rows that repeat a doc_id are trusted alike.
    """
    trusted = saved(labels.filter((F.col(label).cast("int") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("trusted_id")).distinct())
    few = trusted.count() <= BROADCAST_KEYS
    marked = measured.join(F.broadcast(trusted) if few else trusted, F.col("doc_id") == F.col("trusted_id"), "left").withColumn("trusted", F.col("trusted_id").isNotNull())
    rows = marked.select(*FEATURES, "trusted") if few else saved(marked.select(*FEATURES, "trusted"))
    return fit(lambda sums: gathered(rows, sums), prior)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs (doc_id, text).

    Labels are learned from rows of labels whose crc32(doc_id) mod 5 isn't 0; a null doc_id isn't held out. Null and empty texts have all
    features 0 and are scored like any other. Rows that repeat are scored alike; empty tables give no rows.
    """
    measured = saved(with_features(docs))
    model = learn(measured, labels.filter(crc_mod(F.col("doc_id"), 5) != 0))
    rows = measured.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), score_of(model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))

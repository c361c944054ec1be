"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Lexicons are learned from labelled rows (words, and beginnings of words, whose share among toxic documents far exceeds that
among others) beside a short fixed one. Features are lexicon densities, the nearness of second-person words, capitals, punctuation and
obfuscation. Isotonic regression over sums of trees that haven't seen the rows calibrates the scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, sampled, saved

#: Labelled rows that the model is fitted on, about: those with the least hashes. Their texts are read whole.
LABELLED = 20_000
#: Words, and beginnings of words, of the learned lexicon at most, the toxic documents that each needs, and how much more likely it must be in them.
WORDS = 400
SUPPORT = {"word": 3, "beginning": 6}
LIFT = {"word": 5.0, "beginning": 12.0}
#: Letters of a beginning, which stands in the lexicon with a '*'.
BEGINNINGS = range(4, 9)
_REMEMBERED = 150_000  # words whose weight a worker keeps

FOLDS = 3

THRESHOLD = 0.7
NEAR = 5

#: A fixed list of English insults, so that a small sample of labels still has some.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic disgusting worthless scum trash garbage clown fool imbecile jerk filthy vermin retard bastard".split())
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())

FEATURES = ("density", "hits", "distinct", "weight", "fixed", "second", "near", "upper", "shouts", "points", "obfuscated", "masked", "log_words")

_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"\w*[^\W\d_][0-9@$*!.\-]{1,2}[^\W\d_]\w*")
_CAPITAL = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_LETTER = np.isin(np.arange(256), [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)])
_STAND_IN = np.isin(np.arange(256), list(b"0123456789@$*!.-"))
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


class Lexicon(dict):
    """Word -> weight, 0 outside the lexicon: the word's own, else that of its longest beginning in the lexicon."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = self.weights.get(word)
        if found is None:
            found = next((w for n in reversed(BEGINNINGS) if len(word) > n and (w := self.weights.get(word[:n] + "*"))), 0.0)
        if len(self) > _REMEMBERED:
            self.clear()
        self[word] = found
        return found


def _may_hide(raw: np.ndarray) -> bool:
    """Whether one or two stand-ins lie between letters anywhere in the bytes of a text; no regular expression runs if not."""
    letter, odd = _LETTER[raw], _STAND_IN[raw]
    one = letter[:-2] & odd[1:-1] & letter[2:]
    two = letter[:-3] & odd[1:-2] & odd[2:-1] & letter[3:]
    return bool(one.any() or two.any())


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES; all 0 for null and for no words."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, counts = len(words), Counter(words)
    found = {w: x for w in counts if (x := lexicon[w])}
    hits = sum(counts[w] for w in found)
    near = 0
    if found:
        last, waiting = -NEAR - 1, []
        for at, word in enumerate(words):
            if word in SECOND_PERSON:
                near += sum(at - x <= NEAR for x in waiting)
                last, waiting = at, []
            elif word in found:
                if at - last <= NEAR:
                    near += 1
                else:
                    waiting = [x for x in waiting if at - x < NEAR] + [at]
    raw = np.frombuffer(text.encode(), np.uint8)
    hidden = _HIDDEN.findall(text) if _may_hide(raw) else []
    masked = sum(lexicon[re.sub(r"[^\w]", "", h.lower().translate(_LEET))] > 0 for h in hidden)
    capitals = int(np.count_nonzero(_CAPITAL[raw]))
    return [
        hits / n, math.log1p(hits), float(len(found)), sum(counts[w] * x for w, x in found.items()) / n, sum(counts[w] for w in counts.keys() & INSULTS) / n,
        sum(counts[w] for w in counts.keys() & SECOND_PERSON) / n, near / hits if hits else 0.0, capitals / sum(map(len, words)),
        text.count("!") / n, (text.count(".") + text.count(",") + text.count("?")) / n, len(hidden) / n, float(masked), math.log1p(n),
    ]


class Trees(NamedTuple):
    """Complete trees of one depth: for each node of each tree a feature and a threshold, for each leaf a value."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner] if at.size else 0
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0, shrink: float = 1.0) -> Trees:
    """Second-order gradient boosting of the logistic loss over histograms. least: summed curvature a leaf needs."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start, inner = math.log(share / (1 - share)), 2**depth - 1
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]) if len(x) else np.zeros((0, x.shape[1]), int)
    total, made = np.full(len(x), start), ([], [], [])
    for _ in range(trees if len(x) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = 1e-9
            if len(own):
                go, ho = g[own], h[own]
                gs, hs = go.sum(), ho.sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[own, j]
                    gl, hl = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (go, ho))
                    gain = gl**2 / (hl + shrink) + (gs - gl) ** 2 / (hs - hl + shrink) - gs**2 / (hs + shrink)
                    gain[(hl < least) | (hs - hl < least)] = 0
                    if gain.max() > best:
                        k = int(gain.argmax())
                        best, feature[node], threshold[node] = gain[k], j, e[k]
                at[own] = 2 * node + 1 + (x[own, feature[node]] > threshold[node])
        leaf = -rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + shrink)
        total = total + leaf[at - inner]
        for kept, new in zip(made, (feature, threshold, leaf), strict=True):
            kept.append(new)
    shapes = ((-1, inner), (-1, inner), (-1, inner + 1))
    return Trees(start, *[np.array(m, t).reshape(s) for m, t, s in zip(made, (np.int64, float, float), shapes, strict=True)])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing function nearest to y over x, by pooling adjacent violators; between knots it is linear.

    A block's mean has one more row of either class, so that no score is 0 or 1.
    """
    if not len(x):
        return np.zeros(1), np.full(1, 0.5)
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for value, hit in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([value, value, hit, 1.0])
        while len(blocks) > 1 and (blocks[-2][1] == blocks[-1][0] or blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]):
            low, last = blocks[-2], blocks.pop()
            blocks[-1] = [low[0], last[1], low[2] + last[2], low[3] + last[3]]
    knots = [(at, (b[2] + 0.02) / (b[3] + 0.04)) for b in blocks for at in dict.fromkeys((b[0], b[1]))]
    found = np.maximum.accumulate([k[1] for k in knots])
    return np.array([k[0] for k in knots]), found


class Model(NamedTuple):
    lexicon: Lexicon
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, len(FEATURES))
        return np.interp(self.trees.sums(x), self.knots, self.values)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind (half, label) that hold a word or begin one."""
    kinds = [(half, label) for half in (0, 1) for label in (0, 1)]
    seen = {kind: Counter() for kind in kinds}
    for batch in batches:
        for text, label, part in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), batch.column("part").to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower())) if text else set()
            seen[part % 2, label].update(words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n})
    words = list(set().union(*seen.values()))
    yield pa.record_batch([pa.array(words, pa.string()), *[pa.array([seen[k][w] for w in words], pa.int64()) for k in kinds]], ["word", *[f"n{h}{y}" for h, y in kinds]])


def word_counts(sample: DataFrame) -> DataFrame:
    """sample (text, label 0/1, part) -> word, n00, n01, n10, n11: documents with it by half (part mod 2) and label. Written once."""
    names = [f"n{h}{y}" for h in (0, 1) for y in (0, 1)]
    counts = sample.select("text", "label", "part").mapInArrow(_words, "word string, " + ", ".join(f"{n} long" for n in names))
    return saved(counts.groupBy("word").agg(*[F.sum(n).alias(n) for n in names]))


def learn_lexicon(counts: DataFrame, sizes: dict[tuple[int, int], int], halves: tuple[int, ...] = (0, 1), words: int = WORDS) -> Lexicon:
    """Words and beginnings with their smoothed log ratio of shares among toxic and other documents of these halves. sizes: documents
    by half and label."""
    clean, toxic = (sum(sizes.get((h, y), 0) for h in halves) for y in (0, 1))
    own_clean, own_toxic = (sum((F.col(f"n{h}{y}") for h in halves), F.lit(0)) for y in (0, 1))
    weight = F.log((own_toxic + 0.5) / (toxic + 1)) - F.log((own_clean + 0.5) / (clean + 1))
    weighed = counts.select("word", own_toxic.alias("toxic"), weight.alias("weight"))
    kinds = {"word": ~F.col("word").endswith("*"), "beginning": F.col("word").endswith("*")}
    weights = dict.fromkeys(sorted(INSULTS), 1.0)
    for kind, own in kinds.items():
        strong = weighed.filter(own & (F.col("toxic") >= SUPPORT[kind]) & (F.col("weight") >= math.log(LIFT[kind])))
        weights |= {r["word"]: r["weight"] for r in strong.orderBy((F.col("toxic") * F.col("weight")).desc(), "word").limit(words).collect()}
    return Lexicon(weights)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = LABELLED) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, label 0/1) that may be learned from.

    About bound labelled rows are read, whole. A hash cuts them in two: each half is measured with the lexicon of the other, as
    no density may come from a lexicon that has seen it. Trees fitted on all folds but one give the sums of that one, on which
    the calibration is fitted. The model's own lexicon and trees are those of all rows. Labels other than 0 and 1, and those of a null doc_id, are left out;
    rows that repeat count once.
    """
    usable = labels.filter(F.col(label).cast("int").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    chosen = F.broadcast(sampled(usable, bound, "doc_id", "label", salt="toxic"))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(12))
    rows = docs.select("doc_id", F.col("text").cast("string")).join(chosen, "doc_id").withColumn("digest", F.xxhash64("text")).dropDuplicates(["doc_id", "label", "digest"])
    sample = saved(sampled(saved(rows), 2 * bound, "doc_id", "digest", salt="texts").drop("digest").withColumn("part", part))
    counts = word_counts(sample)
    sizes = {(r["half"], r["label"]): r["count"] for r in sample.groupBy((F.col("part") % 2).cast("int").alias("half"), "label").count().collect()}
    other = [learn_lexicon(counts, sizes, (1 - half,)) for half in (0, 1)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = batch.column("part").to_pylist()
        rows = np.array([features(t, other[p % 2]) for t, p in zip(batch.column("text").to_pylist(), part, strict=True)], float).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column("part"), batch.column("label"), *[pa.array(c) for c in rows.T]], ["part", "label", *FEATURES])

    schema = "part long, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = np.array([list(r) for r in map_batches(sample.select("text", "label", "part"), work, schema).collect()], float).reshape(-1, len(FEATURES) + 2)
    rows = rows[np.lexsort(rows.T)]  # tasks end in any order
    x, y, fold = rows[:, 2:], rows[:, 1], rows[:, 0] // 2 % FOLDS
    sums = np.zeros(len(rows))
    for k in range(FOLDS):
        sums[fold == k] = boost(x[fold != k], y[fold != k]).sums(x[fold == k])
    return Model(learn_lexicon(counts, sizes), boost(x, y), *isotonic(sums, y))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs (doc_id, text).

    Labels are learned from rows of labels whose crc32(doc_id) mod 3 isn't 1; a null doc_id isn't held out. Null and empty texts have
    all features 0 and are scored like any other. Rows that repeat are scored alike; empty tables give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1)))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(model.value.scores(batch.column("text").to_pylist()), pa.float64())})

    scored = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, score double")
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

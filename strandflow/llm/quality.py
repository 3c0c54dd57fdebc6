"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are labelled good documents of the training folds; every document counts as
unlabelled. A linear model on bounded text features g(x) minimises

    prior * mean_P[l(g)] + max(0, mean_U[l(-g)] - prior * mean_P[l(-g)]),    l(z) = log(1 + exp(-z)),

plus a ridge, larger where positives are few. The features are shares of kinds of characters and tallies of repeated words and
phrases; words themselves are no features. Unlabelled means are taken over
the whole table: each Newton step is one pass over the stored features, in which tasks send one block
of sums each, added up in groups, in a fixed order, before one row per group reaches the driver. Where
the negative part of the risk falls below zero by more than its sampling error, the step is taken back
and halved until it does not: that is the non-negative correction.

The class prior is estimated from positives and unlabelled documents alone: of all score levels of a
first model, the least ratio of the share of unlabelled documents above the level to that of positives,
each ratio with its sampling error added. Negative labels are not used. At most about MAX_LABELS
positives are read (those with the smallest id digests).

A document's score is the model's probability. Null and empty texts have a score too: all their
features are zero but for a flag. With no trusted positive every score is a half. Rows of equal text
have equal scores; of labels that contradict each other the good one counts; labels of null doc_id or
quality do not count. An empty table gives an empty one. Only doc_id and text are read, whatever other
columns the table holds (keep_good keeps them).
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut, small_batches
from strandflow.llm.textkernel import SPACE, chunks, split_words, window_hash

#: Labelled rows that are read for the fit.
MAX_LABELS = 200_000
STEPS, THRESHOLD, FOLDS = 14, 0.3, 5
#: The ridge of many positives, and what it takes more, divided by their number.
RIDGE, RIDGE_OF_FEW = 1e-2, 3.0
#: Steps of the first model, which only ranks, and the levels its scores are compared at.
FIRST_STEPS, LEVELS = 5, 1000
#: Standard errors by which the negative part of the risk may lie below zero.
SLACK = 2.0

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*+=^~@\\", b"<>{}[]/_", b"\"'()-:;"]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[128:] = len(_GROUPS) + 1
_N_CLASSES = len(_GROUPS) + 2
FEATURES = 1 + 2 * (_N_CLASSES - 2) + 2 + 12


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the number of distinct values, and how often the commonest occurs."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    runs = np.diff(np.append(new, len(doc)))
    most = np.zeros(n)
    np.maximum.at(most, doc[new], runs)
    return np.bincount(doc[new], minlength=n), most


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of bounded features per text; 0 means nothing of that kind."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    classes = np.bincount(owner * _N_CLASSES + _CLASS[buf], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    share = classes / np.maximum(size, 1)[:, None]
    words = split_words(buf, offsets, SPACE, lower=True)
    doc, count = words.doc(), np.maximum(words.counts, 1)
    length = words.ends - words.starts
    last = buf[words.ends - 1]
    again = np.zeros(len(doc), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    tally = lambda mask: np.bincount(doc[mask], minlength=n) / count
    kinds, most = _distinct(doc, words.hashes, n)
    three = words.room() >= 3
    phrases, often = _distinct(doc[three], window_hash(words.hashes, 3)[three], n)
    spans = np.maximum(np.bincount(doc[three], minlength=n), 1)
    upper = (buf >= 65) & (buf < 91)
    caps = np.concatenate([[0], np.cumsum(upper)])
    shout = caps[words.ends] - caps[words.starts] >= np.maximum(2, (length + 1) // 2)
    mean = np.bincount(doc, weights=length, minlength=n) / count
    odd = np.isin(last, np.frombuffer(b"#$%&*+=^~@|!", np.uint8))
    columns = [
        size == 0,
        *share[:, : _N_CLASSES - 2].T,
        *np.sqrt(share[:, : _N_CLASSES - 2]).T,
        share[:, _N_CLASSES - 2], share[:, _N_CLASSES - 1],
        np.log1p(size) / 12, np.minimum(mean / 12, 2), tally(again), tally(odd), tally(shout), np.sqrt(tally(odd)), np.sqrt(tally(shout)),
        1 - kinds / count, most / count, 1 - phrases / spans, np.sqrt(np.maximum(0, 1 - phrases / spans)), often / spans,
    ]
    out = np.stack([np.asarray(c, np.float64) for c in columns], axis=1)
    out[size == 0, 1:] = 0
    return out


@dataclass(frozen=True)
class Model:
    """A linear model on standardised features; the last weight is the constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid(z @ self.weights[:-1] + self.weights[-1])


def _feature_table(documents: DataFrame) -> DataFrame:
    """doc_id and `x`: a document's features as 32-bit floats."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in chunks(batches):
            x = features(buf, offsets).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, x binary")


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)


def _sum(table: DataFrame, task_sums) -> np.ndarray:
    """Sums over the table of task_sums(features, is_positive), added up in groups of tasks, always in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, task = None, TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                s = task_sums(_rows(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(bool))
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task % 16], pa.int32()), pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "task", "sums"])

    def add(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("task").to_pylist(), t.column("sums").to_pylist(), strict=True), key=operator.itemgetter(0))
        return pa.table({"slot": t.column("slot").slice(0, 1), "sums": pa.array([np.sum([np.frombuffer(s) for _, s in rows], axis=0).tobytes()], pa.binary())})

    parts = table.select("x", "positive").mapInArrow(run, "slot int, task int, sums binary").groupBy("slot").applyInArrow(add, "slot int, sums binary").collect()
    return np.sum([np.frombuffer(p["sums"]) for p in sorted(parts, key=operator.itemgetter("slot"))], axis=0) if parts else np.zeros(2 + 2 * FEATURES)


def training_fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != 0


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -500, 500)))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def ridge_of(positives: float) -> float:
    return RIDGE + RIDGE_OF_FEW / positives


def _newton(table: DataFrame, mean: np.ndarray, scale: np.ndarray, prior: float, start: np.ndarray, steps: int, strength: float) -> np.ndarray:
    """Weights of the least non-negative risk, from a start."""
    w = best = start
    step, ridge = np.zeros_like(w), np.full(len(w), strength)
    ridge[-1] = 1e-6
    for _ in range(steps):
        now = w

        def sums(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
            g, u = z @ now, ~p
            q, soft = _sigmoid(g), np.logaddexp(0, g)
            hess = (z * (q * (1 - q) * u)[:, None]).T @ z
            return np.concatenate([[u.sum(), soft[u].sum(), (soft[u] ** 2).sum(), p.sum(), soft[p].sum(), (soft[p] ** 2).sum()], (q * u) @ z, z[p].sum(0), hess.ravel()])

        s = _sum(table, sums)
        (n, u, u2, m, v, v2), k = s[:6], len(w)
        negative = u / n - prior * v / m
        noise = math.sqrt(max(0.0, u2 / n - (u / n) ** 2) / n + prior**2 * max(0.0, v2 / m - (v / m) ** 2) / m)
        if negative >= -SLACK * noise:
            best, hess = w, s[6 + 2 * k :].reshape(k, k) / n + np.diag(ridge)
            step = np.linalg.solve(hess, s[6 : 6 + k] / n - prior * s[6 + k : 6 + 2 * k] / m + ridge * w)
        else:
            step = step / 2
        w = best - step
        if np.abs(step).max() < 1e-4:
            break
    return best


def estimate_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The share of positives among the unlabelled, from both kinds' counts by score level, the lowest first.

    The ratio of shares at the level where the ratio with its error added is least.
    """
    n, m = unlabelled.sum(), positive.sum()
    above_u, above_p = np.cumsum(unlabelled[::-1]) / n, np.cumsum(positive[::-1]) / m
    error = math.sqrt(math.log(40) / 2 / n) + math.sqrt(math.log(40) / 2 / m)
    some = above_p > error
    if not some.any():
        return 0.99
    at = int(np.argmin((above_u[some] + error) / above_p[some]))
    return float(np.clip(above_u[some][at] / above_p[some][at], 0.01, 0.99))


def fit_features(table: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """The model from a stored feature table and labels (doc_id, quality) of the training folds."""
    good = labels.select("doc_id").where("doc_id is not null AND quality = 1").where(training_fold()).distinct()
    share = min(1.0, max_labels / max(good.count(), 1))
    trusted = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000))
    positives = cut(table.join(trusted, "doc_id", "left_semi").select("doc_id", "x").repartition("doc_id").sortWithinPartitions("doc_id", "x"))
    both = table.select("x", F.lit(False).alias("positive")).unionAll(positives.select("x", F.lit(True)))
    d = FEATURES
    s = _sum(both, lambda x, p: np.concatenate([[(~p).sum(), p.sum()], x[~p].sum(0), (x[~p] ** 2).sum(0)]))
    if not s[1]:
        return Model(np.zeros(d), np.ones(d), np.zeros(d + 1), 0.5)
    mean = s[2 : 2 + d] / s[0]
    scale = np.sqrt(np.maximum(s[2 + d :] / s[0] - mean**2, 0)) + 1e-3
    strength = ridge_of(s[1])
    first = _newton(both, mean, scale, 0.5, np.zeros(d + 1), FIRST_STEPS, strength)
    model = Model(mean, scale, first, 0.5)

    def levels(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        level = np.minimum((model.score(x) * LEVELS).astype(np.int64), LEVELS - 1)
        return np.bincount(level + LEVELS * p, minlength=2 * LEVELS).astype(np.float64)

    counts = _sum(both, levels)
    prior = estimate_prior(counts[:LEVELS], counts[LEVELS:])
    start = np.append(np.zeros(d), _logit(prior))
    return Model(mean, scale, _newton(both, mean, scale, prior, start, STEPS, strength), prior)


def fit(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    return fit_features(cut(_feature_table(documents)), labels, max_labels)


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in chunks(batches):
            yield batch.filter(pa.array(model.score(features(buf, offsets).astype(np.float32)) >= threshold))

    return documents.mapInArrow(run, documents.schema)


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    table = cut(_feature_table(documents))
    model = fit_features(table, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_rows(b.column(1))))], names=["doc_id", "score"])

    scored = table.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (~training_fold()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

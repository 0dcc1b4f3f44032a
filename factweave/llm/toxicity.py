"""Toxicity by non-negative positive-unlabelled learning: a linear classifier from confirmed toxic examples and unlabelled text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows the classifier is fitted on: confirmed toxic ones, and unlabelled ones. Both are hashed samples.
MOST_POSITIVE = 4_000
MOST_UNLABELLED = 12_000
#: Used where no label tells the share of toxic texts.
CLASS_PRIOR = 0.1
BUCKETS = 1 << 18
STEM = 5
MIN_ROWS = 10
ROUNDS = 120
PACE = 0.02
SHRINK = 1.5e-3

_WORD = re.compile(r"\w+")


def features(text: str | None) -> np.ndarray:
    """Buckets of the different words of a whole text, and of their first letters."""
    words = set(_WORD.findall((text or "").lower()))
    if not words:
        return np.zeros(0, np.int32)
    items = words | {word[:STEM] + "*" for word in words if len(word) > STEM}
    return np.unique((pd.util.hash_array(np.array(list(items), dtype=object), categorize=False) >> np.uint64(64 - 18)).astype(np.int32))


def with_features(rows: DataFrame) -> DataFrame:
    """`rows` (positive, text) as (positive, f)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "f"])

    return rows.select("positive", "text").mapInArrow(cut, "positive boolean, f array<int>")


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk: prior * R+(P) + max(0, R-(U) - prior * R-(P)), logistic loss.

    Where the share of negatives in the unlabelled rows would get a negative risk, the step goes back along it, so the
    classifier does not learn the confirmed rows by heart. Features of fewer than MIN_ROWS rows have no weight.
    """
    weights = np.zeros(BUCKETS)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return weights, start
    rows = [*positive, *unlabelled]
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    common = np.bincount(flat, minlength=BUCKETS) >= MIN_ROWS
    flat, owner = flat[common[flat]], owner[common[flat]]
    used, columns = np.unique(flat, return_inverse=True)
    p = np.arange(len(rows)) < len(positive)
    n_p, n_u = len(positive), len(unlabelled)
    w = np.zeros(len(used) + 1)
    w[-1] = start
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        score = np.bincount(owner, weights=w[columns], minlength=len(rows)) + w[-1]
        chance = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        as_negative = np.logaddexp(0, score)
        excess = as_negative[~p].mean() - prior * as_negative[p].mean()
        slope = np.where(p, -prior * chance / n_p, chance / n_u)
        if excess >= 0:
            slope[p] += prior * (chance[p] - 1) / n_p
        else:
            slope = -slope
        grad = np.append(np.bincount(columns, weights=slope[owner], minlength=len(used)), slope.sum())
        grad[:-1] += SHRINK * w[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w -= PACE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def scored(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every whole text of `docs` (doc_id, text); a text without words has the score of the bias."""
    weights = weights.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.array([float(weights[features(t.as_py())].sum()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums + bias, -30, 30))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[np.ndarray, float]:
    """Fit on rows that are not held out: `labels` (doc_id, toxic) names the confirmed toxic documents, all others are unlabelled.

    The class prior is the toxic share of the labels that are not held out. Samples are drawn by a hash of doc_id with a share
    that makes about `most_positive` and `most_unlabelled` rows. An id labelled both ways is toxic; null labels are ignored.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    total = docs.count()
    if prior is None:
        prior = min(0.9, max(0.001, (counts["p"] or 0) / counts["n"])) if counts["n"] else CLASS_PRIOR
    wide = 1 << 30

    def drawn(share: float, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(wide)) < int(min(1.0, share) * wide)

    toxic = known.filter("toxic = 1").filter(drawn(most_positive / max(1, counts["p"] or 0), 1)).select("doc_id")
    rest = docs.filter(~held_out(F.col("doc_id"))).filter(drawn(most_unlabelled / max(1, 0.8 * total), 2)).select(F.lit(False).alias("positive"), "text")
    chosen = docs.select("doc_id", "text").join(toxic, "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")
    groups: dict[bool, list] = {True: [], False: []}
    for row in with_features(chosen.unionByName(rest)).toLocalIterator():
        groups[row["positive"]].append(np.array(row["f"], np.int32))
    return fit(groups[True], groups[False], prior)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`. Scores rest on the text alone; null texts are empty."""
    weights, bias = train(docs, labels)
    out = scored(docs, weights, bias)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

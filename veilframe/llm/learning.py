"""Bounded, labelled samples and small numpy models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labels that a classifier can have; more are an error.
MOST_LABELS = 1000


def bounded_sample(docs: DataFrame, labels: DataFrame, per_label: int, seed: str) -> tuple[DataFrame, dict]:
    """(doc_id, label, text) of at most ``per_label`` rows for each label, and how many rows each label has in all.

    ``labels`` has doc_id and label; rows are chosen by a hash of the id, so the choice does not depend on how rows lie.
    A first cut by the hash leaves about twice the bound of each label, so no label's rows meet in one task.
    """
    labels = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    lot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    share = F.lit(1 << 30)
    for label, n in counts.items():
        if n > 2 * per_label:
            share = F.when(F.col("label") == label, F.lit(int((1 << 30) * 2 * per_label / n))).otherwise(share)
    drawn = labels.select("doc_id", "label", lot.alias("lot")).where(F.col("lot") < share)
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("lot", "doc_id")))
    chosen = ranked.where(F.col("k") <= per_label).select("doc_id", "label")
    # The chosen ids are bounded by per_label and MOST_LABELS, so they are sent to the documents and not the other way.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), without overflow."""
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


def softmax(x: np.ndarray) -> np.ndarray:
    """Rows that sum to one."""
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(loss: Callable[[float], float]) -> float:
    """The temperature of least loss on rows that were not learned from."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    return float(grid[np.argmin([loss(t) for t in grid])])


def adam(params: list[np.ndarray], gradient: Callable[[list[np.ndarray], np.random.Generator], list[np.ndarray]], steps: int, rate: float, seed: int) -> list[np.ndarray]:
    """Stochastic gradient steps with Adam's scaling."""
    rng, m, v = np.random.default_rng(seed), [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for i, g in enumerate(gradient(params, rng)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return params

"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Random indexing: each word has a sparse ternary index vector, drawn from its hash. A word's vector is the sum of the
index vectors of the words around it in the training sample, plus its own. Words share SLOTS rows by hash, so the
table's size is fixed. Besides its words, a document holds a token for each word's shape (capital, digits, symbols, ...)
and one for each word that continues a three-word run seen before in the document. The vectors of both kinds of token are pooled by
their mean, and the two means are what the network reads: one hidden layer, then a logit, divided by a temperature
that is fitted on rows the network did not learn from.

The sample has at most PER_LABEL documents of each label, chosen by a hash of the id, and only of ids outside the held
out fold. Every document is scored whole. Null and empty texts have zero vectors and get the network's score of those.
Repeated rows get equal scores; an empty table gives no rows. Without both labels to learn from, every score is the
share of label 1 (0.5 if there are none). Labels of unknown documents, null labels, and other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents, held_out, id_and_text
from veilframe.llm.learning import adam, bounded_sample, sigmoid, temperature

PER_LABEL = 2500
SLOTS, WIDTH, NONZERO = 1 << 15, 32, 4
AROUND, HIDDEN = 2, 24
CUT = 0.3
#: Words whose codes a worker remembers; then it starts anew.
REMEMBERED = 500_000

_SHAPES = (
    re.compile(r"[^\w\s]*[A-ZÀ-Þ]{2,}[^\w\s]*"),  # capitals
    re.compile(r"[^\w\s]*[^\W\d_]+[^\w\s]?"),  # a word with at most one mark after it
    re.compile(r"[^\w\s]+"),  # marks alone
    re.compile(r"[\d.,:/-]+"),  # numbers
)
N_SHAPES = 2 * (len(_SHAPES) + 1) + 1
AGAIN = N_SHAPES - 1


def _code(word: str) -> int:
    """Slot and shape of a word in one number."""
    shape = next((i for i, p in enumerate(_SHAPES) if p.fullmatch(word)), len(_SHAPES))
    odd = bool(re.search(r"[#*$%&|<>]|!!", word))
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % SLOTS * 16 + 2 * shape + odd


class Reader:
    """Turns texts into slots and shapes, remembering words."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the words, and how often each shape token occurs."""
        words = (text or "").split()
        if len(self.codes) > REMEMBERED:
            self.codes = {}
        found = list(map(self.codes.get, words))
        if None in found:
            for w in {w for w, c in zip(words, found) if c is None}:
                self.codes[w] = _code(w)
            found = list(map(self.codes.get, words))
        codes = np.array(found, dtype=np.int64)
        shapes = np.bincount(codes & 15, minlength=N_SHAPES).astype(np.float32)
        slots = codes >> 4
        if len(slots) >= 3:
            runs = np.sort((slots[:-2] * SLOTS + slots[1:-1]) * SLOTS + slots[2:])
            shapes[AGAIN] = (runs[1:] == runs[:-1]).sum()
        return slots, shapes


def index_vectors(n: int, width: int = WIDTH, nonzero: int = NONZERO, seed: int = 7) -> np.ndarray:
    """Sparse ternary vectors, the same in every process."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, width), dtype=np.float32)
    at = np.argsort(rng.random((n, width), dtype=np.float32), axis=1)[:, :nonzero]
    out[np.arange(n)[:, None], at] = rng.choice(np.array([-1, 1], dtype=np.float32), (n, nonzero))
    return out


class Vectors:
    """Word vectors learned by random indexing, and fixed ones for shape tokens."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        index, table = index_vectors(SLOTS), np.zeros((SLOTS, WIDTH), dtype=np.float32)
        for slots in texts:
            for step in range(1, AROUND + 1):
                np.add.at(table, slots[:-step], index[slots[step:]])
                np.add.at(table, slots[step:], index[slots[:-step]])
        table += index
        self.words = table / np.linalg.norm(table, axis=1, keepdims=True)
        self.shapes = index_vectors(N_SHAPES, seed=11)

    def pool(self, slots: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """The document's two mean vectors."""
        n = max(1, len(slots))
        words = np.zeros(WIDTH, dtype=np.float64)
        for at in range(0, len(slots), 1 << 15):
            words += self.words[slots[at : at + (1 << 15)]].sum(axis=0)
        return np.concatenate((words / n, shapes @ self.shapes / n))


class Network:
    """Two layers, standardized inputs, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        kept = rng.random(len(x)) < 0.2
        if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
            kept = np.zeros(len(x), dtype=bool)
        lx, ly, lw = x[~kept], y[~kept], weights[~kept]
        start = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

        def gradient(p: list[np.ndarray], rng: np.random.Generator) -> list[np.ndarray]:
            rows = rng.integers(0, len(lx), 256)
            h = np.tanh(lx[rows] @ p[0] + p[1])
            e = (sigmoid(h @ p[2] + p[3]) - ly[rows]) * lw[rows] / len(rows)
            back = np.outer(e, p[2]) * (1 - h * h)
            return [lx[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], e.sum(keepdims=True)]

        self.params, self.heat = adam(start, gradient, 2500, 0.005, seed), 1.0
        if kept.any():
            z, t, w = self._logits(x[kept]), y[kept], weights[kept]

            def loss(heat: float) -> float:
                p = np.clip(sigmoid(z / heat), 1e-9, 1 - 1e-9)
                return float(-(w * (t * np.log(p) + (1 - t) * np.log(1 - p))).sum())

            self.heat = temperature(loss)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.params
        return np.tanh(x @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        return sigmoid(self._logits(np.clip((x - self.mean) / self.scale, -8, 8)) / self.heat)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[Vectors, Network] | float:
    """The model for ``labels`` (doc_id, label 0 or 1); a constant where there is nothing to tell apart."""
    sample, counts = bounded_sample(docs, labels, per_label, "quality")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            got = [reader.read(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "slots": [s.astype("<u2").tobytes() for s, _ in got], "shapes": [h.tobytes() for _, h in got]})

    rows = sample.select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInPandas(read, "doc_id long, label int, slots binary, shapes binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["slots"]))
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return float(counts.get(1, 0) / max(1, sum(counts.values()))) if counts else 0.5
    slots = [np.frombuffer(r["slots"], "<u2").astype(np.int64) for r in rows]
    vectors = Vectors(slots)
    x = np.stack([vectors.pool(s, np.frombuffer(r["shapes"], np.float32)) for s, r in zip(slots, rows)])
    # The sample holds labels about evenly; the weights give them their shares of all labelled rows.
    share = np.array([counts.get(0, 0), counts.get(1, 0)]) / sum(counts.values())
    weights = (share / np.bincount(y.astype(int), minlength=2) * len(y))[y.astype(int)]
    return vectors, Network(x, y, weights)


def score(docs: DataFrame, model: tuple[Vectors, Network] | float) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            if isinstance(sent.value, float):
                scores = np.full(len(batch), sent.value)
            else:
                vectors, network = sent.value
                pooled = [vectors.pool(*reader.read(t)) for t in batch["text"]]
                scores = network.score(np.stack(pooled)) if pooled else np.empty(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores})

    return id_and_text(docs).mapInPandas(run, "doc_id long, score double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; learned from the rows outside the held-out fold."""
    docs = documents(spark, sf_dir)
    fold = held_out(F.col("doc_id"), 5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold).select("doc_id", F.col("quality").alias("label"))
    return score(docs, fit(docs, labels)).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A word's subwords are the runs of 2 to 4 bytes of "<word>", lower-cased; each has one of SLOTS embeddings by hash. A
text's vector is the mean over all its subwords, and a linear layer with softmax gives the languages' probabilities. As
both steps are linear, scoring adds up the subwords' logits; a worker remembers the sum of each word.

The probabilities are calibrated: a temperature is fitted on sample rows that were not learned from, and so is the
probability below which an answer is ``rejected``: it keeps REJECT of those rows' right answers. The answer itself stays.

The sample has at most PER_LANGUAGE documents of each language, chosen by a hash of the id, outside the held-out fold.
A text that is null or has no letter is ``und`` with score 0. Repeated rows get equal answers; empty tables give no rows;
other columns are ignored. With nothing to learn from every answer is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents, held_out
from veilframe.llm.exchange import mixed, rolling
from veilframe.llm.learning import bounded_sample, softmax, temperature

PER_LANGUAGE = 1200
SLOTS, WIDTH = 1 << 15, 16
SIZES = (2, 3, 4)
EPOCHS, RATE = 6, 0.5
REJECT = 0.99
UNKNOWN = "und"
#: Words whose sums a worker remembers; then it starts anew.
REMEMBERED = 300_000
BASE = 0x9E3779B97F4A7C15
#: A letter in the sense of Unicode; half signs, superscripts and circled digits are none.
_LETTER = regex.compile(r"\p{L}")


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all subwords of the words, and the word that each belongs to."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[word] - np.arange(len(word))
    slots, owner = [], []
    for n in SIZES:
        if len(data) >= n:
            hashes = mixed(rolling(data.astype(np.uint64) + np.uint64(1), n, BASE) + np.uint64(n << 56))
            real = left[: len(hashes)] >= n
            slots.append((hashes[real] % np.uint64(SLOTS)).astype(np.int64))
            owner.append(word[: len(hashes)][real])
    return (np.concatenate(slots), np.concatenate(owner)) if slots else (np.empty(0, np.int64), np.empty(0, np.int64))


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


class Model:
    """Embeddings and a linear layer, folded into one table of logits for scoring."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], answers: list[str], shares: dict[str, float], seed: int = 5) -> None:
        self.languages = sorted(set(answers))
        y = np.array([self.languages.index(a) for a in answers])
        rng, n = np.random.default_rng(seed), len(self.languages)
        table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (SLOTS, WIDTH))
        layer, bias = rng.normal(0, 0.1, (WIDTH, n)), np.zeros(n)
        weight = np.array([shares[c] for c in self.languages]) / np.bincount(y, minlength=n) * len(y)
        kept = rng.random(len(y)) < 0.2
        learned = np.flatnonzero(~kept)
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for i in rng.permutation(learned):
                slots, counts = bags[i]
                if not len(slots):
                    continue
                share = counts / counts.sum()
                mean = share @ table[slots]
                z = mean @ layer + bias
                e = np.exp(z - z.max())
                e /= e.sum()
                e[y[i]] -= 1
                e *= min(3.0, weight[y[i]])
                back = layer @ e
                layer -= rate * np.outer(mean, e)
                bias -= 0.1 * rate * e
                # Each subword moves by its share; the factor makes up for how thinly a mean spreads the step.
                table[slots] -= rate * np.minimum(1, 20 * share)[:, None] * back
        self.table, self.bias, self.heat, self.least = (table @ layer).astype(np.float32), bias, 1.0, 0.0
        if kept.any():
            z = np.stack([self._mean(*bags[i]) for i in np.flatnonzero(kept)])
            right = y[kept]
            at = np.arange(len(right))
            self.heat = temperature(lambda t: float(-np.log(softmax(z / t)[at, right] + 1e-12).sum()))
            p = softmax(z / self.heat)
            good = p.max(axis=1)[p.argmax(axis=1) == right]
            self.least = float(np.quantile(good, 1 - REJECT)) if len(good) else 0.0

    def _mean(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = max(1, counts.sum())
        return counts @ self.table[slots] / total + self.bias if len(slots) else self.bias.copy()


class Scorer:
    """Sums of words' logits, remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.at = model, {}
        self._grow([])

    def _grow(self, words: list[bytes]) -> None:
        if not words or len(self.at) + len(words) > REMEMBERED:
            self.at, self.n = {}, 0
            self.sums = np.zeros((1 << 12, len(self.model.languages) + 1))
        if words:
            slots, owner = subwords(words)
            need = self.n + len(words)
            while need > len(self.sums):
                self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
            for c in range(self.sums.shape[1] - 1):
                self.sums[self.n : need, c] = np.bincount(owner, weights=self.model.table[slots, c], minlength=len(words))
            self.sums[self.n : need, -1] = np.bincount(owner, minlength=len(words))
            self.at.update(zip(words, range(self.n, need)))
            self.n = need

    def logits(self, text: str) -> np.ndarray:
        """The text's calibrated logits."""
        words, total = _words(text), np.zeros(len(self.model.languages) + 1)
        for k in range(0, len(words), REMEMBERED // 2):
            part = words[k : k + REMEMBERED // 2]
            found = list(map(self.at.get, part))
            if None in found:
                missing = list({w for w, f in zip(part, found) if f is None})
                if len(self.at) + len(missing) > REMEMBERED:
                    missing = list(set(part))
                self._grow(missing)
                found = list(map(self.at.get, part))
            total += self.sums[np.array(found)].sum(axis=0)
        return (total[:-1] / max(1, total[-1]) + self.model.bias) / self.model.heat


def fit(docs: DataFrame, labels: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """The model for ``labels`` (doc_id, label: a language)."""
    sample, counts = bounded_sample(docs, labels, per_language, "language")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [np.unique(subwords(_words(t or ""))[0], return_counts=True) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "slots": [s.astype("<u2").tobytes() for s, _ in bags], "counts": [c.astype("<u4").tobytes() for _, c in bags]})

    rows = sample.select("doc_id", F.col("label").cast("string").alias("label"), "text").mapInPandas(read, "doc_id long, label string, slots binary, counts binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["slots"]))
    bags = [(np.frombuffer(r["slots"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.float64)) for r in rows]
    total = sum(counts.values())
    return Model(bags, [r["label"] for r in rows], {str(k): v / total for k, v in counts.items()})


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            out = []
            for text in batch["text"]:
                if scorer is None or text is None or not _LETTER.search(text):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                p = softmax(scorer.logits(text)[None, :])[0]
                best = int(p.argmax())
                out.append((scorer.model.languages[best], float(p[best]), bool(p[best] < scorer.model.least)))
            frame = pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learned from the rows outside the held-out fold."""
    docs = documents(spark, sf_dir)
    fold = held_out(F.col("doc_id"), 4, 2)
    labels = docs.where(~fold & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("label"))
    return predict(docs, fit(docs, labels)).select("doc_id", fold.alias("held_out"), "lang_pred", "score", "rejected")

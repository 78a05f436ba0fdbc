"""Toxicity: a weighted finite-state grammar over the clauses of a text.

A reader turns each word into a symbol: INSULT with a weight, HARM (what a threat does), WILL (what announces it),
TARGET (who is addressed), NOT, BUT (what takes a negation back), SAID (reported speech begins), or nothing. Five
transducers run over the symbols:

* insult: emits the weight of an insult;
* threat: emits THREAT for a harm after an announcement in the same clause;
* target: the whole clause counts AIMED times if it addresses somebody, before or behind the insult: a final weight;
* negation: multiplies what is emitted by DENIED up to DENIES words behind a negation, or until it is taken back;
* reported speech: multiplies it by QUOTED until the clause ends.

They are composed into one table over product states; the end of a clause (a mark of punctuation after a word) takes the
final weight and brings all of them back to their first states. A clause's score is the sum of what is emitted, at most
CLAUSE; a text's evidence is the logarithm of one plus the sum over its clauses, and a logistic curve makes a probability
of it.

Insults are learned: whole words and beginnings of words (stems) that many toxic and hardly any other documents of the
sample hold, weighted by log-odds. Copies in the sample count once, or the words of one much-copied document would all
look toxic. The sample has at most PER_LABEL documents of each label, chosen by a hash of the id, outside the held-out fold.

Null and empty texts have no clause and get the curve's lowest score. Repeated rows get equal scores; empty tables give
no rows; labels of unknown documents, null labels and other columns are ignored. Without both labels to learn from the
list of insults is empty and every score is the share of label 1 (0 if there are none).
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents, held_out, id_and_text, scratch
from veilframe.llm.exchange import mixed, rolling
from veilframe.llm.learning import bounded_sample, sigmoid

PER_LABEL = 2500
STEMS = range(3, 9)
#: A stem or word is an insult if chance would put so many of its documents among the toxic ones with less than this
#: probability over all stems and words together, and if no more than this share of the other documents holds it.
CHANCE, SPARE = 0.01, 0.002
THREAT, CLAUSE = 3.0, 8.0
AIMED, DENIED, QUOTED = 1.5, 0.4, 0.6
DENIES = 4
CUT = 0.3
REMEMBERED = 500_000

#: Words of the grammar, in English, French, German and Spanish: what announces a deed, what it does, who is addressed, what denies,
#: what takes a denial back, and what begins reported speech.
WILL = frozenset(
    "will shall gonna going must should i'll we'll they'll vais va allons vont vas irai devrais werde werden wird wirst werdet sollte muss voy vas va vamos van iré debería".split()
)
HARM = frozenset(
    "kill hurt beat destroy murder stab shoot hang burn crush smash strangle punch kick slaughter torture tuer frapper détruire égorger pendre brûler écraser étrangler poignarder torturer "
    "töten schlagen umbringen vernichten erschießen erstechen verbrennen hängen zerstören verprügeln quälen matar golpear destruir asesinar quemar ahorcar apuñalar aplastar torturar degollar".split()
)
TARGET = frozenset(
    "you your yours yourself yourselves u ya they them their tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer eure sie tú ti tu tus te usted ustedes vosotros vuestro".split()
)
NOT = frozenset(
    "not never no none nobody neither nor without isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't cannot couldn't shouldn't ne pas jamais aucun aucune rien ni sans "
    "nicht kein keine keinen keiner nie niemals niemand nichts ohne nunca jamás ningún ninguna nadie nada sin tampoco".split()
)
BUT = frozenset("but yet however mais pourtant cependant aber doch sondern jedoch pero sino aunque".split())
SAID = frozenset(
    "said says say told tells called calls quoted quotes wrote writes claimed claims reported according dit disait disent écrit appelé selon affirme "
    "sagte sagt sagen schrieb nannte laut behauptet zitiert dijo dice decía escribió llamó según afirmó citó".split()
)

NOTHING, INSULT, HARMS, WILLS, TARGETS, NOTS, BUTS, SAYS = range(8)
_MARKS = re.compile(r"^[^\w]+|[^\w]+$")
_END = re.compile(r"[.!?;:|\n]")


class Transducer:
    """States, a step (state, symbol) -> state, what it adds or multiplies at a state and symbol, and the weight of the state at the end."""

    def __init__(self, states: int, step, emit=None, factor=None, final=None) -> None:
        self.states, self.step, self.emit, self.factor, self.final = states, step, emit or (lambda s, a: (0.0, 0.0)), factor or (lambda s, a: 1.0), final or (lambda s: 1.0)


#: emit gives (what is added, what the word's own weight is multiplied by and added).
GRAMMAR = (
    Transducer(1, lambda s, a: 0, emit=lambda s, a: (0.0, 1.0 if a == INSULT else 0.0)),
    Transducer(2, lambda s, a: 1 if a == WILLS else s, emit=lambda s, a: (THREAT if s and a == HARMS else 0.0, 0.0)),
    Transducer(2, lambda s, a: 1 if a == TARGETS else s, final=lambda s: AIMED if s else 1.0),
    Transducer(DENIES + 1, lambda s, a: DENIES if a == NOTS else 0 if a == BUTS else max(0, s - 1), factor=lambda s, a: DENIED if s else 1.0),
    Transducer(2, lambda s, a: 1 if a == SAYS else s, factor=lambda s, a: QUOTED if s else 1.0),
)


def compose(parts: tuple[Transducer, ...] = GRAMMAR) -> tuple[dict[tuple[int, int], tuple[int, float, float]], list[float]]:
    """(state, symbol) -> (state, what is added, what the word's weight is multiplied by), over product states; the states' final weights."""
    states = list(itertools.product(*(range(p.states) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    table = {}
    for s, a in itertools.product(states, range(SAYS + 1)):
        factor = math.prod(p.factor(x, a) for p, x in zip(parts, s))
        added, times = (sum(v) for v in zip(*(p.emit(x, a) for p, x in zip(parts, s))))
        table[number[s], a] = (number[tuple(p.step(x, a) for p, x in zip(parts, s))], added * factor, times * factor)
    return table, [math.prod(p.final(x) for p, x in zip(parts, s)) for s in states]


_TABLE, _FINAL = compose()


def _plain(word: str) -> str:
    return _MARKS.sub("", word.lower())


class Grammar:
    """The transducers with learned insults."""

    def __init__(self, insults: dict[str, float], curve: tuple[float, float] = (0.0, 0.0)) -> None:
        self.insults, self.curve = insults, curve
        self.longest = max(map(len, insults), default=0)
        self.read: dict[str, tuple[int, float, bool]] = {}

    def weight(self, word: str) -> float:
        """The greatest weight of the word itself and of its stems."""
        found = [self.insults.get(f"{word}$", 0.0)]
        found += [self.insults.get(word[:n], 0.0) for n in STEMS if n <= len(word)]
        return max(found)

    def _symbol(self, raw: str) -> tuple[int, float, bool]:
        word, end = _plain(raw), bool(_END.search(raw[-1]))
        weight = self.weight(word)
        for symbol, words in ((WILLS, WILL), (HARMS, HARM), (TARGETS, TARGET), (NOTS, NOT), (BUTS, BUT), (SAYS, SAID)):
            if word in words:
                return symbol, 0.0, end
        return (INSULT, weight, end) if weight else (NOTHING, 0.0, end)

    def clauses(self, text: str | None) -> list[float]:
        """The scores of the clauses that emit anything."""
        words = (text or "").split()
        if len(self.read) > REMEMBERED:
            self.read = {}
        found = list(map(self.read.get, words))
        if None in found:
            for w in {w for w, f in zip(words, found) if f is None}:
                self.read[w] = self._symbol(w)
            found = list(map(self.read.get, words))
        out, state, score, table = [], 0, 0.0, _TABLE
        for symbol, weight, end in found:
            if symbol or state:
                state, added, times = table[state, symbol]
                if added or times:
                    score += added + times * weight
            if end and (state or score):
                if score:
                    out.append(min(score * _FINAL[state], CLAUSE))
                state, score = 0, 0.0
        return out + [min(score * _FINAL[state], CLAUSE)] if score else out

    def evidence(self, text: str | None) -> float:
        """The logarithm of one plus the clauses' scores."""
        return math.log1p(sum(self.clauses(text)))

    def score(self, text: str | None) -> float:
        """The probability of label 1."""
        a, b = self.curve
        return float(sigmoid(a * self.evidence(text) + b))


def _features(text: str) -> set[str]:
    words = {_plain(w) for w in text.split()}
    return {f"{w}$" for w in words if w} | {w[:n] for w in words for n in STEMS if n <= len(w)}


def _signature(text: str) -> list[int]:
    """Three MinHash values of five-word runs: copies share one of them."""
    words = text.lower().split()
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    runs = mixed(rolling(hashes, min(5, len(hashes)), 0x9E3779B97F4A7C15)) if len(hashes) else np.zeros(1, np.uint64)
    least = [mixed(runs ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min() for k in (1, 2, 3)]
    return np.array(least, dtype=np.uint64).view(np.int64).tolist()


def _chance(k: int, others: int, share: float) -> float:
    """The logarithm of the probability that of k + others documents, drawn with this share of toxic ones, k or more are toxic."""
    n = k + others
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + (n - i) * math.log(share) + i * math.log1p(-share) for i in range(others + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def _curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small penalty."""
    p = np.array([1.0, -2.0])
    design = np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(50):
        q = sigmoid(design @ p)
        g = design.T @ (weights * (q - y)) + 1e-2 * p
        h = (design * (weights * q * (1 - q))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(p[0], 0.1)), float(p[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Grammar:
    """The grammar for ``labels`` (doc_id, label 0 or 1).

    The sample is written once. Only signatures, insults that chance does not explain, and evidence come to the driver.
    """
    spark = docs.sparkSession
    sample, counts = bounded_sample(docs, labels, per_label, "toxicity")
    at = scratch(spark, "toxicity-sample")
    sample.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text")).write.parquet(at)
    rows = spark.read.parquet(at)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    kept = _without_copies(rows)
    n = Counter(kept.values())
    if not n[0] or not n[1]:
        return Grammar({}, (0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    insults = _insults(rows, kept, n)
    found = sorted(_evidence(rows, kept, Grammar(insults)))
    x, y = np.array([e for e, _ in found]), np.array([label for _, label in found], dtype=np.float64)
    weights = np.where(y == 1, share / n[1], (1 - share) / n[0]) * len(found)
    return Grammar(insults, _curve(x, y, weights))


def _without_copies(rows: DataFrame) -> dict[int, int]:
    """Row and label of the sample's rows that share no MinHash value with one before them."""

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(signs=[_signature(t) for t in batch["text"]])

    seen: set[int] = set()
    kept: dict[int, int] = {}
    for r in sorted(rows.mapInPandas(signs, "row long, doc_id long, label int, signs array<long>").toLocalIterator(), key=lambda r: (r["doc_id"], r["signs"], r["row"])):
        if not seen & set(r["signs"]):
            kept[r["row"]] = r["label"]
        seen |= set(r["signs"])
    return kept


def _insults(rows: DataFrame, kept: dict[int, int], n: Counter) -> dict[str, float]:
    """Words and stems that chance does not explain, with their weights."""
    spark = rows.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = {0: Counter(), 1: Counter()}
            for row, text in zip(batch["row"], batch["text"]):
                if row in kept:
                    held[kept[row]].update(_features(text))
            names = list(held[0] | held[1])
            yield pd.DataFrame({"feature": names, "toxic": [held[1][f] for f in names], "others": [held[0][f] for f in names]})

    at = scratch(spark, "toxicity-features")
    counted = rows.mapInPandas(count, "feature string, toxic long, others long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))
    counted.where("toxic > 0").write.parquet(at)
    features, toxic = spark.read.parquet(at), n[1] / (n[0] + n[1])
    limit = math.log(CHANCE / max(1, features.count()))
    # With none among the others chance is least, so fewer toxic documents than this never pass.
    least = math.ceil(limit / math.log(toxic) - 1e-9)
    held = {r["feature"]: (r["toxic"], r["others"]) for r in features.where((F.col("toxic") >= least) & (F.col("others") <= SPARE * n[0])).collect()}
    insults = {f: math.log((k + 0.5) / (n[1] + 1)) - math.log((o + 0.5) / (n[0] + 1)) for f, (k, o) in held.items() if _chance(k, o, toxic) < limit}
    # A stem that one longer stem or word accounts for says no more than that one.
    spare = {f for g in insults for f in (g[:i] for i in STEMS if i < len(g)) if f in insults and held[g][0] >= 0.95 * held[f][0]}
    return {f: w for f, w in insults.items() if f not in spare}


def _evidence(rows: DataFrame, kept: dict[int, int], grammar: Grammar) -> list[tuple[float, int]]:
    """Evidence and label of the kept rows of the sample."""
    insults = grammar.insults

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Grammar(insults)
        for batch in batches:
            batch = batch[batch["row"].isin(kept)]
            yield pd.DataFrame({"evidence": [mine.evidence(t) for t in batch["text"]], "label": batch["label"].to_numpy()})

    return [(r["evidence"], r["label"]) for r in rows.mapInPandas(run, "evidence double, label int").collect()]


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score, n_clauses) of every row; n_clauses counts the matched ones."""
    sent = docs.sparkSession.sparkContext.broadcast((grammar.insults, grammar.curve))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Grammar(*sent.value)
        for batch in batches:
            found = [mine.clauses(t) for t in batch["text"]]
            x = np.log1p(np.array([sum(f) for f in found], dtype=np.float64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": sigmoid(mine.curve[0] * x + mine.curve[1]), "n_clauses": [len(f) for f in found]})

    return id_and_text(docs).mapInPandas(run, "doc_id long, score double, n_clauses long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; learned from the rows outside the held-out fold."""
    docs = documents(spark, sf_dir)
    fold = held_out(F.col("doc_id"), 4, 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold).select("doc_id", F.col("toxic").alias("label"))
    return score(docs, fit(docs, labels)).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_clauses")

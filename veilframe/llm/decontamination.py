"""Benchmark items inside documents: size-partitioned MinHash containment, verified by exact shingle containment.

A text's shingles are its runs of SHINGLE words (A-Z lower-cased; words as everywhere here), as a set. An item with
fewer words has one shingle, all its words, and is looked for among runs of that many words. A document is contaminated
by an item if it holds at least THRESHOLD of the item's shingles.

Items are partitioned by how many shingles they have, in powers of two. The sketch of an item is its k least shingle
hashes (bottom-k MinHash), with k from the partition's upper size n: k = n - ceil(THRESHOLD * n) + 1. An item that has
less than k shingles keeps all. A document that holds THRESHOLD of the item misses fewer than k of its shingles, so it
holds one of the sketch: candidates miss nothing. Documents with too few shingles for a partition's least size are not
its candidates. A candidate's shingles are then compared as words, not as hashes.

Benchmarks are sent to executors in blocks of at most BLOCK_BYTES of text, or more only where one text is longer than half of that, one
pass for each block. A repeated item is looked for once.

Null and empty texts have no shingle: such items match nothing and such documents hold nothing. Repeated rows are
judged one by one; empty tables give no rows; columns other than doc_id and text, item_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import cut, documents
from veilframe.llm.exchange import mixed, rolling

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 16 << 20
#: Characters of documents that are hashed at once.
CHUNK = 1 << 21
BASE = 0x9E3779B97F4A7C15


def _needed(n: int, threshold: float) -> int:
    """The least whole number of n shingles that is at least the threshold's share; the share is taken in thousandths."""
    return -(-n * round(threshold * 1000) // 1000)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def _hashes(lists: list[list[bytes]]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for ws in lists for w in ws), dtype=np.uint64)


class Sketches:
    """The items of one block, partitioned by size, with their bottom-k sketches."""

    def __init__(self, items: list[Item], shingle: int = SHINGLE, threshold: float = THRESHOLD) -> None:
        self.items, self.sets, self.widths, self.threshold = [], [], [], threshold
        by_width: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            words = _words(text)
            width = min(shingle, len(words))
            if not width:
                continue
            held = _shingles(words, width)
            hashes = np.unique(mixed(rolling(_hashes([words]), width, BASE)))
            low = 1 << (len(held).bit_length() - 1)
            high = 2 * low - 1
            k = high - _needed(high, threshold) + 1
            at = len(self.items)
            self.items.append(item_id)
            self.sets.append(held)
            self.widths.append(width)
            by_width.setdefault(width, []).extend((int(h), at, _needed(low, threshold)) for h in hashes[:k])
        #: width -> sorted hashes, the item of each, and the shingles that a document must have at least.
        self.tables = {w: (np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) for w, rows in ((w, sorted(rows)) for w, rows in by_width.items())}

    def _candidates(self, lists: list[list[bytes]]) -> set[tuple[int, int]]:
        sizes = np.array([len(w) for w in lists], dtype=np.int64)
        hashes, starts = _hashes(lists), np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(lists)), sizes)
        left = (starts + sizes)[doc] - np.arange(len(doc))
        found: set[tuple[int, int]] = set()
        for width, (keys, item, least) in self.tables.items():
            grams = mixed(rolling(hashes, width, BASE))
            at = np.searchsorted(keys, grams)
            hit = np.flatnonzero((keys[np.minimum(at, len(keys) - 1)] == grams) & (left[: len(grams)] >= width))
            for g in hit.tolist():
                k, d = int(at[g]), int(doc[g])
                while k < len(keys) and keys[k] == grams[g]:
                    if sizes[d] - width + 1 >= least[k]:
                        found.add((d, int(item[k])))
                    k += 1
        return found

    def matches(self, texts: list[str | None]) -> list[tuple[int, tuple[int | None, int], int, int]]:
        """(place of the text, the item's id and number, its shingles, shared shingles) of every contaminated text."""
        out, at = [], 0
        while at < len(texts):
            past, size = at, 0
            while past < len(texts) and (past == at or size < CHUNK):
                size += len(texts[past] or "")
                past += 1
            lists = [_words(t) for t in texts[at:past]]
            held: dict[tuple[int, int], set[bytes]] = {}
            for d, i in sorted(self._candidates(lists)):
                width = self.widths[i]
                if (d, width) not in held:
                    held[d, width] = _shingles(lists[d], width)
                shared = len(self.sets[i] & held[d, width])
                if shared >= _needed(len(self.sets[i]), self.threshold):
                    out.append((at + d, self.items[i], len(self.sets[i]), shared))
            at = past
        return out


#: An item as a block holds it: its id and how often it is there, and its text.
Item = tuple[tuple[int | None, int], str]


def _blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[Item]]:
    """The benchmark in blocks of at most ``most`` bytes, one at a time: the driver holds one block. Each block is a pass over the documents.

    Repeated items are one item and a number. Items are dealt by a running sum of their bytes: a block takes those that begin in a stretch
    of half its size, so it is larger only where its last text alone is longer than the other half. The sums run inside parts that
    hashing makes even, as no item is there twice.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").groupBy("item_id", "text").agg(F.count("*").alias("n"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= most:
        blocks = [items]
    else:
        dealt = items.withColumn("__h", F.xxhash64("item_id", "text")).withColumn("__part", F.pmod("__h", F.lit(math.ceil(size / most))))
        before = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("__part").orderBy("__h", "item_id", "text").rowsBetween(Window.unboundedPreceding, -1))
        placed = cut(dealt.withColumn("__block", F.floor(F.coalesce(before, F.lit(0)) / F.lit(max(1, most // 2)))))
        names = placed.select("__part", "__block").distinct().orderBy("__part", "__block").collect()
        blocks = (placed.where((F.col("__part") == k["__part"]) & (F.col("__block") == k["__block"])) for k in names)
    for block in blocks:
        yield [((r["item_id"], r["n"]), r["text"]) for r in block.select("item_id", "n", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every contaminated row and item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one(block: list[Item]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sketches = Sketches(sent.value, shingle, threshold)
            for batch in batches:
                found = [f for f in sketches.matches(batch["text"].tolist()) for _ in range(f[1][1])]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[[f[0] for f in found]].astype("Int64").to_numpy(),
                    "item_id": pd.array([f[1][0] for f in found], dtype="Int64"),
                    "n_shingles": [f[2] for f in found],
                    "n_shared": [f[3] for f in found],
                    "containment": [f[3] / f[2] for f in found],
                })

        return rows.mapInPandas(run, "doc_id long, item_id long, n_shingles long, n_shared long, containment double")

    return reduce(DataFrame.unionByName, map(one, _blocks(benchmark)))


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that no item contaminates, with all their columns."""
    flagged = docs

    def judge(block: list[Item]):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            sketches = Sketches(sent.value, shingle, threshold)
            for batch in texts:
                ok = np.ones(len(batch), dtype=bool)
                ok[[f[0] for f in sketches.matches(batch.tolist())]] = False
                yield pd.Series(ok)

        return F.pandas_udf(run, T.BooleanType())

    for block in _blocks(benchmark):
        flagged = flagged.where(judge(block)("text"))
    return flagged


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds 0.8 of a benchmark item's shingles, with the item."""
    return find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP9_SQL = r"""
WITH b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
bi AS (SELECT item_id, ws, least(5, len(ws)) AS w FROM b WHERE len(ws) > 0),
bs AS (SELECT DISTINCT item_id, w, array_to_string(list_slice(ws, i, i + w - 1), ' ') AS g FROM (SELECT item_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM bi)),
wd AS (SELECT DISTINCT w FROM bi),
ds AS (SELECT DISTINCT r, doc_id, w, array_to_string(list_slice(ws, i, i + w - 1), ' ') AS g FROM (SELECT r, doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, wd WHERE len(ws) >= w)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
m AS (SELECT r, any_value(doc_id) AS doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (w, g) GROUP BY r, item_id)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, n_shared::BIGINT AS n_shared, n_shared::DOUBLE / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_shared * 10 >= n_shingles * 8
"""

"""SimHash fingerprints, linked by covering locality-sensitive hashing.

A fingerprint has 64 bits. Give each bit a nonzero vector of r + 1 bits; each of the 2^(r+1) - 1 nonzero vectors v
then names a mask of the bits whose vectors have an odd product with v. The vectors of any r differing bits span
less than the whole space, so some v is orthogonal to all of them: two fingerprints within the radius agree on that
whole mask. Every pair within the radius therefore meets in a table; none is lost.

A bucket with more than ``MOST`` different fingerprints is not compared as it is: the same construction over the bits
outside its mask splits it again, up to three levels, after which fewer free bits are left than make ``MOST`` values.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share a fingerprint and so a
component. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import cut, documents, id_and_text
from veilframe.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Different fingerprints that are compared with each other inside one bucket.
MOST = 256
LEVELS = 3
#: One row in so many makes a fingerprint hot.
HOT_SHARE = 10_000
#: Parts into which the rows of one bucket are dealt while its size is looked up.
SALTS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() touches A-Z alone
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([_signed(fingerprint(t, shingle)) for t in batch["text"]], dtype="int64")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps})

    return id_and_text(docs).mapInPandas(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, levels: int = LEVELS) -> list[list[int]]:
    """Masks by level. A mask of level k at place p extends the mask at place p // (2^(r+1) - 1) of the level before."""
    vectors = range(1, 1 << (radius + 1))
    out, before = [], [0]
    for _ in range(levels):
        now = []
        for used in before:
            free = [i for i in range(64) if not used >> i & 1]
            for v in vectors:
                extra = sum(1 << bit for rank, bit in enumerate(free) if bin(v & (rank % len(vectors) + 1)).count("1") % 2)
                now.append(used | extra)
        out.append(now)
        before = now
    return out


def _tables(rows: DataFrame, masks: list[int], fan: int) -> DataFrame:
    """A row for each fingerprint and each mask that extends the bucket it is in: (fp, path, key)."""
    names = F.lit([_signed(m) for m in masks])
    spread = rows.select("fp", F.explode(F.sequence(F.col("path") * fan, F.col("path") * fan + fan - 1)).alias("path"))
    return spread.select("fp", "path", F.col("fp").bitwiseAND(F.get(names, F.col("path").cast("int"))).alias("key"))


def _within(radius: int):
    """A function for mapInPandas: links the fingerprints of each bucket to the least of their group in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [np.empty(0, "int64")], [np.empty(0, "int64")]
            for fps in batch["fps"]:
                x = np.sort(np.asarray(fps, dtype="int64"))
                u = x.view("uint64")
                near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
                root = np.arange(len(x))
                while True:  # the least place reachable, one step a round
                    step = np.where(near, root[None, :], len(x)).min(axis=1)
                    step = step[step]
                    if (step == root).all():
                        break
                    root = step
                linked = root != np.arange(len(x))
                a.append(x[linked])
                b.append(x[root[linked]])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Links (a, b) that join exactly those of the different fingerprints ``fp`` that chains within the radius join."""
    spark, fan = distinct.sparkSession, (1 << (radius + 1)) - 1
    by_level = covering_masks(radius)
    rows, found = distinct.select("fp", F.lit(0).cast("bigint").alias("path")), None
    for level, masks in enumerate(by_level):
        table = _tables(rows, masks, fan)
        sizes = table.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        salted = sizes.withColumn("salt", F.explode(F.lit(list(range(SALTS)))))
        # Spark sizes either side as before its explode, a 15th or 16th of it, and would broadcast more than the driver holds.
        met = table.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["path", "key", "salt"])
        last = level == len(by_level) - 1
        small = met if last else met.where(F.col("n") <= most)
        groups = small.groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        pairs = groups.mapInPandas(_within(radius), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        rows = cut(met.where(F.col("n") > most).select("fp", "path"))
        if rows.isEmpty():
            break
    return found if found is not None else spark.createDataFrame([], "a long, b long")


def cluster(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds component_id, the smallest doc_id reachable over links, to rows of (doc_id, fp).

    A fingerprint of more than one row in HOT_SHARE has its component sent to the rows, of which there are at most HOT_SHARE; the rows of
    the others are joined by fingerprint, where none is hot.
    """
    same = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(links(same, radius))
    placed = same.join(roots, same.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(placed.join(least, "root").select("fp", "component_id", "n"))
    bound = (named.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot = F.broadcast(named.where(F.col("n") > bound).select("fp", "component_id"))
    cold = named.where(F.col("n") <= bound).select("fp", "component_id")
    return prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id; of rows that repeat id and text, any one.

    Components are looked up by fingerprint, so a hot group of copies is dealt by its ids. A row without an id stays if
    no row of its component has one.
    """
    keys = cut(fingerprints(docs).distinct())
    placed = cluster(keys)
    taken = {c.lower() for c in docs.columns}
    id_, none = (next(n for n in (name + "_" * i for i in range(len(taken) + 1)) if n not in taken) for name in ("__kept", "__none"))
    doc_id = F.col("doc_id").cast("long")
    by = [F.coalesce(doc_id, F.lit(0)).alias(id_), doc_id.isNull().alias(none)]
    chosen = placed.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*by).distinct()
    # Texts move once: rows that lie by id, whatever their texts, need no second deal to meet their repeats.
    kept = docs.select("*", *by).join(chosen, [id_, none], "left_semi")
    return kept.dropDuplicates([id_, none, "doc_id", "text"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def hex_of(fp: Column) -> Column:
    """Sixteen lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    prints = cut(fingerprints(documents(spark, sf_dir)))
    return cluster(prints).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")

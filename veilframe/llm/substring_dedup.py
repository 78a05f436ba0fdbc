"""Exact repeats of word passages, found by fixed-block anchors.

Words are runs of anything but the six ASCII white-space characters, unchanged. Every document is cut into
non-overlapping reference blocks of BLOCK words; with 2 * BLOCK - 1 = WINDOW, each window holds a whole block of the
document it stands in. An index of these blocks is probed with every rolling window of BLOCK words of every document.
A window without a hit in another document has no equal elsewhere. The hits are extended, word by word, to all windows
that touch one, and those are compared whole, by 96 bits of hash, over all documents.

A word is removed if a window over it also starts in a document with a smaller id. Null and empty texts have no words.
Rows that repeat an id are the same document in this sense: they do not remove each other's words. A null id counts as
larger than any other. Empty tables give no rows; other columns are ignored. Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents
from veilframe.llm.exchange import answered, by_bucket, grouped_documents, mixed, ordered, rolling, shared_keys, short

WINDOW = 13
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
KEPT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,past:long>>"


class _Group:
    """The words of one group of documents in one sequence, and the keys of its blocks and windows."""

    def __init__(self, rows: pd.DataFrame, window: int, buckets: int) -> None:
        self.ids, raw, self.null, _ = ordered(rows)
        self.words = [t.split() for t in raw]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.window, self.block = window, (window + 1) // 2
        digest = xxhash.xxh3_64_intdigest
        self.hashes = np.fromiter((digest(w) for ws in self.words for w in ws), dtype=np.uint64, count=int(self.starts[-1]))
        self.doc = np.repeat(np.arange(len(self.words)), self.sizes)
        keys = mixed(rolling(self.hashes, self.block, BASE))
        left = self.starts[self.doc + 1] - np.arange(len(self.doc))  # words from here to the document's end
        self.at = np.flatnonzero(left >= self.block)
        #: Shorter documents have no window and take part in nothing.
        self.at = self.at[self.sizes[self.doc[self.at]] >= window]
        self.keys, self.place = np.unique(keys[self.at], return_inverse=True)
        aligned = (self.at - self.starts[self.doc[self.at]]) % self.block == 0
        owner = self.ids[self.doc[self.at]]
        self.least = np.full(len(self.keys), np.iinfo(np.int64).max)
        self.most = np.full(len(self.keys), -1 << 63)
        np.minimum.at(self.least, self.place[aligned], owner[aligned])
        np.maximum.at(self.most, self.place[aligned], owner[aligned])
        self.order, self.cuts = by_bucket(self.keys, buckets)
        self.indexed = self.least <= self.most
        self.left = left

    def candidates(self, answers: pd.DataFrame) -> np.ndarray:
        """Starts of the windows that hold a block of another document."""
        hit = np.empty(len(self.keys), dtype=bool)
        hit[self.order] = answered(answers, self.cuts)
        owner = self.ids[self.doc[self.at]]
        own = self.indexed[self.place] & ((self.least[self.place] != owner) | (self.most[self.place] != owner))
        marked = np.zeros(len(self.doc) + 1, dtype=np.int64)
        marked[self.at[hit[self.place] | own] + 1] = 1
        marked = np.cumsum(marked)
        starts = np.flatnonzero(self.left >= self.window)
        return starts[marked[starts + self.window - self.block + 1] > marked[starts]]

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different windows at these starts as two hashes, and which one each start has."""
        if not len(starts):
            return np.empty(0, np.uint64), np.empty(0, "<u4"), np.empty(0, np.int64)
        a = mixed(rolling(self.hashes, self.window, BASE))[starts]
        b = short(mixed(rolling(self.hashes, self.window, BASE2)[starts]))
        order = np.lexsort((b, a))
        new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
        which = np.empty(len(a), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        return a[order][new], b[order][new], which


def _first_holders(sent: DataFrame) -> DataFrame:
    """For rows (bucket, pid, a, b, least, most) of packed windows: (pid, bucket, bits, firsts), the smallest id that holds each window, where it is below the group's largest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = np.concatenate([np.frombuffer(x, "<u8") for x in rows["a"]])
        b = np.concatenate([np.frombuffer(x, "<u4") for x in rows["b"]])
        least = np.concatenate([np.frombuffer(x, "<i8") for x in rows["least"]])
        order = np.lexsort((b, a))
        new = np.flatnonzero(np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))))
        first = np.empty(len(a), dtype=np.int64)
        first[order] = np.repeat(np.minimum.reduceat(least[order], new), np.diff(np.append(new, len(a))))
        out, at = [], 0
        for pid, most in zip(rows["pid"], rows["most"]):
            most = np.frombuffer(most, "<i8")
            mine = first[at : at + len(most)]
            at += len(most)
            below = mine < most
            if below.any():
                out.append((pid, rows["bucket"].iat[0], np.packbits(below).tobytes(), mine[below].tobytes()))
        return pd.DataFrame(out, columns=["pid", "bucket", "bits", "firsts"])

    return sent.groupBy("bucket").applyInPandas(run, "pid int, bucket int, bits binary, firsts binary")


def _keep(group: _Group, removed: np.ndarray) -> pd.DataFrame:
    """A row for each document of the group: its kept words, and the removed runs as word numbers."""
    out, total = [], np.concatenate(([0], np.cumsum(removed)))
    for d, words in enumerate(group.words):
        a, b = group.starts[d], group.starts[d + 1]
        n, spans = int(total[b] - total[a]), []
        if n:
            gone = removed[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
            spans = [{"first": int(x), "past": int(y)} for x, y in zip(edges[::2], edges[1::2])]
            words = [w for w, g in zip(words, gone) if not g]
        out.append((None if group.null[d] else int(group.ids[d]), int(b - a), n, b" ".join(words).decode("utf-8", "surrogatepass"), spans))
    frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "spans"])
    return frame.astype({"doc_id": "Int64"})


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: n_words, n_removed, the kept words joined by a space, and the removed runs of words."""
    grouped, _, buckets = grouped_documents(docs)

    def send_blocks(rows: pd.DataFrame) -> pd.DataFrame:
        group, out = _Group(rows, window, buckets), []
        if len(group.keys):
            keys, held = short(group.keys[group.order]), group.indexed[group.order]
            for k in np.flatnonzero(np.diff(group.cuts)):
                part = slice(group.cuts[k], group.cuts[k + 1])
                out.append((k, rows["pid"].iat[0], keys[part][held[part]].tobytes(), keys[part].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "pid", "index", "probe"])

    def send_windows(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            group = _Group(rows, window, buckets)
            starts = group.candidates(answers)
            a, b, which = group.windows(starts)
            if len(a):
                owner = group.ids[group.doc[starts]]
                least, most = np.full(len(a), np.iinfo(np.int64).max), np.full(len(a), -1 << 63)
                np.minimum.at(least, which, owner)
                np.maximum.at(most, which, owner)
                order, cuts = by_bucket(a, buckets)
                for k in np.flatnonzero(np.diff(cuts)):
                    part = order[cuts[k] : cuts[k + 1]]
                    out.append((k, rows["pid"].iat[0], a[part].tobytes(), b[part].tobytes(), least[part].tobytes(), most[part].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "pid", "a", "b", "least", "most"])

    def remove(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "kept", "spans"])
        group = _Group(rows, window, buckets)
        blocks = answers["firsts"].isna()
        starts = group.candidates(answers[blocks])
        a, _, which = group.windows(starts)
        removed = np.zeros(len(group.doc), dtype=np.int8)
        if len(a):
            order, cuts = by_bucket(a, buckets)
            first = np.full(len(a), np.iinfo(np.int64).max)
            for bucket, bits, firsts in answers.loc[~blocks, ["bucket", "bits", "firsts"]].itertuples(index=False):
                part = order[cuts[bucket] : cuts[bucket + 1]]
                first[part[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part)).astype(bool)]] = np.frombuffer(firsts, "<i8")
            seen = starts[first[which] < group.ids[group.doc[starts]]]
            edge = np.zeros(len(group.doc) + 1, dtype=np.int64)
            np.add.at(edge, seen, 1)
            np.add.at(edge, seen + window, -1)
            removed = (np.cumsum(edge[:-1]) > 0).astype(np.int8)
        return _keep(group, removed)

    by_pid = grouped.groupBy("pid")
    hits = shared_keys(by_pid.applyInPandas(send_blocks, "bucket int, pid int, index binary, probe binary"))
    sent = by_pid.cogroup(hits.groupBy("pid")).applyInPandas(send_windows, "bucket int, pid int, a binary, b binary, least binary, most binary")
    firsts = _first_holders(sent)
    both = hits.withColumn("firsts", F.lit(None).cast("binary")).unionByName(firsts)
    return by_pid.cogroup(both.groupBy("pid")).applyInPandas(remove, KEPT)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and removed words, and the digest of what is kept."""
    return deduplicate(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM s) WHERE m < doc_id),
r AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM f, (SELECT unnest(range(0, 13)) AS k) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE
              array_to_string([ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(gone, i)], ' ') END) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""

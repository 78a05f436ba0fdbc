"""Packed rounds between document groups and key buckets.

Operators that compare windows of all documents deal documents into groups by id and window keys into buckets.
A group sends each bucket one row that packs its different keys; a bucket answers each group with one row. As a
key that a third of all documents share is sent once per group, no bucket grows with the copies of a passage.
The number of groups and buckets follows spark.sql.shuffle.partitions, which is set for the data's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilframe.llm.common import bucket_count

#: Stands for a null id: larger than any other, so a document without an id is never the first to hold a passage.
NO_ID = (1 << 63) - 1
#: Bytes of rows that a task packs at once.
PACK = 32 << 20


def grouped_documents(docs: DataFrame, carry: list[tuple[str, Column]] | None = None) -> tuple[DataFrame, int, int]:
    """(doc_id, text, pid) of every row with the named expressions to carry along, and the numbers of groups and of buckets."""
    spark = docs.sparkSession
    groups, buckets = bucket_count(spark, least=128, times=2), bucket_count(spark, least=96, times=1)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    pid = F.pmod(F.xxhash64(doc_id, F.lit("group")), F.lit(groups)).cast("int")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), pid.alias("pid"), *(value.alias(name) for name, value in carry or [])), groups, buckets


def packed_groups(grouped: DataFrame) -> DataFrame:
    """(pid, rows) of the rows of :func:`grouped_documents`: those that a task has of a group travel together, compressed, and are sorted and spilled so."""
    schema = _inside(grouped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACK:
                yield from made(held)
                held, size = [], 0
        yield from made(held)

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for whole in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
            pids = whole.column("pid").to_numpy()
            order = np.argsort(pids, kind="stable")
            rows = pa.RecordBatch.from_arrays([whole.column(f.name).take(pa.array(order)).cast(f.type) for f in schema], schema=schema)
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(pids[order]) != 0, [True]))).tolist() if len(pids) else []
            for a, b in zip(cuts, cuts[1:]):
                yield pa.RecordBatch.from_pydict({"pid": pa.array([pids[order[a]]], pa.int32()), "rows": pa.array([packer.compress(rows.slice(a, b - a).serialize())], pa.binary())})

    return grouped.mapInArrow(run, "pid int, rows binary")


def _inside(grouped: DataFrame) -> pa.Schema:
    return to_arrow_schema(T.StructType([f for f in grouped.schema.fields if f.name != "pid"]))


def opener(grouped: DataFrame) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function that gives the rows of a group of :func:`packed_groups`."""
    schema = _inside(grouped)

    def rows_of(packed: pd.DataFrame) -> pd.DataFrame:
        unpacker = zstandard.ZstdDecompressor()
        table = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(unpacker.decompress(x)), schema) for x in packed["rows"]], schema=schema)
        return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return rows_of


def ordered(group: pd.DataFrame) -> tuple[np.ndarray, list[bytes], np.ndarray, list[int]]:
    """Ids (null: NO_ID), texts as bytes and which ids were null, in an order that does not depend on how rows arrived; that order."""
    raw = [t.encode("utf-8", "surrogatepass") for t in group["text"]]
    null = group["doc_id"].isna().to_numpy()
    ids = group["doc_id"].fillna(NO_ID).astype("int64").to_numpy() if null.any() else group["doc_id"].to_numpy(dtype="int64")
    ids = np.where(null, NO_ID, ids)
    order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
    return ids[order], [raw[i] for i in order], null[order], order


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit hashes over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total, done, block, size = None, 0, x, 1
    # Doubling: a window of 2s is two windows of s; ``width`` is put together from its binary digits.
    while True:
        if width & size:
            piece = block[done : done + n]
            total = piece.copy() if total is None else total * np.uint64(pow(base, size, 1 << 64)) + piece
            done += size
        if size * 2 > width:
            return total
        block = block[:-size] * np.uint64(pow(base, size, 1 << 64)) + block[size:]
        size *= 2


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys into buckets, stably, and where each bucket begins."""
    at = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(buckets + 1))


def short(keys: np.ndarray) -> np.ndarray:
    """Four bytes of a key that its bucket does not settle: enough where a chance meeting only costs a later look."""
    return (keys >> np.uint64(32)).astype("<u4")


def _plain(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4")


def shared_keys(sent: DataFrame, read: Callable[[bytes], np.ndarray] = _plain) -> DataFrame:
    """For rows (bucket, pid, index, probe) of packed four-byte keys: (pid, bucket, bits), a bit for each probe that the index of another group holds.

    Without a column ``probe`` the index is what is probed. ``read`` unpacks keys.
    """
    alike = "probe" not in sent.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = [read(x) for x in rows["index"]]
        pids = rows["pid"].to_numpy()
        keys = np.concatenate(held)
        owner = np.repeat(pids, [len(x) for x in held])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        if not len(keys):
            return pd.DataFrame({"pid": [], "bucket": [], "bits": []})
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        least, most, keys = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first), keys[first]
        out = []
        for pid, probe in zip(pids, held if alike else map(read, rows["probe"])):
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            hit = (keys[at] == probe) & ((least[at] != pid) | (most[at] != pid))
            if hit.any():
                out.append((pid, rows["bucket"].iat[0], np.packbits(hit).tobytes()))
        return pd.DataFrame(out, columns=["pid", "bucket", "bits"])

    return sent.groupBy("bucket").applyInPandas(run, "pid int, bucket int, bits binary")


def answered(rows: pd.DataFrame, starts: np.ndarray) -> np.ndarray:
    """The answers of :func:`shared_keys` in the order of :func:`by_bucket`, as booleans."""
    hit = np.zeros(starts[-1], dtype=bool)
    for bucket, bits in zip(rows["bucket"], rows["bits"]):
        a, b = starts[bucket], starts[bucket + 1]
        hit[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
    return hit

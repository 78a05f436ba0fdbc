"""Phrases of several words that occur together more often than their parts would, by direct-address tiling.

Texts become chunks: streams of word numbers, with a gap wherever a piece ends or a word is rare. Words get ids by
their frequency, so that frequent pairs meet in few square tiles of ``SIDE`` ids a side. A chunk counts its pairs of
neighbours tile by tile: dense tiles by numpy's bincount over direct addresses, the others as sorted coordinates with
counts. Pairs that are frequent enough over all chunks are ranked anew and become the ids of the next round, where two
overlapping phrases of k words are one of k + 1. A phrase can only be frequent if both are, so nothing is lost.

Counts are added up over the chunks as through a tree (:func:`_totals`): a node adds up the packed counts of ``FAN``
nodes below and cuts its sum into ``FAN`` finer parts by a hash of the tile, so a group's size depends neither on the
number of chunks nor on how frequent a phrase is. The ids of frequent pairs go down the same tree, each node told of
the pairs that it has sent. A chunk sends its different words to buckets, packed; a bucket counts them all at once and
keeps the frequent ones, which get their ids by Spark's own sort and joins.

Only A to Z are lower-cased. A null text is empty; a null lang counts as ``und``. Repeated rows count each time. Other
columns take no part. Empty tables, and those without frequent words, give no rows. Phrases never cross documents. A
chunk closes at ``CHUNK`` bytes; one longer text makes one longer chunk. Ids must stay below 2^32 (checked).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilframe.llm.common import bucket_count, documents, scratch
from veilframe.llm.ordinals import placed

LEAST, LONGEST, TOP = 100, 5, 2000
#: Ids a side of a tile; head tiles that may be dense; cells for each occurrence up to which a tile is counted densely.
SIDE_BITS, HEAD, SPARE = 8, 16, 16
CHUNK, FAN = 16 << 20, 1024
#: Chunks that a row of a frequent word names, about.
PLACES = 1024
#: Ends of pieces become a byte that UTF-8 never has; tabs become spaces.
_GAP = b"\xff"
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
SENT = "lang string, bucket long, node long, code binary, n binary"
STATE = "chunk long, lang string, at binary, ids binary"
#: A chunk's stream (bucket -1) or those of its words that a bucket counts, with their numbers in the chunk and how often each occurs.
CHUNKS = "chunk long, lang string, bucket int, size int, total long, stream binary, local binary, own binary, lengths binary, words binary"
OFTEN = "lang string, word binary, rare long, part long, chunks array<struct<chunk:long,local:int>>"


@cache
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)  # one a worker: to make one takes longer than most rows


@cache
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    values = np.ascontiguousarray(values, dtype="<u8")
    return _packer().compress(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    """What :func:`pack` packed."""
    planes = np.frombuffer(_unpacker().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending whole numbers, by their differences."""
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def _binaries(data: np.ndarray | bytes, ends: np.ndarray) -> pa.Array:
    """Strings that lie one behind the other; ``ends`` begins with 0."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words of texts as numbers of different words, from 1; 0 stands where a piece ends, and before each text. The different words, after the gap."""
    data = np.frombuffer(_GAP.join([b"", *texts]).lower().translate(_TABLE), dtype=np.uint8)
    kept, gap = data != 0x20, data == 0xFF
    begins = kept & (gap | np.concatenate(([True], ~kept[:-1] | gap[:-1])))
    data = data[kept]
    words = _binaries(data, np.append(np.flatnonzero(begins[kept]), len(data))).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary


def _chunk_rows(chunk: int, lang: str, texts: list[bytes], buckets: int) -> list[tuple]:
    """Rows of CHUNKS."""
    stream, words = _numbered(texts)
    counts, words = np.bincount(stream, minlength=len(words))[1:], words[1:]
    out = [(chunk, lang, -1, len(words), int(counts.sum()), pack(stream), None, None, None, None)]
    bucket = np.fromiter(map(crc32, words.to_pylist()), dtype=np.int64, count=len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    words = pa.concat_arrays([words.take(pa.array(order))])
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data, cuts = words.buffers()[2], np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(order) else []
    for a, b in zip(cuts, cuts[1:]):
        mine = order[a:b]
        out.append((chunk, lang, int(bucket[mine[0]]), None, None, None, pack_sorted(mine), pack(counts[mine]), pack(np.diff(ends[a : b + 1])), _packer().compress(data[ends[a] : ends[b]].to_pybytes())))
    return out


def chunks(docs: DataFrame, buckets: int, size: int = CHUNK) -> DataFrame:
    """CHUNKS rows: every word of every text, as numbers of the chunk's words, and these by bucket; 0 where a piece ends."""
    schema = _arrow(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, total = TaskContext.get().partitionId(), 0, {}, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text)
                total[lang] = total.get(lang, 0) + len(text)
                if sum(total.values()) >= size if len(held) < 64 else total[lang] >= size // 64:
                    yield from closed(part, made, held)
                    made, held, total = made + len(held), {}, {}
        yield from closed(part, made, held)

    def closed(part: int, made: int, held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for k, (lang, texts) in enumerate(held.items()):
            rows = _chunk_rows((part << 32) + made + k, lang, texts, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, CHUNKS)


def _written(rows: DataFrame, name: str) -> DataFrame:
    at = scratch(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.parquet(at)


def codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of ids as tile (high bits) and address in the tile (low 16 bits)."""
    low, a, b = np.uint64((1 << SIDE_BITS) - 1), a.astype(np.uint64), b.astype(np.uint64)
    side = np.uint64(SIDE_BITS)
    return ((a >> side) << np.uint64(40)) | ((b >> side) << np.uint64(16)) | ((a & low) << side) | (b & low)


def pair_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a code."""
    low = np.uint64((1 << SIDE_BITS) - 1)
    a = ((code >> np.uint64(40)) << np.uint64(SIDE_BITS)) | ((code >> np.uint64(SIDE_BITS)) & low)
    b = (((code >> np.uint64(16)) & np.uint64((1 << 24) - 1)) << np.uint64(SIDE_BITS)) | (code & low)
    return a, b


def counted(code: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes, ascending, and their counts (or summed weights): dense tiles by direct address, the others sorted."""
    cells = 1 << (2 * SIDE_BITS)
    tile_a, tile_b = (code >> np.uint64(40)).astype(np.int64), ((code >> np.uint64(16)) & np.uint64((1 << 24) - 1)).astype(np.int64)
    head = (tile_a < HEAD) & (tile_b < HEAD)
    index = tile_a[head] * HEAD + tile_b[head]
    dense = np.bincount(index, minlength=HEAD * HEAD) * SPARE >= cells
    found, sums = [], []
    if dense.any():
        in_dense = np.flatnonzero(head)[dense[index]]
        tile = (tile_a * HEAD + tile_b)[in_dense]
        rank = np.cumsum(dense) - 1
        for first in range(0, int(dense.sum()), 32):  # 32 tiles are 16 MB of counts
            mine = (rank[tile] >= first) & (rank[tile] < first + 32)
            chosen = in_dense[mine]
            at = (rank[tile[mine]] - first) * cells + (code[chosen] & np.uint64(cells - 1)).astype(np.int64)
            if weight is None:
                n = np.bincount(at)
            else:
                n = np.zeros(min(32, int(dense.sum()) - first) * cells, dtype=np.int64)
                np.add.at(n, at, weight[chosen])
            hit = np.flatnonzero(n)
            tiles = np.flatnonzero(dense)[first + hit // cells]
            found.append((tiles // HEAD).astype(np.uint64) << np.uint64(40) | (tiles % HEAD).astype(np.uint64) << np.uint64(16) | (hit % cells).astype(np.uint64))
            sums.append(n[hit].astype(np.int64))
        rest = np.ones(len(code), dtype=bool)
        rest[in_dense] = False
        code, weight = code[rest], weight if weight is None else weight[rest]
    if len(code):
        order = np.argsort(code, kind="stable") if weight is not None else None
        code = np.sort(code) if order is None else code[order]
        new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        found.append(code[new])
        sums.append(np.diff(np.append(new, len(code))) if order is None else np.add.reduceat(weight[order], new))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code, n = np.concatenate(found), np.concatenate(sums)
    order = np.argsort(code, kind="stable") if len(found) > 1 else slice(None)
    return code[order], n[order]


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each code, one for all of a tile; ``buckets`` times a number gives finer ones."""
    h = (code >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _parts(lang: str, node: int, code: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of SENT, one a bucket that has codes."""
    bucket = _bucket(code, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(code) else np.zeros(1, int)
    return [(lang, int(bucket[order[i]]), node, pack_sorted(code[order[i:j]]), pack(n[order[i:j]])) for i, j in zip(cuts, cuts[1:])]


def _above(nodes: int) -> Column:
    """The node, of ``nodes`` on the next level, that adds up this one's counts."""
    return F.pmod(F.xxhash64("node"), F.lit(nodes))


def _totals(sent: DataFrame, nodes: int, buckets: int, fan: int) -> list[tuple[DataFrame, int, int]]:
    """(rows, nodes, buckets) of each level of the tree; the last has one node, whose counts are those of all chunks."""
    levels = [(sent, nodes, buckets)]
    while nodes > 1:
        nodes, finer = -(-nodes // fan), buckets * min(fan, nodes) if nodes > fan else buckets

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            code, n = counted(np.concatenate([unpack_sorted(x) for x in rows["code"]]), np.concatenate([unpack(x).astype(np.int64) for x in rows["n"]]))
            return pd.DataFrame(_parts(rows["lang"].iat[0], int(rows["up"].iat[0]), code, n, finer), columns=["lang", "bucket", "node", "code", "n"])

        up = levels[-1][0].withColumn("up", _above(nodes))
        buckets = finer
        levels.append((_written(up.groupBy("lang", "bucket", "up").applyInPandas(merge, SENT), "collocations"), nodes, buckets))
    return levels


def _told(levels: list[tuple[DataFrame, int, int]], frequent: DataFrame) -> DataFrame:
    """(lang, bucket, node, code, ids) for the nodes of the first level, from ``frequent`` (lang, bucket, code, id) of the last."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(code := rows["code"].to_numpy().view(np.uint64))
        return pd.DataFrame([(rows["lang"].iat[0], int(rows["bucket"].iat[0]), 0, pack_sorted(code[order]), pack(rows["id"].to_numpy()[order]))], columns=["lang", "bucket", "node", "code", "n"])

    def tell(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(answers):
            code, ids = np.concatenate([unpack_sorted(x) for x in answers["code"]]), np.concatenate([unpack(x) for x in answers["n"]])
            order = np.argsort(code)
            code, ids = code[order], ids[order]
            for lang, bucket, node, own in rows[["lang", "bucket", "node", "code"]].itertuples(index=False):
                _, hit = looked_up(unpack_sorted(own), code)  # few are frequent, so these are sought among the node's own
                if hit.any():
                    out.append((lang, int(bucket), int(node), pack_sorted(code[hit]), pack(ids[hit])))
        return pd.DataFrame(out, columns=["lang", "bucket", "node", "code", "n"])

    answers = frequent.groupBy("lang", "bucket").applyInPandas(packed, SENT)
    for (rows, _, buckets), (_, above, _) in reversed(list(zip(levels, levels[1:]))):
        asked = rows.withColumn("up", _above(above)).groupBy("lang", "bucket", "up")
        known = answers.select("lang", F.pmod("bucket", F.lit(buckets)).alias("coarse"), F.col("node").alias("up"), "code", "n").groupBy("lang", "coarse", "up")
        answers = asked.cogroup(known).applyInPandas(tell, SENT)
    return answers


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key would stand in ascending keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _often(made: DataFrame, least: int, nodes: int) -> DataFrame:
    """OFTEN rows: every word that occurs ``least`` times in all chunks, minus how often, and its number in each chunk that has it.

    A row of about ``PLACES`` chunks, so a word of all chunks is more than one row and no row grows with the corpus. A bucket gets one row from each
    chunk that has words of it.
    """
    schema, parts = _arrow(OFTEN), max(1, -(-nodes // PLACES))

    def run(rows: pa.Table) -> pa.Table:
        out, langs = [schema.empty_table()], np.array(rows["lang"].to_pylist(), dtype=object)
        for lang in dict.fromkeys(langs):
            mine = rows.filter(pa.array(langs == lang)).combine_chunks()
            own, local, lengths = ([read(x) for x in mine[c].to_pylist()] for c, read in (("own", unpack), ("local", unpack_sorted), ("lengths", unpack)))
            words = _binaries(b"".join(_unpacker().decompress(x) for x in mine["words"].to_pylist()), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))).dictionary_encode()
            chunk, code, n = np.repeat(mine["chunk"].to_numpy(), [len(x) for x in own]), words.indices.to_numpy(), np.zeros(len(words.dictionary), dtype=np.int64)
            np.add.at(n, code, np.concatenate(own).astype(np.int64))
            often = (n >= least)[code]
            chunk, code, local = chunk[often], code[often], np.concatenate(local)[often]
            part = ((chunk.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
            order = np.lexsort((chunk, part, code))
            chunk, code, local, part = chunk[order], code[order], local[order], part[order]
            first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])))) if len(code) else np.empty(0, np.int64)
            places = pa.StructArray.from_arrays([pa.array(chunk, pa.int64()), pa.array(local.astype(np.int32), pa.int32())], fields=list(schema.field("chunks").type.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), places)
            columns = [pa.array([lang] * len(first), pa.string()), words.dictionary.take(pa.array(code[first])).cast(pa.binary()), pa.array(-n[code[first]]), pa.array(part[first]), lists.cast(schema.field("chunks").type)]
            out.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(out)

    return _written(made.where("bucket >= 0").select("bucket", "chunk", "lang", "local", "own", "lengths", "words").groupBy("bucket").applyInArrow(run, OFTEN), "words")


def _word_states(made: DataFrame, often: DataFrame, ranked: DataFrame, buckets: int) -> DataFrame:
    """STATE rows: where the frequent words of each chunk stand, and their ids.

    Words meet their ids once, and not once a chunk; a bucket of words then tells each of its chunks all ids at once, packed.
    """

    def turned(rows: pd.DataFrame) -> pd.DataFrame:
        chunk, local = np.concatenate(rows["chunk"].to_list()), np.concatenate(rows["local"].to_list())
        order, id_ = np.argsort(chunk, kind="stable"), np.repeat(rows["id"].to_numpy(), rows["chunk"].str.len())
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(chunk[order]) != 0, [True])))
        return pd.DataFrame([(int(chunk[order[i]]), pack(local[order[i:j]]), pack(id_[order[i:j]])) for i, j in zip(cuts, cuts[1:])], columns=["chunk", "local", "id"])

    known = often.join(ranked.select("lang", "word", "id"), ["lang", "word"]).select("id", F.col("chunks.chunk").alias("chunk"), F.col("chunks.local").alias("local"), "part", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)).alias("bucket"))
    told = known.groupBy("bucket", "part").applyInPandas(turned, "chunk long, local binary, id binary")
    ids = told.groupBy("chunk").agg(F.collect_list(F.struct("local", "id")).alias("t")).select("chunk", "t.local", "t.id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for chunk, lang, words, stream, local, id_ in rows[["chunk", "lang", "words", "stream", "local", "id"]].itertuples(index=False):
                to = np.full(words + 1, -1, dtype=np.int64)
                to[np.concatenate([unpack(x) for x in local]).astype(np.int64) + 1] = np.concatenate([unpack(x) for x in id_]).astype(np.int64)
                ids = to[unpack(stream).astype(np.int64)]
                at = np.flatnonzero(ids >= 0)
                out.append((chunk, lang, pack_sorted(at), pack(ids[at])))
            yield pd.DataFrame(out, columns=["chunk", "lang", "at", "ids"])

    both = made.select("chunk", "lang", F.col("size").alias("words"), "stream").join(ids, "chunk")
    return both.mapInPandas(run, STATE)


def _neighbours(at: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where two neighbours begin, and their code."""
    at, ids = unpack_sorted(at), unpack(ids)
    first = np.flatnonzero(at[1:] == at[:-1] + np.uint64(1)) if len(at) > 1 else np.empty(0, int)
    return at[first], codes(ids[first], ids[first + 1])


def _sent(states: DataFrame, buckets: int) -> DataFrame:
    """SENT rows: the pairs of each chunk with their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for chunk, lang, at, ids in rows[["chunk", "lang", "at", "ids"]].itertuples(index=False):
                out = _parts(lang, int(chunk), *counted(_neighbours(at, ids)[1]), buckets)
                yield pd.DataFrame(out, columns=["lang", "bucket", "node", "code", "n"])

    return states.mapInPandas(run, SENT)


def _next_states(states: DataFrame, answers: DataFrame) -> DataFrame:
    """STATE rows of the longer phrases."""

    def run(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(told):
            code, ids = np.concatenate([unpack_sorted(x) for x in told["code"]]), np.concatenate([unpack(x) for x in told["n"]])
            order = np.argsort(code)
            for chunk, lang, at, own in rows[["chunk", "lang", "at", "ids"]].itertuples(index=False):
                begins, pairs = _neighbours(at, own)
                place, hit = looked_up(code[order], pairs)
                out.append((chunk, lang, pack_sorted(begins[hit]), pack(ids[order][place[hit]])))
        return pd.DataFrame(out, columns=["chunk", "lang", "at", "ids"])

    return states.groupBy("chunk").cogroup(answers.groupBy("node")).applyInPandas(run, STATE)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of every phrase of 1 to ``longest`` words that occurs ``least`` times, and (lang, n) of all words."""
    buckets = bucket_count(docs.sparkSession, least=8, times=1)
    packed = _written(chunks(docs, bucket_count(docs.sparkSession, least=256, times=1) // 4, size), "chunks")
    made = packed.where("bucket < 0")
    nodes = made.count()
    totals = made.groupBy("lang").agg(F.sum("total").alias("n"))
    often = _often(packed, least, nodes)
    words = placed(often.select("lang", "word", "rare").distinct(), "lang", ["rare", "word"]).select("lang", "word", F.col("place").alias("id"), (-F.col("rare")).alias("n"))
    text = F.col("word").cast("string")
    known = [words.select("lang", "id", text.alias("phrase"), text.alias("last"), F.lit(1).alias("words"), "n")]
    states = _written(_word_states(made, often, words, buckets), "word-states")
    for k in range(2, longest + 1):
        if (known[-1].agg(F.max("id")).first()[0] or 0) >= 1 << 32:
            raise ValueError("more than 2^32 frequent phrases of a language")
        levels = _totals(_written(_sent(states, buckets), "pairs"), nodes, buckets, fan)

        def enough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for lang, bucket, code, n in rows[["lang", "bucket", "code", "n"]].itertuples(index=False):
                    code, n = unpack_sorted(code), unpack(n).astype(np.int64)
                    a, b = pair_of(code := code[n >= least])
                    yield pd.DataFrame({"lang": lang, "bucket": bucket, "code": code.view(np.int64), "a": a.astype(np.int64), "b": b.astype(np.int64), "n": n[n >= least]})

        pairs = levels[-1][0].mapInPandas(enough, "lang string, bucket long, code long, a long, b long, n long")
        ranked = placed(pairs.withColumn("rare", -F.col("n")), "lang", ["rare", "code"]).withColumn("id", F.col("place"))
        first, second = known[-1].select("lang", F.col("id").alias("a"), "phrase"), known[-1].select("lang", F.col("id").alias("b"), "last")
        longer = ranked.join(first, ["lang", "a"]).join(second, ["lang", "b"])
        known.append(_written(longer.select("lang", "id", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.lit(k).alias("words"), "n"), "phrases"))
        if k < longest:
            states = _written(_next_states(states, _told(levels, ranked)), "states")
    return reduce(DataFrame.unionByName, [x.select("lang", "phrase", "words", "n") for x in known]), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a (its count), l and r (those of its parts at the weakest cut), n (all words) and score.

    The score, floor(1000 * a * n / (l * r)), is exact: products are decimals of 38 digits. A phrase inside a longer one
    that occurs as often is left out. The cut at ``top`` is the report's length; ranks are worked out before it.
    """
    counts, totals = frequent_phrases(docs, least, longest, size, fan)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    found = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    run = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("first"), run(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    part = lambda c, name: counts.select("lang", F.col("phrase").alias(c), F.col("n").alias(name))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("over", wide("a") * F.lit(1000).cast("decimal(5,0)")).withColumn("under", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("CAST(CAST(over AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) AS DECIMAL(38,0)) div under"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    inside = found.select(
        "lang", F.col("a").alias("longer"), F.explode(F.expr("flatten(transform(sequence(2, greatest(2, size(w) - 1)), m -> IF(m < size(w), transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' ')), array())))")).alias("phrase")
    )
    covered = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language in ``documents``."""
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM
        (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS ws, k FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, a, ws, i, array_to_string(ws[1:i], ' ') AS x, array_to_string(ws[i+1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, i, x.n AS l, y.n AS r, t.n, 1000 * a::HUGEINT * t.n // (x.n::HUGEINT * y.n) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y JOIN t ON t.lang = cut.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
sub AS (SELECT lang, a AS longer, array_to_string(ws[i:i+m-1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
kept AS (SELECT low.* FROM low LEFT JOIN (SELECT lang, phrase, max(longer) AS longer FROM sub GROUP BY lang, phrase) v USING (lang, phrase) WHERE v.longer IS NULL OR 100 * v.longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) WHERE rank <= 2000
"""

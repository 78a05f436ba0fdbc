"""Token ids in files of transposed, compressed planes, with a chunk index.

Layout of one chunk (all integers little-endian)::

    magic "VPL1", kind u8 (0: byte planes, 1: bit planes), documents u32, ids u64, block length u32, blocks u32
    chunk index: for each block, its ids u32, its planes u8, and the bytes of each plane u32
    documents' ids and lengths, as two i64 arrays, compressed: bytes u32, then the data
    planes, block after block, least significant first, each a zstandard frame

A chunk holds whole documents in ascending doc_id order and as many blocks as they need; all blocks but a chunk's last
have the block length. A row of a file is a chunk with its shard, its number in the shard, its first and last doc_id, and
its documents and ids; Spark's writer commits files, so a lost executor leaves no half of one.

Each document ends with the end id. Null texts count as empty: the end id alone. Null ids come first, then ascending
ids; rows that repeat an id follow each other, in the order of their texts. An empty table gives no rows; other columns
are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm.common import documents, id_and_text, scratch

TOKENIZER = "byte_bpe_50k.json"
END = 0
BLOCK = 1 << 14
#: Ids after which a chunk is closed.
CHUNK_IDS = 1 << 20
#: Characters of text whose different pieces are encoded together.
SLICE = 16 << 20
#: Pieces that go to the tokenizer at once.
MANY = 20_000
#: White space besides spaces and newlines.
_OTHER = "\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MAGIC = b"VPL1"
CHUNKS = "shard int, chunk int, first_doc long, last_doc long, n_docs long, n_ids long, payload binary"
NULL_ID = -1 << 63


class Encoder:
    """The tokenizer's ids of whole texts.

    The vocabulary's pattern never joins what stands on both sides of a single space or newline between two words, so many texts
    are cut there and each different piece is encoded once. Pieces go to the tokenizer many at a time: behind each other with their
    spaces, or, where none stands before them, between newlines; the ids say where a piece begins. Texts with any other white space,
    or with an added token, go to the tokenizer whole.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold an added token go to the tokenizer whole, as only it knows what surrounds one.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([*added, f"[{_OTHER}]", r"[ \n][ \n]", r"^[ \n]", r"[ \n]$"])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker and path."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _many(self, words: list[str], spaced: bool) -> list[bytes]:
        """The ids of words that have no white space, with a space before each or nothing."""
        if len(words) > MANY:  # what the library hands back is much larger than ids
            return [ids for k in range(0, len(words), MANY) for ids in self._many(words[k : k + MANY], spaced)]
        groups = [words[k : k + 200] for k in range(0, len(words), 200)]
        texts = [f" {' '.join(g)}" if spaced else "\n".join(g) for g in groups]
        out = []
        for encoded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(encoded.ids, dtype="<u4")
            raw = ids.tobytes()
            if spaced:
                starts = (4 * np.flatnonzero(self.spaced[ids])).tolist()
                out += [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]
            else:
                gaps = (4 * np.flatnonzero(ids == self.newline)).tolist()
                out += [raw[a:b] for a, b in zip([0, *(g + 4 for g in gaps)], [*gaps, len(raw)])]
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. A piece is looked up once, however often the texts hold it."""
        all_texts = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(all_texts, self.odd).to_numpy(zero_copy_only=False)
        out = [self._whole(t) if o else b"" for t, o in zip(texts, odd.tolist())]
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        # A newline is the first character of the piece behind it; a text's first piece has nothing before it.
        split = pc.split_pattern(pc.replace_substring(all_texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        heads, which = np.unique(codes[ends[:-1]], return_inverse=True)
        inside = np.ones(len(codes), dtype=bool)
        inside[ends[:-1]] = False
        used = np.unique(codes[inside]).tolist()
        spaced = [i for i in used if pieces[i][0] != "\n"]
        lines = [i for i in used if pieces[i][0] == "\n"]
        first = [pieces[i] for i in heads.tolist()]
        ids: list[bytes] = [b""] * (len(pieces) + len(first))
        for i, found in zip(spaced, self._many([pieces[i] for i in spaced], True)):
            ids[i] = found
        unspaced = self._many([*(pieces[i][1:] for i in lines), *filter(None, first)], False)
        newline = self.newline.to_bytes(4, "little")
        for i, found in zip([*lines, *(len(pieces) + k for k, h in enumerate(first) if h)], unspaced):
            ids[i] = newline + found if i < len(pieces) else found
        codes[ends[:-1]] = len(pieces) + which
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, each = np.frombuffer(b"".join(ids), dtype="<u4"), n[codes]
        past = np.concatenate(([0], np.cumsum(each)))
        raw = flat[np.repeat((np.cumsum(n) - n)[codes] - past[:-1], each) + np.arange(past[-1])].tobytes()
        cuts = (4 * past[ends]).tolist()
        for i, a, b in zip(plain.tolist(), cuts, cuts[1:]):
            out[i] = raw[a:b]
        return out


def _planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block, least significant first; planes above the largest id are left out."""
    top = int(ids.max()) if len(ids) else 0
    if bits:
        table = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return [np.packbits(table[:, k], bitorder="little").tobytes() for k in range(top.bit_length())]
    return [np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range((top.bit_length() + 7) // 8)]


def _block(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    table = np.zeros((n, 32 if bits else 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        plane = np.frombuffer(plane, dtype=np.uint8)
        table[:, k] = np.unpackbits(plane, count=n, bitorder="little") if bits else plane
    return (np.packbits(table, axis=1, bitorder="little") if bits else table).reshape(-1).view("<u4")


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK, bits: bool = False) -> bytes:
    """One chunk of whole documents."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    index, data = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        planes = [squeeze(p) for p in _planes(part, bits)]
        index.append(struct.pack(f"<IB{len(planes)}I", len(part), len(planes), *map(len, planes)))
        data += planes
    names = squeeze(doc_ids.astype("<i8").tobytes() + sizes.astype("<i8").tobytes())
    head = MAGIC + struct.pack("<BIQII", bits, len(doc_ids), len(ids), block, len(index))
    return b"".join([head, *index, struct.pack("<I", len(names)), names, *data])


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their lengths and all their ids."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    expand = zstandard.ZstdDecompressor().decompress
    bits, n_docs, n_ids, _, n_blocks = struct.unpack_from("<BIQII", payload, 4)
    at, index = 4 + struct.calcsize("<BIQII"), []
    for _ in range(n_blocks):
        n, planes = struct.unpack_from("<IB", payload, at)
        index.append((n, struct.unpack_from(f"<{planes}I", payload, at + 5)))
        at += 5 + 4 * planes
    (size,) = struct.unpack_from("<I", payload, at)
    names = np.frombuffer(expand(payload[at + 4 : at + 4 + size]), dtype="<i8")
    at += 4 + size
    parts = []
    for n, lengths in index:
        planes = []
        for length in lengths:
            planes.append(expand(payload[at : at + length]))
            at += length
        parts.append(_block(planes, n, bool(bits)))
    ids = np.concatenate(parts) if parts else np.empty(0, "<u4")
    if len(ids) != n_ids:
        raise ValueError("a chunk is cut off")
    return names[:n_docs], names[n_docs:], ids


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = END, bits: bool = False) -> None:
    """Encodes every text and writes the chunks under ``path``, shards in ascending doc_id order."""
    spark, tokenizer = docs.sparkSession, tokenizer or public_tokenizers.path(TOKENIZER)
    tail = b"" if end is None else struct.pack("<I", end)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, chunk, names, coded, held = Encoder.of(tokenizer), 0, [], [], 0

        def close() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(coded), dtype="<u4")
            payload = pack(np.array(names, dtype=np.int64), np.array([len(c) // 4 for c in coded], dtype=np.int64), ids, bits=bits)
            return pd.DataFrame([(shard, chunk, names[0], names[-1], len(names), len(ids), payload)], columns=[c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            shard, texts = int(batch["shard"].iat[0]) if len(batch) else 0, batch["text"].tolist()
            ids, ends, at = batch["doc_id"].fillna(NULL_ID).astype("int64").tolist(), np.cumsum([len(t) for t in texts]), 0
            while at < len(texts):  # a few texts at a time
                past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
                for doc_id, mine in zip(ids[at:past], encoder.encode_many(texts[at:past])):
                    names.append(doc_id)
                    coded.append(mine + tail)
                    held += len(coded[-1]) // 4
                    if held >= CHUNK_IDS:
                        yield close()
                        chunk, names, coded, held = chunk + 1, [], [], 0
                at = past
        if names:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = id_and_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.withColumn("shard", F.spark_partition_id()).mapInPandas(run, CHUNKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids as little-endian bytes."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    sizes = chunks.select("shard", "chunk", "n_ids")
    # As many rows as shards; a shard's chunks are added up inside the shard.
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    within = sizes.select("shard", "chunk", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")).alias("inner"))
    starts = within.join(before, "shard").select("shard", "chunk", (F.col("base") + F.col("inner")).alias("start"))
    # One small row for each chunk of a million ids.
    placed = chunks.join(starts, ["shard", "chunk"]).select("start", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, payload in zip(batch["start"], batch["payload"]):
                names, sizes, ids = unpack(payload)
                ends, raw = np.cumsum(sizes), ids.tobytes()
                begun = ends - sizes
                doc_id = pd.array([None if d == NULL_ID else d for d in names.tolist()], dtype="Int64")
                yield pd.DataFrame({"doc_id": doc_id, "start": start + begun, "n_tokens": sizes, "ids": [raw[4 * a : 4 * b] for a, b in zip(begun.tolist(), ends.tolist())]})

    return placed.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place among all ids, its number of ids and their checksum, from files that were written and read back."""
    path = scratch(spark, "planes")
    write(documents(spark, sf_dir), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, by Spark's higher-order functions.

A task cuts the texts of a block (BLOCK bytes of text, whole documents) into words by the vocabulary's pattern and writes
a block as one row: its distinct words as byte arrays, and each document as positions in that list. The fold then works
on the distinct words alone: a word starts as the ids of its bytes, and the leftmost neighbouring pair of least rank is
merged until no pair has a rank. The rank map is a literal from pairs of ids to ranks, which are ids too. A piece has
one pair: what merges leave of its own bytes before the last merge, as nothing outside a span changes the order of the
merges inside it. A document's ids are those of its words, gathered by position. Decoding concatenates the binary pieces
of the ids. No row leaves its task, so nothing is shuffled, broadcast by words, or kept by the driver.

A word of n bytes takes n steps over at most n ids; words of more than LONG bytes are therefore cut into their final
pieces by the same ranked merges with a heap in the task (n log n steps), and their pieces go through the rank map.

Null texts count as empty and give no ids. Repeated rows are encoded one by one; empty tables give no rows; other
columns are ignored; a document larger than a block is a block of its own. Ranks of which some piece is not reached by
merging its bytes are an error.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents, id_and_text

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text whose distinct words are folded together; words of more bytes than LONG are cut by a heap.
BLOCK, LONG = 32 << 20, 128
#: Bytes of text that are cut at once.
SLICE = 2 << 20
#: Bits of an id or rank; the rank of what is no pair; the two divisors whose remainders are a pair's places in the rank map.
ID_BITS, DIVISORS = 20, (130_969, 131_009)
NONE = (1 << ID_BITS) - 1
_BLOCKS = "words array<array<int>>, docs array<struct<doc_id:bigint,at:array<int>>>"


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks, which are their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def last_merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two pieces that a piece's own bytes are merged to at last."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
        if rank == NONE:
            raise ValueError(f"merges do not reach {piece!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


@cache
def _literals(path: str) -> tuple[str, str, str]:
    """As JSON: the pieces by id; at each place a pair of ids with its rank, or -1; the ids of the 256 bytes."""
    ranks = read_ranks(path)
    pieces, held = [""] * (max(ranks.values()) + 1), [-1] * max(DIVISORS)
    for piece, rank in ranks.items():
        pieces[rank] = base64.b64encode(piece).decode()
        if len(piece) == 1:
            continue
        a, b = last_merge(piece, ranks)
        now = (ranks[a] << ID_BITS | ranks[b]) << ID_BITS | rank
        at = (now >> ID_BITS) % DIVISORS[0]
        for _ in range(500):
            now, held[at] = held[at], now
            if now < 0:
                break
            first, second = ((now >> ID_BITS) % d for d in DIVISORS)
            at = second if at == first else first
        else:
            raise ValueError("the ranks do not fit their places")
    plain = lambda values: json.dumps(values, separators=(",", ":"))
    return plain(pieces), plain(held), plain([ranks[bytes([i])] for i in range(256)])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


class RankMap:
    """The literal rank map, bound for use inside lambdas."""

    def __init__(self, pieces: Column, held: Column, bytes_: Column) -> None:
        self.pieces, self.held, self.bytes = pieces, held, bytes_

    def rank(self, left: Column, right: Column) -> Column:
        """The rank of two neighbours (ids as bigint), or NONE."""

        def found(key: Column) -> Column:
            entries = [self.held[key % F.lit(d).cast("bigint")] for d in DIVISORS]
            match = lambda at: F.shiftright(at, ID_BITS) == key
            return F.when(match(entries[0]), _low(entries[0])).when(match(entries[1]), _low(entries[1])).otherwise(_long(NONE))

        return _let(F.shiftleft(left, ID_BITS).bitwiseOR(right), found)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _low(packed: Column) -> Column:
    """The id or rank in the low bits."""
    return packed.bitwiseAND(_long(NONE))


def with_ranks(path: str, body: Callable[[RankMap], Column]) -> Column:
    """``body`` of the rank map."""
    pieces, held, bytes_ = (F.from_json(F.lit(text), f"array<{kind}>") for text, kind in zip(_literals(path), ("binary", "bigint", "bigint")))
    return _let(pieces, lambda p: _let(held, lambda h: _let(bytes_, lambda b: body(RankMap(p, h, b)))))


def _entry(rank: Column, of: Column) -> Column:
    """An id in the low bits, above it the rank of it and the next id."""
    return F.shiftleft(rank, ID_BITS).bitwiseOR(of)


def byte_pairs(ranks: RankMap) -> Column:
    """The entries of all pairs of bytes, so that a word's first entries are looked up by place."""
    each = lambda i: _entry(ranks.rank(ranks.bytes[F.shiftright(i, 8)], ranks.bytes[i.bitwiseAND(255)]), ranks.bytes[F.shiftright(i, 8)])
    return F.transform(F.sequence(F.lit(0), F.lit((1 << 16) - 1)), each)


def fold(word: Column, ranks: RankMap, pairs: Column) -> Column:
    """The ids of a word, an array of bytes.

    The state is one array of entries. Its least entry is the leftmost pair of least rank, as a rank has one pair; the rank is the id
    that the two become.
    """
    end = _long(NONE)

    def merged(v: Column, k: Column) -> Column:
        new = F.shiftright(v[k], ID_BITS)
        next_rank = F.when(k + 2 < F.size(v), ranks.rank(new, _low(v[k + 2]))).otherwise(end)
        moved = lambda x, i: F.when(i == k, _entry(next_rank, new)).when(i == k - 1, _entry(ranks.rank(_low(x), new), _low(x))).otherwise(x)
        return F.transform(F.filter(v, lambda _, i: i != k + 1), moved)

    def step(v: Column, _: Column) -> Column:
        return _let(F.array_position(v, F.array_min(v)).cast("int") - 1, lambda k: F.when(v[k] < NONE << ID_BITS, merged(v, k)).otherwise(v))

    def merge_all(rest: Column) -> Column:
        first = F.zip_with(word, rest, lambda a, b: F.when(b.isNull(), _entry(end, ranks.bytes[a])).otherwise(pairs[F.shiftleft(a, 8) + b]))
        return F.aggregate(rest, first, step, lambda v: F.transform(v, lambda x: _low(x).cast("int")))

    return _let(F.slice(word, 2, F.size(word)), merge_all)


def strings(parts: Column) -> Column:
    """Binary pieces as strings: the cast leaves bytes as they are, and strings can be joined."""
    return F.transform(parts, lambda x: x.cast("string"))


def gathered(places: Column, pieces: Column) -> Column:
    """The pieces at some places, one after the other."""
    return F.array_join(F.transform(places, lambda i: F.get(pieces, i)), "")


def decode(ids: Column, ranks: RankMap) -> Column:
    """The bytes that an array of ids stands for: their binary pieces, concatenated."""
    return _let(strings(ranks.pieces), lambda pieces: gathered(ids, pieces)).cast("binary")


def little_endian(i: Column) -> Column:
    """An id as an unsigned 32-bit integer, least byte first."""
    byte = lambda shift: F.lpad(F.hex(F.shiftrightunsigned(i, shift).bitwiseAND(255)), 2, "0")
    return F.unhex(F.concat(byte(0), byte(8), byte(16), byte(24)))


def heap_pieces(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces that ranked merges leave of a word, the leftmost pair of least rank first."""
    if word in ranks:
        return [word]
    n = len(word)
    # A piece is known by where it starts: end[i] is where it ends, before[i] where the piece to its left starts.
    end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, past = heapq.heappop(heap)
        if end[i] != j or end[j] != past:
            continue
        end[i], end[j] = past, -1
        if past < n:
            before[past] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = end[i]
    return out


#: White space in the sense of the pattern, and without the space.
_WIDE = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"[ {_WIDE}]"
#: Stand before each word while a text is cut, the second where a run's space has gone to the word; texts that hold one are cut by the
#: pattern itself.
_MARK, _TAKEN = "\x01", "\x02"


@cache
def _cuts(pattern: str) -> tuple[str, list[tuple[str, str]]]:
    """What a text must not hold to be cut by replacements, and the replacements that put a mark before each word.

    They need no look-ahead: a run of white space is first one word; if another word follows, the run's last character then goes to that
    word if it is a space, and is a word of its own if not.
    """
    plain = pattern.replace(r"|\s+(?!\S)|\s+", f"|{_SPACE}+").replace(r"\s", f" {_WIDE}")
    return f"[{_MARK}{_TAKEN}]|{_SPACE}{{2}}'", [
        (plain, rf"{_MARK}\0"),
        (f"{_MARK}({_SPACE}+) {_MARK}", rf"{_MARK}\1{_TAKEN} "),
        (f"{_MARK}({_SPACE}+)([{_WIDE}]){_MARK}", rf"{_MARK}\1{_MARK}\2{_MARK}"),
    ]


class _Block:
    """Some documents as they are cut: their ids, their numbers of words, and their words."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.compiled, self.size = pattern, regex.compile(pattern), 0
        self.names, self.sizes, self.words = [], [], []

    def add(self, names: pa.Array, texts: pa.Array) -> None:
        """More documents; their order does not matter."""
        odd, replacements = _cuts(self.pattern)
        self.size += int(pc.sum(pc.binary_length(texts)).as_py() or 0)
        is_odd = pc.match_substring_regex(texts, odd)
        plain = pc.invert(is_odd)
        marked = texts.filter(plain)
        for what, by in replacements:
            marked = pc.replace_substring_regex(marked, what, by)
        split = pc.split_pattern(pc.replace_substring(marked, _TAKEN, _MARK), _MARK)
        n = np.diff(split.offsets.to_numpy())
        words = split.flatten().dictionary_encode()
        # Nothing stands before a text's first mark.
        kept = np.ones(len(words), dtype=bool)
        kept[split.offsets.to_numpy()[:-1]] = False
        self._hold(names.filter(plain), n - 1, pa.DictionaryArray.from_arrays(words.indices.filter(pa.array(kept)), words.dictionary))
        if len(marked) < len(texts):
            found = [self.compiled.findall(t) for t in texts.filter(is_odd).to_pylist()]
            self._hold(names.filter(is_odd), np.array([len(f) for f in found]), pa.array(list(itertools.chain.from_iterable(found)), pa.string()).dictionary_encode())

    def _hold(self, names: pa.Array, sizes: np.ndarray, words: pa.DictionaryArray) -> None:
        self.names.append(names)
        self.sizes.append(sizes)
        self.words.append(words)

    def row(self, ranks: Callable[[], dict[bytes, int]]) -> pa.RecordBatch:
        """The block as one row."""
        coded = pa.chunked_array(self.words).unify_dictionaries()
        words = coded.chunk(0).dictionary.cast(pa.binary())
        at, sizes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]), np.concatenate(self.sizes)
        if (pc.max(pc.binary_length(words)).as_py() or 0) > LONG:
            at, sizes, words = _without_long(at, sizes, words.to_pylist(), ranks())
        positions = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(at.astype(np.int32)))
        held = pa.StructArray.from_arrays([pa.concat_arrays(self.names), positions], ["doc_id", "at"])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(words).to_numpy()))).astype(np.int32)
        raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"")[0].as_buffer(), dtype=np.uint8)
        return pa.RecordBatch.from_arrays([one(pa.ListArray.from_arrays(pa.array(ends), pa.array(raw.astype(np.int32)))), one(held)], ["words", "docs"])


def _without_long(at: np.ndarray, sizes: np.ndarray, words: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Positions, the documents' numbers of words, and the different words, with long words as their final pieces."""
    known = {w: i for i, w in enumerate(words)}
    cut = {i: [known.setdefault(p, len(known)) for p in heap_pieces(w, ranks)] for i, w in enumerate(words) if len(w) > LONG}
    words = [b"" if cut.get(i, [i]) != [i] else w for i, w in enumerate(known)]
    pieces = [cut.get(i, [i]) for i in at.tolist()]
    total = np.concatenate(([0], np.cumsum([len(p) for p in pieces], dtype=np.int64)))
    ends = np.cumsum(sizes)
    return np.array(list(itertools.chain.from_iterable(pieces)), dtype=np.int32), total[ends] - total[ends - sizes], pa.array(words, pa.binary())


def blocks(rows: DataFrame, path: str, size: int = BLOCK, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Blocks of documents, each with its distinct words, from rows of doc_id and text."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(pattern)
        for batch in batches:
            ends, at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy()), 0
            while at < len(ends):  # a few documents at a time, so that what is cut is small beside the block
                past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + min(size, SLICE), side="right")))
                block.add(batch.column(0).slice(at, past - at), batch.column(1).slice(at, past - at))
                at = past
                if block.size >= size:
                    yield block.row(lambda: shared.value)
                    block = _Block(pattern)
                    pa.default_memory_pool().release_unused()
        if block.names:
            yield block.row(lambda: shared.value)
        del block
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, _BLOCKS)


def encode(docs: DataFrame, path: str | None = None, size: int = BLOCK) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, and the bytes that the ids decode to, of every row."""
    path = path or public_tokenizers.path(RANKS)

    def coded(ranks: RankMap) -> Column:
        def word(w: Column, pairs: Column, le: Column, pieces: Column) -> Column:
            return _let(fold(w, ranks, pairs), lambda ids: F.struct(gathered(ids, le).alias("ids"), gathered(ids, pieces).alias("bytes")))

        def document(d: Column, words: Column) -> Column:
            part = lambda name: F.array_join(F.transform(d["at"], lambda i: F.get(words, i)[name]), "").cast("binary")
            return F.struct(d["doc_id"].alias("doc_id"), part("ids").alias("ids"), part("bytes").alias("decoded"))

        every_id = F.transform(F.sequence(F.lit(0), F.size(ranks.pieces) - 1), little_endian)
        all_words = lambda pairs: _let(strings(every_id), lambda le: _let(strings(ranks.pieces), lambda pieces: F.transform("words", lambda w: word(w, pairs, le, pieces))))
        return _let(_let(byte_pairs(ranks), all_words), lambda words: F.transform("docs", lambda d: document(d, words)))

    out = blocks(id_and_text(docs), path, size).select(F.inline(with_ranks(path, coded)))
    return out.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "decoded")


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens and the digests of the ids and of the bytes they decode to."""
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids, and the digests of its ids and of what they decode to."""
    return digests(encode(documents(spark, sf_dir)))

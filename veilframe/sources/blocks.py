"""Block text files (A5): a name, a count, and rows of ten numbers; a count of 0 has one row of zeros, which is no box.

What a line is depends on all lines before it, so a file is parsed by composing maps. A chunk of lines is turned into a
map from the state in which the chunk may be entered to that in which it is left, for every state at once. The maps are
applied one after the other along the file, which needs numbers alone; then each chunk, knowing how it is entered, labels
its lines. All lines of a file are moved by chunk, never gathered, and where the splits or chunks lie does not matter.

A count that cannot be read leaves the rest of the file unreadable: its lines get no label, and the error says so. Every
other error leaves the structure as it is, and the parse goes on. A byte-order mark before a name is dropped. Blank lines
stand between blocks only. Null lines are blank. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veilframe.streaming.folds import fold_sorted

FIELDS = ("x", "y", "width", "height", "blur", "expression", "illumination", "invalid", "occlusion", "pose")
#: Lines of a file that are looked at together, by ``at``.
CHUNK = 1 << 16
#: States in which a chunk is left, beside the number of lines (0 or more) until the next name is due.
COUNT, LOST = -1, -2
LABELLED = "file string, at long, kind string, block long, declared long, box long, name string, values array<long>, error string"


def whole_number(text: str) -> int | None:
    """A line or field as a whole number, or None."""
    try:
        return int(text.strip())
    except ValueError:
        return None


def safe_name(text: str) -> str | None:
    """A relative path in plain form; None if it leads out of its folder or nowhere."""
    path = text.replace("\\", "/")
    parts = [x for x in path.split("/") if x not in ("", ".")]
    return None if path.startswith("/") or ".." in parts or not parts else "/".join(parts)


def _name(raw: str | None) -> str:
    return (raw or "").strip().lstrip("﻿").strip()


def _long(n: int | None) -> int:
    """A count as a long: -1 if it cannot be used."""
    return -1 if n is None or n < 0 else min(n, (1 << 62) - 1)


#: Lines that stand for themselves as names, that are counts, that cannot be a whole number, and rows of up to ten plain numbers. All others are read by Python.
_PLAIN, _DIGITS, _NEVER, _NUMBERS = r"^[!-~]([ -~]*[!-~])?$", r"^[0-9]{1,18}$", r"[!-*,./:-^`-~]|[!-~][\t ]+[!-~]", r"^[0-9]{1,18}( [0-9]{1,18}){0,9}$"


def _where(text: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)


def _read(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines without nulls: which are blank, each as a count (-1 if it cannot be used), and which are no whole number."""
    blank, digits = ~_where(text, _PLAIN), _where(text, _DIGITS)
    odd = np.flatnonzero(blank)
    blank[odd] = [not _name(x) for x in text.take(pa.array(odd)).to_pylist()]
    number, none = np.full(len(text), -1, dtype=np.int64), ~digits
    number[digits] = text.filter(pa.array(digits)).cast(pa.int64()).to_numpy()
    rest = np.flatnonzero(~digits & ~_where(text, _NEVER))
    found = [whole_number(x) for x in text.take(pa.array(rest)).to_pylist()]
    number[rest], none[rest] = [_long(x) for x in found], [x is None for x in found]
    return blank, number, none


def _steps(blank: np.ndarray, number: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """How names lead to names in chunks that begin at ``begins``. A chunk of n lines takes n + 1 slots, the last of which stands for its end.

    Out come each line's slot and the count behind it, and for each slot the next one (itself: none) and the state in which a chunk is left from there.
    """
    line, sizes = np.arange(len(blank)), np.diff(np.append(begins, len(blank)))
    chunk = np.repeat(np.arange(len(begins)), sizes)
    slot, end = line + chunk, (begins + sizes)[chunk]
    follows = line + 1 < end
    count = np.where(follows, np.append(number[1:], -1), -1)
    rows = 2 + np.maximum(count, 1)
    inside = ~blank & (count >= 0) & (line + rows <= end)
    to, state = np.arange(len(blank) + len(begins)), np.zeros(len(blank) + len(begins), dtype=np.int64)
    to[slot[blank]] += 1
    to[slot[inside]] += rows[inside]
    out = ~blank & ~inside
    state[slot[out]] = np.where(~follows, COUNT, np.where(count < 0, LOST, line + rows - end))[out]
    return slot, count, to, state


def chunk_maps(at: np.ndarray, blank: np.ndarray, number: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each slot of :func:`_steps`, a line at which a name may be due: the state after the chunk, where the last name then stands (-1: none) and its count (-1: not read here).

    Steps are doubled until none leads further, as a block leads to the line behind it.
    """
    slot, count, to, state = _steps(blank, number, begins)
    line = np.full(len(to), -1)
    line[slot] = np.arange(len(slot))
    name = np.full(len(to), -1)
    name[slot[~blank]] = slot[~blank]
    while True:
        name = np.where(name[to] >= 0, name[to], name)
        further = to[to]
        if (further == to).all():
            break
        to = further
    last = line[name]
    none = name < 0
    return state[to], np.where(none, -1, at[last]), np.where(none, -1, count[last])


def _together(batches: Iterator[pa.RecordBatch], begins: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows, whole chunks at a time (many small ones, or one large one), and where these begin."""
    held, size, enough = [], 0, CHUNK
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= enough:
            rows = _one(held)
            first = begins(rows)
            if first[-1]:
                yield rows.slice(0, first[-1]), first[:-1]
            held, size = [rows.slice(first[-1])], rows.num_rows - int(first[-1])
            enough = max(CHUNK, 2 * size)
    if size:
        rows = _one(held)
        yield rows, begins(rows)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches) if len(batches) > 1 else batches[0]


def _chunk_begins(rows: pa.RecordBatch) -> np.ndarray:
    file, chunk = rows.column("file"), rows.column("chunk").to_numpy()
    null = file.is_null().to_numpy(zero_copy_only=False)
    file = file.fill_null("")
    other = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate(([True], other | (null[1:] != null[:-1]) | (chunk[1:] != chunk[:-1]))))


def _numbers(values: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=none)


MAPS = "file string, chunk long, n long, first long, state binary, last binary, declared binary"
_MAPS_SCHEMA = pa.schema({"file": pa.string(), **{c: pa.int64() for c in ("chunk", "n", "first")}, **{c: pa.binary() for c in ("state", "last", "declared")}})
_LABELLED_SCHEMA = pa.schema([("file", pa.string()), ("at", pa.int64()), ("kind", pa.string()), *((c, pa.int64()) for c in ("block", "declared", "box")), ("name", pa.string()), ("values", pa.list_(pa.int64())), ("error", pa.string())])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of sorted lines."""
    for rows, begins in _together(batches, _chunk_begins):
        blank, number, _ = _read(rows.column("raw").fill_null(""))
        sizes = np.diff(np.append(begins, rows.num_rows))
        ends = pa.py_buffer(np.concatenate(([0], np.cumsum(sizes + 1) * 8)).astype(np.int32))
        maps = [pa.Array.from_buffers(pa.binary(), len(begins), [None, ends, pa.py_buffer(np.ascontiguousarray(x, dtype=np.int64))]) for x in chunk_maps(rows.column("at").to_numpy(), blank, number, begins)]
        first = pa.array(begins)
        yield pa.RecordBatch.from_arrays([rows.column("file").take(first), rows.column("chunk").take(first), pa.array(sizes, pa.int64()), pa.array(number[begins], pa.int64()), *maps], schema=_MAPS_SCHEMA)


def _enter(now: tuple[int, int, int], row: tuple) -> tuple[tuple[int, int, int], list[tuple]]:
    """The state (due, block, declared) behind a chunk; out comes how the chunk is entered."""
    due, block, declared = now
    file, chunk, n, first = row[:4]
    out = [(file, chunk, due, block, declared)]
    if due == COUNT:
        due, declared = (LOST, -1) if first < 0 else (1 + max(first, 1), first)
    if due > n:
        due -= n
    elif due >= 0:
        state, last, counts = (np.frombuffer(x, dtype=np.int64) for x in row[4:])
        if last[due] >= 0:
            block, declared = int(last[due]), int(counts[due])
        due = int(state[due])
    return (due, block, declared), out


def _spans(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of spans, which span each is of, and its place there."""
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return first[of] + place, of, place


def _boxes(text: pa.Array, full: bool) -> tuple[np.ndarray, pa.Array]:
    """The errors of boxes, and their first ten fields as numbers (not ``full``: nulls)."""
    plain = _where(text, _NUMBERS)
    error, slow = np.full(len(text), None, dtype=object), []
    many = pc.count_substring(text, " ").to_numpy(zero_copy_only=False)
    error[plain & (many < len(FIELDS) - 1)] = "fields"
    odd = np.flatnonzero(~plain)
    for i, fields in zip(odd.tolist(), (x.split() for x in text.take(pa.array(odd)).to_pylist())):
        values = [whole_number(x) for x in fields[: len(FIELDS)]]
        values = [x if x is None or -(1 << 63) <= x < 1 << 63 else None for x in values]
        error[i] = "fields" if len(fields) < len(FIELDS) else "integer" if None in values else None
        slow.append(values)
    if not full:
        return error, pa.nulls(len(text), pa.list_(pa.int64()))
    cut = pc.split_pattern(text.filter(pa.array(plain)), " ")
    fast = pa.ListArray.from_arrays(cut.offsets, cut.values.cast(pa.int64()))
    place = np.empty(len(text), dtype=np.int64)
    place[plain], place[odd] = np.arange(len(text) - len(odd)), np.arange(len(odd)) + len(text) - len(odd)
    return error, pa.concat_arrays([fast, pa.array(slow, pa.list_(pa.int64()))]).take(pa.array(place))


def _labelled(rows: pa.RecordBatch, heads: np.ndarray, full: bool) -> pa.RecordBatch:
    """The lines of chunks, each read from the state in which it is entered, which is the row at a chunk's head."""
    due, block, declared = (rows.column(c).take(pa.array(heads)).to_numpy() for c in ("due", "block", "declared"))
    lines = rows.filter(pc.invert(rows.column("entered")))
    sizes = np.diff(np.append(heads, rows.num_rows)) - 1
    begins = np.cumsum(sizes) - sizes
    ends = begins + sizes
    at, text = lines.column("at").to_numpy(), lines.column("raw").fill_null("")
    blank, number, none = _read(text)
    slot, count, to, _ = _steps(blank, number, begins)

    # Of the block that is open where a chunk begins: its count, then its rows.
    waits = np.flatnonzero((due == COUNT) & (sizes > 0))
    open_first, open_n = begins.copy(), np.maximum(due, 0)
    declared = declared.copy()
    declared[waits] = number[begins[waits]]
    open_first[waits] += 1
    open_n[waits] = np.where(declared[waits] < 0, 0, np.maximum(declared[waits], 1))
    left = open_n.copy()
    lost = (due == LOST) | ((due == COUNT) & (declared < 0))
    start = np.where(lost, ends, np.minimum(open_first + open_n, ends))
    open_n = np.minimum(open_n, ends - open_first)

    # The names that are met from there.
    found, leads, named = [], to.tolist(), np.zeros(len(to), dtype=bool)
    named[slot[~blank]] = True
    named = named.tolist()
    chunks = np.arange(len(begins))
    for place, end in zip((start + chunks).tolist(), (ends + chunks).tolist()):
        while place < end:
            if named[place]:
                found.append(place)
            if (step := leads[place]) == place:
                break
            place = step
    line = np.full(len(to), -1)
    line[slot] = np.arange(len(slot))
    names = line[np.array(found, dtype=np.int64)]
    end = np.repeat(ends, sizes)[names]
    counts = names[names + 1 < end] + 1
    n = np.where(count[names] < 0, 0, np.minimum(np.maximum(count[names], 1), np.maximum(end - names - 2, 0)))

    kind, of, said, box = (np.zeros(len(text), dtype=np.int64) for _ in range(4))
    kind[names], of[names] = 1, at[names]
    kind[counts], of[counts], said[counts] = 2, at[counts - 1], number[counts]
    kind[begins[waits]], of[begins[waits]], said[begins[waits]] = 2, block[waits], declared[waits]
    for first, size, own, total, before in ((open_first, open_n, block, declared, declared - left), (names + 2, n, at[names], count[names], np.zeros(len(names), dtype=np.int64))):
        mine, span, place = _spans(first, size)
        kind[mine], of[mine], said[mine], box[mine] = np.where(total[span] == 0, 3, 4), own[span], total[span], before[span] + place + 1

    error, name, boxes = np.full(len(text), None, dtype=object), np.full(len(text), None, dtype=object), np.flatnonzero(kind == 4)
    for i, raw in zip(names.tolist(), text.take(pa.array(names)).to_pylist()):
        safe = safe_name(plain := _name(raw))
        name[i], error[i] = safe or plain, None if safe else "name"
    bad = np.flatnonzero((kind == 2) & (number < 0))
    error[bad] = np.where(none[bad], "count", "negative")
    zeros = np.flatnonzero(kind == 3)
    error[zeros] = [None if x.split() == ["0"] * len(FIELDS) else "placeholder" for x in text.take(pa.array(zeros)).to_pylist()]
    error[boxes], values = _boxes(text.take(pa.array(boxes)), full)

    told = kind > 0
    if not full:  # of a block in a chunk: its name, its last line and its errors
        chunk = np.repeat(chunks, sizes)
        at_all = np.flatnonzero(told)
        after = np.concatenate(((of[at_all[1:]] != of[at_all[:-1]]) | (chunk[at_all[1:]] != chunk[at_all[:-1]]), [True]))[: len(at_all)]
        ends_here = np.zeros(len(text), dtype=bool)
        ends_here[at_all[after]] = True
        told &= ends_here | (kind == 1) | (error != None)  # noqa: E711
    keep = np.flatnonzero(told)
    of_box = np.zeros(len(text), dtype=np.int64)
    of_box[boxes] = np.arange(len(boxes))
    k = kind[keep]
    kinds = pa.array(["name", "count", "placeholder", "box"]).take(pa.array(k - 1))
    return pa.RecordBatch.from_arrays(
        [lines.column("file").take(pa.array(keep)), _numbers(at[keep], np.zeros(len(keep), dtype=bool)), kinds, _numbers(of[keep], np.zeros(len(keep), dtype=bool)), _numbers(said[keep], k == 1), _numbers(box[keep], k != 4), pa.array(name[keep], pa.string()), values.take(pa.array(of_box[keep], mask=k != 4)), pa.array(error[keep], pa.string())],
        schema=_LABELLED_SCHEMA,
    )


def block_lines(lines: DataFrame, chunk: int = CHUNK, full: bool = True) -> DataFrame:
    """Every line of block files with what it is: a name, a count, a placeholder or a box of its block, and its error.

    ``lines`` has file, at and raw; ``at`` ascends in a file. A block is known by where its name stands. Not ``full``, what
    :func:`block_errors` has no need of is left out: lines without an error that are neither names nor a block's last in a chunk, and fields.
    """
    dealt = lines.select("file", F.col("at").cast("long").alias("at"), "raw", F.floor(F.col("at") / chunk).cast("long").alias("chunk"))
    maps = dealt.repartition("file", "chunk").sortWithinPartitions("file", "chunk", "at").mapInArrow(_maps, MAPS)
    entered = fold_sorted(maps, "file", ["chunk"], lambda: (0, -1, -1), _enter, "file string, chunk long, due long, block long, declared long")
    none = F.lit(None).cast("long")
    both = entered.select("file", "chunk", F.lit(True).alias("entered"), none.alias("at"), F.lit(None).cast("string").alias("raw"), "due", "block", "declared")
    both = both.unionByName(dealt.select("file", "chunk", F.lit(False).alias("entered"), "at", "raw", *(none.alias(c) for c in ("due", "block", "declared"))))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, heads in _together(batches, lambda x: np.flatnonzero(x.column("entered").to_numpy(zero_copy_only=False))):
            yield _labelled(rows, heads, full)

    return both.repartition("file", "chunk").sortWithinPartitions("file", "chunk", F.desc("entered"), "at").mapInArrow(label, LABELLED)


def _in_block() -> WindowSpec:
    """Rows of a block from its name, which is its first line, to each line; the frame runs, so a block of any length passes."""
    return Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def block_text(lines: DataFrame, chunk: int = CHUNK, labelled: DataFrame | None = None) -> DataFrame:
    """The boxes: file, filename, block, declared, box number and the ten fields, null where a field is missing or no number."""
    labelled = block_lines(lines, chunk) if labelled is None else labelled
    boxes = labelled.withColumn("filename", F.first("name").over(_in_block())).where("kind = 'box'")
    return boxes.select("file", "filename", "block", F.col("declared").try_cast("int").alias("declared"), F.col("box").try_cast("int").alias("box"), *(F.get("values", F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(FIELDS)))


def block_errors(labelled: DataFrame) -> DataFrame:
    """(file, filename, at, code) of everything that is wrong with a file.

    ``name`` an unsafe name, ``duplicate`` a name seen before in the file, ``no_count`` a name at the file's end, ``count`` and
    ``negative`` a count that is none (the rest of the file is not read), ``no_placeholder`` and ``placeholder`` a missing or
    wrong row of zeros, ``truncated`` fewer boxes than declared, ``fields`` and ``integer`` a box of less than ten fields or with
    a field that is no whole number.
    """
    # The last row of a block tells how many it has, and each how many were declared.
    rows, declared = F.coalesce(F.max(F.when(F.col("kind") == "placeholder", 1).otherwise(F.col("box"))).over(_in_block()), F.lit(0)), F.max("declared")
    seen = labelled.select("file", "block", "at", "kind", "error", F.first("name").over(_in_block()).alias("filename"), rows.alias("rows"), declared.over(_in_block()).alias("declared"), F.lead("at").over(Window.partitionBy("file", "block").orderBy("at")).alias("next"))
    short = F.when(F.col("declared").isNull(), "no_count").when((F.col("declared") == 0) & (F.col("rows") == 0), "no_placeholder").when(F.col("rows") < F.col("declared"), "truncated")
    # A name goes on without a code too, as it may be a duplicate.
    codes = F.array_compact(F.array("error", F.when(F.col("next").isNull(), short), F.when(F.col("kind") == "name", "")))
    found = seen.select("file", "filename", "block", "at", F.explode(codes).alias("code"))
    order = Window.partitionBy("file", "filename", F.col("code") == "").orderBy("block")
    counted = found.withColumn("k", F.when(F.col("code") == "", F.row_number().over(order)))
    return counted.where("code <> '' OR k > 1").select("file", "filename", "at", F.when(F.col("code") == "", "duplicate").otherwise(F.col("code")).alias("code"))

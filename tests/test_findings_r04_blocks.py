"""Findings of round 4 on the core queries."""

import random

import numpy as np

from veilframe.sources import blocks as b


def test_errors_of_blocks_need_no_whole_lines(spark):
    """what is read for the errors is less than every line, and the errors are the same, on lines that only Python reads too."""
    rng, odd = random.Random(3), ["a.jpg", "b/c.jpg", "1", "2", "0", "+2", " 3", "1_0", "٣", "-0", "-4", "1 2 3 4 5 6 7 8 9 10", "1 2 3 4 5 6 7 8 9 10 11", "1 2 3 4 5 6 7 8 9 ٣", "1  2 3 4 5 6 7 8 9 10", "0 0 0 0 0 0 0 0 0 0", "0 0", None, "", "\t", " ", "﻿d.jpg", f"{10**25}", f"1 2 3 4 5 6 7 8 9 {10**25}", "1 2\n3"]
    rows = [(f"f{k}" if k else None, i, rng.choice(odd)) for k in range(120) for i in range(rng.randint(1, 30))]
    rows += [("long", i, x) for i, x in enumerate(["n.jpg", "50", *["1 2 3 4 5 6 7 8 9 10"] * 50] * 20)]
    lines = spark.createDataFrame(rows, "file string, at long, raw string").repartition(3)
    wanted = None
    for chunk in (4, 1 << 16):
        whole, brief = b.block_lines(lines, chunk).cache(), b.block_lines(lines, chunk, full=False).cache()
        found = [sorted(map(str, b.block_errors(x).collect())) for x in (whole, brief)]
        wanted = wanted or found[0]
        assert found == [wanted, wanted]
        assert brief.where("file = 'long'").count() * (2 if chunk == 4 else 10) < whole.where("file = 'long'").count()


def test_chunks_are_read_at_once():
    """the maps of many chunks come from one set of arrays; they equal a walk line by line."""
    rng = random.Random(5)
    raw = [rng.choice(["a.jpg", "1", "2", "0", "", "-1", "x y"]) for _ in range(300)]
    begins = np.array(sorted({0, *rng.sample(range(1, 300), 40)}))
    text = b.pa.array(raw)
    blank, number, _ = b._read(text)
    state, last, count = b.chunk_maps(np.arange(300) * 7, blank, number, begins)
    ends = [*begins[1:].tolist(), 300]
    for k, (first, end) in enumerate(zip(begins.tolist(), ends)):
        for i in range(first, end + 1):
            place, name, said, out = i, -1, -1, 0
            while place < end:
                if not raw[place].strip():
                    place += 1
                    continue
                name, said, n = place * 7, -1, None
                if place + 1 == end:
                    out = b.COUNT
                    break
                n = b.whole_number(raw[place + 1])
                if n is None or n < 0:
                    out = b.LOST
                    break
                said, place = n, place + 2 + max(n, 1)
                out = max(place - end, 0)
            assert (state[i + k], last[i + k], count[i + k]) == (out, name, said)

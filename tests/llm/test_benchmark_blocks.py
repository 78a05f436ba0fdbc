"""The benchmark's blocks keep their bound, and the rows do not depend on it."""

import random

import pytest

from veilframe.llm import decontamination as d


@pytest.fixture(scope="module")
def items(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(120)]
    rows += [(7, "one text that is there a hundred times over and over")] * 100 + [(8, "longer " * 300), (9, None), (9, ""), (None, "no id at all has this item here")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_blocks_keep_their_bound(items):
    rows, frame = items
    for most in (1000, 5000, 1 << 20):
        blocks = list(d._blocks(frame, most))
        for block in blocks:
            sizes = sorted(len(text.encode()) for _, text in block)
            assert sum(sizes) <= most or sum(sizes[:-1]) <= most // 2
        assert sorted(((i, t) for block in blocks for (i, n), t in block for _ in range(n)), key=repr) == sorted((x for x in rows if x[1] is not None), key=repr)
        assert len(blocks) == 1 if most > 5000 else len(blocks) > 1


def test_rows_do_not_depend_on_blocks(spark, items, monkeypatch):
    rows, frame = items
    texts = [(i, f"before it all {t} and after it") for i, (_, t) in enumerate(rows) if t]
    docs = spark.createDataFrame([*texts, (None, None), (-1, ""), (-2, "very long " * 20000)], "doc_id long, text string")
    whole = sorted(map(repr, d.find(docs, frame).collect()))
    kept = sorted(x.doc_id or 0 for x in d.clean(docs, frame).collect())
    monkeypatch.setattr(d._blocks, "__defaults__", (1500,))
    assert sorted(map(repr, d.find(docs, frame).collect())) == whole and whole
    assert sorted(x.doc_id or 0 for x in d.clean(docs, frame).collect()) == kept

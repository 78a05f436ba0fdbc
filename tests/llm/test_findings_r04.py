"""Findings of round 4 on the training-data operators."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veilframe.llm import collocations, exchange, simhash, suffix_dedup

LARGE = (1 << 60) + 1
ROWS = [(i, f"{i} " + " ".join(f"w{k * i % 97}" for k in range(400)), "x") for i in range(60)] + [(LARGE, "far", "x"), (None, "none", "x"), (None, None, "x")]


def test_texts_and_anchors_travel_packed(spark):
    """a group's rows are compressed before they are sorted; an anchor's key goes to its bucket once, as a difference."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(2)
    grouped = exchange.grouped_documents(docs)[0].withColumn("pid", F.lit(0))
    packed = exchange.packed_groups(grouped).toPandas()
    assert packed["rows"].map(len).sum() * 2 < sum(len(t or "") for _, t, _ in ROWS)
    back = exchange.opener(grouped)(packed)
    assert sorted(zip(back["doc_id"].fillna(0).tolist(), back["text"])) == sorted((i or 0, t or "") for i, t, _ in ROWS)
    keys = [np.array([3, 9, 1 << 31]), np.array([9])]
    sent = spark.createDataFrame([(0, k, suffix_dedup.pack_sorted(x)) for k, x in enumerate(keys)], "bucket int, pid int, index binary")
    assert {r.pid: bytes(r.bits) for r in exchange.shared_keys(sent, suffix_dedup._keys_of).collect()} == {0: b"\x40", 1: b"\x80"}


def test_a_text_travels_once(spark):
    """the pipeline's third stage carries of a text's column only whether it is null; the second deals texts once."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(2)
    sent = docs.select(*(value.alias(name) for name, value, _ in suffix_dedup._carried(docs))).toDF("doc_id", "text", "lang").collect()
    assert {r.text for r in sent} == {None, ""}
    out = {(r.doc_id, r.text) for r in suffix_dedup.strip(docs).collect()}
    assert {(LARGE, "far"), (None, "none"), (None, None)} <= out and len(out) == len(ROWS)


def _ran(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_texts_are_dealt_once(spark):
    """rows that met their component's id by id are told from their repeats where they lie."""
    docs = spark.createDataFrame([*ROWS, *ROWS], "doc_id long, text string, lang string").repartition(2)
    kept = simhash.keep_first(docs)
    one = lambda rows: sorted((r.doc_id or 0, r.text or "") for r in rows.collect())
    assert one(kept) == one(simhash.keep_first(docs.distinct()))
    assert kept.columns == docs.columns
    assert not any("text" in line for line in _ran(kept).split("\n") if "hashpartitioning" in line)


def test_exploded_tables_are_not_broadcast(spark):
    """neither side of the join of fingerprints and bucket sizes goes to the driver, however small Spark takes it for."""
    near = [(i, i ^ (1 << i % 60)) for i in range(1, 200)]
    frame = spark.createDataFrame([(x,) for pair in near for x in {*pair}], "fp long").distinct()
    linked = simhash.links(frame)
    assert "BroadcastHashJoin" not in _ran(linked)


def test_words_travel_by_bucket(spark):
    """a chunk sends its words to a bucket as one row, and a bucket counts them at once."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)] + ["Ümlaut", "日本", "a\x00b"]
    made = [("en" if i % 2 else "de", " ".join(rng.choice(words, 200)) + ";.  \t\n") for i in range(80)] + [("fr", None), ("fr", " ;\t")]
    frame = spark.createDataFrame(made, "lang string, text string").repartition(3)
    packed = collocations.chunks(frame, 4, 1 << 12).cache()
    nodes = packed.where("bucket < 0").count()
    assert nodes > 8 and packed.count() <= 5 * nodes
    wanted = Counter((lang, w.encode()) for lang, text in made for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "").replace(";", " ").replace(".", " ")).split())
    found = collocations._often(packed, 30, nodes).collect()
    assert {(r.lang, bytes(r.word)): -r.rare for r in found} == {k: n for k, n in wanted.items() if n >= 30}
    sizes = {r.chunk: r.size for r in packed.where("bucket < 0").collect()}
    assert all(0 <= x.local < sizes[x.chunk] for r in found for x in r.chunks) and sum(map(len, (r.chunks for r in found))) >= len(found)

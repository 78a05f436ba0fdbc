"""Manifest, phrases and shards against brute force, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import collocations, merkle, sharding

LONG = "long long ago " * 40_000


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ROWS = [(i, f"Text NUMBER {i} of many", "en", "hot", i % 7) for i in range(300)] + [
    (7, None, "de", None, None), (8, "", None, None, 0), (9, "Lone", "fr", "alone", 4), (10, LONG, "en", "ünï", len(LONG)), (11, "same", "en", "ünï", 4), (11, "same", "en", "ünï", 4), (None, "no id", "en", "hot", 5), (None, "No ID", "en", "hot", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS g", "'x' AS place", "2 AS slot", "3 AS shard", "4 AS digest", "5 AS virtual_slot", "6 AS chunk").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _climb(level):
    """Root and each leaf's (left, right) siblings, level by level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for path, i in zip(paths, at):
            path.append(("".join(level[i // 16 * 16 : i]), "".join(level[i + 1 : i // 16 * 16 + 16])))
        at = [i // 16 for i in at]
        level = [_sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def test_manifest(docs, empty, spark):
    built = merkle.manifest(docs, carry={"now": merkle.leaf([F.col(c) if c != "text" else merkle.tampered_text(F.col("doc_id"), F.col("text")) for c in merkle.COLUMNS])})
    groups = defaultdict(list)
    for row in ROWS:
        groups[row[3]].append((row[0] is not None, row[0], _leaf(row), _leaf(row, True)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: _climb([x[2] for x in sorted(groups[s])]) for s in order}
    root, above = _climb([inner[s][0] for s in order])
    wanted = []
    for s, top in zip(order, above):
        for (_, doc_id, leaf, now), path in zip(sorted(groups[s]), inner[s][1]):
            fold = now
            for left, right in path + top:
                fold = _sha(left + fold + right)
            wanted.append((doc_id, leaf, inner[s][0], _sha("".join(a + b for a, b in path + top)), fold, fold == root))
    got = built.proofs().select("node.key", "node.digest", "subroot", F.sha2(merkle.siblings(F.col("path")), 256), merkle.folded(F.col("node.now"), F.col("path")).alias("fold"))
    got = [(*r, r.fold == built.root) for r in got.collect()]
    assert built.root == root
    assert Counter(got) == Counter(wanted)
    assert {r.source: r.subroot for r in built.subroots().collect()} == {s: inner[s][0] for s in order}
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)
    nothing = merkle.manifest(empty)
    assert nothing.root is None and nothing.proofs().count() == 0
    one = merkle.manifest(docs.where("source = 'alone'"))
    assert one.root == _leaf(ROWS[302]) and one.proofs().first().path == []


def test_phrases(docs, empty, spark):
    rng = np.random.default_rng(3)
    words = ["a", "b", "Cc", "über", "日本", "x\x1cy", "\x00"]
    made = [("de" if i % 3 else None, " ".join(rng.choice(words, 40, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])) + ("; \t" if i % 2 else "\n")) for i in range(60)]
    made += [("en", None), ("en", ""), ("en", " ;;\t,"), ("en", LONG), ("und", "a b cc a b cc")]
    frame = spark.createDataFrame(made, "lang string, text string").withColumn("words", F.lit(1)).repartition(4)
    least = 8
    counts, total = defaultdict(Counter), Counter()
    for lang, text in made:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 6):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    wanted = []
    for lang, f in counts.items():
        found, kept = {p: a for p, a in f.items() if a >= least and len(p) > 1}, []
        longer = {}
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer.get(p[i : i + m], 0), a)
        for p, a in found.items():
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if longer.get(p, 0) < a:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        wanted += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:50], 1)]
    for size, fan in ((1 << 10, 2), (1 << 20, 64)):
        got = collocations.collocations(frame, least=least, top=50, size=size, fan=fan)
        assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)
    assert len(wanted) > 50
    assert collocations.collocations(empty).count() == 0


def test_tiles_count_like_a_dictionary():
    rng = np.random.default_rng(4)
    a, b = (np.concatenate([rng.integers(0, 300, 60_000), rng.integers(0, 1 << 32, 5_000)]).astype(np.uint64) for _ in range(2))
    code = collocations.codes(a, b)
    assert all((x == y).all() for x, y in zip(collocations.pair_of(code), (a, b)))
    got, n = collocations.counted(code)
    wanted, m = np.unique(code, return_counts=True)
    assert (got == wanted).all() and (n == m).all()
    weight = rng.integers(1, 1 << 40, len(code))
    got, n = collocations.counted(code, weight)
    sums = defaultdict(int)
    for c, w in zip(code.tolist(), weight.tolist()):
        sums[c] += w
    assert dict(zip(got.tolist(), n.tolist())) == sums
    assert (collocations.unpack_sorted(collocations.pack_sorted(wanted)) == wanted).all()


def test_shards(docs, empty, spark):
    hot = [(None, "copy")] * 500 + [(3, "copy")] * 100
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(hot, "doc_id long, text string"))
    found = sharding.records(rows)
    load = sharding.loads(found)
    log = sharding.first_map(spark)
    edits = sharding.rebalanced(log, load)
    both = log.unionByName(edits).cache()
    now = sharding.map_at(both)
    got = sharding.places(found, now, load).collect()
    texts = [(r[0], r[1]) for r in ROWS] + hot
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in texts)
    for shard in range(16):
        mine = [r.place for r in got if r.shard == shard]
        assert sorted(mine) == list(range(len(mine)))
    # The long text fills one shard; the others share the rest evenly, but for what no move can split (one virtual slot).
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    slots = {r.slot: r.bytes for r in load.collect()}
    rest = sorted(sums.values())[:-1]
    assert max(rest) - min(rest) <= sorted(slots.values())[-2]
    assert {(r.slot, r.shard) for r in sharding.map_at(both, 0).collect()} == {(s, s % 16) for s in range(sharding.SLOTS)}
    # One more shard takes slots only into itself.
    before = {r.slot: r.shard for r in now.collect()}
    after = {r.slot: r.shard for r in sharding.map_at(both.unionByName(sharding.grown(both, load))).collect()}
    moved = {s for s in after if after[s] != before[s]}
    assert moved and all(after[s] == 16 for s in moved)
    assert sharding.rebalanced(log, sharding.loads(sharding.records(empty))).count() == 0
    assert sharding.places(sharding.records(empty), now, sharding.loads(sharding.records(empty))).count() == 0
    kept = sharding.assigned(docs, now)
    assert kept.count() == len(ROWS) and set(docs.columns) == set(kept.columns)


def test_shards_are_near_equal(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', CAST(1 + pow(id % 97, 2) AS INT)) AS text")
    found = sharding.records(rows)
    load, log = sharding.loads(found), sharding.first_map(spark)
    now = sharding.map_at(log.unionByName(sharding.rebalanced(log, load)))
    sums = [r["sum(size)"] for r in found.join(now, "slot").groupBy("shard").sum("size").collect()]
    assert len(sums) == 16 and max(sums) <= 1.001 * min(sums)

"""Each operator against a brute-force version, a round trip, or held-out accuracy, and on awkward rows."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import byte_bpe, decontamination, language_id, plane_files, quality_model, quality_rules, simhash, substring_dedup, suffix_dedup, toxicity
from veilframe.llm.components import components

A = " ".join(f"alpha{i}" for i in range(30))
B = " ".join(f"beta{i} ünï" for i in range(20))
ROWS = [
    (1, f"{A}\n{B}"), (2, A), (3, f"start {A} end"), (4, None), (5, ""), (6, "  \t\n"), (7, B), (7, B), (8, f"x {B[:60]}"), (9, "short"), (None, A), (10, "don't  stop\n\nnow, 123 ÄÖ €5 <|endoftext|>"), (11, "ab" * 400), (12, "ab" * 300),
    (13, f"{A}\n{A}\n{A} ### !! !!"), (14, "日本語 テスト。日本語 テスト。"), (15, A.upper()), (16, "a b c"), (17, "a b c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with clashing names must not matter.
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS lang", "1 AS fp", "2 AS pid", "3 AS n_chars").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_measures(docs, empty):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.ledger(docs).collect()}
    wanted = set()
    for doc_id, text in ROWS:
        w, seen, dup = _words(text), set(), 0
        for line in (text or "").split("\n"):
            if _words(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, x in enumerate(grams) if grams.count(x) > 1 for k in range(3)}
        wanted.add((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)))
    assert got == wanted
    assert quality_rules.ledger(empty).count() == 0


def test_policies_and_ablations(docs):
    rows = quality_rules.ledger(docs).cache()
    kept = quality_rules.apply_policy(rows, "v2")
    assert quality_rules.rejects_go(docs).count() == kept.where("kept").count()
    for r in quality_rules.ablations(rows, "v2").collect():
        bit = quality_rules.mask((r.rule,))
        own = [x.fail_bits & quality_rules.mask(quality_rules.POLICIES["v2"]) for x in rows.collect()]
        assert r.n_failed == sum(bool(b & bit) for b in own) and r.n_only_this == sum(b == bit for b in own)


def _fingerprint(text):
    w = _words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, empty):
    prints = simhash.fingerprints(docs)
    got = sorted((r.doc_id or -1, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.cluster(prints).collect())
    fps = [(d, _fingerprint(t)) for d, t in ROWS]
    root = list(range(len(fps)))
    for _ in fps:
        root = [min(root[j] for j in range(len(fps)) if (fps[i][1] ^ fps[j][1]).bit_count() <= 3) for i in range(len(fps))]
    wanted = sorted((d or -1, f, min(fps[j][0] for j in range(len(fps)) if root[j] == root[i] and fps[j][0] is not None)) for i, (d, f) in enumerate(fps))
    assert got == wanted
    assert simhash.cluster(simhash.fingerprints(empty)).count() == 0


def test_covering_masks_meet_every_pair():
    masks, rng = simhash.covering_masks()[0], np.random.default_rng(1)
    for _ in range(500):
        differ = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not differ & m for m in masks)


def test_hot_buckets_are_split_without_loss(spark):
    # A chain of fingerprints that agree on most bits: more than one bucket's share of them at a low limit.
    rng = np.random.default_rng(2)
    fps = sorted({int(x) for x in rng.integers(0, 1 << 12, 300)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    linked = {(r.node, r.root) for r in components(simhash.links(frame, most=16)).collect()}
    group = {f: f for f in fps}
    for _ in fps:
        new = {f: min(group[x] for x in fps if (x ^ f).bit_count() <= 3) for f in fps}
        if new == group:
            break
        group = new
    assert linked == {(f, r) for f, r in group.items() if f != r}


def test_substring_dedup(docs, empty):
    got = sorted((r.doc_id or 1 << 62, r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(docs).collect())
    windows, wanted = {}, []
    for d, text in ROWS:
        w = _words(text)
        for i in range(len(w) - 12):
            windows[tuple(w[i : i + 13])] = min(windows.get(tuple(w[i : i + 13]), 1 << 62), d or 1 << 62)
    for d, text in ROWS:
        w = _words(text)
        gone = {i + k for i in range(len(w) - 12) if windows[tuple(w[i : i + 13])] < (d or 1 << 62) for k in range(13)}
        wanted.append((d or 1 << 62, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(wanted)
    assert substring_dedup.deduplicate(empty).count() == 0


def _bytes_removed(length=50):
    first = {}
    for d, text in ROWS:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], 1 << 62), d or 1 << 62)
    out = []
    for d, text in ROWS:
        b = (text or "").encode()
        gone = {i + k for i in range(len(b) - length + 1) if first[b[i : i + length]] < (d or 1 << 62) for k in range(length)}
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((d or 1 << 62, len(b), len(gone), spans, bytes(x for i, x in enumerate(b) if i not in gone)))
    return sorted(out)


def test_suffix_dedup(docs, empty):
    got = sorted((r.doc_id or 1 << 62, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.deduplicate(docs).collect())
    assert got == _bytes_removed()
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_deep_shallow_order():
    rng = np.random.default_rng(3)
    data = np.frombuffer(bytes(rng.choice([97, 98], 400).astype(np.uint8)) + b"ab" * 100, dtype=np.uint8)
    at = np.arange(len(data) - 50)
    order, group = suffix_dedup.deep_shallow(data, at)
    strings = [data[i : i + 50].tobytes() for i in order]
    assert strings == sorted(strings) and sorted(order) == at.tolist()
    assert all((strings[i] == strings[i + 1]) == (group[i] == group[i + 1]) for i in range(len(at) - 1))


def test_strip_keeps_columns_and_characters(docs):
    out = suffix_dedup.strip(docs)
    assert out.dtypes == docs.dtypes and out.count() == len(ROWS)
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[4].text is None and by_id[1].text == ROWS[0][1] and by_id[2].text == "" and by_id[2].n_chars == 0


def test_byte_bpe_equals_tiktoken(docs, empty):
    path = public_tokenizers.path(byte_bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id or -1, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.encode(docs).collect())
    wanted = sorted((d or -1, len(ids := coder.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for d, t in ROWS)
    assert got == wanted
    assert byte_bpe.encode(empty).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_plane_files(spark, docs, empty, tmp_path, bits):
    tk = Tokenizer.from_file(public_tokenizers.path(plane_files.TOKENIZER))
    plane_files.write(docs, str(tmp_path / "a"), bits=bits)
    got = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in plane_files.read(spark, str(tmp_path / "a")).collect())
    wanted, start = [], 0
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        wanted.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == wanted
    plane_files.write(empty, str(tmp_path / "b"))
    assert plane_files.read(spark, str(tmp_path / "b")).count() == 0


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, plane_files.BLOCK, 3 * plane_files.BLOCK + 5):
        ids = rng.integers(0, 50257, n).astype("<u4")
        for bits in (False, True):
            names, sizes, back = plane_files.unpack(plane_files.pack(np.array([5]), np.array([n]), ids, bits=bits))
            assert (back == ids).all() and names.tolist() == [5] and sizes.tolist() == [n]


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, A), (2, " ".join(A.split()[:6])), (3, "b c"), (4, None), (5, ""), (6, "nothing of this is anywhere at all"), (1, A)], "item_id long, text string")
    shingles = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    wanted = []
    for d, t in ROWS:
        for r in items.collect():
            w = _words(r.text)
            if w:
                n = min(5, len(w))
                own = shingles([x.lower() for x in w], n)
                shared = len(own & shingles([x.lower() for x in _words(t)], n))
                if shared * 10 >= len(own) * 8:
                    wanted.append((d or -1, r.item_id, len(own), shared))
    got = [(r.doc_id or -1, r.item_id, r.n_shingles, r.n_shared) for r in decontamination.find(docs, items).collect()]
    assert sorted(got) == sorted(wanted)
    dirty = {w[0] for w in wanted}
    assert sorted(r.doc_id or -1 for r in decontamination.clean(docs, items).collect()) == sorted(d or -1 for d, _ in ROWS if (d or -1) not in dirty)
    assert decontamination.find(empty, items).count() == 0 and decontamination.find(docs, items.limit(0)).count() == 0


def test_toxicity_grammar():
    g = toxicity.Grammar({"idiot$": 4.0, "vequ": 3.0}, (3.0, -4.0))
    base = g.clauses("such an idiot here")
    assert base == [4.0] and g.clauses("you are an idiot")[0] > 4.0 > g.clauses("not an idiot")[0]
    assert g.clauses("he said an idiot was there")[0] < 4.0 and g.clauses("I will kill")[0] == toxicity.THREAT
    assert g.clauses("not here. idiot vequxx, fine.") == [7.0] and g.clauses(None) == [] and g.clauses("idiotic words") == []


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


def _held_out(spark, sf, query, column):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = query(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(column).alias("y")).collect()
    return float(np.mean([r.predicted == r.y for r in rows])), rows


def test_quality_model_held_out(spark, sf):
    accuracy, rows = _held_out(spark, sf, quality_model.op1, "quality")
    assert accuracy >= 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_held_out(spark, sf):
    accuracy, rows = _held_out(spark, sf, toxicity.op3, "toxic")
    assert accuracy >= 0.88 and all(0 <= r.score <= 1 for r in rows)


def test_language_held_out(spark, sf, docs, empty):
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = language_id.op6(spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95
    none = docs.sparkSession.createDataFrame([], "doc_id long, label string")
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs, none)).collect()} == {"und"}
    assert language_id.predict(empty, None).count() == 0


def test_models_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality_model.score(docs, quality_model.fit(docs, none)).collect()} == {0.5}
    assert all(r.score < 0.01 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 1) for i in range(6)]
    rows += [(10, rows[0][1], "en", "s", 1), (11, f"{' '.join(f'q{k}' for k in range(60))} {rows[1][1][:200]}", "en", "s", 1), (12, "few words", "en", "s", 1), (13, f"{' '.join(f'z{k}' for k in range(60))} {A}", "en", "s", 1), (14, None, "en", "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, A)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 11]
    assert got[11].decoded_sha256 == hashlib.sha256((" ".join(f"q{k}" for k in range(60)) + " ").encode()).hexdigest()
    assert got[2].decoded_sha256 == hashlib.sha256(rows[2][1].encode()).hexdigest()


def _tiktoken():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_byte_bpe_long_words_and_small_blocks(spark):
    rng, (coder, _) = np.random.default_rng(4), _tiktoken()
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = [letters(1 << 20), f"a {letters(byte_bpe.LONG)} {letters(byte_bpe.LONG + 1)} b", "\n" * 300 + "x" * 5000, "é" * 200, " " * 200 + "end", "a  b \n c　 d e", "Ⅻ½٩ x²", "word, " * 9000, "", " "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts[1:5])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    wanted = sorted((i, np.array(coder.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in rows)
    for size in (byte_bpe.BLOCK, 1000):
        assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.encode(frame, size=size).collect()) == wanted


def test_block_words_are_the_patterns():
    import random

    import pyarrow as pa
    import regex

    rng, pattern = random.Random(7), regex.compile(public_tokenizers.PATTERN)
    texts = ["".join(rng.choices(["a", "Z", "é", " ", "  ", "\n", "\t", "'s", "'", "1", ".", ",", "!!", "\xa0", "　", "日", "_", "\x1c", "\x01"], k=rng.randrange(0, 14))) for _ in range(20000)]
    block = byte_bpe._Block(public_tokenizers.PATTERN)
    for k in range(0, len(texts), 3000):
        block.add(pa.array(range(k, k + len(texts[k : k + 3000])), pa.int64()), pa.array(texts[k : k + 3000]))
    row = block.row(dict)
    words = [bytes(w).decode() for w in row.column(0)[0].as_py()]
    assert {d["doc_id"]: [words[i] for i in d["at"]] for d in row.column(1)[0].as_py()} == {i: pattern.findall(t) for i, t in enumerate(texts)}


def test_heap_equals_the_order_of_ranks():
    (coder, ranks), rng = _tiktoken(), np.random.default_rng(9)
    for n in (1, 2, 30, 400):
        word = bytes(rng.choice(list(b"abcdenst "), n).astype(np.uint8))
        assert [ranks[p] for p in byte_bpe.heap_pieces(word, ranks)] == coder._encode_single_piece(word)


def test_decode_concatenates_pieces(spark):
    coder, _ = _tiktoken()
    ids = coder.encode_ordinary("daß 日本 €5")
    frame = spark.createDataFrame([(ids,), ([],)], "ids array<int>")
    out = frame.select(byte_bpe.with_ranks(public_tokenizers.path(byte_bpe.RANKS), lambda r: byte_bpe.decode(F.col("ids"), r)).alias("b")).collect()
    assert [bytes(r.b) for r in out] == ["daß 日本 €5".encode(), b""]


def test_strip_carries_every_type_exactly(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        A2 = " ".join(f"gamma{i}" for i in range(30))
        docs = spark.createDataFrame([(1, A2), (2, A2), (3, None), (None, "x")], "doc_id int, text string").selectExpr(
            "*", "timestamp_micros(1729991400123456) AS again", "struct(timestamp_micros(1729987800123456) AS t, array(1.5D, double('NaN'), NULL) AS a, NULL AS n) AS s", "map(1, timestamp_micros(1), 2, NULL) AS m", "CAST('12345678901234567890.12' AS DECIMAL(30,2)) AS d",
            "unhex('FF00') AS b", "CAST('NaN' AS FLOAT) AS f", "CAST(9007199254740993 AS BIGINT) AS big", "IF(doc_id = 1, NULL, true) AS flag", "DATE'0999-01-01' AS day", "TIMESTAMP_NTZ'2024-10-27 02:30:00.123456' AS ntz", "INTERVAL '1 02:03:04.5' DAY TO SECOND AS span",
            "named_struct('a b', CAST(NULL AS STRUCT<x: INT>)) AS odd", "array(map('k', unhex('00'))) AS deep", "7 AS __c0", "9 AS n_chars",
        )
        out = suffix_dedup.strip(docs)
        assert out.dtypes == docs.dtypes
        as_text = lambda frame: sorted(str(r) for r in frame.selectExpr("doc_id", "to_json(struct(* EXCEPT (text, n_chars, flag))) AS j", "hex(b)", "cast(again AS bigint)", "unix_micros(again)", "unix_micros(s.t)", "map_values(m)", "flag").collect())
        assert as_text(out) == as_text(docs)
        assert {(r.doc_id, r.text, r.n_chars) for r in out.select("doc_id", "text", "n_chars").collect()} == {(1, A2, 9), (2, "", 0), (3, None, 9), (None, "x", 9)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_near_duplicates_with_clashing_columns_and_hot_prints(spark, monkeypatch):
    rows = [(i, "one and the same text here", 1) for i in range(40)] + [(100 + i, f"other words {i} x{i} y{i} z{i}", 2) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __kept long").selectExpr("*", "5 AS component_id", "6 AS root")
    wanted = {0, *range(100, 105)}
    for share in (2, 10_000):
        monkeypatch.setattr(simhash, "HOT_SHARE", share)
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == wanted
        assert simhash.cluster(simhash.fingerprints(docs)).where("doc_id < 100 AND component_id <> 0").count() == 0


def test_suffix_dedup_of_a_long_text(spark):
    rng = np.random.default_rng(8)
    part = "".join(map(chr, rng.integers(97, 123, 60_000)))
    rows = [(1, part), (2, f"{part[100:30_000]}-{part[40_000:40_050]}-{part[50_000:50_049]}-{'ab' * 500}"), (3, "ab" * 400)]
    got = {r.doc_id: (r.n_removed, len(r.spans)) for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (29_900 + 50, 2), 3: (800, 1)}


def test_letters_decide_what_has_a_language(spark):
    docs = spark.createDataFrame([(1, "½ ² ① 12 _ Ⅻ"), (2, "é"), (3, ""), (4, None)], "doc_id long, text string")
    texts = spark.createDataFrame([(i, w * 20, k) for i, (w, k) in enumerate([("the cat sat ", "en"), ("le chat noir ", "fr")] * 20)], "doc_id long, text string, lang string")
    model = language_id.fit(texts, texts.select("doc_id", F.col("lang").alias("label")))
    assert [r.doc_id for r in language_id.predict(docs, model).where("lang_pred = 'und'").orderBy("doc_id").collect()] == [1, 3, 4]


def test_empty_tables(spark, empty, tmp_path):
    import corpus_pipeline

    none = spark.createDataFrame([], "doc_id long, label int")
    assert quality_model.score(empty, quality_model.fit(empty, none)).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_toxicity_targets_and_contrasts():
    g = toxicity.Grammar({"idiot$": 4.0}, (3.0, -4.0))
    assert g.clauses("an idiot is what you are") == [6.0] and g.clauses("not only here but an idiot") == [4.0] and g.clauses("not a single one idiot here") == [1.6]
    assert g.clauses("no a b c d idiot") == [4.0] and g.clauses("idiot. you are here") == [4.0]


def test_registered_sql_is_text():
    from veilframe.llm import registry

    assert all(isinstance(sql, str) for sql in registry.oracle_sql().values()) and registry.oracle_sql().keys() <= registry.queries().keys()


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from veilframe.shared import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))

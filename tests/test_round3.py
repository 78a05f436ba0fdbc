"""Row bitmaps, block files, timed release, scheduling and watchlists: by hand and against brute force."""

import random

from pyspark.sql import functions as F

from veilframe.functions import geometry as g
from veilframe.operators import evaluate as e
from veilframe.operators import relations as r
from veilframe.operators import spans
from veilframe.sources import blocks as b
from veilframe.streaming import timed


def _polygons(n, seed):
    rng = random.Random(seed)
    return [[[rng.random(), rng.random()] for _ in range(rng.choice([3, 4, 5, 8]))] for _ in range(n)]


def test_bit_rows_are_the_cells(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(_polygons(60, 1))], "i int, poly array<array<double>>").repartition(3)
    for grid in (64, 100, 256):
        found = rows.select(g.cells(F.col("poly"), grid).alias("cells"), g.bit_rows(F.col("poly"), grid).alias("bits"), g.cell_count(F.col("poly"), grid).alias("n")).collect()
        for r in found:
            packed = sorted(x["y"] * grid + 64 * i + k for x in r.bits for i, w in enumerate(x["words"]) for k in range(64) if (w & (1 << 64) - 1) >> k & 1)
            assert packed == sorted(set(r.cells)) and r.n == len(packed)


def test_raster_counts_at_the_full_grid(spark):
    t = [(i % 6, i, "A" if i % 3 else "B", p) for i, p in enumerate(_polygons(24, 2))]
    p = [(i % 7, i, "A" if i % 2 else "B", q) for i, q in enumerate(_polygons(30, 3))]
    targets = spark.createDataFrame(t, "frame int, obj int, category string, poly array<array<double>>")
    findings = spark.createDataFrame(p, "frame int, pred int, p_category string, poly array<array<double>>")
    cells = lambda df, key: {r[key]: set(r.c) for r in df.select(key, g.cells(F.col("poly"), 256).alias("c")).collect()}
    ct, cp = cells(targets, "obj"), cells(findings, "pred")
    wanted = []
    for frame in {x[0] for x in t} | {x[0] for x in p}:
        used, covered, recalled = set(), set(), 0
        for _, obj, category, _ in sorted(x for x in t if x[0] == frame):
            options = [(len(ct[obj] & cp[q[1]]), q[1]) for q in p if q[0] == frame and q[2] == category and q[1] not in used]
            if options and max(options)[0]:
                used.add(max(options)[1])
                covered |= ct[obj] & cp[max(options)[1]]
                recalled += 1
        truth = set().union(*(ct[x[1]] for x in t if x[0] == frame))
        found = set().union(*(cp[x[1]] for x in p if x[0] == frame))
        n_p = sum(x[0] == frame for x in p)
        wanted.append((frame, sum(x[0] == frame for x in t), recalled, len(truth), len(covered), len(found), len(found - truth), n_p, n_p - recalled))
        sets = e.mask_sets(targets, findings, 256).where(F.col("frame") == frame).first()
        assert tuple(sets)[1:] == (len(truth | found), len(truth & found), len(truth - found), len(found - truth))
    counts = e.raster_counts(targets, findings, 256)
    assert sorted(tuple(r) for r in counts.collect()) == sorted(wanted)
    assert e.raster_counts(targets.limit(0), findings.limit(0)).count() == 0


def _parsed(text):
    """Boxes and errors of one file, line by line."""
    lines, i, seen, boxes, errors = text.split("\n"), 0, set(), [], []
    while i < len(lines):
        name, at = lines[i].strip().lstrip("﻿").strip(), i
        i += 1
        if not name:
            continue
        safe = b.safe_name(name)
        if safe is None:
            errors.append((at, "name"))
        if (safe or name) in seen:
            errors.append((at, "duplicate"))
        seen.add(safe or name)
        if i >= len(lines):
            errors.append((at, "no_count"))
            break
        count = b.whole_number(lines[i])
        if count is None or count < 0:
            errors.append((i, "count" if count is None else "negative"))
            break
        i += 1
        if count == 0 and i >= len(lines):
            errors.append((i - 1, "no_placeholder"))
        elif count == 0:
            if lines[i].split() != ["0"] * 10:
                errors.append((i, "placeholder"))
            i += 1
        for k in range(count):
            if i >= len(lines):
                errors.append((i - 1, "truncated"))
                break
            f = lines[i].split()
            v = [b.whole_number(x) for x in f[:10]]
            if len(f) < 10:
                errors.append((i, "fields"))
            elif None in v:
                errors.append((i, "integer"))
            boxes.append((safe or name, at, count, k + 1, (v + [None])[0]))
            i += 1
    return boxes, errors


def test_block_files_however_they_are_cut(spark):
    rng, files = random.Random(7), {}
    pieces = ["a/b.jpg", "x.jpg", "../up.jpg", "/abs.jpg", "7", "0", "1", "2", "many", "-1", "1 2 3 4 5 6 7 8 9 10", "1 2 3 4 5 6 7 8 9 z", "1 2", "0 0 0 0 0 0 0 0 0 0", "9 9 9 9 9 9 9 9 9 9", "", "  ", "c\\d.png", ".", "3 "]
    for k in range(150):
        files[f"f{k}"] = "\n".join(rng.choices(pieces, weights=[6, 6, 1, 1, 1, 6, 8, 6, 1, 0.3, 12, 1, 1, 6, 1, 3, 1, 1, 1, 2], k=rng.randint(1, 40)))
    good = "\n".join(f"n{i}.jpg\n{i % 4}\n" + "\n".join(["1 2 3 4 5 6 7 8 9 10"] * (i % 4) or ["0 0 0 0 0 0 0 0 0 0"]) for i in range(60))
    files |= {"good": "﻿" + good, "last": "a.jpg", "short": "a.jpg\n3\n1 2 3 4 5 6 7 8 9 10", "zero": "a.jpg\n0", "huge": f"a.jpg\n{10**30}\n1"}
    rows = [(f, i, raw) for f, text in files.items() for i, raw in enumerate(text.split("\n"))]
    lines = spark.createDataFrame(rows, "file string, at long, raw string").repartition(5)
    wanted = {f: _parsed(text) for f, text in files.items() if f != "huge"}
    for chunk in (1, 3, 1 << 16):
        labelled = b.block_lines(lines, chunk).cache()
        got = {f: ([], []) for f in files}
        for r in b.block_text(lines, chunk, labelled).collect():
            got[r.file][0].append((r.filename, r.block, r.declared, r.box, r.x))
        for r in b.block_errors(labelled).collect():
            got[r.file][1].append((r.at, r.code))
        assert {f: (sorted(x, key=str), sorted(y)) for f, (x, y) in got.items() if f != "huge"} == {f: (sorted(x, key=str), sorted(y)) for f, (x, y) in wanted.items()}
        assert got["huge"][1] == [(2, "fields"), (2, "truncated")]
    assert b.block_errors(b.block_lines(lines.limit(0))).count() == 0


def _outcomes(policy, rows):
    state, out = policy.start(), []
    for row in rows:
        state, made = policy.row(state, row)
        out += made
    return [r[1:] for r in out + policy.rest(rows[-1][0], state)]


def _frame(at, frame, thermal="NOMINAL", scene=False):
    return ("s", at, "FRAME", frame, thermal, scene, None)


def _done(at, frame, until):
    return ("s", at, "DONE", frame, None, None, until)


def test_schedule_by_hand():
    lane = timed.schedule(10, 20, 15, 30)
    # A start, a busy drop, an end, a cadence skip, a start at a changed scene.
    rows = [_frame(0, 0), _frame(3, 1), _done(5, 0, 9), _frame(6, 2), _frame(8, 3, scene=True), _done(9, 3, 20)]
    assert _outcomes(lane, rows) == [(0, "STARTED"), (1, "BUSY"), (0, "COMPLETED"), (2, "SKIPPED"), (3, "STARTED"), (3, "COMPLETED")]
    # A changed scene revokes what runs and starts the next; the revoked result is ignored.
    rows = [_frame(0, 0), _frame(2, 1, scene=True), _done(3, 0, 9), _done(4, 1, 9)]
    assert _outcomes(lane, rows) == [(0, "STARTED"), (0, "SCENE_REVOKED"), (1, "STARTED"), (0, "IGNORED"), (1, "COMPLETED")]
    # Severe heat revokes and disables; a warning makes the interval longer.
    rows = [_frame(0, 0), _frame(2, 1, "SEVERE"), _frame(4, 2, "SEVERE"), _frame(12, 3, "WARNING"), _frame(20, 4, "WARNING")]
    assert _outcomes(lane, rows) == [(0, "STARTED"), (0, "HEAT_REVOKED"), (1, "DISABLED"), (2, "DISABLED"), (3, "SKIPPED"), (4, "STARTED")]
    # Not later than the last frame; results that are stale at the latest frame, too long, or failed.
    rows = [_frame(5, 0), _frame(5, 1), _frame(4, 2), _frame(9, 3), _done(10, 0, 8), _frame(20, 4), _done(21, 4, 51), _frame(40, 5), _done(41, 5, None)]
    assert _outcomes(lane, rows) == [(0, "STARTED"), (1, "STALE"), (2, "STALE"), (3, "BUSY"), (0, "INVALID"), (4, "STARTED"), (4, "INVALID"), (5, "STARTED"), (5, "FAILED")]
    # A mandatory lane past its deadline is revoked and may start at once; scenes and heat do not touch it.
    face = timed.schedule(10, 20, 15, 30, optional=False)
    rows = [_frame(0, 0), _frame(14, 1, "SEVERE", True), _frame(15, 2), _done(16, 0, 20), _frame(17, 3, scene=True)]
    assert _outcomes(face, rows) == [(0, "STARTED"), (1, "BUSY"), (0, "DEADLINE_REVOKED"), (2, "STARTED"), (0, "IGNORED"), (3, "BUSY")]


def _unit(arrival, pts, size, unit, kind="media", event=None):
    return ("s", arrival, pts, size, kind in ("config", "both"), kind in ("key", "both"), unit, event)


def test_release_by_hand():
    # The case of the review: the configuration's bytes are given back when it leaves, so later media fits.
    policy = timed.release(delay_ns=1000, most_bytes=100, most_us=10)
    rows = [_unit(0, 0, 5, 0, "key"), _unit(1, 0, 60, 1, "config"), _unit(2, 0, 5, 2), _unit(3, 1, 30, 3, "key"), _unit(5000, 5, 60, 4)]
    assert _outcomes(policy, rows) == [(0, "AWAITING_CONFIGURATION", None), (1, "ACCEPTED", None), (2, "AWAITING_KEY", None), (3, "ACCEPTED", 2000), (1, "RELEASED", 2000), (3, "RELEASED", 2000), (4, "ACCEPTED", 6000), (4, "RELEASED", 6000)]
    # A configuration above the bound, and media beyond bytes or span, stop the session; what waited is cleared.
    assert _outcomes(policy, [_unit(0, 0, 500, 0, "config"), _unit(1, 0, 1, 1)]) == [(0, "OVERFLOW", None), (1, "STOPPED", None)]
    start = [_unit(0, 0, 10, 0, "config"), _unit(1, 0, 10, 1, "key")]
    assert _outcomes(policy, [*start, _unit(2, 11, 1, 2)])[2:] == [(0, "CLEARED", None), (1, "CLEARED", None), (2, "OVERFLOW", None)]
    assert _outcomes(policy, [*start, _unit(2, 1, 81, 2)])[-1] == (2, "OVERFLOW", None)
    assert _outcomes(policy, [*start, _unit(2, 5, 1, 2), _unit(3, 4, 1, 3)])[-1] == (3, "INVALID_ORDER", None)
    # Once all has left, the order is checked anew, and so is the span.
    assert _outcomes(policy, [*start, _unit(9000, 0, 1, 2)])[-2:] == [(2, "ACCEPTED", 1000), (2, "RELEASED", 1000)]
    # A reconnect drops the queue and waits for a configuration; a new configuration clears; a stop ends it.
    assert _outcomes(policy, [*start, _unit(2, 0, 0, None, event="RECONNECT"), _unit(3, 1, 1, 2)])[2:] == [(0, "CLEARED", None), (1, "CLEARED", None), (2, "AWAITING_CONFIGURATION", None)]
    assert _outcomes(policy, [*start, _unit(2, 0, 1, 2, "both")])[2:] == [(0, "CLEARED", None), (1, "CLEARED", None), (2, "ACCEPTED", None)]
    assert _outcomes(policy, [*start, _unit(2, 0, 0, None, event="STOP"), _unit(3, 0, 1, 3, "config")])[-1] == (3, "STOPPED", None)


def _wait(at, kind, frame=None, of=None, ready=True, shield=False, basis="FRESH"):
    return ("s", at, kind, frame, of, ready, shield, basis)


def test_waiting_frames_by_hand():
    policy = timed.waiting(budget=100, capacity=4)
    # A decision on the second frame does not let it pass the first; both leave in order, the deadline included.
    assert _outcomes(policy, [_wait(0, "FRAME", 0), _wait(10, "FRAME", 1), _wait(20, "DECISION", of=10), _wait(100, "DECISION", of=0)]) == [(0, "RELEASED"), (1, "RELEASED")]
    # None by the deadline: all that wait are shielded, and so is what follows until recovery is verified.
    rows = [_wait(0, "FRAME", 0), _wait(10, "FRAME", 1), _wait(20, "DECISION", of=10), _wait(101, "FRAME", 2), _wait(102, "VERIFY"), _wait(103, "FRAME", 3), _wait(104, "DECISION", of=103)]
    assert _outcomes(policy, rows) == [(0, "TIMEOUT_SHIELD"), (1, "TIMEOUT_SHIELD"), (2, "ERROR_SHIELD"), (3, "RELEASED")]
    # A full queue shields the frame that fills it too.
    assert _outcomes(policy, [_wait(i, "FRAME", i) for i in range(5)]) == [*((i, "TIMEOUT_SHIELD") for i in range(4)), (4, "ERROR_SHIELD")]
    # An unsafe basis latches, a safe shield does not; a frame that was not ready is shielded alone; a latch is not hidden by it.
    rows = [_wait(0, "FRAME", 0), _wait(1, "FRAME", 1, ready=False), _wait(2, "FRAME", 2), _wait(3, "DECISION", of=0, shield=True, basis="CARRIED"), _wait(4, "DECISION", of=1), _wait(5, "DECISION", of=2, shield=True, basis="STALE"), _wait(6, "FRAME", 3, ready=False)]
    assert _outcomes(policy, rows) == [(0, "CARRIED_SHIELD"), (1, "UNREADY_SHIELD"), (2, "STALE_SHIELD"), (3, "ERROR_SHIELD")]
    # A fault shields all; a decision may come before its frame; without any further row the deadline still comes.
    assert _outcomes(policy, [_wait(0, "FRAME", 0), _wait(1, "FAIL"), _wait(2, "FRAME", 1)]) == [(0, "ERROR_SHIELD"), (1, "ERROR_SHIELD")]
    assert _outcomes(policy, [_wait(0, "DECISION", of=5), _wait(5, "FRAME", 0), _wait(6, "FRAME", 1)]) == [(0, "RELEASED"), (1, "TIMEOUT_SHIELD")]


def test_timers_in_a_stream_give_the_rows_of_the_batch(spark, tmp_path):
    ms, rng = 1_000_000, random.Random(5)
    rows = []
    for session in range(4):
        for i in range(40):
            at = (1_000_000 + i * 30 + session) * ms
            rows.append((session, at, "FRAME", i, None, rng.random() < 0.9, None, None))
            if rng.random() < 0.9:
                rows.append((session, at + rng.randint(1, 110) * ms, "DECISION", i, at, None, rng.random() < 0.1, rng.choice(["CARRIED", "STALE"])))
            if rng.random() < 0.2:
                rows.append((session, at + 7 * ms, "VERIFY", None, None, None, None, None))
    schema = "session long, at long, kind string, frame long, of long, ready boolean, shield boolean, basis string"
    out, order, policy = "session long, frame long, outcome string", ["at", "kind", "frame"], timed.waiting(capacity=6)
    batch = sorted(map(tuple, timed.timed_fold(spark.createDataFrame(rows, schema), "session", order, policy, out).collect()))
    # Each file's rows in any order, and some rows in the file after theirs: late, but within the watermark.
    rows.sort(key=lambda r: r[1])
    for k in range(4):
        part = [r for i, r in enumerate(rows) if (i + (5 if i % 11 == 0 else 0)) // (len(rows) // 4 + 1) == k]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    far = [(s, 1_060_000 * ms, "VERIFY", None, None, None, None, None) for s in (99,)]
    spark.createDataFrame(far, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = timed.timed_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "session", order, policy, out, late="2 seconds")
    query = stream.writeStream.format("memory").queryName("timed_rows").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert sorted(map(tuple, spark.table("timed_rows").collect())) == batch
    assert {r[2] for r in batch} >= {"RELEASED", "TIMEOUT_SHIELD", "ERROR_SHIELD"}


def test_watchlist_by_one_pass(spark):
    rng = random.Random(9)
    texts = [None, "", "aaaa aa", "de la dela de la", "x" * 300_000 + " ab", "𝒜b ａb 😀ab😀 ab_ _ab", "ﬁab ab"] + ["".join(rng.choices("ab _-😀é", k=rng.randint(0, 60))) for _ in range(120)]
    terms = sorted({"".join(rng.choices("ab _é-", k=rng.randint(1, 4))).strip() for _ in range(60)} - {""})[:28] + ["de la", "dela", "😀ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    word = lambda c: c == "_" or c.isalnum()
    normal = {r.doc_id: r.t for r in docs.select("doc_id", spans.nfkc("text")["text"].alias("t")).collect()}
    for some in (terms[:1], terms):
        listed = {" ".join(x.split()) for x in some}
        wanted = []
        for i, text in normal.items():
            for term in listed:
                at = (text or "").find(term)
                while at >= 0:
                    end = at + len(term)
                    if not (word(term[0]) and at and word(text[at - 1])) and not (word(term[-1]) and end < len(text) and word(text[end])):
                        wanted.append((i, term, end - at))
                    at = text.find(term, at + 1)
        frame = spark.createDataFrame([(x,) for x in some], "term string")
        got = spans.watchlist_spans(docs, "doc_id", "text", frame)
        assert sorted((r.doc_id, r.term) for r in got.collect()) == sorted((i, term) for i, term, _ in wanted)
        assert "Join" not in got._jdf.queryExecution().toString()


def test_binned_interval_join(spark):
    rng = random.Random(11)
    interval = lambda most: (s := rng.randint(-50, 2000), s + rng.choice([0, 1, 5, rng.randint(0, most)]))
    elements = [(rng.randint(0, 2), i, *interval(900)) for i in range(300)]
    wanted_spans = [(rng.randint(0, 3), *interval(1500)) for _ in range(150)]
    wanted_spans += wanted_spans[:5]
    got = r.span_elements(spark.createDataFrame(elements, "k int, element int, start long, end long"), spark.createDataFrame(wanted_spans, "k int, start long, end long"), "k", width=64)
    wanted = []
    for k, a, z in wanted_spans:
        hits = [(k, a, z, e) for own, e, s, t in elements if own == k and s < z and t > a]
        wanted += hits or [(k, a, z, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_masks_of_odd_polygons(spark):
    """Null, empty, thin and outlying polygons beside a crossed one, in one batch; a mask keeps the empty rows between its first and last."""
    polygons = [None, [], [[0.5, 0.5]], [[0.1, 0.1], [0.9, 0.1], [0.9, 0.1]], [[-1.0, -1.0], [2.0, -1.0], [2.0, 2.0], [-1.0, 2.0]], [[0.0, 0.0], [1.0, 1.0], [1.0, 0.0], [0.0, 1.0]]]
    rows = spark.createDataFrame(list(enumerate(polygons)), "i int, poly array<array<double>>").coalesce(1)
    found = rows.select("i", g.cells(F.col("poly"), 4).alias("cells"), g.cell_count(F.col("poly"), 4).alias("n"), g.mask(F.col("poly"), 4).alias("m")).orderBy("i").collect()
    assert [r.n for r in found] == [0, 0, 0, 0, 16, 8] == [len(r.cells) for r in found]
    assert [r.m for r in found[:4]] == [None] * 4 and tuple(found[4].m) == (0, 3, [15] * 4)
    gap = [[0.3, 0.0], [0.7, 0.0], [0.7, 0.25], [0.45, 0.25], [0.45, 0.75], [0.7, 0.75], [0.7, 1.0], [0.3, 1.0], [0.3, 0.75], [0.44, 0.75], [0.44, 0.25], [0.3, 0.25]]
    assert tuple(spark.createDataFrame([(gap,)], "poly array<array<double>>").select(g.mask(F.col("poly"), 4).alias("m")).first().m) == (0, 3, [6, 0, 0, 6])


def test_objects_are_not_moved_by_grid_row(spark):
    """Frames of tall objects send a row for each object, not one for each grid row (F1, I4)."""
    tall = spark.range(2000).selectExpr("id % 50 AS frame", "id AS obj", "id AS pred", "'A' AS category", "'A' AS p_category", "array(array(0D, 0D), array(0.01D, 0D), array(0.01D, 1D), array(0D, 1D)) AS poly")
    plan = e.mask_sets(tall, tall, 256)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and plan.count("Exchange") == 1
    assert [r.shared_cells for r in e.mask_sets(tall, tall, 256).collect()] == [3 * 256] * 50


def test_waiting_frames_of_close_events_equal_the_sql(spark, tmp_path):
    """Events of a user less than a decision's time apart."""
    import duckdb

    from veilframe.plans import stateful

    rows = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 20000) AS ts, i % 2 AS user_id, 'view' AS event_type, 1e0 AS value"
    duckdb.sql(f"COPY ({rows} FROM range(400) r(i)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = [tuple(r) for r in stateful.j16_deadline(spark, str(tmp_path)).select("session", "frame", "outcome").collect()]
    assert sorted(found) == sorted(con.execute(stateful.ORACLE["j16_deadline"]).fetchall())


def test_many_small_block_files_in_one_batch(spark):
    """Files of few lines each pass together, chunk by chunk, and no function is called for a single file."""
    text = ["a/1.jpg", "2", "1 2 3 4 5 6 7 8 9 0", "9 8 7 6 5 4 3 2 1 0", "", "b.jpg", "0", "0 0 0 0 0 0 0 0 0 0", "a/1.jpg", "3", "1 2 3"]
    lines = spark.range(200).selectExpr("concat('f', id) AS file", "posexplode(array(%s)) AS (at, raw)" % ", ".join(f"'{x}'" for x in text))
    for chunk in (2, 5, 100):
        labelled = b.block_lines(lines, chunk)
        assert "FlatMapGroups" not in labelled._jdf.queryExecution().executedPlan().toString()
        boxes = b.block_text(lines, chunk).groupBy("filename", "block", "box").count().collect()
        assert sorted(tuple(r) for r in boxes) == [("a/1.jpg", 0, 1, 200), ("a/1.jpg", 0, 2, 200), ("a/1.jpg", 8, 1, 200)]
        errors = b.block_errors(labelled).groupBy("filename", "at", "code").count().collect()
        assert sorted(tuple(r) for r in errors) == [("a/1.jpg", 8, "duplicate", 200), ("a/1.jpg", 10, "fields", 200), ("a/1.jpg", 10, "truncated", 200)]


def test_texts_leave_python_piece_by_piece(monkeypatch):
    """A batch of texts is never held as Python's own values as a whole, and its parts are what the texts give alone."""
    import pyarrow as pa

    monkeypatch.setattr(spans, "PIECE", 64)
    texts = [None, "", "Ａ  b ﬁ é"] * 3 + ["a  B " * 10] * 9 + [None]
    batch = pa.array(texts)
    pieces = [*spans._pieces(batch)]
    assert len(pieces) > 5 and sum(pieces, []) == texts and [*spans._pieces(batch[:0])] == []
    found = [tuple(r.values()) for r in spans._normal_batch(batch).to_pylist()]
    assert found == [(None,) * 4 if x is None else spans._normalized(x) for x in texts]
    assert len(spans._normal_batch(batch[:0])) == 0

"""Hand-computed cases, and the registered queries against DuckDB on the smallest data."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from veilframe.functions import geometry as g
from veilframe.functions import text as t
from veilframe.functions.geometry import Rect
from veilframe.operators import evaluate, relations, sessions
from veilframe.plans import catalog
from veilframe.sources import records
from veilframe.streaming import policies as p
from veilframe.streaming.folds import fold_sorted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_duckdb(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    wanted = duck.sql(catalog.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    key = lambda row: tuple(str(v) for v in row)
    got = sorted(key(r) for r in frame.select(*(F.col(f"`{c}`") for c in columns)).collect())
    assert got == sorted(key(r) for r in wanted.select(*map(duckdb.ColumnExpression, columns)).fetchall())


def test_temporal_metrics_by_hand(spark):
    # Four of six visible frames are protected; the longest gap is two frames and 80 ns; one fragment, one switch.
    rows = [(1, 0, 0, True, True, 1), (1, 1, 40, True, False, None), (1, 2, 80, True, False, None), (1, 3, 120, True, True, 2), (1, 4, 160, True, True, 2), (1, 5, 200, True, True, 2)]
    frames = spark.createDataFrame(rows, "episode int, frame int, ts_ns long, visible boolean, guarded boolean, track long")
    (m,) = evaluate.episode_metrics(frames, 40).collect()
    assert (m.guarded, m.visible, m.gap_frames, m.gap_ns, m.fragments, m.switches) == (4, 6, 2, 80, 1, 1)


def test_greedy_matching_by_hand(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.9), (1, 1, 1, 0.8), (1, 1, 0, 0.3)], "frame int, obj int, pred int, iou double")
    assert {(r.obj, r.pred) for r in evaluate.greedy_pairs(pairs, "frame", "obj", "pred", "iou").collect()} == {(0, 1), (1, 0)}
    # The first target takes the best overlap; of equal ones the highest finding.
    ties = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.5), (1, 1, 1, 0.4), (1, 1, 0, 0.4)], "frame int, obj int, pred int, inter double")
    assert {(r.obj, r.pred) for r in evaluate.sequential_best(ties, "frame", "obj", "pred", "inter").collect()} == {(0, 1), (1, 0)}


def test_merge_reaches_boxes_that_no_member_touched(spark):
    boxes = [(1, "a", 0.0, 0.0, 0.1, 0.5), (1, "a", 0.05, 0.4, 0.5, 0.6), (1, "a", 0.4, 0.0, 0.45, 0.1), (1, "b", 0.0, 0.0, 0.1, 0.1)]
    out = relations.merge_boxes(spark.createDataFrame(boxes, "frame int, category string, left double, top double, right double, bottom double"), "frame", ["category"]).collect()
    assert {(r.category, r.left, r.top, r.right, r.bottom) for r in out} == {("a", 0.0, 0.0, 0.5, 0.6), ("b", 0.0, 0.0, 0.1, 0.1)}


def test_crowded_frames_lose_no_pair(spark):
    import random

    rng = random.Random(11)
    box = lambda: (lambda x, y: (x, y, x + rng.random() / 8, y + rng.random() / 8))(rng.random() * 0.9, rng.random() * 0.9)
    a, b = [(k, i, *box()) for k in (1, 2) for i in range(150)], [(k, i, *box()) for k in (1, 2) for i in range(150)]
    names = lambda p: ", ".join(f"{p}{c} double" for c in ("left", "top", "right", "bottom"))
    left, right = spark.createDataFrame(a, f"k int, i int, {names('')}"), spark.createDataFrame(b, f"k int, j int, {names('p_')}")
    wanted = sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[4] and x[4] >= y[2] and x[3] <= y[5] and x[5] >= y[3])
    for crowd in (1, 4, 1000):
        pairs = relations.meeting(left, right, "k", Rect.of(), Rect.of("p_"), crowd=crowd)
        assert sorted(map(tuple, pairs.where(g.overlaps(Rect.of(), Rect.of("p_"))).select("k", "i", "j").collect())) == wanted


def test_nearest_is_monotonic(spark):
    wanted = spark.createDataFrame([("s", 10), ("s", 12), ("s", 30)], "k string, at long")
    decoded = spark.createDataFrame([("s", 9), ("s", 11), ("s", 26)], "k string, at long")
    got = {(r.at, r.taken) for r in relations.nearest_monotonic(wanted, decoded, "k", 3).collect()}
    assert got == {(10, 9), (12, 11), (30, None)}


def test_geometry_refuses_unsafe(spark):
    singular = F.lit([1.0, 2.0, 0.0, 2.0, 4.0, 0.0, 0.0, 0.0, 1.0])
    bow = F.lit([[0.0, 0.0], [1.0, 1.0], [1.0, 0.0], [0.0, 1.0]])
    square = F.lit([[0.0, 0.0], [0.5, 0.0], [0.5, 0.5], [0.0, 0.5]])
    r = spark.range(1).select(g.inverse(singular).alias("inv"), g.is_simple(bow).alias("bow"), g.is_simple(square).alias("square"), F.size(g.cells(square, 4)).alias("cells")).first()
    assert (r.inv, r.bow, r.square, r.cells) == (None, False, True, 4)


def test_spans(spark):
    rows = [("a.b@x.org and c@y.zz.", 1), ("4111 1111 1111 1111, 1111 1111 1111 1111", 1), ("your security code is 123456 ok", 1), (None, 0), ("", 0)]
    frame = spark.createDataFrame(rows, "text string, n int")
    found = F.size(t.email_spans(F.col("text"))) + F.size(t.card_spans(F.col("text"))) + F.size(t.code_spans(F.coalesce("text", F.lit(""))))
    for r in frame.select("text", "n", found.alias("found")).collect():
        assert r.found == r.n, r.text
    out = frame.limit(1).select(t.redacted(F.col("text"), t.email_spans(F.col("text"))).alias("x")).first().x
    assert out == "********* and c@y.zz."


def _run(step, state, rows):
    out = []
    for row in rows:
        state, made = step(state, row)
        out += made
    return out


def test_carry_counts_from_acceptance_and_never_revives():
    step = p.carry_step(("TEXT",), p.Windows(100, 10, 30))
    snapshot = ("s", 0, 0, "TEXT", 1000, False, 2, False, -1)
    frame = lambda at: ("s", at, 1, "", 0, False, 0, False, at)
    got = [r[3] for r in _run(step, p.carry_start(), [snapshot, frame(5), frame(15), frame(30), frame(40), frame(41)])]
    assert got == ["FRESH", "CARRIED", "EXPANDED", "SHIELD_REQUIRED", "SHIELD_REQUIRED"]


def test_guards_latch_until_verified():
    step = p.guard_step(p.Windows(100, 10, 30, thermal_recovery=2))
    frame = lambda at, **k: ("s", at, 1, 0, False, 0, True, True, 0, k.get("thermal", "NOMINAL"), k.get("recovery", "VERIFIED"), False, at, False)
    snapshot = ("s", 0, 0, 1000, False, 1, True, True, 0, "", "", False, -1, False)
    got = [r[4] for r in _run(step, p.guard_start(), [frame(0), snapshot, frame(1), frame(2, thermal="SEVERE"), frame(3, recovery="PENDING"), frame(4), frame(5), frame(6, thermal="WARNING")])]
    assert got == ["MISSING", "FRESH", "ERROR", "ERROR", "ERROR", "FRESH", "EXPANDED"]


def test_tracks_keep_ids_and_refuse_late_rows():
    step = p.track_step(expiry=1000)
    a, b = (0.1, 0.1, 0.2, 0.2, None), (0.7, 0.7, 0.8, 0.8, None)
    out = _run(step, p.tracks_start(), [("s", 0, [a, b]), ("s", 100, [b, a]), ("s", 50, [a]), ("s", 200, [a])])
    assert [(r[1], r[2], r[7]) for r in out] == [(0, 0, "FRESH"), (0, 1, "FRESH"), (100, 0, "FRESH"), (100, 1, "FRESH"), (50, None, "REJECTED"), (200, 0, "FRESH"), (200, 1, "PREDICTED")]


def test_scene_needs_confirmation():
    step = p.scene_step()
    assert [r[2] for r in _run(step, {}, [("s", i, x) for i, x in enumerate([0, -1, -1, -1, -1])])] == ["STABLE", "STABLE", "STABLE", "CHANGED", "STABLE"]


def test_session_machine():
    step, none = p.session_step(), (None,) * 4
    rows = [("s", 0, "READY", False, none), ("s", 1, "READY", True, none), ("s", 2, "LIVE", True, none), ("s", 3, "HOST_LOST", False, none), ("s", 4, "ENDED", True, none), ("s", 5, "FAILED", True, none)]
    assert [(r[2], r[3]) for r in _run(step, {}, rows)] == [("SETUP", False), ("READY", True), ("LIVE", True), ("SHIELDING", True), ("SHIELDING", False), ("FAILED", True)]


def test_publisher_degrades_and_recovers_a_session():
    health = lambda at, *h, host=True: ("s", at, "HEALTH", host, h)
    rows = [
        health(0, "FAILED", "NONE", False, False), ("s", 1, "READY", True, None), ("s", 2, "LIVE", True, None), health(3, "RECONNECTING", "NONE", True, True), health(4, "PUBLISHING", "NONE", True, False), health(5, "PUBLISHING", "NONE", True, True, host=False),
        health(6, "PUBLISHING", "NONE", True, True), ("s", 7, "DEGRADED", True, None), health(8, "PUBLISHING", "NONE", True, True), health(9, "PUBLISHING", "NONE", False, True), health(10, "STOPPED", "NONE", True, True),
    ]
    # A session that was degraded by hand is not recovered by the publisher.
    assert [r[2] for r in _run(p.session_step(), {}, rows)] == ["SETUP", "READY", "LIVE", "DEGRADED", "DEGRADED", "DEGRADED", "LIVE", "DEGRADED", "DEGRADED", "DEGRADED", "STOPPING"]


def test_publication_states_and_failures():
    rows = [("s", i, *x) for i, x in enumerate([("PUBLISHED", "KEY"), ("CONNECT", None), ("CONNECTED", None), ("PUBLISHED", "KEY"), ("PUBLISHED", "CONFIG"), ("PUBLISHED", "KEY"), ("PUBLISHER", "DISCONNECTED"), ("PUBLISHED", "KEY"), ("CONNECTED", None), ("CONGESTION", None), ("QUEUE", "OVERFLOW"), ("CONNECTED", None), ("STOP", None), ("CLOSE", None), ("STOP", None)])]
    out = [r[2:] for r in _run(p.publication_step(), {}, rows)]
    assert [r[0] for r in out] == ["IDLE", "CONNECTING", "PUBLISHING", "PUBLISHING", "PUBLISHING", "PUBLISHING", "RECONNECTING", "RECONNECTING", "PUBLISHING", "RECONNECTING", "FAILED", "FAILED", "STOPPED", "CLOSED", "CLOSED"]
    assert [r[1] for r in out[6:11]] == ["NETWORK_DISCONNECTED", "NETWORK_DISCONNECTED", "NONE", "CONGESTION", "QUEUE_OVERFLOW"]
    assert [r[3] for r in out] == [False] * 5 + [True] + [False] * 9 and [r[2] for r in out][-1] == 3 and [r[4] for r in out].count(False) == 4


def test_coordinator_revokes_until_nothing_is_selected():
    a = (0.1, 0.1, 0.2, 0.2, None)
    rows = [("s", 0, "FACE", False, [a], None), ("s", 100, "FACE", False, [a], 0), ("s", 100, "FACE", False, [a], 0), ("s", 200, "TEXT", False, [], 0), ("s", 300, "FACE", False, [a], 0), ("s", 400, "FACE", False, [a], None), ("s", 500, "FACE", False, [a], 0), ("s", 600, "FACE", False, [], 0), ("s", 700, "FACE", False, [(0.5, 0.5, 0.5, 0.5, None), a], 0)]
    out = _run(p.coordinator_step(), p.coordinator_start(), rows)
    assert [r[2:] for r in out] == [("TRACKED", False, None, 1), ("TRACKED", False, 0, 0), ("FULL_SHIELD", True, None, 0), ("FULL_SHIELD", True, None, 0), ("TRACKED", True, None, 1), ("TRACKED", False, None, 1), ("TRACKED", False, 0, 0), ("TRACKED", True, None, 1), ("FULL_SHIELD", True, None, 0)]


def test_simple_tracker_keeps_given_ids_and_forgets_over_empty_frames():
    box = lambda x: (x, 0.0, x + 0.2, 0.2)
    rows = [("s", 0, *box(0.1), None), ("s", 0, *box(0.5), 7), ("s", 1, *box(0.12), None), ("s", 1, *box(0.5), None), ("s", 2, None, None, None, None, None), ("s", 3, *box(0.1), None)]
    assert [r[-1] for r in _run(p.simple_tracks(), {}, rows)] == [0, 7, 0, 7, 1]


def test_zones_join_findings(spark):
    rect = "left double, top double, right double, bottom double"
    decisions = spark.createDataFrame([(1, "FRESH", True), (2, "FRESH", False), (3, "CARRIED", True), (4, "SHIELD_REQUIRED", True)], "frame int, basis string, zones_ok boolean")
    findings = spark.createDataFrame([(1, "CARD", "VALIDATED", "OPAQUE", 0.0, 0.0, 0.2, 0.2), (1, "CARD", "UNCERTAIN", "OPAQUE", 0.1, 0.1, 0.3, 0.3), (2, "CARD", "VALIDATED", "OPAQUE", 0.0, 0.0, 0.2, 0.2)], f"frame int, category string, confidence string, action string, {rect}")
    zones = spark.createDataFrame([(1, 0.1, 0.1, 0.3, 0.3), (1, 0.2, 0.2, 0.4, 0.4), *[(3, i / 10, 0.0, i / 10 + 0.05, 0.1) for i in range(9)]], f"frame int, {rect}")
    decided, regions = sessions.with_zones(decisions, findings, zones)
    assert {(r.frame, r.basis) for r in decided.collect()} == {(1, "FRESH"), (2, "SHIELD_REQUIRED"), (3, "SHIELD_REQUIRED"), (4, "SHIELD_REQUIRED")}
    assert sorted((r.category, r.confidence, r.left, r.right) for r in regions.collect()) == [("CARD", "UNCERTAIN", 0.1, 0.3), ("CARD", "VALIDATED", 0.0, 0.2), ("PRIVACY_ZONE", "VALIDATED", 0.1, 0.4)]


def test_merge_equals_brute_force(spark):
    import random

    rng, rows = random.Random(3), []
    for k in range(40):
        rows += [(k, *(lambda x, y, w, h: (x, y, x + w, y + h))(rng.randrange(60), rng.randrange(60), rng.randrange(1, 12), rng.randrange(1, 12))) for _ in range(rng.randrange(1, 25))]
    wanted = set()
    for k in {r[0] for r in rows}:
        left = [r[1:] for r in rows if r[0] == k]
        while (hit := next(((a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]), None)) is not None:
            a, b = hit
            left.remove(a)
            left.remove(b)
            left.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))
        wanted |= {(k, *map(float, b)) for b in left}
    frame = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "k int, left double, top double, right double, bottom double")
    assert {tuple(r) for r in relations.merge_boxes(frame, "k", []).collect()} == wanted


def test_stream_state_ends_and_goes_to_all_sinks(spark, tmp_path):
    from veilframe.streaming.stateful import fold_stream, publish

    schema = "session int, at long, over boolean"
    spark.createDataFrame([(1, 0, False), (1, 1, False), (1, 2, True), (1, 3, False), (2, 5, False)], schema).write.parquet(str(tmp_path / "in"))
    count = lambda n, row: (n + 1, [(row[0], row[1], n + 1)])
    stream = fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "session", ["at"], int, count, "session int, at long, n int", end_column="over", ttl_ms=3_600_000)
    paths = [str(tmp_path / x) for x in "ab"]
    sinks = [lambda rows, batch, path=path: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}") for path in paths]
    assert publish(stream, sinks, str(tmp_path / "cp"), once=True).awaitTermination(90)
    for path in paths:
        assert sorted((r.session, r.at, r.n) for r in spark.read.parquet(path).collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 5, 1)]


def test_fold_does_not_depend_on_input_order_or_partitions(spark):
    rows = [(k, i) for k in range(5) for i in range(20)]
    step = lambda s, r: (s + r[1], [(r[0], r[1], s + r[1])])
    run = lambda data, n: sorted(map(tuple, fold_sorted(spark.createDataFrame(data, "k int, i int").repartition(n), "k", ["i"], int, step, "k int, i int, total int").collect()))
    assert run(rows, 1) == run(rows[::-1], 7)


def test_folds_keep_whole_numbers_beside_missing_ones(spark, tmp_path):
    from veilframe.streaming.stateful import fold_stream

    big = (1 << 60) + 1
    rows, schema = [("s", 0, None, big), ("s", 1, big + 2, None), ("s", 2, big + 4, big + 6)], "k string, at long, a long, b long"
    step = lambda s, row: (row[2], [(row[0], s, row[3])])
    wanted = [("s", None, big), ("s", None, None), ("s", big + 2, big + 6)]
    frame = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in fold_sorted(frame, "k", ["at"], lambda: None, step, "k string, before long, b long").collect()] == wanted
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", ["at"], lambda: None, step, "k string, before long, b long")
    query = stream.writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert sorted(map(tuple, spark.table("whole").collect()), key=str) == sorted(wanted, key=str)


def test_stream_equals_batch(spark, tmp_path):
    from veilframe.streaming.stateful import fold_stream

    schema, out = "session int, at long, pattern long", "session int, at long, scene string"
    rows = [(s, i, 0 if i < 3 else -1) for s in range(3) for i in range(8)]
    frame = spark.createDataFrame(rows, schema)
    frame.write.parquet(str(tmp_path / "in"))
    stream = fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "session", ["at"], dict, p.scene_step(), out)
    query = stream.writeStream.format("memory").queryName("scenes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = fold_sorted(frame, "session", ["at"], dict, p.scene_step(), out)
    assert sorted(map(tuple, spark.table("scenes").collect())) == sorted(map(tuple, batch.collect()))


def test_strict_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n[1]\n')
    (tmp_path / "b.jsonl").write_text("\n")
    from pyspark.sql import types as T

    rows = records.strict_jsonl(spark, str(tmp_path), T.StructType([T.StructField("a", T.IntegerType())])).collect()
    assert sorted((r.line, r.error or "") for r in rows) == [(0, "empty_file"), (1, ""), (3, "bad_json"), (4, "not_an_object")]


def test_jpeg_size():
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x01\x68\x02\x80"
    assert records.jpeg_size(head + b"\0" * 8) == (640, 360)
    assert records.jpeg_size(b"png") == (None, None)


def test_visibility_refuses_repeated_ids(spark):
    rows = [(1, 0, 7, 7, "FRESH", False, False), (1, 1, 7, 7, "FRESH", True, False), (1, 2, 7, 7, "FRESH", False, False), (1, 2, 7, 7, "FRESH", False, False)]
    frame = spark.createDataFrame(rows, "session int, at int, track int, selected int, confidence string, lost boolean, expired boolean")
    assert sorted(r.policy for r in sessions.visibility(frame).collect()) == ["HOST_VISIBLE", "PROTECTED", "REFUSED", "REFUSED"]


def test_detector_faults_become_rows(spark):
    def broken(batch):
        raise ValueError("no model")

    out = evaluate.plugged(spark.range(3), broken, "id long, lane string, failure string").collect()
    assert {r.failure for r in out} == {"ValueError"} and len(out) == 3


def test_iou_by_hand(spark):
    a, b = Rect(*map(F.lit, (0.0, 0.0, 0.5, 0.5))), Rect(*map(F.lit, (0.1, 0.0, 0.6, 0.5)))
    assert math.isclose(spark.range(1).select(g.iou(a, b).alias("x")).first().x, 0.2 / 0.3)

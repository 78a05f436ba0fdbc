"""Findings of the third review that were left open: costs of steps, with the rows that they give."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from veilframe.functions import geometry as g
from veilframe.operators import evaluate, relations
from veilframe.plans import evaluation, relational
from veilframe.sources import corpora
from veilframe.streaming import folds, policies

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coco_files_are_read_without_a_pass_for_their_fields(spark, tmp_path):
    for i, boxes in enumerate(([1, 2, 3, 4], [0.5, 0, 1e3, 1])):
        note = {"id": 2**40 + i, "image_id": i, "category_id": 7, "bbox": boxes, "segmentation": [[1, 2]] if i else {"counts": "a"}, "other": {"a": 1}}
        (tmp_path / f"{i}.json").write_text(json.dumps({"info": {}, "annotations": [note], "categories": [{"id": 7, "name": "c"}], "images": [{"id": i, "file_name": f"{i}.jpg", "width": 640, "height": 480.0}]}, indent=1))
    (tmp_path / "2.json").write_text('{"images": [{"id": 9, "file_name": "9.jpg", "width": 1, "height": 1}]}')
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("coco"))
    spark.sparkContext.setJobGroup("coco", "")
    images, categories, notes = corpora.coco_tables(spark, str(tmp_path))
    assert jobs() == 0
    spark.sparkContext.setJobGroup("", "")
    assert sorted((x.id, x.file_name, x.width, x.height) for x in images.collect()) == [(0, "0.jpg", 640, 480), (1, "1.jpg", 640, 480), (9, "9.jpg", 1, 1)]
    assert [tuple(x) for x in categories.distinct().collect()] == [(7, "c")]
    assert sorted((x.id, x.image_id, x.bbox, str(json.loads(x.segmentation))) for x in notes.collect()) == [(2**40, 0, [1, 2, 3, 4], "{'counts': 'a'}"), (2**40 + 1, 1, [0.5, 0, 1000, 1], "[[1, 2]]")]


def test_sides_of_a_code_are_worked_out_once():
    code = str(g.code_bounds(g.code_polygon(F.col("p"), F.col("q")), F.col("m")))
    assert code.count("array_min") == code.count("array_max") == 4


def test_boxes_that_lie_by_frame_are_paired_in_place(spark):
    plan = _plan(evaluation.e7_overlap_pairs(spark, SMALL))
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(l_orderkey") > 0


def test_crowded_frames_are_matched_as_others_are(spark):
    rng = random.Random(5)
    box = lambda: (x := rng.randrange(50) / 64, y := rng.randrange(50) / 64, x + rng.randrange(1, 14) / 64, y + rng.randrange(1, 14) / 64)
    rows = [(f, o, *box()) for f, n in ((1, 3), (2, 90), (3, 1), (4, 30)) for o in range(n)]
    truth = spark.createDataFrame(rows, "frame long, obj int, left double, top double, right double, bottom double")
    preds = spark.createDataFrame([(f, o, *box()) for f, o, *_ in rows if o % 5 != 4] + [(9, 1, *box())], "frame long, pred int, p_left double, p_top double, p_right double, p_bottom double")
    counted = evaluate.sizes(truth, preds, "frame")
    assert sorted((x.frame, x.a, x.b) for x in counted.collect()) == [(1, 3, 3), (2, 90, 72), (3, 1, 1), (4, 30, 24), (9, 0, 1)]
    got = [sorted(tuple(x) for x in evaluate.one_to_one(truth, preds, evaluate.overlap_pairs(truth, preds, counted=c), "iou", "contained", most=m, counted=c).collect()) for m in (1 << 20, 12, 0) for c in (None, counted)]
    assert got[0] and all(x == got[0] for x in got)


def test_means_of_polygons(spark):
    rng = random.Random(6)
    shapes = [(f, o, [[rng.randrange(9) / 8, rng.randrange(9) / 8] for _ in range(rng.randrange(1, 6))]) for f in range(12) for o in range(1 + 70 * (f == 3))]
    cells = [(f, x / 16, y / 16, float(x * y)) for f in range(11) for x in range(17) for y in range(17)]
    polygons = spark.createDataFrame([*shapes, shapes[0]], "frame int, obj int, poly array<array<double>>")
    got = sorted(tuple(r) for r in evaluate.polygon_mean(polygons, spark.createDataFrame(cells, "frame int, x double, y double, score double")).collect())

    def held(x, y, p):
        edges = [(a, b) for a, b in zip(p, p[1:] + p[:1]) if (a[1] > y) != (b[1] > y)]
        return sum(x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2 == 1

    def mean(f, p):
        found = [s for c, x, y, s in cells if c == f and held(x, y, p)]
        return sum(found) / len(found) if found else 0.0

    assert [x[:2] for x in got] == sorted((f, o) for f, o, _ in [*shapes, shapes[0]])
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, sorted((f, o, mean(f, p)) for f, o, p in [*shapes, shapes[0]])))


def test_means_of_polygons_are_one_aggregation(spark):
    plan = _plan(evaluation.f17_polygon_mean(spark, SMALL))
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(l_orderkey") > 0


def test_values_of_columns():
    for kind, made in ((pa.int64(), [2**62 + 1, None, -1]), (pa.float64(), [0.1, None]), (pa.bool_(), [True, None, False]), (pa.string(), ["a", None]), (pa.list_(pa.list_(pa.float64())), [[[1.0, None], []], None, [], [[2.0], None]])):
        whole = pa.array(made, kind)
        for column in (whole, whole[1:], whole[:0]):
            assert folds.values_of(column) == column.to_pylist()


def test_a_track_is_moved_once_a_row(monkeypatch):
    calls, moved = [], policies._moved
    monkeypatch.setattr(policies, "_moved", lambda *a: calls.append(a) or moved(*a))
    step, state = policies.track_step(), policies.tracks_start()
    for at in (0, 1):
        state, out = step(state, (1, at * 10**8, [(i / 8, 0.1, i / 8 + 0.1, 0.2, None) for i in range(4)]))
    assert [(x[2], x[7]) for x in out] == [(i, "AMBIGUOUS") for i in range(4)] and len(calls) == 4


def test_words_that_lie_by_document_meet_spans_in_place(spark):
    plan = _plan(relational.e6_spans(spark, SMALL))
    assert "bin#" not in plan and "LeftAnti" not in plan


def test_spans_of_crowded_and_other_keys(spark):
    rng = random.Random(7)
    elements = [(k, i, a := rng.randrange(2000), a + rng.randrange(1, 40)) for k in (1, 2, 3) for i in range(60)]
    spans = [(k, a := rng.randrange(2200), a + rng.randrange(1, 9)) for k, n in ((1, 5), (2, 90), (4, 3)) for _ in range(n)] + [(1, 3000, 3001)] * 2 + [(None, 1, 2)]
    wanted = sorted(((k, a, b, i) for k, a, b in spans for i in ([i for e, i, s, t in elements if e == k and s < b and t > a] or [None])), key=repr)
    frames = spark.createDataFrame(elements, "k int, element int, start long, end long"), spark.createDataFrame(spans, "k int, start long, end long")
    for crowd in (0, 10, 1000):
        assert sorted((tuple(x) for x in relations.span_elements(*frames, "k", crowd=crowd).collect()), key=repr) == wanted

"""Evaluation queries: matching, rasters, temporal metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import derive
from veilframe.functions import geometry as g
from veilframe.functions.geometry import Rect
from veilframe.operators import evaluate as e
from veilframe.operators.relations import nearest_monotonic, sizes
from veilframe.plans.views import sql


def _truth(spark, sf):
    return derive.truth_box(spark, sf)


def _both(spark, sf):
    t = _truth(spark, sf)
    return t, derive.pred_box(t)


def _split(spark, sf):
    return derive.table(spark, sf, "orders").selectExpr("o_orderkey AS frame", "CASE WHEN o_custkey % 2 = 0 THEN 'DEVELOPMENT' ELSE 'HOLDOUT' END AS split")


def f5_slice_totals(spark, sf):
    return e.slice_totals(*_both(spark, sf))


def e7_overlap_pairs(spark, sf):
    return e.overlap_pairs(*_both(spark, sf)).select("frame", "obj", "pred", F.round("iou", 9).alias("iou"), "contained")


def e8_greedy(spark, sf):
    truth, preds = _both(spark, sf)
    n = sizes(truth, preds, "frame")
    return e.one_to_one(truth, preds, e.overlap_pairs(truth, preds, counted=n), "iou", "contained", counted=n).select("frame", "obj", "pred", F.round("iou", 9).alias("iou"), "contained")


def e8_rounds(spark, sf):
    """The pairs of e8_greedy with every frame of more than twelve possible pairs matched by rounds."""
    truth, preds = _both(spark, sf)
    n = sizes(truth, preds, "frame")
    return e.one_to_one(truth, preds, e.overlap_pairs(truth, preds, counted=n), "iou", "contained", most=12, counted=n).select("frame", "obj", "pred", F.round("iou", 9).alias("iou"), "contained")


def e8_mutual_best(spark, sf):
    pairs = e.overlap_pairs(*_both(spark, sf)).where("iou >= 0.20")
    return e.mutual_best(pairs, "frame", "obj", "pred", "iou").select("frame", "obj", "pred", F.round("iou", 9).alias("iou"))


def e9_coverage(spark, sf):
    return e.coverage_pairs(*_both(spark, sf)).select("frame", "obj", "pred", F.round("coverage", 9).alias("coverage"), F.round("excess", 9).alias("excess"))


GRID = 64
NOMINAL_NS = 40_000_000
#: A frame's lane, as its fixture's tags would name it.
LANE = "element_at(array('AUTOMATIC_PATTERN', 'CONFIGURED_WATCHLIST', 'CONFIGURED_ZONE'), CAST(frame % 3 + 1 AS INT))"


def _targets(spark, sf):
    """Truth with its corners; what has the category of the frame's first object is protectable."""
    t = _truth(spark, sf).withColumn("protectable", F.expr("category = first_value(category) OVER (PARTITION BY frame ORDER BY obj)"))
    return t.select("frame", "obj", "category", "protectable", g.corners(Rect.of()).alias("poly"))


def _findings(spark, sf):
    return derive.pred_box(_truth(spark, sf)).select("frame", "pred", "p_category", g.corners(Rect.of("p_")).alias("poly"))


def e10_sequential(spark, sf):
    return e.cell_matches(_targets(spark, sf), _findings(spark, sf), GRID)


def f1_raster(spark, sf):
    return e.raster_counts(_targets(spark, sf), _findings(spark, sf), GRID)


def i4_masks(spark, sf):
    """What truth and predictions share and have alone in each frame."""
    return e.mask_sets(_targets(spark, sf), _findings(spark, sf), GRID)


def suite(spark, sf):
    """The report of frames of one category, as the suite asks."""
    targets = e.lane_targets(_targets(spark, sf), F.expr(LANE), GRID)
    counts = e.raster_counts(targets, _findings(spark, sf), GRID)
    frames = counts.join(targets.groupBy("frame").agg(F.min("category").alias("category")), "frame").join(_split(spark, sf), "frame").withColumn("lane", F.expr(LANE))
    return e.suite_report(frames, GRID)


def f2_suite(spark, sf):
    out = suite(spark, sf)
    ratios = ("recall", "coverage", "excess_share", "false_share")
    return out.select(*(c for c in out.columns if c not in ratios), *(F.round(c, 9).alias(c) for c in ratios))


def f3_category_sets(spark, sf):
    frames = _truth(spark, sf).where("NOT (category = 'CARD' AND frame % 2 = 0)").selectExpr("CASE WHEN frame % 2 = 0 THEN 'DEVELOPMENT' ELSE 'HOLDOUT' END AS split", "category")
    return e.category_sets_differ(frames)


def f4_mixed_frames(spark, sf):
    frames = derive.table(spark, sf, "orders").selectExpr("o_orderkey AS frame")
    return e.mixed_frames(_truth(spark, sf), frames)


def _episodes(spark, sf):
    return derive.episode_frames(derive.session_frames(spark, sf))


def _metrics(spark, sf):
    return e.episode_metrics(_episodes(spark, sf), NOMINAL_NS)


def f6_episodes(spark, sf):
    return _metrics(spark, sf).withColumn("coverage", F.round("coverage", 9))


def f7_summary(spark, sf):
    return e.episode_summary(_metrics(spark, sf)).withColumn("micro", F.round("micro", 9))


def f19_acceptance(spark, sf):
    return e.accepted(_metrics(spark, sf), 0.75, 2_000_000_000_000_000).select("episode", "accepted")


def _joined(spark, sf):
    f = derive.session_frames(spark, sf)
    decoded = f.where("event_id % 11 <> 0").selectExpr("session AS episode", "ts_ns + (event_id % 7 - 3) * 1000 AS at", "event_id")
    return f, f.selectExpr("session AS episode", "ts_ns AS at"), decoded


def f8_totals(spark, sf):
    _, wanted, decoded = _joined(spark, sf)
    return e.join_totals(wanted, decoded, "episode", 3000)


def f8_objects(spark, sf):
    """Three faces in every frame, of which the first is the host's and the last is not always protectable."""
    f, wanted, decoded = _joined(spark, sf)
    objects = f.selectExpr("session AS episode", "ts_ns AS at", "event_type", "explode(sequence(0, 2)) AS object").selectExpr("episode", "at", "object", "IF(object = 0, 'HOST', 'UNKNOWN') AS role", "object < 2 OR event_type <> 'signup' AS protectable")
    seen = decoded.selectExpr("episode", "at", "event_id", "explode(sequence(1, 2)) AS object").selectExpr("episode", "at", "object", "event_id % (object + 2) <> 0 AS fully_protected", "event_id % 13 % (object + 1) AS track")
    return e.object_metrics(objects, nearest_monotonic(wanted, decoded, "episode", 3000), seen, NOMINAL_NS).withColumn("coverage", F.round("coverage", 9))


def _pixels(spark, sf):
    return derive.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey % 100 AS fixture", "l_orderkey AS frame", "array(l_partkey % 40, l_suppkey % 40, CAST(l_linenumber AS BIGINT)) AS seen",
        "array(10L, 12L, 4L) AS raw", "array(20L, 20L, 4L) AS mask", "l_partkey % 40 / 40D AS x", "l_suppkey % 40 / 40D AS y",
    )


def f9_pixels(spark, sf):
    return e.pixel_oracle(_pixels(spark, sf)).select("fixture", F.round("max_raw", 9).alias("max_raw"), F.round("min_mask", 9).alias("min_mask"), "protected", "exposed")


def f10_gate(spark, sf):
    regions = _truth(spark, sf).where("obj = 1").select("frame", "left", "top", "right", "bottom")
    return e.coverage_gate(regions, _pixels(spark, sf), (20, 20, 4), tolerance=20, least=0.5).withColumn("share", F.round("share", 9))


def f14_expected(spark, sf):
    t = _truth(spark, sf)
    expected = t.select("frame").distinct().selectExpr("frame", "frame % 8 AS n")
    return e.expected_counts(t, expected, "frame")


def f15_exactly_one(spark, sf):
    return e.not_exactly_one(_truth(spark, sf).selectExpr("frame * 100 + ln AS key"), "key")


def f16_recognition(spark, sf):
    rows = derive.table(spark, sf, "part").selectExpr("p_brand AS brand", "p_name AS text", "p_type AS expected", "p_size / 50D AS confidence")
    return e.recognition_diagnostics(rows, "brand").withColumn("least_distance", F.round("least_distance", 9))


def f17_polygon_mean(spark, sf):
    t = _truth(spark, sf)
    scores = _pixels(spark, sf).selectExpr("frame", "x", "y", "seen[0] / 64D AS score")
    return e.polygon_mean(t.select("frame", "obj", g.corners(Rect.of()).alias("poly")), scores).withColumn("mean_score", F.round("mean_score", 9))


def f18_dispatch(spark, sf):
    return derive.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("dispatched"), F.countDistinct("user_id").alias("fixtures"))


def f20_zone(spark, sf):
    return e.fixed_zone(_truth(spark, sf), "category")


def g7_largest(spark, sf):
    return e.largest_object(_truth(spark, sf), g.area(Rect.of())).select("frame", "obj", "category")


_IOU = """pr AS (SELECT t.*, p.*, greatest(0, least("right", p_right) - greatest("left", p_left)) * greatest(0, least(bottom, p_bottom) - greatest(top, p_top)) AS inter,
    ("right" - "left") * (bottom - top) AS ta, (p_right - p_left) * (p_bottom - p_top) AS pa,
    (greatest(0, p_left - (p_right - p_left) * 0.25::DOUBLE) <= "left" AND greatest(0, p_top - (p_bottom - p_top) * 0.25::DOUBLE) <= top
     AND least(1, p_right + (p_right - p_left) * 0.25::DOUBLE) >= "right" AND least(1, p_bottom + (p_bottom - p_top) * 0.25::DOUBLE) >= bottom) AS contained
    FROM truth_box t JOIN pred_box p USING (frame)),
  q AS (SELECT *, inter / (ta + pa - inter) AS iou FROM pr WHERE inter / (ta + pa - inter) >= 0.2::DOUBLE OR contained)"""
_BEST = """r AS (SELECT *, row_number() OVER (PARTITION BY frame, obj ORDER BY iou DESC, obj, pred) AS a, row_number() OVER (PARTITION BY frame, pred ORDER BY iou DESC, obj, pred) AS b FROM q WHERE iou >= 0.2::DOUBLE),
  m AS (SELECT frame, obj, pred, iou FROM r WHERE a = 1 AND b = 1)"""


def _assigned(pairs: str, order: str, name: str = "m") -> str:
    """One-to-one pairs in the given order as rounds: a pair that is first for both its sides is taken, then its sides are gone."""
    return f"""rounds AS (SELECT *, false AS taken FROM {pairs} UNION ALL
    SELECT * EXCLUDE (taken, best, o_gone, p_gone), best AS taken FROM (SELECT *, bool_or(best) OVER (PARTITION BY frame, obj) AS o_gone, bool_or(best) OVER (PARTITION BY frame, pred) AS p_gone FROM
      (SELECT *, row_number() OVER (PARTITION BY frame, obj ORDER BY {order}) = 1 AND row_number() OVER (PARTITION BY frame, pred ORDER BY {order}) = 1 AS best FROM rounds WHERE NOT taken))
    WHERE best OR NOT (o_gone OR p_gone)), {name} AS (SELECT * EXCLUDE (taken) FROM rounds WHERE taken)"""


_RUNS = """d AS (SELECT *, coalesce(lead(ts_ns) OVER w - ts_ns, 40000000) AS duration, sum(CASE WHEN visible THEN 0 ELSE 1 END) OVER w AS span FROM episode_frames WINDOW w AS (PARTITION BY episode ORDER BY frame)),
  r AS (SELECT *, sum(CASE WHEN visible AND NOT guarded THEN 0 ELSE 1 END) OVER w AS gap, visible AND guarded AND NOT coalesce(lag(visible AND guarded) OVER s, false) AS starts,
    last_value(CASE WHEN visible AND guarded THEN track END IGNORE NULLS) OVER (PARTITION BY episode, span ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_id
    FROM d WINDOW w AS (PARTITION BY episode ORDER BY frame), s AS (PARTITION BY episode, span ORDER BY frame)),
  gp AS (SELECT episode, max(n) AS gap_frames, max(ns) AS gap_ns FROM (SELECT episode, gap, count(*) AS n, sum(duration) AS ns FROM r WHERE visible AND NOT guarded GROUP BY ALL) GROUP BY episode),
  sp AS (SELECT episode, sum(f)::BIGINT AS fragments, sum(x)::BIGINT AS switches FROM (SELECT episode, span, greatest(count(*) FILTER (starts) - 1, 0) AS f, count(*) FILTER (visible AND guarded AND track <> last_id) AS x FROM r GROUP BY ALL) GROUP BY episode),
  tt AS (SELECT episode, count(*) FILTER (visible) AS visible, count(*) FILTER (visible AND guarded) AS guarded FROM r GROUP BY episode),
  em AS (SELECT episode, tt.visible, tt.guarded, fragments, switches, coalesce(gap_frames, 0)::BIGINT AS gap_frames, coalesce(gap_ns, 0)::BIGINT AS gap_ns, CASE WHEN tt.visible > 0 THEN tt.guarded / tt.visible END AS coverage FROM tt JOIN sp USING (episode) LEFT JOIN gp USING (episode))"""
_TARGETS = """tb AS (SELECT *, category = first_value(category) OVER (PARTITION BY frame ORDER BY obj) AS protectable, ['AUTOMATIC_PATTERN', 'CONFIGURED_WATCHLIST', 'CONFIGURED_ZONE'][frame % 3 + 1] AS lane FROM truth_box)"""
_CELLS = """k AS (SELECT unnest(range(0, 64)) AS i),
  tc AS (SELECT frame, obj, category, y.i * 64 + x.i AS cell FROM {t} JOIN k x ON (x.i + 0.5e0) / 64 >= "left" AND (x.i + 0.5e0) / 64 < "right" JOIN k y ON (y.i + 0.5e0) / 64 >= top AND (y.i + 0.5e0) / 64 < bottom),
  pc AS (SELECT frame, pred, p_category, y.i * 64 + x.i AS cell FROM pred_box JOIN k x ON (x.i + 0.5e0) / 64 >= p_left AND (x.i + 0.5e0) / 64 < p_right JOIN k y ON (y.i + 0.5e0) / 64 >= p_top AND (y.i + 0.5e0) / 64 < p_bottom),
  ov AS (SELECT frame, obj, pred, count(*) AS cells FROM tc JOIN pc USING (frame, cell) WHERE category = p_category GROUP BY ALL), """ + _assigned("ov", "obj, cells DESC, pred DESC", "mt")
_COUNTS = """cv AS (SELECT DISTINCT frame, cell FROM mt JOIN tc USING (frame, obj) JOIN pc USING (frame, pred, cell)), td AS (SELECT DISTINCT frame, cell FROM tc), pd AS (SELECT DISTINCT frame, cell FROM pc),
  nt AS (SELECT frame, count(*) AS targets FROM {t} GROUP BY frame), np AS (SELECT frame, count(*) AS findings FROM pred_box GROUP BY frame), nm AS (SELECT frame, count(*) AS recalled FROM mt GROUP BY frame),
  n1 AS (SELECT frame, count(*) AS truth_cells FROM td GROUP BY frame), n2 AS (SELECT frame, count(*) AS covered_cells FROM cv GROUP BY frame), n3 AS (SELECT frame, count(*) AS predicted_cells FROM pd GROUP BY frame),
  n4 AS (SELECT frame, count(*) AS excess_cells FROM pd ANTI JOIN td USING (frame, cell) GROUP BY frame),
  rc AS (SELECT frame, coalesce(targets, 0) AS targets, coalesce(recalled, 0) AS recalled, coalesce(truth_cells, 0) AS truth_cells, coalesce(covered_cells, 0) AS covered_cells, coalesce(predicted_cells, 0) AS predicted_cells, coalesce(excess_cells, 0) AS excess_cells,
    coalesce(findings, 0) AS findings, coalesce(findings, 0) - coalesce(recalled, 0) AS false_positives FROM nt FULL JOIN np USING (frame) LEFT JOIN nm USING (frame) LEFT JOIN n1 USING (frame) LEFT JOIN n2 USING (frame) LEFT JOIN n3 USING (frame) LEFT JOIN n4 USING (frame))"""
_TARGET = """tg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ("right" - "left") * (bottom - top) DESC, obj) AS rk FROM truth_box) WHERE rk = 1)"""

_SUITE = f"""WITH RECURSIVE {_TARGETS}, k0 AS (SELECT unnest(range(0, 64)) AS i), nc AS (SELECT frame, obj, count(*) FILTER ((i + 0.5e0) / 64 >= "left" AND (i + 0.5e0) / 64 < "right") * count(*) FILTER ((i + 0.5e0) / 64 >= top AND (i + 0.5e0) / 64 < bottom) AS n FROM tb CROSS JOIN k0 WHERE protectable GROUP BY ALL),
        zt AS (SELECT frame, arg_max(obj, (n, -obj)) AS obj FROM nc GROUP BY frame), tg AS (SELECT tb.* FROM tb LEFT JOIN zt USING (frame) WHERE protectable AND (lane <> 'CONFIGURED_ZONE' OR tb.obj = zt.obj)), {_CELLS.format(t='tg')}, {_COUNTS.format(t='tg')},
        f AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'DEVELOPMENT' ELSE 'HOLDOUT' END AS split, lane, category, rc.* FROM rc JOIN (SELECT frame, min(category) AS category, min(lane) AS lane FROM tg GROUP BY frame) USING (frame) JOIN orders ON o_orderkey = frame),
        s AS (SELECT split, lane, category, count(*) AS frames, sum(targets)::BIGINT AS targets, sum(recalled)::BIGINT AS recalled, sum(truth_cells)::BIGINT AS truth_cells, sum(covered_cells)::BIGINT AS covered_cells, sum(predicted_cells)::BIGINT AS predicted_cells, sum(excess_cells)::BIGINT AS excess_cells, sum(findings)::BIGINT AS findings, sum(false_positives)::BIGINT AS false_positives FROM f GROUP BY ALL)"""

#: The rows of the report (A10), for the queries of files.
REPORT_SQL = sql(_SUITE + """ SELECT '1.0.0' AS schema_version, 'suite-1' AS suite, 64 AS grid_size, split, lane, category, frames, recalled AS recall_n, targets AS recall_d, round(recalled / targets, 9) AS recall, covered_cells AS coverage_n, truth_cells AS coverage_d,
    excess_cells AS excess_n, frames * 4096 AS excess_d, false_positives AS false_n, findings AS false_d, true AS omitted FROM s""", "truth_box", "pred_box")

ORACLE = {
    "f5_slice_totals": sql(f"""WITH RECURSIVE {_IOU}, {_assigned('q', 'iou DESC, obj, pred')}, h AS (SELECT frame, count(*) AS matched, count(*) FILTER (contained) AS contained, sum(iou) AS iou_sum FROM m GROUP BY frame),
        i AS (SELECT frame, count(*) AS objects, bool_or(is_small) AS s, bool_or(is_blurred) AS b, bool_or(is_occluded) AS o, bool_or(is_difficult) AS d FROM truth_box GROUP BY frame), n AS (SELECT frame, count(*) AS predictions FROM pred_box GROUP BY frame),
        a AS (SELECT frame, objects, coalesce(predictions, 0) AS predictions, coalesce(matched, 0) AS matched, coalesce(contained, 0) AS contained, coalesce(iou_sum, 0) AS iou_sum,
          list_filter(['overall', CASE WHEN s THEN 'small' END, CASE WHEN b THEN 'heavy_blur' END, CASE WHEN o THEN 'heavy_occlusion' END, CASE WHEN d THEN 'difficult_capture' END, CASE WHEN NOT (s OR b OR o OR d) THEN 'baseline' END], lambda x: x IS NOT NULL) AS labels FROM i LEFT JOIN n USING (frame) LEFT JOIN h USING (frame)),
        l AS (SELECT unnest(labels) AS slice, * FROM a)
        SELECT slice, count(*) AS images, sum(objects)::BIGINT AS objects, sum(predictions)::BIGINT AS predictions, sum(matched)::BIGINT AS matched, sum(contained)::BIGINT AS contained, sum(predictions - matched)::BIGINT AS false_positives, round(sum(iou_sum) / sum(matched), 6) AS mean_iou FROM l GROUP BY slice""", "truth_box", "pred_box"),
    "e8_greedy": sql(f"WITH RECURSIVE {_IOU}, {_assigned('q', 'iou DESC, obj, pred')} SELECT frame, obj, pred, round(iou, 9) AS iou, contained FROM m", "truth_box", "pred_box"),
    "e10_sequential": sql(f"WITH RECURSIVE {_CELLS.format(t='truth_box')} SELECT frame, obj, pred, cells FROM mt", "truth_box", "pred_box"),
    "e7_overlap_pairs": sql(f"WITH {_IOU} SELECT frame, obj, pred, round(iou, 9) AS iou, contained FROM q", "truth_box", "pred_box"),
    "e8_mutual_best": sql(f"WITH {_IOU}, {_BEST} SELECT frame, obj, pred, round(iou, 9) AS iou FROM m", "truth_box", "pred_box"),
    "e9_coverage": sql(f"""WITH RECURSIVE q AS (SELECT * FROM (SELECT t.*, p.*, greatest(0, least("right", p_right) - greatest("left", p_left)) * greatest(0, least(bottom, p_bottom) - greatest(top, p_top)) AS inter FROM truth_box t JOIN pred_box p USING (frame)) WHERE inter > 0), {_assigned('q', 'inter DESC, obj, pred')}
        SELECT frame, obj, pred, round(inter / (("right" - "left") * (bottom - top)), 9) AS coverage, round(((p_right - p_left) * (p_bottom - p_top) - inter) / ((p_right - p_left) * (p_bottom - p_top)), 9) AS excess FROM m""", "truth_box", "pred_box"),
    "f1_raster": sql(f"WITH RECURSIVE {_CELLS.format(t='truth_box')}, {_COUNTS.format(t='truth_box')} SELECT * FROM rc", "truth_box", "pred_box"),
    "i4_masks": sql(f"""WITH RECURSIVE {_CELLS.format(t='truth_box')}, b AS (SELECT frame, cell, bool_or(t) AS t, bool_or(p) AS p FROM (SELECT frame, cell, true AS t, false AS p FROM tc UNION ALL SELECT frame, cell, false, true FROM pc) GROUP BY ALL)
        SELECT frame, count(*) AS union_cells, count(*) FILTER (t AND p) AS shared_cells, count(*) FILTER (t AND NOT p) AS only_a, count(*) FILTER (p AND NOT t) AS only_b FROM b GROUP BY frame""", "truth_box", "pred_box"),
    "f2_suite": sql(f"""{_SUITE} SELECT *, round(recalled / targets, 9) AS recall, round(covered_cells / truth_cells, 9) AS coverage, round(excess_cells / (frames * 4096), 9) AS excess_share, round(false_positives / findings, 9) AS false_share FROM s""", "truth_box", "pred_box"),
    "f3_category_sets": sql("""WITH f AS (SELECT CASE WHEN frame % 2 = 0 THEN 'DEVELOPMENT' ELSE 'HOLDOUT' END AS split, category FROM truth_box WHERE NOT (category = 'CARD' AND frame % 2 = 0))
        SELECT category, split AS missing_split FROM (SELECT DISTINCT category FROM f) CROSS JOIN (SELECT DISTINCT split FROM f) EXCEPT SELECT category, split FROM f""", "truth_box"),
    "f4_mixed_frames": sql("SELECT o_orderkey AS frame, count(DISTINCT category) AS categories FROM orders LEFT JOIN truth_box ON frame = o_orderkey GROUP BY o_orderkey HAVING count(DISTINCT category) <> 1", "truth_box"),
    "f6_episodes": sql(f"WITH {_RUNS} SELECT episode, visible, guarded, fragments, switches, gap_frames, gap_ns, round(coverage, 9) AS coverage FROM em", "episode_frames"),
    "f7_summary": sql(f"""WITH {_RUNS} SELECT round(sum(guarded) / sum(visible), 9) AS micro, round(avg(coverage), 9) AS macro, max(gap_frames) AS gap_frames, max(gap_ns) AS gap_ns, sum(fragments)::BIGINT AS fragments,
        sum(switches)::BIGINT AS switches, count(*) FILTER (gap_frames > 0) AS with_gap FROM em""", "episode_frames"),
    "f8_totals": sql("""SELECT session AS episode, count(*) AS annotated, count(*) FILTER (event_id % 11 <> 0) AS decoded, count(*) FILTER (event_id % 11 <> 0) AS matched, 0 AS unmatched_decoded, coalesce(max(abs(event_id % 7 - 3) * 1000) FILTER (event_id % 11 <> 0), 0) AS largest_delta FROM session_frames GROUP BY session""", "session_frames"),
    "f8_objects": sql("""WITH o AS (SELECT session AS episode, 1 + k.k AS object, frame, ts_ns, k.k = 0 OR event_type <> 'signup' AS visible, (k.k = 0 OR event_type <> 'signup') AND event_id % 11 <> 0 AND event_id % (k.k + 3) <> 0 AS guarded,
          CASE WHEN (k.k = 0 OR event_type <> 'signup') AND event_id % 11 <> 0 THEN event_id % 13 % (k.k + 2) END AS track FROM session_frames CROSS JOIN (SELECT unnest([0, 1]) AS k) k),
        episode_frames AS (SELECT episode * 10 + object AS episode, frame, ts_ns, visible, guarded, track FROM o), """ + _RUNS + """ SELECT episode // 10 AS episode, (episode % 10)::INT AS object, visible, guarded, fragments, switches, gap_frames, gap_ns, round(coverage, 9) AS coverage FROM em""", "session_frames"),
    "f19_acceptance": sql(f"WITH {_RUNS} SELECT episode, coalesce(coverage, 1) >= 0.75::DOUBLE AND gap_ns <= 2000000000000000 AS accepted FROM em", "episode_frames"),
    "f9_pixels": """WITH p AS (SELECT l_orderkey % 100 AS fixture, l_orderkey AS frame, abs(l_partkey % 40 - 10) <= 12 AND abs(l_suppkey % 40 - 12) <= 12 AND abs(l_linenumber - 4) <= 12 AS r,
        abs(l_partkey % 40 - 20) <= 28 AND abs(l_suppkey % 40 - 20) <= 28 AND abs(l_linenumber - 4) <= 28 AS m FROM lineitem),
        f AS (SELECT fixture, frame, avg(r::INT) AS raw_ratio, avg(m::INT) AS mask_ratio FROM p GROUP BY ALL)
        SELECT fixture, round(max(raw_ratio), 9) AS max_raw, round(min(mask_ratio), 9) AS min_mask, count(*) FILTER (raw_ratio <= 0.1::DOUBLE AND mask_ratio >= 0.9::DOUBLE) AS protected,
        count(*) FILTER (NOT (raw_ratio <= 0.1::DOUBLE AND mask_ratio >= 0.9::DOUBLE)) AS exposed FROM f GROUP BY fixture""",
    "f10_gate": sql("""WITH px AS (SELECT l_orderkey AS frame, l_partkey % 40 / 40e0 AS x, l_suppkey % 40 / 40e0 AS y, abs(l_partkey % 40 - 20) <= 20 AND abs(l_suppkey % 40 - 20) <= 20 AND abs(l_linenumber - 4) <= 20 AS near FROM lineitem),
        s AS (SELECT frame, avg(near::INT) AS share FROM truth_box JOIN px USING (frame) WHERE obj = 1 AND x BETWEEN greatest(0, "left" - 0.02::DOUBLE) AND least(1, "right" + 0.02::DOUBLE) AND y BETWEEN greatest(0, top - 0.02::DOUBLE) AND least(1, bottom + 0.02::DOUBLE) GROUP BY frame)
        SELECT frame, round(coalesce(share, 0), 9) AS share, CASE WHEN share >= 0.5::DOUBLE THEN 'CERTIFIED' ELSE 'ESCALATE' END AS verdict FROM (SELECT DISTINCT frame FROM truth_box) LEFT JOIN s USING (frame)""", "truth_box"),
    "f14_expected": sql("SELECT frame, count(*) AS found, frame % 8 AS wanted FROM truth_box GROUP BY frame HAVING count(*) <> frame % 8", "truth_box"),
    "f15_exactly_one": sql("SELECT frame * 100 + ln AS key, count(*) AS n FROM truth_box GROUP BY ALL HAVING count(*) <> 1", "truth_box"),
    "f16_recognition": """SELECT p_brand AS brand, count(*) FILTER (p_size / 50e0 < 0.5::DOUBLE) AS low, count(*) FILTER (p_size / 50e0 >= 0.5::DOUBLE AND p_size / 50e0 < 0.8::DOUBLE) AS middle, count(*) FILTER (p_size / 50e0 >= 0.8::DOUBLE) AS high,
        bool_or(p_name = p_type) AS any_exact, round(min(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))), 9) AS least_distance, sum(length(p_name))::BIGINT AS characters FROM part GROUP BY p_brand""",
    "f17_polygon_mean": sql("""WITH px AS (SELECT l_orderkey AS frame, l_partkey % 40 / 40e0 AS x, l_suppkey % 40 / 40e0 AS y, l_partkey % 40 / 64e0 AS score FROM lineitem),
        s AS (SELECT t.frame, obj, avg(score) AS m FROM truth_box t JOIN px USING (frame) WHERE x >= "left" AND x < "right" AND y >= top AND y < bottom GROUP BY ALL)
        SELECT frame, obj, round(coalesce(m, 0), 9) AS mean_score FROM truth_box LEFT JOIN s USING (frame, obj)""", "truth_box"),
    "f18_dispatch": "SELECT event_type, count(*) AS dispatched, count(DISTINCT user_id) AS fixtures FROM events GROUP BY event_type",
    "f20_zone": sql('SELECT category, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom FROM truth_box GROUP BY category', "truth_box"),
    "g7_largest": sql(f"WITH {_TARGET} SELECT frame, obj, category FROM tg", "truth_box"),
}
ORACLE["e8_rounds"] = ORACLE["e8_greedy"]
QUERIES = {f.__name__: f for f in (f5_slice_totals, e7_overlap_pairs, e8_greedy, e8_rounds, e8_mutual_best, e9_coverage, e10_sequential, f1_raster, i4_masks, f2_suite, f3_category_sets, f4_mixed_frames, f6_episodes, f7_summary, f8_totals, f8_objects, f19_acceptance, f9_pixels, f10_gate, f14_expected, f15_exactly_one, f16_recognition, f17_polygon_mean, f18_dispatch, f20_zone, g7_largest)}

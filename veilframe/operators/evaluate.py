"""Detections against truth: matching, raster coverage, temporal gaps, slices and totals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import geometry as g
from veilframe.functions.geometry import Rect
from veilframe.operators.relations import meeting, nearest_monotonic, sizes
from veilframe.shared import kept as keep
from veilframe.streaming.folds import fold_sorted

#: A frame that may have more pairs than this is matched by rounds over many tasks.
MOST_PAIRS = 1 << 20


def slice_labels(small: Column, blurred: Column, occluded: Column, difficult: Column) -> Column:
    """The slices that an object is in, or the baseline."""
    named = ((small, "small"), (blurred, "heavy_blur"), (occluded, "heavy_occlusion"), (difficult, "difficult_capture"))
    labels = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in named)))
    return F.when(F.size(labels) == 0, F.array(F.lit("baseline"))).otherwise(labels)


# Sides of at most so many pixels are small; levels of blur and occlusion from which they are heavy.
SMALL_SIDE, HEAVY_BLUR, HEAVY_OCCLUSION = 20, 2, 2


def slice_flags(width: Column, height: Column, blur: Column, occlusion: Column, illumination: Column, pose: Column) -> tuple[Column, Column, Column, Column]:
    """An annotated object's small, heavy_blur, heavy_occlusion and difficult_capture flags for :func:`slice_labels`; unknown is false."""
    known = lambda c: F.coalesce(c, F.lit(False))
    small = known(width <= SMALL_SIDE) | known(height <= SMALL_SIDE)
    return small, known(blur == HEAVY_BLUR), known(occlusion == HEAVY_OCCLUSION), known(illumination > 0) | known(pose > 0)


def image_slices(objects: DataFrame, image: str) -> DataFrame:
    """(image, slice): every slice that an object of the image is in, or the baseline.

    ``objects`` has width, height, blur, occlusion, illumination and pose; one aggregation by image, with partial results map-side.
    """
    flags = slice_flags(*(F.col(c) for c in ("width", "height", "blur", "occlusion", "illumination", "pose")))
    each = objects.groupBy(image).agg(*(F.bool_or(f).alias(f"__{i}") for i, f in enumerate(flags)))
    return each.select(image, F.explode(slice_labels(*(F.col(f"__{i}") for i in range(4)))).alias("slice"))


def overlap_pairs(truth: DataFrame, preds: DataFrame, least_iou: float = 0.20, padding: float = 0.25, counted: DataFrame | None = None) -> DataFrame:
    """Pairs in one frame whose overlap is enough or whose padded prediction holds the truth (E7); ``counted`` are the sizes of both by frame."""
    t, p = Rect.of(), Rect.of("p_")
    both = meeting(truth, preds, "frame", t, g.expand(p, padding), counted=counted).withColumns({"iou": g.iou(t, p), "contained": g.contains_rect(g.expand(p, padding), t)})
    return both.where((F.col("iou") >= least_iou) | F.col("contained"))


def greedy_pairs(pairs: DataFrame, frame: str, truth: str, pred: str, by: str, *more: str) -> DataFrame:
    """One-to-one pairs of a frame: the best first, ties to the lower truth and then the lower prediction.

    ``more`` names further columns to keep.
    """

    def take(state: tuple[set, set], row: tuple) -> tuple[tuple[set, set], list[tuple]]:
        used_t, used_p = state
        if row[1] in used_t or row[2] in used_p:
            return state, []
        used_t.add(row[1])
        used_p.add(row[2])
        return state, [row]

    kept = pairs.select(frame, truth, pred, by, *more)
    return fold_sorted(kept, frame, [F.desc(by), truth, pred], lambda: (set(), set()), take, kept.schema)


def dominant_pairs(pairs: DataFrame, frame: str, truth: str, pred: str, by: str, *more: str, least_share: float = 0.2) -> DataFrame:
    """The rows of :func:`greedy_pairs` by rounds that spread a frame over tasks.

    A pair that is the best of its truth and of its prediction is one that the greedy order takes, as nothing before it can use either.
    A round takes all of these and drops what they use; it aggregates by (frame, truth) and (frame, prediction), with partial results
    map-side. Where a round uses up less than ``least_share`` of what is left, as with long rows of ties, the fold takes the rest in order;
    it holds a frame's used numbers and none of its pairs. So the rounds grow with the logarithm of the pairs.
    """
    kept = pairs.select(frame, truth, pred, by, *more)
    order = F.struct((-F.col(by)).alias("__by"), truth, pred, by, *more)
    left = keep(kept)
    size, taken = left.count(), []
    while size:
        of_truth = left.groupBy(frame, truth).agg(F.min(order).alias("__b")).select(frame, *(F.col(f"__b.{c}").alias(c) for c in (truth, pred, by, *more)))
        of_pred = left.groupBy(frame, pred).agg(F.min(order).alias("__b")).select(frame, F.col(f"__b.{truth}").alias(truth), pred)
        best = keep(of_truth.join(of_pred, [frame, truth, pred], "left_semi"))
        taken.append(best)
        left = keep(left.join(best.select(frame, truth), [frame, truth], "left_anti").join(best.select(frame, pred), [frame, pred], "left_anti"))
        before, size = size, left.count()
        if size > (1 - least_share) * before:
            return reduce(DataFrame.unionByName, taken, greedy_pairs(left, frame, truth, pred, by, *more))
    return reduce(DataFrame.unionByName, taken) if taken else left


def one_to_one(truth: DataFrame, preds: DataFrame, pairs: DataFrame, by: str, *more: str, most: int = MOST_PAIRS, counted: DataFrame | None = None) -> DataFrame:
    """Greedy pairs of boxes: frames that may have more than ``most`` pairs go by rounds, all others by the fold, with equal rows.

    How many pairs a frame may have is told by its boxes, which takes one aggregation and no pairs: ``counted``, their sizes by frame, if these
    are known. Where some frames are crowded, the pairs are found once and written with a mark.
    """
    crowded = keep((sizes(truth, preds, "frame") if counted is None else counted).where(F.col("a") * F.col("b") > most).select("frame"))
    names = ("frame", "obj", "pred", by, *more)
    if crowded.isEmpty():
        return greedy_pairs(pairs, *names)
    found = keep(pairs.select(*names).join(crowded.withColumn("__crowded", F.lit(True)), "frame", "left"))
    return greedy_pairs(found.where("__crowded IS NULL"), *names).unionByName(dominant_pairs(found.where("__crowded"), *names))


def mutual_best(pairs: DataFrame, frame: str, truth: str, pred: str, by: str) -> DataFrame:
    """The first round of :func:`greedy_pairs` in plain DataFrame form: pairs that are best for both sides."""
    order = [F.desc(by), truth, pred]
    ranked = pairs.withColumns({
        "__t": F.row_number().over(Window.partitionBy(frame, truth).orderBy(*order)),
        "__p": F.row_number().over(Window.partitionBy(frame, pred).orderBy(*order)),
    })
    return ranked.where("__t = 1 AND __p = 1").drop("__t", "__p")


def slice_totals(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """Per slice of images and overall: images, objects, predictions, matched and contained pairs, false positives, mean overlap.

    An image is in every slice that one of its objects is in; contained counts matched pairs alone; a prediction without a
    match is a false positive. Images with predictions alone count as baseline.
    """
    counted = sizes(truth, preds, "frame")
    matched = one_to_one(truth, preds, overlap_pairs(truth, preds, counted=counted), "iou", "contained", counted=counted)
    hits = matched.groupBy("frame").agg(F.count("*").alias("matched"), F.count_if("contained").alias("contained"), F.sum("iou").alias("iou_sum"))
    flags = ("is_small", "is_blurred", "is_occluded", "is_difficult")
    images = truth.groupBy("frame").agg(F.count("*").alias("objects"), *(F.bool_or(c).alias(c) for c in flags))
    found = preds.groupBy("frame").agg(F.count("*").alias("predictions"))
    labels = F.concat(slice_labels(*(F.coalesce(c, F.lit(False)) for c in flags)), F.array(F.lit("overall")))
    each = images.join(found, "frame", "full").join(hits, "frame", "left").select(F.explode(labels).alias("slice"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("objects", "predictions", "matched", "contained", "iou_sum")))
    sums = each.groupBy("slice").agg(F.count("*").alias("images"), *(F.sum(c).alias(c) for c in ("objects", "predictions", "matched", "contained", "iou_sum")))
    return sums.select("slice", "images", "objects", "predictions", "matched", "contained", (F.col("predictions") - F.col("matched")).alias("false_positives"), F.round(F.try_divide("iou_sum", "matched"), 6).alias("mean_iou"))


def coverage_pairs(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """Greedy one-to-one pairs by intersection area, with the share of truth covered and of prediction in excess."""
    t, p = Rect.of(), Rect.of("p_")
    counted = sizes(truth, preds, "frame")
    both = meeting(truth, preds, "frame", t, p, counted=counted).withColumns({"inter": g.intersection_area(t, p), "t_area": g.area(t), "p_area": g.area(p)}).where("inter > 0")
    best = one_to_one(truth, preds, both, "inter", "t_area", "p_area", counted=counted)
    return best.select("frame", "obj", "pred", (F.col("inter") / F.col("t_area")).alias("coverage"), ((F.col("p_area") - F.col("inter")) / F.col("p_area")).alias("excess"))


def sequential_best(pairs: DataFrame, frame: str, target: str, finding: str, by: str, *more: str) -> DataFrame:
    """Targets of a frame in order, each taking the unused finding of largest overlap; ties take the highest finding.

    ``more`` names further columns to keep.
    """

    def take(state: tuple[set, set], row: tuple) -> tuple[tuple[set, set], list[tuple]]:
        served, used = state
        if row[1] in served or row[2] in used:
            return state, []
        served.add(row[1])
        used.add(row[2])
        return state, [row]

    kept = pairs.select(frame, target, finding, by, *more).where(F.col(by) > 0)
    return fold_sorted(kept, frame, [target, F.desc(by), F.desc(finding)], lambda: (set(), set()), take, kept.schema)


def _matches(targets: DataFrame, findings: DataFrame, grid: int) -> DataFrame:
    """The pairs of :func:`cell_matches`, with the words that both have from their first common row, top, on.

    Objects are rows with a mask each, and no plan has a row for each of their grid rows before it is known which pairs are taken.
    """
    t = targets.select("frame", "obj", "category", g.mask(F.col("poly"), grid).alias("__t"))
    p = findings.select("frame", "pred", "p_category", g.mask(F.col("poly"), grid).alias("__p"))
    # Two inequalities and not an equality: the frame alone stays the join's key, by which the objects may lie already.
    same = (F.col("category") <= F.col("p_category")) & (F.col("category") >= F.col("p_category"))
    met = t.join(p, "frame").where(same & (F.col("__t.top") <= F.col("__p.bottom")) & (F.col("__p.top") <= F.col("__t.bottom")))
    both = met.select("frame", "obj", "pred", g.shared_cells(F.col("__t"), F.col("__p"), grid).alias("__s"))
    return both.select("frame", "obj", "pred", F.col("__s.n").alias("cells"), F.col("__s.top").alias("top"), F.col("__s.words").alias("words"))


def cell_matches(targets: DataFrame, findings: DataFrame, grid: int = g.GRID) -> DataFrame:
    """(frame, obj, pred, cells): each target in turn takes the unused finding of its category that shares most cells with it.

    ``targets`` has frame, obj, category and poly; ``findings`` frame, pred, p_category and poly.
    """
    return sequential_best(_matches(targets, findings, grid), "frame", "obj", "pred", "cells")


def _unions(parts: dict[str, DataFrame], grid: int) -> DataFrame:
    """(frame, slot) and, for each named part, the union of its objects' words there and how many objects it has, each counted in one slot (I4).

    Parts have rows (frame, top, words); words may be null. An object is sent to its frame's task as one row and taken apart there, so a grid row
    is never moved. A slot is a word of a grid row.
    """
    names, width = list(parts), -(-grid // 64)
    each = [rows.select("frame", F.lit(i).alias("part"), "top", "words") for i, rows in enumerate(parts.values())]
    apart = reduce(DataFrame.unionByName, each).repartition("frame").select("frame", "part", "top", F.posexplode_outer("words").alias("i", "word"))
    slot = (F.coalesce(F.col("top") * width + F.col("i"), F.lit(0))).alias("slot")
    own = lambda k, value: F.when(F.col("part") == k, value).otherwise(F.lit(0).cast("bigint"))
    words = [own(k, F.coalesce("word", F.lit(0).cast("bigint"))).alias(name) for k, name in enumerate(names)]
    counts = [own(k, F.when(F.coalesce("i", F.lit(0)) == 0, F.lit(1).cast("bigint")).otherwise(0)).alias(f"n_{name}") for k, name in enumerate(names)]
    return apart.select("frame", slot, *words, *counts).groupBy("frame", "slot").agg(*(F.bit_or(n).alias(n) for n in names), *(F.sum(f"n_{n}").alias(f"n_{n}") for n in names))


def _masked(objects: DataFrame, grid: int) -> DataFrame:
    return objects.select("frame", g.mask(F.col("poly"), grid).alias("__m")).select("frame", "__m.top", "__m.words")


def _n(words: Column) -> Column:
    return F.sum(F.bit_count(words))


def mask_sets(a: DataFrame, b: DataFrame, grid: int = g.GRID) -> DataFrame:
    """Per frame, the cells of the union, the intersection and the differences of two masks, each the union of its objects (I4).

    ``a`` and ``b`` have frame and poly. Frames without a cell are left out.
    """
    a_, b_ = F.col("a"), F.col("b")
    rows = _unions({"a": _masked(a, grid).where("words IS NOT NULL"), "b": _masked(b, grid).where("words IS NOT NULL")}, grid)
    return rows.groupBy("frame").agg(_n(a_.bitwiseOR(b_)).alias("union_cells"), _n(a_.bitwiseAND(b_)).alias("shared_cells"), _n(a_.bitwiseAND(F.bitwise_not(b_))).alias("only_a"), _n(b_.bitwiseAND(F.bitwise_not(a_))).alias("only_b"))


def raster_counts(targets: DataFrame, findings: DataFrame, grid: int = g.GRID) -> DataFrame:
    """Per frame: targets, recalled ones, findings, false positives, and the cells of truth, of predictions, covered and in excess.

    Covered is the union of what the matched pairs share. Cells are bits of grid rows, and no plan has a row for each cell.
    """
    taken = sequential_best(_matches(targets, findings, grid), "frame", "obj", "pred", "cells", "top", "words")
    rows = _unions({"t": _masked(targets, grid), "p": _masked(findings, grid), "c": taken.select("frame", "top", "words")}, grid)
    t, p, c = (F.col(x) for x in "tpc")
    counts = rows.groupBy("frame").agg(
        F.sum("n_t").alias("targets"), F.sum("n_c").alias("recalled"), _n(t).alias("truth_cells"), _n(c).alias("covered_cells"), _n(p).alias("predicted_cells"), _n(p.bitwiseAND(F.bitwise_not(t))).alias("excess_cells"), F.sum("n_p").alias("findings"),
    )
    return counts.withColumn("false_positives", F.col("findings") - F.col("recalled"))


def suite_report(frames: DataFrame, grid: int = g.GRID) -> DataFrame:
    """Sums by split, lane and category, and their four ratios; there is no overall row, as averages over categories mislead (F2, A10)."""
    counted = ("targets", "recalled", "truth_cells", "covered_cells", "predicted_cells", "excess_cells", "findings", "false_positives")
    sums = frames.groupBy("split", "lane", "category").agg(F.count("*").alias("frames"), *(F.sum(c).alias(c) for c in counted))
    col = F.col
    return sums.withColumns({
        "recall": F.try_divide(col("recalled"), col("targets")),
        "coverage": F.try_divide(col("covered_cells"), col("truth_cells")),
        "excess_share": F.try_divide(col("excess_cells"), col("frames") * grid * grid),
        "false_share": F.try_divide(col("false_positives"), col("findings")),
    })


def lane_targets(objects: DataFrame, lane: Column, grid: int = g.GRID) -> DataFrame:
    """The protectable objects of each frame; in the lane of configured zones the one of most cells alone, the first of equals.

    ``objects`` has frame, obj, poly and protectable.
    """
    at = objects.where("protectable").withColumns({"__zone": lane == "CONFIGURED_ZONE", "__n": g.cell_count(F.col("poly"), grid)})
    k = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("__n"), "obj"))
    return at.withColumn("__k", k).where("NOT __zone OR __k = 1").drop("__zone", "__n", "__k")


def category_sets_differ(frames: DataFrame) -> DataFrame:
    """Categories that some split lacks."""
    splits = frames.select("split").distinct()
    wanted = frames.select("category").distinct().join(F.broadcast(splits.agg(F.collect_set("split").alias("all"))))
    have = frames.groupBy("category").agg(F.collect_set("split").alias("have"))
    return wanted.join(have, "category").select("category", F.explode(F.array_except("all", "have")).alias("missing_split"))


def mixed_frames(objects: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Frames whose targets have several categories, and those of ``frames`` without a target, which an evaluation refuses."""
    counted = objects.groupBy("frame").agg(F.countDistinct("category").alias("categories"))
    if frames is not None:
        counted = frames.select("frame").distinct().join(counted, "frame", "left").fillna({"categories": 0})
    return counted.where("categories <> 1")


def _runs(frames: DataFrame, nominal_ns: int) -> DataFrame:
    """Durations, visible spans, and islands of unprotected visible frames."""
    w = Window.partitionBy("episode").orderBy("frame")
    span = Window.partitionBy("episode", "span").orderBy("frame")
    with_span = frames.withColumns({
        "duration": F.coalesce(F.lead("ts_ns").over(w) - F.col("ts_ns"), F.lit(nominal_ns)),
        "span": F.sum(F.when(F.col("visible"), 0).otherwise(1)).over(w),
        "open": F.col("visible") & ~F.col("guarded"),
    })
    before = Window.partitionBy("episode", "span").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    safe = F.col("visible") & F.col("guarded")
    return with_span.withColumns({
        "gap": F.sum(F.when(F.col("open"), 0).otherwise(1)).over(w),
        "run_starts": safe & ~F.coalesce(F.lag(safe).over(span), F.lit(False)),
        "last_id": F.last(F.when(F.col("visible") & F.col("guarded"), F.col("track")), ignorenulls=True).over(before),
        "id_now": F.when(safe, F.col("track")),
    })


def episode_metrics(frames: DataFrame, nominal_ns: int) -> DataFrame:
    """Per episode: visible and protected frames, coverage, longest gap in frames and nanoseconds, fragments, id switches.

    An invisible frame ends a gap and a span: fragments and switches are counted inside spans only. A frame lasts until the
    next one, an episode's last frame for the nominal duration (G4).
    """
    runs = _runs(frames, nominal_ns)
    gaps = runs.where("open").groupBy("episode", "gap").agg(F.count("*").alias("n"), F.sum("duration").alias("ns")).groupBy("episode").agg(F.max("n").alias("gap_frames"), F.max("ns").alias("gap_ns"))
    spans = runs.groupBy("episode", "span").agg(F.greatest(F.count_if("run_starts") - 1, F.lit(0)).alias("fragments"), F.count_if(F.col("id_now").isNotNull() & (F.col("id_now") != F.col("last_id"))).alias("switches"))
    spans = spans.groupBy("episode").agg(F.sum("fragments").alias("fragments"), F.sum("switches").alias("switches"))
    total = runs.groupBy("episode").agg(F.count_if("visible").alias("visible"), F.count_if(F.col("visible") & F.col("guarded")).alias("guarded"))
    out = total.join(spans, "episode").join(gaps, "episode", "left").fillna({"gap_frames": 0, "gap_ns": 0})
    return out.withColumn("coverage", F.try_divide("guarded", "visible"))


def episode_summary(metrics: DataFrame) -> DataFrame:
    """Over episodes: micro and macro coverage, maxima, sums, and episodes with a gap."""
    return metrics.agg(
        F.try_divide(F.sum("guarded"), F.sum("visible")).alias("micro"),
        F.round(F.avg("coverage"), 9).alias("macro"),
        F.max("gap_frames").alias("gap_frames"),
        F.max("gap_ns").alias("gap_ns"),
        F.sum("fragments").alias("fragments"),
        F.sum("switches").alias("switches"),
        F.count_if(F.col("gap_frames") > 0).alias("with_gap"),
    )


def join_totals(wanted: DataFrame, decoded: DataFrame, key: str, tolerance: int) -> DataFrame:
    """Per episode: annotation and decoded frames, matched ones, decoded ones that no annotation took, and the largest time difference."""
    joined = nearest_monotonic(wanted, decoded, key, tolerance)
    seen = joined.groupBy(key).agg(F.count("*").alias("annotated"), F.count("taken").alias("matched"), F.coalesce(F.max(F.abs(F.col("at") - F.col("taken"))), F.lit(0)).alias("largest_delta"))
    counted = decoded.groupBy(key).agg(F.count("*").alias("decoded"))
    both = seen.join(counted, key, "full").fillna({c: 0 for c in ("annotated", "matched", "largest_delta", "decoded")})
    return both.select(key, "annotated", "decoded", "matched", (F.col("decoded") - F.col("matched")).alias("unmatched_decoded"), "largest_delta")


def object_metrics(objects: DataFrame, joined: DataFrame, decoded: DataFrame, nominal_ns: int) -> DataFrame:
    """The episode metrics of each object whose role is UNKNOWN, over all annotated frames of its episode (F8).

    ``objects`` has episode, at, object, role and protectable; ``joined`` the rows of E4 (episode, at, taken) for every annotated
    frame; ``decoded`` has episode, at, object, fully_protected and track. Where an object is absent or not protectable it is not visible;
    where it was not decoded it is visible and not protected.
    """
    unknown = objects.where("role = 'UNKNOWN'").select("episode", "object").distinct()
    shown = objects.where("protectable").select("episode", "at", "object", F.lit(True).alias("visible"))
    seen = decoded.select("episode", F.col("at").alias("taken"), "object", "fully_protected", "track")
    frames = joined.withColumn("frame", F.row_number().over(Window.partitionBy("episode").orderBy("at")))
    each = frames.join(unknown, "episode").join(shown, ["episode", "at", "object"], "left").join(seen, ["episode", "taken", "object"], "left")
    visible = F.coalesce("visible", F.lit(False))
    named = each.select(F.struct("episode", "object").alias("episode"), "frame", F.col("at").alias("ts_ns"), visible.alias("visible"), (visible & F.coalesce("fully_protected", F.lit(False))).alias("guarded"), F.when(visible, F.col("track")).alias("track"))
    return episode_metrics(named, nominal_ns).select("episode.*", *("visible", "guarded", "fragments", "switches", "gap_frames", "gap_ns", "coverage"))


def accepted(metrics: DataFrame, least: float, most_gap_ns: int) -> DataFrame:
    """Whether coverage and longest gap meet acceptance thresholds."""
    ok = (F.coalesce(F.col("coverage"), F.lit(1.0)) >= least) & (F.col("gap_ns") <= most_gap_ns)
    return metrics.withColumn("accepted", ok)


def pixel_oracle(pixels: DataFrame, raw_tolerance: int = 12, mask_tolerance: int = 28, most_raw: float = 0.10, least_mask: float = 0.90) -> DataFrame:
    """Per fixture: the worst raw-match ratio, the worst mask ratio, and its protected and exposed frames.

    ``pixels`` has fixture, frame and arrays seen, raw and mask of three channels. A frame is protected if few pixels show the
    raw color and most show the mask.
    """
    near = lambda a, b, tol: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tol), lambda ok: ok).cast("int")
    frames = pixels.groupBy("fixture", "frame").agg(F.avg(near(F.col("seen"), F.col("raw"), raw_tolerance)).alias("raw_ratio"), F.avg(near(F.col("seen"), F.col("mask"), mask_tolerance)).alias("mask_ratio"))
    safe = (F.col("raw_ratio") <= most_raw) & (F.col("mask_ratio") >= least_mask)
    return frames.groupBy("fixture").agg(F.max("raw_ratio").alias("max_raw"), F.min("mask_ratio").alias("min_mask"), F.count_if(safe).alias("protected"), F.count_if(~safe).alias("exposed"))


def coverage_gate(regions: DataFrame, pixels: DataFrame, mask: tuple[int, int, int], padding: float = 0.02, tolerance: int = 28, least: float = 0.90) -> DataFrame:
    """Per frame CERTIFIED or ESCALATE: enough pixels of each padded region show the mask; a pixel counts once per region."""
    r, x, y = Rect.of(), F.col("x"), F.col("y")
    padded = Rect(g.clamp(r.left - padding), g.clamp(r.top - padding), g.clamp(r.right + padding), g.clamp(r.bottom + padding))
    near = F.forall(F.zip_with(F.col("seen"), F.lit(list(mask)), lambda a, b: F.abs(a - b) <= tolerance), lambda ok: ok)
    share = meeting(regions, pixels, "frame", padded, Rect(x, y, x, y)).where(g.contains_point(padded, x, y)).groupBy("frame").agg(F.avg(near.cast("int")).alias("share"))
    return regions.select("frame").distinct().join(share, "frame", "left").select("frame", F.coalesce("share", F.lit(0.0)).alias("share"), F.when(F.col("share") >= least, "CERTIFIED").otherwise("ESCALATE").alias("verdict"))


def polygon_mean(polygons: DataFrame, scores: DataFrame) -> DataFrame:
    """The mean score of the cells in each polygon, 0 where none is inside (F17). ``scores`` has frame, x, y and score."""
    x, y, box = F.col("x"), F.col("y"), Rect.from_struct(F.col("__box"))
    # Edges are looked at for cells in a polygon's bounds alone; above and below these nothing crosses, and beside them only by rounding.
    off = 1e-9 * (1 + F.abs(box.left) + F.abs(box.right))
    near = (y >= box.top) & (y < box.bottom) & (x >= box.left - off) & (x <= box.right + off)
    bounded = polygons.select("frame", "obj", "poly", g.polygon_box(F.col("poly")).alias("__box"))
    inside = meeting(bounded, scores, "frame", box, Rect(x, y, x, y)).where(near).where(g.point_in_polygon(x, y, F.col("poly")))
    # Polygons and what they hold meet in one aggregation, whose keys lie by frame already, and not in a join.
    each = polygons.select("frame", "obj", F.lit(None).cast("double").alias("score"), F.lit(1).alias("n")).unionAll(inside.select("frame", "obj", F.col("score").cast("double"), F.lit(0)))
    means = each.groupBy("frame", "obj").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.sum("n").cast("int").alias("n"))
    return means.select("frame", "obj", F.explode(F.array_repeat("mean_score", F.col("n"))).alias("mean_score"))


def fixed_zone(objects: DataFrame, key: str) -> DataFrame:
    """The union of a target's rectangles over all frames of a fixture."""
    return objects.groupBy(key).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def recognition_diagnostics(rows: DataFrame, key: str) -> DataFrame:
    """Per key: confidence buckets, whether any reading is exact, the least edit distance, and characters."""
    distance = F.when((F.length("text") == 0) & (F.length("expected") == 0), 0.0).otherwise(F.levenshtein("text", "expected") / F.greatest(F.length("text"), F.length("expected")))
    return rows.withColumn("distance", distance).groupBy(key).agg(
        F.count_if(F.col("confidence") < 0.5).alias("low"), F.count_if((F.col("confidence") >= 0.5) & (F.col("confidence") < 0.8)).alias("middle"), F.count_if(F.col("confidence") >= 0.8).alias("high"),
        F.bool_or(F.col("text") == F.col("expected")).alias("any_exact"), F.min("distance").alias("least_distance"), F.sum(F.length("text")).alias("characters"),
    )


def expected_counts(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Groups whose number of rows is not what a profile expects (F14). ``expected`` has the key and n."""
    counted = rows.groupBy(key).agg(F.count("*").alias("found"))
    joined = counted.join(expected.withColumnRenamed("n", "wanted"), key, "full").fillna({"found": 0, "wanted": 0})
    return joined.where("found <> wanted")


def not_exactly_one(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n <> 1")


def largest_object(objects: DataFrame, size: Column, frame: str = "frame", position: str = "obj") -> DataFrame:
    """The largest object of each frame; the first wins ties."""
    best = objects.withColumn("__size", size).withColumn("__k", F.row_number().over(Window.partitionBy(frame).orderBy(F.desc("__size"), position)))
    return best.where("__k = 1").drop("__k", "__size")


def plugged(frames: DataFrame, analyze: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """A user's detector over batches of frames (L1): rows of a fixed schema; an error becomes a row with a failure.

    The frames of a part that fails are searched for the first that fails, and what lies behind it is tried anew, so what fails does not
    depend on how rows fall into batches. Parts are as long as the faults that the task has met suggest, so that about half of them pass:
    n frames with k faults take about k * (2 + log2(n / k)) tries, most of them of short parts, and a batch's results leave together.
    ``schema`` names the frame's key columns first and ends with ``failure string``.
    """
    fields = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fieldNames()

    def shaped(frame: pd.DataFrame) -> pd.DataFrame:
        absent = {c: pd.Series([None] * len(frame), index=frame.index, dtype=object) for c in fields if c not in frame.columns}
        return frame.assign(**absent)[fields]

    def run(batches):
        seen = faults = 0
        for batch in batches:
            good, bad, first = {}, [], 0

            def refused(first: int, behind: int) -> str | None:
                try:
                    out = analyze(batch.iloc[first:behind].reset_index(drop=True))
                except Exception as error:  # a detector's fault is data here
                    return type(error).__name__
                good.setdefault((*out.columns, *out.dtypes), []).append(out)  # only values of one type are put together, so that none is rounded
                return None

            while first < len(batch):
                behind = min(len(batch), first + (max(1, 2 * seen // (3 * faults)) if faults else len(batch)))
                begun, name = first, refused(first, behind)
                if name is not None:
                    while behind - first > 1:  # the first fault lies before behind, and before first there is none
                        half = (first + behind) // 2
                        found = refused(first, half)
                        first, behind, name = (half, behind, None) if found is None else (first, half, found)
                    name = name or refused(first, behind)
                    if name is not None:
                        bad.append((first, name))
                    faults += 1
                seen, first = seen + behind - begun, behind
            for parts in good.values():
                yield shaped(pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0])
            if bad:
                keys = batch.iloc[[at for at, _ in bad]][[c for c in fields if c in batch.columns]]
                yield shaped(keys.assign(failure=[name for _, name in bad]))

    return frames.mapInPandas(run, schema)

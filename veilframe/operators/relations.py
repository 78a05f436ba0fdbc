"""Joins in time and space, windows, top-k and set audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions import geometry as g
from veilframe.functions.geometry import Rect
from veilframe.shared import cut, kept, scratch
from veilframe.streaming.folds import fold_sorted


#: Boxes of a key that one cell holds on average, before the frame is cut into more cells.
CROWD = 64


def sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, a, b): how many rows of each a key has, kept."""
    each = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(key, F.lit(0), F.lit(1)))
    return kept(each.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "sizes")


def meeting(a: DataFrame, b: DataFrame, key: str, reach_a: Rect, reach_b: Rect, crowd: int = CROWD, counted: DataFrame | None = None) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` of one key whose reaches may meet; what the caller asks for is a condition on these.

    Rows of frames with few boxes are paired by their key alone: where they lie by it already, as numbered objects do, nothing is moved.
    A frame with many boxes is cut into a grid, as fine as it is crowded, and only rows of one cell are paired; a pair comes from the
    first cell that both reach. So a crowded frame neither pairs everything with everything nor stays in one task. ``counted`` are the
    :func:`sizes` of both, if they are known.
    """
    if counted is None:
        counted = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = F.col("a") + F.col("b")
    crowded = kept(counted.where(n > crowd).select(key, F.ceil(F.sqrt(n / crowd)).cast("int").alias("__g")), "crowded")
    if crowded.isEmpty():
        return a.join(b, key)

    def placed(rows: DataFrame, reach: Rect, side: str) -> DataFrame:
        cell = lambda v: F.greatest(F.lit(0), F.least(F.col("__g") - 1, F.floor(v * F.col("__g")).cast("int")))
        first = rows.join(crowded, key).withColumns({f"__{side}x": cell(reach.left), f"__{side}y": cell(reach.top), "__r": cell(reach.right), "__b": cell(reach.bottom)})
        across = first.withColumn("__x", F.explode(F.sequence(f"__{side}x", F.greatest(f"__{side}x", "__r"))))
        return across.withColumn("__y", F.explode(F.sequence(f"__{side}y", F.greatest(f"__{side}y", "__b")))).drop("__g", "__r", "__b")

    pairs = placed(a, reach_a, "a").join(placed(b, reach_b, "b"), [key, "__x", "__y"])
    once = (F.col("__x") == F.greatest("__ax", "__bx")) & (F.col("__y") == F.greatest("__ay", "__by"))
    spread = pairs.where(once).drop("__x", "__y", "__ax", "__ay", "__bx", "__by")
    few = lambda rows: rows.join(crowded, key, "left_anti")
    return few(a).join(few(b), key).unionByName(spread)


def matched_and_extra(truth: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's status: MATCHED, MISSING (truth alone) or EXTRA (observation alone)."""
    a, b = truth.select(*keys).distinct().withColumn("__t", F.lit(1)), seen.select(*keys).distinct().withColumn("__s", F.lit(1))
    status = F.when(F.col("__t").isNull(), "EXTRA").when(F.col("__s").isNull(), "MISSING").otherwise("MATCHED")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def as_of(frames: DataFrame, snapshots: DataFrame, lanes: list[str]) -> DataFrame:
    """For each frame and lane the latest snapshot at or before the frame, and whether one comes later.

    ``frames`` has session, ts_ns and frame; ``snapshots`` session, lane, source_ns, event_id and payload columns. Of
    snapshots with one source time the first seen counts. One sort per (session, lane) and no range join; frames without
    a snapshot stay, with basis FUTURE or MISSING.
    """
    payload = [c for c in snapshots.columns if c not in ("session", "lane")]
    per_lane = frames.withColumn("lane", F.explode(F.lit(lanes))).select("session", "lane", F.col("ts_ns").alias("at"), F.col("frame"), F.lit(1).alias("kind"), F.lit(None).alias("s"))
    firsts = snapshots.withColumn("__k", F.row_number().over(Window.partitionBy("session", "lane", "source_ns").orderBy("event_id"))).where("__k = 1")
    sources = firsts.select("session", "lane", F.col("source_ns").alias("at"), F.lit(None).alias("frame"), F.lit(0).alias("kind"), F.struct(*payload).alias("s"))
    keys = Window.partitionBy("session", "lane")
    both = sources.unionByName(per_lane)
    found = both.withColumns({
        "past": F.last("s", ignorenulls=True).over(keys.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)),
        "newest": F.max(F.col("s.source_ns")).over(keys),
    })
    basis = F.when(F.col("past").isNotNull(), "FOUND").when(F.col("newest") > F.col("at"), "FUTURE").otherwise("MISSING")
    return found.where("kind = 1").select("session", "frame", F.col("at").alias("ts_ns"), "lane", basis.alias("basis"), *(F.col("past")[c].alias(c) for c in payload))


def freshness(rows: DataFrame, most_age_ns: int) -> DataFrame:
    """Whether the snapshot found for a frame is fresh: no failure, valid at the frame, and young enough."""
    fresh = (F.col("basis") == "FOUND") & ~F.col("failed") & (F.col("source_ns") <= F.col("ts_ns")) & (F.col("ts_ns") <= F.col("valid_until_ns")) & (F.col("ts_ns") - F.col("source_ns") <= most_age_ns)
    return rows.withColumn("fresh", F.coalesce(fresh, F.lit(False)))


def nearest_monotonic(wanted: DataFrame, decoded: DataFrame, key: str, tolerance: int) -> DataFrame:
    """Each annotation takes the nearest unused decoded time within the tolerance, never before one already passed.

    ``wanted`` has the key and at, ``decoded`` the key and at. The earliest of equally near ones wins. Both lists of a key pass once,
    in order; only decoded times within the tolerance of the next annotation are held.
    """
    both = wanted.select(key, (F.col("at") + tolerance).alias("turn"), F.col("at"), F.lit(1).alias("kind")).unionByName(decoded.select(key, F.col("at").alias("turn"), F.col("at"), F.lit(0).alias("kind")))

    def step(state: list[int], row: tuple) -> tuple[list[int], list[tuple]]:
        owner, _, at, kind = row
        if kind == 0:
            state.append(at)
            return state, []
        while state and state[0] < at - tolerance:
            state.pop(0)
        near = [abs(d - at) for d in state]
        if not near or min(near) > tolerance:
            return state, [(owner, at, None)]
        best = near.index(min(near))
        taken = state[best]
        del state[: best + 1]
        return state, [(owner, at, taken)]

    return fold_sorted(both, key, ["turn", "kind"], list, step, f"{key} {dict(wanted.dtypes)[key]}, at long, taken long")


def decision_lookup(frames: DataFrame, decisions: DataFrame, forgotten: DataFrame, most_age_ns: int) -> DataFrame:
    """The decision of exactly a frame's time, or why a shield stands in for it (E5).

    ``frames``: session, ts_ns, now_ns. ``decisions``: session, ts_ns, status, expires_ns. ``forgotten``: evicted session, ts_ns.
    Without a decision: EVICTED, FUTURE where the session has a later one, else MISSING. With one: EXPIRED after its expiry, STALE
    above the age. A lookup before its frame is REFUSED.
    """
    newest = decisions.groupBy("session").agg(F.max("ts_ns").alias("newest"))
    gone = forgotten.select("session", "ts_ns").withColumn("evicted", F.lit(True))
    joined = frames.join(decisions, ["session", "ts_ns"], "left").join(gone, ["session", "ts_ns"], "left").join(newest, "session", "left")
    none = F.col("status").isNull()
    reason = (
        F.when(F.col("now_ns") < F.col("ts_ns"), "REFUSED")
        .when(none & F.coalesce(F.col("evicted"), F.lit(False)), "EVICTED")
        .when(none & (F.col("newest") > F.col("ts_ns")), "FUTURE")
        .when(none, "MISSING")
        .when(F.col("now_ns") > F.col("expires_ns"), "EXPIRED")
        .when(F.col("now_ns") - F.col("ts_ns") > most_age_ns, "STALE")
    )
    return joined.select("session", "ts_ns", F.coalesce(reason, F.lit("OK")).alias("lookup"), F.when(reason.isNull(), F.col("status")).otherwise("FULL_SHIELD").alias("status"))


def span_elements(elements: DataFrame, spans: DataFrame, key: str, width: int = 256, crowd: int = 256) -> DataFrame:
    """Elements that a half-open span overlaps, and spans without one (element null), which are errors.

    The elements of a key with at most ``crowd`` spans meet all of these: where they lie by key already, none is moved. Those of other keys are cut,
    as their spans are, at multiples of ``width`` and meet by (key, bin), so a key with very many elements and spans is spread, and no two
    meet that are far apart. A pair that shares several bins is taken from the first.
    """
    crowded = kept(spans.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(key), "crowded")
    wanted = spans.select(key, "start", "end")
    each = elements.select(F.col(key).alias("__k"), "element", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    touches = (F.col("e_start") < F.col("end")) & (F.col("e_end") > F.col("start"))
    few = wanted if crowded.isEmpty() else wanted.join(crowded, key, "left_anti")
    # A span without an element stays, so that what is missed takes no second pass.
    found = few.join(each, (F.col(key) == F.col("__k")) & touches, "left").select(key, "start", "end", "element")
    if crowded.isEmpty():
        return found
    many = lambda rows: rows.join(crowded, key, "left_semi")
    spread = many(wanted)
    hits = _binned_hits(many(each.withColumnRenamed("__k", key)), spread, key, width).where(touches).select(key, "start", "end", "element")
    missed = spread.join(hits, [key, "start", "end"], "left_anti").withColumn("element", F.lit(None).cast(elements.schema["element"].dataType))
    return found.unionByName(hits).unionByName(missed)


def _binned_hits(elements: DataFrame, spans: DataFrame, key: str, width: int) -> DataFrame:
    """Elements (key, element, e_start, e_end) and spans that share a bin, each pair in the first that both have."""

    at = lambda c: F.floor(c / width)

    def binned(rows: DataFrame, start: str, end: str) -> DataFrame:
        return rows.select("*", F.explode(F.sequence(at(F.col(start)), at(F.greatest(F.col(end) - 1, F.col(start))))).alias("bin"))

    met = binned(spans, "start", "end").join(binned(elements, "e_start", "e_end"), [key, "bin"])
    return met.where(F.col("bin") == F.greatest(at(F.col("start")), at(F.col("e_start"))))


def track_candidates(tracks: DataFrame, seen: DataFrame, key: str, least_iou: float = 0.10, most_scale: float = 2.0, most_distance: float = 0.30) -> DataFrame:
    """Pairs that may be one object, with their score: overlap and nearness, and 2 more where the detector's hint agrees."""
    a, b = Rect.of(), Rect.of("p_")

    def reach(r: Rect) -> Rect:
        # Half the distance around the center, and the box itself.
        x, y, half = (r.left + r.right) / 2, (r.top + r.bottom) / 2, most_distance / 2 + 1e-9
        return Rect(F.least(r.left, x - half), F.least(r.top, y - half), F.greatest(r.right, x + half), F.greatest(r.bottom, y + half))

    both = meeting(tracks, seen, key, reach(a), reach(b)).withColumns({"iou": g.iou(a, b), "distance": g.center_distance(a, b), "scale": g.scale_ratio(a, b)})
    kept = both.where((F.col("iou") >= least_iou) | ((F.col("scale") <= most_scale) & (F.col("distance") <= most_distance)))
    bonus = F.when(F.col("hint") == F.col("p_hint"), 2.0).otherwise(0.0) if {"hint", "p_hint"} <= set(both.columns) else F.lit(0.0)
    return kept.withColumn("score", bonus + F.col("iou") + 1 - F.least(F.lit(1.0), F.col("distance") / most_distance))


def self_overlaps(boxes: DataFrame, key: str, item: str, least_iou: float = 0.30) -> DataFrame:
    """Pairs of one frame's boxes that overlap so much that tracks become ambiguous."""
    other = boxes.select(F.col(key), F.col(item).alias("other"), *(F.col(c).alias(f"p_{c}") for c in Rect._fields))
    pairs = meeting(boxes.select(key, item, *Rect._fields), other, key, Rect.of(), Rect.of("p_")).where(F.col(item) < F.col("other"))
    return pairs.where(g.iou(Rect.of(), Rect.of("p_")) >= least_iou).select(key, item, "other")


def pick(taps: DataFrame, tracks: DataFrame, key: str, most_age_ns: int) -> DataFrame:
    """What a tap selects: NO_FACE, AMBIGUOUS, STALE or SELECTED with the track."""
    inside = g.contains_point(Rect.of(), F.col("x"), F.col("y"))
    hits = taps.join(tracks, key).where(inside).groupBy(key, "tap").agg(F.count("*").alias("n"), F.min(F.struct("track", "fresh", "age_ns")).alias("one"))
    joined = taps.select(key, "tap").join(hits, [key, "tap"], "left")
    verdict = F.when(F.col("n").isNull(), "NO_FACE").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("one.fresh") & (F.col("one.age_ns") <= most_age_ns), "SELECTED").otherwise("STALE")
    return joined.select(key, "tap", verdict.alias("verdict"), F.when(verdict == "SELECTED", F.col("one.track")).alias("track"))


def resolve_members(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each wanted path: the exact one, else the only one of that name, else none or ambiguous."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    exact = files.select(F.col("path").alias("wanted"), F.col("path").alias("exact"))
    by_name = files.groupBy(name(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("only"))
    joined = wanted.withColumn("name", name(F.col("wanted"))).join(exact, "wanted", "left").join(by_name, "name", "left")
    found = F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))
    return joined.select("wanted", found.alias("path"), F.when(found.isNotNull(), "OK").when(F.col("n") > 1, "AMBIGUOUS").otherwise("ABSENT").alias("status"))


def artifact_audit(found: DataFrame, required: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Required artifacts that are missing or differ, forbidden ones that are there, and names that occur twice."""
    missing = required.join(found, ["name", "bytes", "digest"], "left_anti").select("name", F.lit("MISSING").alias("problem"))
    present = found.join(forbidden, "name", "left_semi").select("name", F.lit("FORBIDDEN").alias("problem"))
    twice = found.groupBy("name").count().where("count > 1").select("name", F.lit("DUPLICATE").alias("problem"))
    return missing.unionByName(present).unionByName(twice)


def positional_drift(samples: DataFrame, truth: DataFrame, key: str, most_us: int = 2000) -> DataFrame:
    """Samples and truth frames with one ordinal whose times differ by more than the limit."""
    number = lambda df, name: df.select(key, F.col("at").alias(name), F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("ordinal"))
    both = number(samples, "sample_at").join(number(truth, "truth_at"), [key, "ordinal"])
    return both.where(F.abs(F.col("sample_at") - F.col("truth_at")) > most_us)


def out_of_order(rows: DataFrame, key: str, position: str, at: str) -> DataFrame:
    """Rows whose time does not come strictly after all before them in their key; they are refused, not sorted in."""
    before = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__seen", F.max(at).over(before)).where(F.col(at) <= F.col("__seen")).drop("__seen")


def reading_order(elements: DataFrame, key: str, most_chars: int | None = None) -> DataFrame:
    """Offsets of elements in their text, joined by one space from top to bottom and left to right.

    Elements that end behind ``most_chars`` get ``within`` false, where the bound is given.
    """
    w = Window.partitionBy(key).orderBy("top", "left", "element").rowsBetween(Window.unboundedPreceding, -1)
    # Lengths come first, so that texts which are not asked for are not moved.
    start = F.coalesce(F.sum(F.col("__n") + 1).over(w), F.lit(0))
    out = elements.withColumn("__n", F.length("text")).withColumns({"start": start, "end": start + F.col("__n")}).drop("__n")
    return out if most_chars is None else out.withColumn("within", F.col("end") <= most_chars)


def changes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before, and each key's first."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumns({"__was": F.lag(value).over(w), "__k": F.row_number().over(w)})
    return marked.where((F.col("__k") == 1) | ~F.col(value).eqNullSafe(F.col("__was"))).drop("__was", "__k")


def jumps(rows: DataFrame, key: str, order: str, value: str, least: float) -> DataFrame:
    """Rows whose value differs from the one before by at least so much."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("step", F.abs(F.col(value) - F.lag(value).over(w))).where(F.col("step") >= least)


def retention(rows: DataFrame, key: str, at: str, keep: int, remember: int) -> DataFrame:
    """RETAINED for the newest rows of a key, EVICTED for as many before as are remembered, FORGOTTEN for the rest."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return rows.withColumn("fate", F.when(k <= keep, "RETAINED").when(k <= keep + remember, "EVICTED").otherwise("FORGOTTEN"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place in an order over all of them, from 1.

    Rows are dealt by range and counted there; a range's first number is what the ranges before hold, so one task adds up counts alone.
    Written once, as the ranges of two evaluations might differ.
    """
    spark = rows.sparkSession
    at = scratch(spark, "ranges")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1}).write.parquet(at)
    dealt = spark.read.parquet(at)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__k")).drop("__part", "__k", "__before")


def nth_trigger(rows: DataFrame, key: str, order: list[str], skip: int) -> DataFrame:
    """The one row of each key that fires after ``skip`` others, and its place among those that fire."""
    fired = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__k") == skip + 1).drop("__k")
    return numbered(fired, order, "fired")


def suffix_match(seen: DataFrame, wanted: DataFrame, key: str, least: int = 1, most: int = 160) -> DataFrame:
    """Whether the last frames of a capture are exactly the wanted ones, after a permitted number of others."""
    total = seen.groupBy(key).agg(F.count("*").alias("n"))
    wanted_n = wanted.groupBy(key).agg(F.count("*").alias("m"))
    shift = total.join(wanted_n, key).withColumn("priming", F.col("n") - F.col("m"))
    both = wanted.join(shift, key).join(seen.select(key, F.col("at").alias("s_at"), F.col("digest").alias("s_digest")), key)
    pairs = both.where(F.col("s_at") == F.col("at") + F.col("priming"))
    same = pairs.groupBy(key).agg(F.count_if(F.col("digest") == F.col("s_digest")).alias("same"))
    return shift.join(same, key, "left").select(key, "priming", ((F.col("same") == F.col("m")) & F.col("priming").between(least, most)).alias("ok")).fillna({"ok": False})


def stratified_choice(rows: DataFrame, slices: list[str], each: int, name: str, seed: str) -> DataFrame:
    """For each slice in turn the ``each`` rows of least hash that no slice before has taken; a slice that runs short fails the query (H1).

    ``rows`` has name and slices (an array). The slices before one can take at most ``each`` rows each, so a slice's choice is among its
    first ``each`` times its place; these are kept in one pass, and the choice runs over them alone.
    """
    lots = rows.select(name, F.sha2(F.concat(F.lit(seed), F.col(name)), 256).alias("lot"), F.posexplode(F.filter(F.lit(slices), lambda s: F.array_contains("slices", s))).alias("__i", "slice"))
    place = F.array_position(F.lit(slices), F.col("slice"))
    k = F.row_number().over(Window.partitionBy("slice").orderBy("lot", name))
    first = cut(lots.withColumn("__k", k).where(F.col("__k") <= place * each).select(name, "lot", "slice"))
    taken = None
    for label in slices:
        free = first.where(F.col("slice") == label)
        if taken is not None:
            free = free.join(F.broadcast(taken.select(name)), name, "left_anti")
        mine = free.orderBy("lot", name).limit(each)
        taken = mine if taken is None else taken.unionByName(mine)
    counts = taken.groupBy("slice").agg(F.count("*").alias("__n"))
    short = F.raise_error(F.concat(F.lit("too few candidates for "), F.col("slice")))
    enough = spread(taken.sparkSession, slices, "slice").join(counts, "slice", "left").select("slice", F.when(F.col("__n") >= each, True).otherwise(short.cast("boolean")).alias("__ok"))
    return taken.join(F.broadcast(enough), "slice").where("__ok").select(name, "lot", "slice")


def spread(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """A column of a few given values."""
    return spark.range(1).select(F.explode(F.lit(values)).alias(name))


def first_in_key(rows: DataFrame, key: str, order: list[Column | str], most: int) -> DataFrame:
    """At most so many rows of each key, in order (H3)."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__k") <= most).drop("__k")


def leaked_values(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """Values of leakage keys that stand in more than one split; each element of an array-valued key is a value of its own."""
    types = dict(rows.dtypes)
    values = lambda k: F.col(k).cast("array<string>") if types[k].startswith("array") else F.array(F.col(k).cast("string"))
    named_as = lambda k: F.transform(F.coalesce(values(k), F.array().cast("array<string>")), lambda v: F.struct(F.lit(k).alias("key"), v.alias("value")))
    named = F.concat(*map(named_as, keys))
    long = rows.select(split, F.explode(named).alias("kv"))
    return long.where("kv.value IS NOT NULL").groupBy("kv.key", "kv.value").agg(F.countDistinct(split).alias("splits")).where("splits > 1").select("key", "value", "splits")


def merge_boxes(boxes: DataFrame, key: str, provenance: list[str]) -> DataFrame:
    """Overlapping boxes of one provenance united again and again until none overlap (I6). A united box can reach boxes that no member touched.

    ``provenance`` names the columns that must agree: category, confidence and action of findings, or none for zones. The boxes of a key
    and provenance pass by their left edge; the state is the boxes merged so far that a later one can still reach.
    """
    group = [key, *provenance]
    owner = boxes.select(F.struct(*group).alias("__g"), *Rect._fields, F.lit(0).alias("__end"))
    last = boxes.select(F.struct(*group).alias("__g")).distinct().select("__g", *(F.lit(None).cast("double").alias(c) for c in Rect._fields), F.lit(1).alias("__end"))

    def meets(a: tuple, b: tuple) -> bool:
        return a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]

    def step(state: list[tuple], row: tuple) -> tuple[list[tuple], list[tuple]]:
        owner, *now, end = row
        if end:
            return [], [(owner, *b) for b in state]
        # Boxes come by their left edge. A box left of everything that can still grow is done: behind it lies a free upright line.
        open_from, kept, done = now[0], [], []
        for b in sorted(state, key=lambda b: -b[2]):
            (kept if b[2] >= open_from else done).append(b)
            open_from = min(open_from, b[0]) if b[2] >= open_from else open_from
        now = tuple(now)
        while (hit := next((i for i, b in enumerate(kept) if meets(b, now)), None)) is not None:
            b = kept.pop(hit)
            now = (min(b[0], now[0]), min(b[1], now[1]), max(b[2], now[2]), max(b[3], now[3]))
        return [*kept, now], [(owner, *b) for b in done]

    marked = owner.unionByName(last).select(F.to_json("__g", {"ignoreNullFields": "false"}).alias("__g"), *Rect._fields, "__end")
    merged = fold_sorted(marked, "__g", ["__end", *Rect._fields], list, step, "__g string, left double, top double, right double, bottom double")
    types = ", ".join(f"`{c}` {t}" for c, t in boxes.dtypes if c in group)
    return merged.select(F.from_json("__g", types).alias("__g"), *Rect._fields).select(*(F.col("__g")[c].alias(c) for c in group), *Rect._fields)


def health(units: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Per session: the latest state and failure, and counters of what was offered and released, by kind, and dropped.

    ``units`` has the key, kind (CONFIG, KEY or MEDIA), arrival_ns, released_ns (null: not released) and dropped; ``states`` the key, at, state and failure.
    """
    released = F.col("released_ns").isNotNull()
    counts = [F.count_if((F.col("kind") == k) & on).alias(f"{name}_{k.lower()}") for name, on in (("offered", F.lit(True)), ("released", released)) for k in ("CONFIG", "KEY", "MEDIA")]
    tally = units.groupBy(key).agg(*counts, F.count_if("dropped").alias("dropped"), F.min("released_ns").alias("first_release"), F.max("released_ns").alias("last_release"))
    latest = states.groupBy(key).agg(F.max_by(F.struct("state", "failure"), "at").alias("s"))
    return latest.join(tally, key, "full").select(key, "s.state", "s.failure", *(c for c in tally.columns if c != key))


def release_statistics(units: DataFrame, key: str) -> DataFrame:
    """Per session: offered and released units by kind, and least, largest and whole mean release delay."""
    delay = F.col("released_ns") - F.col("arrival_ns")
    return units.groupBy(key).agg(
        F.count("*").alias("offered"), F.count_if(F.col("is_key")).alias("key_units"), F.count("released_ns").alias("released"),
        F.min(delay).alias("least_delay"), F.max(delay).alias("largest_delay"), F.expr("sum(released_ns - arrival_ns) div count(released_ns)").alias("mean_delay"),
    )


def telemetry_snapshot(events: DataFrame, key: str, newest: int) -> DataFrame:
    """Per session: decisions, the latest value, kind and failure, and the newest events' ids."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts_ns"), F.desc("event_id")))
    last = events.withColumn("__k", k)
    return last.groupBy(key).agg(
        F.count_if(F.col("event_type") == "purchase").alias("decisions"),
        F.max_by("value", F.struct("ts_ns", "event_id")).alias("last_value"),
        F.max_by("event_type", F.struct("ts_ns", "event_id")).alias("last_type"),
        F.sort_array(F.collect_list(F.when(F.col("__k") <= newest, F.col("event_id")))).alias("newest"),
    )

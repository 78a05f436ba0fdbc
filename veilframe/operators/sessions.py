"""Session rules that windows and joins express without a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import geometry as g
from veilframe.functions.geometry import Rect
from veilframe.operators.relations import merge_boxes
from veilframe.streaming import policies as p


def visibility(tracks: DataFrame, selected: str = "selected") -> DataFrame:
    """HOST_VISIBLE only for the selected track while it is fresh, neither lost nor expired; all others are PROTECTED; repeated ids are refused."""
    copies = F.count("*").over(Window.partitionBy("session", "at", "track"))
    ok = (F.col("track") == F.col(selected)) & (F.col("confidence") == "FRESH") & ~F.col("lost") & ~F.col("expired")
    return tracks.withColumn("policy", F.when(copies > 1, "REFUSED").when(F.coalesce(ok, F.lit(False)), "HOST_VISIBLE").otherwise("PROTECTED"))


def host_continuity(rows: DataFrame) -> DataFrame:
    """Whether a pick still holds: from the pick on every row of the session must be ok; only a new pick regains it.

    ``rows`` has session, at, picked (boolean) and ok (boolean).
    """
    w = Window.partitionBy("session").orderBy("at")
    numbered = rows.withColumn("pick", F.sum(F.col("picked").cast("int")).over(w))
    island = Window.partitionBy("session", "pick").orderBy("at")
    return numbered.withColumn("held", (F.col("pick") > 0) & (F.min(F.col("ok").cast("int")).over(island) == 1))


def illegal_steps(events: DataFrame) -> DataFrame:
    """Steps of a session that the table of legal steps does not have (J15). The table is a handful of rows."""
    states = list(p.LEGAL)
    legal = [(a, b) for a in states for b in states if p.is_legal(a, b)]
    table = events.sparkSession.createDataFrame(legal, "from_state string, to_state string")
    w = Window.partitionBy("session").orderBy("at")
    steps = events.withColumn("from_state", F.lag("state").over(w)).withColumnRenamed("state", "to_state").where(F.col("from_state").isNotNull())
    return steps.join(F.broadcast(table), ["from_state", "to_state"], "left_anti")


def zone_revisions(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """The zone revision in force at each frame, and a shield where mapped zones belong to another one.

    ``frames``: session, at, mapped_revision. ``edits``: session, at, revision.
    """
    both = frames.select("session", "at", "mapped_revision", F.lit(None).cast("long").alias("revision"), F.lit(1).alias("kind")).unionByName(edits.select("session", "at", F.lit(None).cast("long").alias("mapped_revision"), "revision", F.lit(0).alias("kind")))
    now = F.max("revision").over(Window.partitionBy("session").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("current", now).where("kind = 1").select("session", "at", "current", (~F.col("mapped_revision").eqNullSafe(F.col("current"))).alias("shield"))


def frame_regions(snapshots: DataFrame, tracks: DataFrame, zones: DataFrame) -> DataFrame:
    """What a frame protects (J3): findings, with faces replaced by tracks where any exist, of which the visible host is left out, and all zones.

    All three have session, at, category and a rectangle; tracks have policy as well.
    """
    has_tracks = tracks.select("session", "at").distinct()
    faces = snapshots.where("category = 'FACE'").join(has_tracks, ["session", "at"], "left_anti")
    others = snapshots.where("category <> 'FACE'")
    guarded = tracks.where("policy <> 'HOST_VISIBLE'").drop("policy")
    return faces.unionByName(others).unionByName(guarded).unionByName(zones)


def with_zones(decisions: DataFrame, findings: DataFrame, zones: DataFrame, most_zones: int = 8) -> tuple[DataFrame, DataFrame]:
    """Each frame's decision with its zones, and the regions of the frames that are safe.

    ``decisions`` has frame, basis (of J1) and zones_ok; ``findings`` frame, category, confidence, action and a rectangle; ``zones`` frame and a
    rectangle. Zones that could not be transformed safely, more than ``most_zones`` of them, and a basis that asks for it shield the frame.
    Zones count as validated and opaque. Regions of equal category, confidence and action that overlap are united (I6).
    """
    counted = decisions.join(zones.groupBy("frame").agg(F.count("*").alias("zones")), "frame", "left").fillna({"zones": 0})
    shield = ~F.coalesce("zones_ok", F.lit(False)) | (F.col("zones") > most_zones) | (F.col("basis") == "SHIELD_REQUIRED")
    decided = counted.select("frame", F.when(shield, "SHIELD_REQUIRED").otherwise(F.col("basis")).alias("basis"), "zones")
    safe = decided.where("basis <> 'SHIELD_REQUIRED'").select("frame")
    columns = ["frame", "category", "confidence", "action", *Rect._fields]
    added = zones.select("frame", F.lit("PRIVACY_ZONE").alias("category"), F.lit("VALIDATED").alias("confidence"), F.lit("OPAQUE").alias("action"), *Rect._fields)
    regions = findings.select(*columns).unionByName(added).join(safe, "frame", "left_semi")
    return decided, merge_boxes(regions, "frame", ["category", "confidence", "action"])


def mask_rectangles(regions: DataFrame, transform: Column, padding: float = 0.04, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """What is painted over each frame (C29): (frame, shield), and the rectangles of the frames that are not shielded.

    ``regions`` has frame, category and a rectangle on the sensor; ``transform`` is the matrix to the output. Rectangles are padded, zones are
    not. An unsafe transform, or more than ``most`` rectangles, shields the frame.
    """
    kept = [c for c in regions.columns if c not in Rect._fields]
    mapped = regions.withColumn("__r", g.map_rect(transform, Rect.of()))
    frames = mapped.groupBy("frame").agg(((F.count("*") > most) | F.bool_or(F.col("__r").isNull())).alias("shield"))
    pad, r = F.when(F.col("category") == "PRIVACY_ZONE", 0.0).otherwise(padding), Rect.from_struct(F.col("__r"))
    grown = Rect(g.clamp(r.left - pad), g.clamp(r.top - pad), g.clamp(r.right + pad), g.clamp(r.bottom + pad))
    safe = mapped.join(frames.where("NOT shield").select("frame"), "frame", "left_semi")
    return frames, safe.select(*kept, *(c.alias(n) for n, c in zip(Rect._fields, grown)))

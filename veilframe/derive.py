"""Views over the driver's tables in the engine's own shapes; coordinates are multiples of 1/64, so they are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truth_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of frames: an order is a frame, its lines are boxes."""
    # The numbers come first, so that the table's own columns are what is moved, and frames lie by key for what follows.
    numbered = table(spark, sf_dir, "lineitem").withColumn("obj", F.expr(f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER})"))
    return numbered.selectExpr(
        "l_orderkey AS frame",
        "obj",
        "CASE l_returnflag WHEN 'A' THEN 'EMAIL' WHEN 'N' THEN 'CARD' ELSE 'PHONE' END AS category",
        "(l_partkey % 40) / 64D AS left",
        "(l_suppkey % 40) / 64D AS top",
        "(l_partkey % 40 + 3 + CAST(l_quantity AS BIGINT) % 16) / 64D AS right",
        "(l_suppkey % 40 + 9 + l_linenumber % 8) / 64D AS bottom",
        "l_partkey AS pk",
        "l_suppkey AS sk",
        "l_linenumber AS ln",
        "3 + CAST(l_quantity AS BIGINT) % 16 <= 4 AS is_small",
        "l_tax >= 0.06 AS is_blurred",
        "l_discount >= 0.08 AS is_occluded",
        "l_linestatus = 'F' AND l_linenumber >= 5 AS is_difficult",
    )


def pred_box(truth: DataFrame) -> DataFrame:
    """Predictions: some objects missing, the others shifted, a few in another category."""
    dx, dy = "(pk % 5 - 2) / 64D", "(sk % 3 - 1) / 64D"
    return truth.where("obj % 5 <> 4").selectExpr(
        "frame",
        "obj AS pred",
        "CASE WHEN ln = 7 THEN 'OTHER' ELSE category END AS p_category",
        f"greatest(0D, least(1D, left + {dx})) AS p_left",
        f"greatest(0D, least(1D, top + {dy})) AS p_top",
        f"greatest(0D, least(1D, right + {dx})) AS p_right",
        f"greatest(0D, least(1D, bottom + {dy})) AS p_bottom",
    )


def session_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the frames of their user's session, in time order; instants are nanoseconds."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        "event_id",
        "event_type",
        "value",
        F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1").cast("long").alias("frame"),
    )


def episode_frames(frames: DataFrame) -> DataFrame:
    """Sessions as tracking episodes."""
    return frames.selectExpr(
        "session AS episode", "frame", "ts_ns", "event_type <> 'signup' AS visible", "value < 400 AS guarded",
        "CASE WHEN event_type IN ('click', 'view') THEN CAST(floor(value / 100) AS BIGINT) END AS track",
    )


def snapshots(frames: DataFrame) -> DataFrame:
    """Detector snapshots: clicks are faces, views text, purchases codes; an error is a failed snapshot of some lane."""
    return frames.where("event_type IN ('click', 'view', 'purchase', 'error')").selectExpr(
        "session",
        "event_id",
        "CASE event_type WHEN 'click' THEN 'FACE' WHEN 'view' THEN 'TEXT' WHEN 'purchase' THEN 'BARCODE' ELSE element_at(array('FACE', 'TEXT', 'BARCODE'), CAST(session % 3 + 1 AS INT)) END AS lane",
        "ts_ns AS source_ns",
        "ts_ns + CAST(floor(value) AS BIGINT) * 3600000000000 AS valid_until_ns",
        "event_type = 'error' AS failed",
        "CAST(floor(value) AS BIGINT) % 4 AS n_findings",
    )

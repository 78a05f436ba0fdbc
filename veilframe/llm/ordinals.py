"""Places of rows inside groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import scratch


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``place`` (from 0, by ``order`` inside ``group``) and ``group_rows``; ``group`` must not be null.

    Rows are dealt by range of (group, order), so a group that holds a third of all rows lies on many tasks. A row's
    place is its distance from the group's first row in its range, plus the group's rows in the ranges before; only
    these counts, one for each group and range, are summed up. Written once, as two evaluations could be dealt differently.
    """
    spark, at = rows.sparkSession, scratch(rows.sparkSession, "places")
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt.withColumns({"__part": F.spark_partition_id(), "__k": F.monotonically_increasing_id()}).write.parquet(at)
    dealt = spark.read.parquet(at)
    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n"), F.min("__k").alias("__first"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")
    offsets = counts.select(group, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("group_rows"))
    return dealt.join(offsets, [group, "__part"]).withColumn("place", F.col("__k") + F.col("__shift")).drop("__part", "__k", "__shift")

"""Sharding by fixed virtual slots: records hash into thousands of slots, a small versioned table maps slots to shards.

A record's virtual slot never changes; only the map does. Version 0 deals the slots round about. :func:`rebalanced` reads
the bytes of each slot and edits the map: every shard keeps its largest slots up to its fair share, the others are dealt,
largest first, to the shard with the least. :func:`grown` moves slots into one more shard and nowhere else. The stored
map is a log of edits: a slot's shard at a version is that of its latest edit up to there.

Uses DataFrame functions alone. The map and the slots' loads have ``SLOTS`` rows at most, which bounds what is broadcast
and what the fold holds. A null text has no bytes and counts as empty; a null id is hashed like any other value beside
the text's checksum. Equal rows get places of their own. An empty table gives no rows and leaves the map at version 0
as it is. Columns of the input named as those that are added give way. Texts of any length are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import documents, scratch

SLOTS, SHARDS = 4096, 16
#: Equal rows are written out in runs of this length, so that no array grows with their number.
RUN = 1 << 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text, and one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def checksum(text: Column) -> Column:
    """Unsigned crc32 of a text's UTF-8 bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def virtual_slot(doc_id: Column, text_crc32: Column, slots: int = SLOTS) -> Column:
    """The slot of a record, from its id and text."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), text_crc32), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 0: (version, slot, shard)."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def map_at(log: DataFrame, version: int | None = None) -> DataFrame:
    """(slot, shard) at a version; None: the latest."""
    seen = log if version is None else log.where(F.col("version") <= version)
    return seen.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))


def loads(records: DataFrame) -> DataFrame:
    """(slot, bytes, rows) of records (slot, size)."""
    return records.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _loaded(log: DataFrame, load: DataFrame) -> DataFrame:
    return map_at(log).join(load, "slot", "left").select("slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _fair_share(now: DataFrame, shards: int) -> DataFrame:
    """(share): bytes of a shard when slots that are larger than it have shards of their own."""
    order = Window.orderBy(F.desc("bytes"), "slot")  # over SLOTS rows at most
    ahead = now.select("bytes", (F.row_number().over(order) - 1).alias("k"), (F.sum("bytes").over(Window.partitionBy()) - F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("bytes")).alias("rest"))
    shares = ahead.where(F.col("k") < shards).select("bytes", "k", (F.col("rest") / (shards - F.col("k"))).alias("share"))
    return shares.where(F.col("bytes") <= F.col("share")).agg(F.coalesce(F.min_by("share", "k"), F.lit(0.0)).alias("share"))


def rebalanced(log: DataFrame, load: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Edits (version, slot, shard) of the next version that make the shards' bytes near equal.

    A shard keeps its first slot by size even beyond its share. The fold over what is given up has at most ``SLOTS`` steps.
    """
    now = _loaded(log, load)
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    fair = now.crossJoin(F.broadcast(_fair_share(now, shards)))
    marked = fair.select("slot", "shard", "bytes", ((F.sum("bytes").over(largest) <= F.col("share")) | (F.row_number().over(largest) == 1)).alias("stays"))
    given = F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "slot", "shard"))))
    held = marked.groupBy("shard").agg(F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)).alias("bytes"))
    state = marked.agg(given.alias("given")).crossJoin(F.broadcast(held.agg(F.collect_list(F.struct("bytes", "shard")).alias("held"))))
    start = F.struct(F.col("held").alias("held"), F.array().cast("array<struct<slot:int,was:int,shard:int>>").alias("moves"))

    def step(acc: Column, item: Column) -> Column:
        least = F.array_min(acc["held"])["shard"]
        held_now = F.transform(acc["held"], lambda x: F.struct(F.when(x["shard"] == least, x["bytes"] - item["less"]).otherwise(x["bytes"]).alias("bytes"), x["shard"].alias("shard")))
        return F.struct(held_now.alias("held"), F.concat(acc["moves"], F.array(F.struct(item["slot"].alias("slot"), item["shard"].alias("was"), least.alias("shard")))).alias("moves"))

    moves = state.select(F.explode(F.aggregate("given", start, step, lambda acc: acc["moves"])).alias("m"))
    return _next_version(log, moves.where("m.shard <> m.was").select("m.slot", "m.shard"))


def grown(log: DataFrame, load: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Edits of the next version that add shard number ``shards``: each old shard gives its smallest slots beyond its new share to it."""
    now = _loaded(log, load)
    small = Window.partitionBy("shard").orderBy("bytes", "slot")
    over = F.sum("bytes").over(Window.partitionBy("shard")) - F.col("share")
    moved = now.crossJoin(F.broadcast(_fair_share(now, shards + 1))).select("slot", (F.sum("bytes").over(small) <= over).alias("goes"))
    return _next_version(log, moved.where("goes").select("slot", F.lit(shards).alias("shard")))


def _next_version(log: DataFrame, edits: DataFrame) -> DataFrame:
    version = log.agg((F.max("version") + 1).alias("version"))
    return edits.crossJoin(F.broadcast(version)).select("version", "slot", "shard")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, slot) of every document."""
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size"), checksum(F.col("text")).alias("text_crc32"))
    return measured.withColumn("slot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots))


def assigned(docs: DataFrame, shard_of: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The documents with all their columns, ``virtual_slot`` and ``shard``."""
    slot = virtual_slot(F.col("doc_id"), checksum(F.col("text")), slots)
    known = F.broadcast(shard_of.select(F.col("slot").alias("virtual_slot"), "shard"))
    return docs.drop("virtual_slot", "shard").withColumn("virtual_slot", slot).join(known, "virtual_slot")


def places(rows: DataFrame, shard_of: DataFrame, load: DataFrame) -> DataFrame:
    """Records (doc_id, size, text_crc32, slot) with their shard and their place in it, gapless from 0.

    A shard's rows stand by virtual slot, then id, checksum and size; a task sorts one virtual slot. Equal rows are one row
    with a count until they have their places, so any number of them does not make a virtual slot large.
    """
    first = load.join(shard_of, "slot").select("slot", "shard", (F.sum("rows").over(w := Window.partitionBy("shard").orderBy("slot")) - F.col("rows")).alias("before"))
    alike = rows.groupBy("slot", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    inside = F.sum("n").over(Window.partitionBy("slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    runs = alike.withColumn("at", inside).join(F.broadcast(first), "slot").withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
    each = runs.withColumn("k", F.explode(F.expr(f"sequence(run * {RUN}, least(n, (run + 1) * {RUN}) - 1)")))
    return each.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") + F.col("k")).alias("place"), F.col("slot").alias("virtual_slot"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard after one rebalancing by bytes, and its place in the shard."""
    at, log_at, load_at = (scratch(spark, name) for name in ("records", "slot-map", "slot-loads"))
    records(documents(spark, sf_dir)).write.parquet(at)
    rows = spark.read.parquet(at)
    loads(rows).write.parquet(load_at)
    load = spark.read.parquet(load_at)
    first_map(spark).write.parquet(log_at)
    log = spark.read.parquet(log_at)
    rebalanced(log, load).write.mode("append").parquet(log_at)
    log = spark.read.parquet(log_at)
    placed = places(rows, map_at(log), load)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")

"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.shared import cut, scratch, shared_folder

__all__ = ["bucket_count", "cut", "documents", "held_out", "id_and_text", "scratch", "shared_folder", "words_of"]

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents; a table of fewer parts than there are cores is dealt to all of them."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def bucket_count(spark: SparkSession, least: int = 64, times: int = 4) -> int:
    """How many groups to deal packed rows into: follows the shuffle partitions that are set for the data's size."""
    return max(least, times * int(spark.conf.get("spark.sql.shuffle.partitions")))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def held_out(doc_id: Column, mod: int, fold: int) -> Column:
    """Whether the crc32 of the id's digits falls in the fold that is kept from learning; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == fold, F.lit(True))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and whole text (null: empty); other columns, whatever their names, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

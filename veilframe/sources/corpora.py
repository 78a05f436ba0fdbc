"""Corpus builders: annotation files to tables, and manifests from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions import geometry as g
from veilframe.functions import text as t


#: The fields of COCO files; a segmentation, of whichever form, stays JSON text.
COCO = "images array<struct<id:{0},file_name:string,width:double,height:double>>, categories array<struct<id:{0},name:string>>, annotations array<struct<id:{0},image_id:{0},category_id:{0},bbox:array<double>,area:double,iscrowd:int,segmentation:string>>"


def coco_tables(spark: SparkSession, path: str, ids: str = "long") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, categories and annotations of COCO files (A6); ``ids`` is the type of their ids.

    The fields are given, so that no pass looks for them, and a table's pass skips what the other tables hold.
    """
    doc = spark.read.schema(COCO.format(ids)).json(path, multiLine=True)
    return tuple(doc.select(F.explode(part).alias("v")).select("v.*") for part in ("images", "categories", "annotations"))


def coco_star(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations with their image and category, as clamped polygons; orphans have an error instead."""
    i = images.select(F.col("id").alias("image_id"), "file_name", F.col("width").alias("iw"), F.col("height").alias("ih"))
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    joined = annotations.join(i, "image_id", "left").join(c, "category_id", "left")
    error = F.when(F.col("file_name").isNull(), "image").when(F.col("category").isNull(), "category")
    b = F.col("bbox")
    poly = g.normalized_box(b[0], b[1], b[2], b[3], F.col("iw"), F.col("ih"))
    return joined.select("id", "file_name", "category", F.when(error.isNull(), poly).alias("polygon"), error.alias("error"))


def public_manifest(items: DataFrame, prefix: str, seed: str) -> DataFrame:
    """Manifest rows with numbered ids and nested leakage keys, in the order of the seeded hash (K1).

    Rows are numbered inside buckets of the hash's first four digits, behind the rows of the buckets before; only the at most 65536
    buckets' counts are added up in one place.
    """
    hashed = items.withColumn("__h", t.selection_hash(seed, F.col("name"))).withColumn("__b", F.substring("__h", 1, 4))
    counts = hashed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", "name"))
    return hashed.withColumn("__k", inside).join(before, "__b").withColumn("k", F.col("__before") + F.col("__k")).select(
        F.format_string(f"{prefix}-%03d", "k").alias("fixtureId"), "name", F.struct(t.group_id(F.col("name")).alias("sourceGroupId"), F.array(F.lit(seed)).alias("generatorSeeds")).alias("leakageKeys"), "split",
    )


def staging_plan(items: DataFrame, found: DataFrame, split: str, expected: int) -> DataFrame:
    """The items of one split in order, with what forbids staging them: digest, repeated file name, or another number of items than expected (H4, K2)."""
    chosen = items.where(F.col("split") == split).join(found.select("path", F.col("digest").alias("f_digest")), "path", "left")
    name = F.element_at(F.split("path", "/"), -1)
    total = items.where(F.col("split") == split).groupBy("split").agg(F.count("*").alias("items"))
    same = F.count("*").over(Window.partitionBy("split", name))
    problem = F.when(~F.col("digest").eqNullSafe(F.col("f_digest")), "digest").when(same > 1, "name").when(F.col("items") != expected, "number")
    return chosen.join(F.broadcast(total), "split").select("path", problem.alias("problem"))


def retention_audit(ledger: DataFrame, deletions: DataFrame, as_of: str) -> DataFrame:
    """Assets whose deadline has passed without a complete deletion (K3)."""
    done = deletions.where("complete").select("asset").distinct()
    return ledger.where(F.col("deadline") < F.lit(as_of).cast("date")).join(done, "asset", "left_anti")

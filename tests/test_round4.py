"""Findings of the third review: few tries for a detector's faults, and what else was mended with them."""

import math
import random

import pandas as pd
import pyarrow as pa

from pyspark.sql import functions as F

from veilframe.functions import rasters
from veilframe.functions.tables import Cells
from veilframe.operators import evaluate, manifests, quality


def test_few_tries_find_all_faults(spark):
    n, refused, tries = 4000, {i for i in range(4000) if i * 7919 % 197 == 5}, spark.sparkContext.accumulator(0)

    def analyze(batch: pd.DataFrame) -> pd.DataFrame:
        tries.add(1)
        if batch["i"].isin(refused).any():
            raise KeyError("refused")
        batch["n"] = batch["i"] + 2**60
        if (batch["i"] % 2 == 0).all():
            batch["n"] = None
        return batch

    got = evaluate.plugged(spark.range(n).withColumnRenamed("id", "i").coalesce(1), analyze, "i long, n long, failure string").collect()
    assert sorted(x.i for x in got) == list(range(n)) and {x.i for x in got if x.failure == "KeyError"} == refused
    assert all(x.n in (None, x.i + 2**60) for x in got)
    assert tries.value < len(refused) * (2 + math.log2(n / len(refused))) + 20


def test_a_detector_that_refuses_long_parts_alone(spark):
    def analyze(batch: pd.DataFrame) -> pd.DataFrame:
        if len(batch) > 3:
            raise MemoryError
        return batch.assign(n=1)

    got = evaluate.plugged(spark.range(50).coalesce(1), analyze, "id long, n long, failure string").collect()
    assert sorted((x.id, x.n, x.failure) for x in got) == [(i, 1, None) for i in range(50)]


def test_runs_of_a_box_are_one_row():
    rng, grid = random.Random(4), 64
    shapes = [[[rng.choice((rng.uniform(-0.2, 1.2), rng.randrange(65) / 64, (rng.randrange(64) + 0.5) / 64)) for _ in "xy"] for _ in range(rng.randrange(2, 7))] for _ in range(400)]
    box = [[0.1, 0.2], [0.6, 0.2], [0.6, 0.9], [0.1, 0.9]]
    assert list(Cells().eval(box, grid)) == [(13, 6, 37, 45)]
    found = rasters.cells(pa.array([*shapes, box], pa.list_(pa.list_(pa.float64()))), grid).to_pylist()
    for shape, wanted in zip([*shapes, box], found):
        made = [r * grid + x for y, first, last, height in Cells().eval(shape, grid) for r in range(y, y + height) for x in range(first, last + 1)]
        assert sorted(made) == wanted


def test_banned_keys_with_and_without_escapes(spark):
    banned = sorted(quality.BANNED)[0]
    odd, escaped = banned.upper()[:1] + "-_ " + banned[1:], "\\u%04x" % ord(banned[0]) + banned[1:]
    texts = ['{"%s": 1, "a": {"b": [{"%s": 2}]}}' % (odd, banned), '{"%s": 1}' % escaped, '{"a": "%s"}' % banned, "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, json string").select("i", quality.banned_keys(F.col("json")).alias("k")).collect()
    assert [x.k for x in sorted(got)] == [[banned], [banned], [], [], None]


def test_a_manifest_is_parsed_once(spark):
    records = spark.range(3).select(F.col("id").alias("line"), F.concat(F.lit('{"a": '), "id", F.lit("}")).alias("json"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    parse = "from_json(structfield(schemaversion"
    assert parse in plan(manifests.parsed(records)) and parse not in plan(manifests.report(records, "2024-05-01"))

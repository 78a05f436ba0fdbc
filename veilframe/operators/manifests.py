"""A manifest judged as a whole: its records, their files, its inventory and its splits in one report (B11, with B1, B2, B4, F14, I1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators import quality as q
from veilframe.operators.evaluate import expected_counts
from veilframe.operators.relations import leaked_values
from veilframe.shared import scratch

# The keys of a fixture record and of its blocks.
FIXTURE_KEYS = [
    "schemaVersion", "corpusVersion", "fixtureId", "group", "sourceKind", "split", "scenarioIds", "sourcePath", "sourceDigest", "provenanceRef", "truthPath", "mediaStreams", "leakageKeys",
]
FIXTURE_BLOCKS = ["deviceContext", "publicDataset", "syntheticSource", "captureAuthorization"]
PUBLIC_KEYS = ["sourceUrl", "datasetVersion", "license", "allowedUsage", "attribution", "retrievedAt", "byteLength", "selectionSeed", "sourceItemId"]
SYNTHETIC_KEYS, SYNTHETIC_OPTIONS = ["generatorId", "generatorVersion", "fictionalPayloadVerified"], ["symbolGenerator", "font"]
FONT_KEYS = ["artifact", "sha256", "license", "upstreamCommit", "rasterizer"]
CAPTURE_KEYS = ["authorizationRef", "consentRecorded", "fictionalPayloadVerified", "encryptedStorageRef", "authorizedAccessRef", "deletionDeadline", "deletionAuditStatus", "capturePhase"]
DEVICE_KEYS = ["deviceClass", "lens", "width", "height", "frameRate"]
#: Splits that must share nothing, and what they must not share.
APART, LEAKAGE = ("DEVELOPMENT", "HOLDOUT"), ["sourceGroupId", "sourceDigests", "actorIds", "payloadIds", "generatorSeeds", "roomMotionIds"]

#: A block's keys are asked for only where the source kind calls for the block.
_OBJECTS = {
    "publicDataset": ("LICENSED_PUBLIC", PUBLIC_KEYS, []), "syntheticSource": ("SYNTHETIC", SYNTHETIC_KEYS, SYNTHETIC_OPTIONS), "syntheticSource.font": ("SYNTHETIC", FONT_KEYS, []),
    "captureAuthorization": ("CONSENTED_CAPTURE", CAPTURE_KEYS, []), "deviceContext": ("CONSENTED_CAPTURE", DEVICE_KEYS, []),
}


def _struct(names: list[str], **types: str) -> str:
    return "struct<" + ", ".join(f"{n}: {types.get(n, 'string')}" for n in names) + ">"


_LISTS = dict.fromkeys(["actorIds", "payloadIds", "generatorSeeds", "roomMotionIds", "scenarioIds", "mediaStreams"], "array<string>")
SCHEMA = _struct(
    FIXTURE_KEYS + FIXTURE_BLOCKS, **_LISTS, leakageKeys=_struct(["sourceGroupId", "actorIds", "payloadIds", "generatorSeeds", "roomMotionIds"], **_LISTS),
    publicDataset=_struct(PUBLIC_KEYS, byteLength="bigint"), syntheticSource=_struct(SYNTHETIC_KEYS + SYNTHETIC_OPTIONS, fictionalPayloadVerified="boolean", font=_struct(FONT_KEYS)),
    captureAuthorization=_struct(CAPTURE_KEYS, consentRecorded="boolean", fictionalPayloadVerified="boolean"), deviceContext=_struct(DEVICE_KEYS, width="bigint", height="bigint", frameRate="double"),
)


def parsed(records: DataFrame) -> DataFrame:
    """(line, json, the record's columns, object): values of a wrong type are null, and ``object`` tells whether the text is a JSON object."""
    whole = F.json_object_keys("json").isNotNull()
    return records.select("line", "json", F.from_json("json", SCHEMA).alias("r"), whole.alias("object")).select("line", "json", "object", "r.*")


def record_codes(as_of: str) -> Column:
    """All that is wrong with one record by itself, as codes: rules, group, missing, unknown and banned keys, or only ``json`` where it is no object."""
    group = q.group_rules(F.col("group"), F.col("sourceKind"), F.col("split"))
    rules = F.array_compact(F.array(*(F.when(fails, F.lit(code)) for code, fails in {**q.record_rules(as_of), **group}.items())))
    keys = [q.key_codes(F.col("json"), FIXTURE_KEYS, FIXTURE_BLOCKS)]
    for at, (kind, required, allowed) in _OBJECTS.items():
        keys.append(F.when(F.col("sourceKind") == kind, q.key_codes(F.get_json_object("json", f"$.{at}"), required, allowed, f"{at}.")))
    banned = F.transform(q.banned_keys(F.col("json")), lambda k: F.concat(F.lit("forbidden:"), k))
    nothing = F.array().cast("array<string>")
    return F.when(F.col("object"), F.concat(rules, *(F.coalesce(k, nothing) for k in keys), F.coalesce(banned, nothing))).otherwise(F.array(F.lit("json")))


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(line) of the records whose fixture id a record before them has. Ids are counted first, so only repeated ones are joined back."""
    first = rows.where("fixtureId IS NOT NULL").groupBy("fixtureId").agg(F.min("line").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.select("fixtureId", "line").join(first, "fixtureId").where("line > first").select("line")


def file_errors(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(line, code) of records whose source file is absent, or whose digest or number of bytes is another. ``files`` has path, sha256 and bytes, a row a path.

    Unsafe paths are an error of their own and are not looked up.
    """
    asked = rows.where(q.is_safe_path(F.col("sourcePath"))).select("line", F.col("sourcePath").alias("path"), "sourceDigest", F.col("publicDataset.byteLength").alias("declared"), F.col("publicDataset").isNotNull().alias("public"))
    held = files.select("path", F.col("sha256").alias("__sha256"), F.col("bytes").alias("__bytes"), F.lit(True).alias("__there"))
    both, there = asked.join(held, "path", "left"), F.col("__there").isNotNull()
    rules = {"sourcePath.absent": ~there, "sourceDigest.file": there & ~F.col("sourceDigest").eqNullSafe(F.col("__sha256")), "publicDataset.byteLength.file": there & F.col("public") & ~F.col("declared").eqNullSafe(F.col("__bytes"))}
    return q.errors(both, F.col("line"), rules).withColumnRenamed("location", "line")


def report(records: DataFrame, as_of: str, files: DataFrame | None = None, profile: str | None = None, expected: int | None = None) -> DataFrame:
    """Every error of a manifest as rows (line, code, detail); line is null where the manifest as a whole is wrong.

    ``records`` has line and json, a row a record; ``files`` is the inventory under the media root (see :func:`file_errors`). A profile
    fixes the number of records of each group (F14), ``expected`` that of all. Values that DEVELOPMENT and HOLDOUT share are a row each
    (I1); detail holds the value, or the number found. A null or empty text is no JSON object; an empty manifest is the error ``empty``.
    Repeated keys of an object: the last one counts for its values. Other columns of both tables take no part. Records are parsed once and
    written to the shared folder, from where each check reads the columns that it needs.
    """
    path = scratch(records.sparkSession, "manifest")
    parsed(records).write.parquet(path)
    rows = records.sparkSession.read.parquet(path)
    found = [rows.select("line", F.explode(record_codes(as_of)).alias("code"))]
    found.append(repeated_ids(rows).select("line", F.lit("fixtureId.duplicate").alias("code")))
    if files is not None:
        found.append(file_errors(rows.where("object"), files))
    each = reduce(DataFrame.unionByName, found).select("line", "code", F.lit(None).cast("string").alias("detail"))
    whole = lambda df, code, detail: df.select(F.lit(None).cast("long").alias("line"), code.alias("code"), detail.cast("string").alias("detail"))
    size = rows.agg(F.count("*").alias("n"))
    parts = [each, whole(size.where("n = 0"), F.lit("empty"), F.col("n"))]
    if expected is not None:
        parts.append(whole(size.where(F.col("n") != expected), F.lit("records"), F.col("n")))
    if profile is not None:
        spark = records.sparkSession
        if profile in q.PROFILES:
            wanted = spark.createDataFrame(list(q.PROFILES[profile].items()), "group string, n long")
            counts = expected_counts(rows.select(F.coalesce("group", F.lit("none")).alias("group")), wanted, "group")
            parts.append(whole(counts, F.concat(F.lit("profile."), "group"), F.col("found")))
        else:
            parts.append(whole(spark.range(1), F.lit("profile.unknown"), F.lit(profile)))
    apart = rows.where(F.col("split").isin(*APART) & F.col("leakageKeys").isNotNull()).select("split", "leakageKeys.*", F.array("sourceDigest").alias("sourceDigests"))
    parts.append(whole(leaked_values(apart, "split", LEAKAGE), F.concat(F.lit("leakage."), "key"), F.col("value")))
    return reduce(DataFrame.unionByName, parts)

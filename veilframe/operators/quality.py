"""Data quality: each rule yields error rows (location, code); a table is valid if there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import text as t

# Keys that no record may hold, without case and punctuation.
BANNED = (
    "address", "authorizationdocument", "consentdocument", "consentrecord", "credential", "credentials", "email", "extractedfacecrop", "facecrop", "facecrops", "faceembedding",
    "faceembeddings", "name", "participantname", "password", "phone", "rawtext", "recognizedtext", "secret", "streamkey", "text", "token",
)
# Source kind and splits of each group.
GROUP_RULES = {
    "WIDER_FACE": ("LICENSED_PUBLIC", ("REGRESSION",)),
    "BIV_PRIV_SEG": ("LICENSED_PUBLIC", ("SMOKE",)),
    "RENDERER": ("SYNTHETIC", ("DEVELOPMENT", "HOLDOUT")),
    "CONSENTED_FACE": ("CONSENTED_CAPTURE", ("DEVELOPMENT", "HOLDOUT")),
    "PRIORITY_2": ("SYNTHETIC", ("DEVELOPMENT", "HOLDOUT")),
    "FAULT_INJECTION": ("SYNTHETIC", ("DEVELOPMENT", "HOLDOUT")),
}
# The block that each source kind asks for.
BLOCKS = {"LICENSED_PUBLIC": "publicDataset", "SYNTHETIC": "syntheticSource", "CONSENTED_CAPTURE": "captureAuthorization"}
# How many fixtures of each group a profile has.
PROFILES = {
    "public-v1": {"WIDER_FACE": 200, "BIV_PRIV_SEG": 16},
    "system-v1": {"RENDERER": 12, "FAULT_INJECTION": 20},
    "face-v1": {"CONSENTED_FACE": 12},
    "pii-v1": {"PRIORITY_2": 26},
    "priority2-v1": {"PRIORITY_2": 26},
    "full-v1": {"WIDER_FACE": 200, "BIV_PRIV_SEG": 16, "RENDERER": 12, "CONSENTED_FACE": 12, "PRIORITY_2": 26, "FAULT_INJECTION": 20},
}
# What a truth object can be.
CATEGORIES = (
    "FACE", "MACHINE_READABLE_CODE", "EMAIL", "PHONE", "PAYMENT_CARD", "VERIFICATION_CODE", "PERSON_NAME", "ADDRESS", "EMPLOYER", "SCHOOL", "DOCUMENT", "BADGE", "PARCEL_LABEL",
    "DEVICE_SCREEN", "BIV_PRIVATE_OBJECT",
)
ROLES = ("HOST", "UNKNOWN", "SENSITIVE", "DECOY", "NOT_APPLICABLE")
# The action that each expected state asks for.
ACTIONS = {"REGIONAL_PROTECTION": "PROTECT_REGIONS", "FULL_SHIELD": "FULL_SHIELD", "STOPPED": "STOP_OUTPUT"}


def _not(ok: Column) -> Column:
    """Fails where a condition does not hold or is unknown."""
    return ~F.coalesce(ok, F.lit(False))


def _blank(text: Column) -> Column:
    return _not(F.length(F.trim(text)) > 0)


def errors(rows: DataFrame, location: Column, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a record breaks; a rule is its failing condition, and unknown (null) does not fail."""
    codes = F.array_compact(F.array(*(F.when(fails, F.lit(code)) for code, fails in rules.items())))
    return rows.select(location.alias("location"), F.explode(codes).alias("code"))


def key_codes(json: Column, required: list[str], allowed: list[str], prefix: str = "") -> Column:
    """Missing and unknown keys of a JSON object as codes; null where the text is no object (B1)."""
    keys = F.json_object_keys(json)
    missing = F.transform(F.array_except(F.lit(required), keys), lambda k: F.concat(F.lit(f"{prefix}missing:"), k))
    unknown = F.transform(F.array_except(keys, F.lit(required + allowed)), lambda k: F.concat(F.lit(f"{prefix}unknown:"), k))
    return F.concat(missing, unknown)


def key_errors(rows: DataFrame, location: Column, json: Column, required: list[str], allowed: list[str]) -> DataFrame:
    """Missing and unknown keys of JSON objects, one error each."""
    return rows.select(location.alias("location"), F.explode(key_codes(json, required, allowed)).alias("code"))


def banned_keys(json: Column) -> Column:
    """The different banned keys of a record at any depth, with case and punctuation taken off (B2).

    The record is parsed and written again, so that every key stands right before its colon; the strings of the record are then read one
    after the other, which needs no recursion. What the parser refuses (repeated keys, text that is no JSON) is read as it is. Each key's
    escapes are decoded by itself, where it has any.
    """
    plain = F.coalesce(F.to_json(F.try_parse_json(json)), json)
    strings = F.regexp_extract_all(plain, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    keys = F.transform(F.filter(strings, lambda s: s.endswith(":")), lambda k: F.regexp_replace(k, r"\s*:\z", ""))
    read = lambda k: F.coalesce(F.get(F.from_json(F.concat(F.lit("["), k, F.lit("]")), "array<string>"), 0), F.regexp_replace(k, r"\\(?:u[0-9A-Fa-f]{4}|.)", ""))
    decoded = F.transform(keys, lambda k: F.when(F.contains(k, F.lit("\\")), read(k)).otherwise(k))
    bare = F.transform(decoded, lambda k: F.regexp_replace(F.lower(k), r"[^a-z0-9]", ""))
    return F.array_distinct(F.array_intersect(bare, F.lit(list(BANNED))))


def forbidden_keys(rows: DataFrame, location: Column, json: Column) -> DataFrame:
    """A row for each banned key of a record (B2)."""
    return rows.select(location.alias("location"), F.explode(banned_keys(json)).alias("key"))


def is_safe_path(path: Column) -> Column:
    """Not empty, no NUL, not absolute, no step up."""
    return (F.length(path) > 0) & ~F.contains(path, F.lit("\0")) & ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda x: x == "..")


def is_under(root: Column, path: Column) -> Column:
    """A resolved path stays under its root (B5): steps up are counted off against the steps down."""
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda a, x: F.struct((a["now"] + F.when(x == "..", -1).when((x == "") | (x == "."), 0).otherwise(1)).alias("now"), F.least(a["least"], a["now"] + F.when(x == "..", -1).otherwise(0)).alias("least")), lambda a: a["least"])
    return (root != "") & ~path.startswith("/") & (depth >= 0)


def group_rules(group: Column, kind: Column, split: Column) -> dict[str, Column]:
    """Failing conditions of a group: it is unknown, or forbids the source kind or the split."""
    named = lambda pick: F.coalesce(*(F.when(group == g, F.lit(pick(rule))) for g, rule in GROUP_RULES.items()))
    known = group.isin(*GROUP_RULES)
    return {"group": _not(known), "source_kind": known & _not(kind == named(lambda r: r[0])), "split": known & _not(F.array_contains(named(lambda r: list(r[1])), split))}


def group_rule_errors(rows: DataFrame, location: Column) -> DataFrame:
    """Groups that are unknown or whose source kind or split they forbid (B6, E16). The rules are a handful, so they are literals."""
    return errors(rows, location, group_rules(F.col("group"), F.col("source_kind"), F.col("split")))


def block_errors(rows: DataFrame, location: Column, kind: Column, blocks: dict[str, str]) -> DataFrame:
    """Exactly the block of the source kind is present (B7). ``blocks`` maps kinds to columns."""
    rules = {}
    for wanted, column in blocks.items():
        rules[f"{column}:missing"] = (kind == wanted) & F.col(column).isNull()
        rules[f"{column}:unexpected"] = (kind != wanted) & F.col(column).isNotNull()
    return errors(rows, location, rules)


def public_rules(block: Column) -> dict[str, Column]:
    """Failing conditions of a public-dataset block."""
    blanks = {n: _blank(block[n]) for n in ("datasetVersion", "license", "allowedUsage", "attribution", "sourceItemId")}
    return {
        "sourceUrl": _not(block["sourceUrl"].rlike(r"^https?://")), **blanks, "byteLength": _not(block["byteLength"] > 0),
        "selectionSeed": _not(block["selectionSeed"].rlike(t.STABLE_ID)), "retrievedAt": t.iso_date(block["retrievedAt"]).isNull(),
    }


def synthetic_rules(block: Column) -> dict[str, Column]:
    """Failing conditions of a synthetic block; symbol generator and font are optional."""
    font = block["font"]
    return {
        "generatorId": _not(block["generatorId"].rlike(t.STABLE_ID)), "generatorVersion": _not(block["generatorVersion"].rlike(t.SEMVER)), "fictionalPayloadVerified": _not(block["fictionalPayloadVerified"]),
        "symbolGenerator": block["symbolGenerator"].isNotNull() & ~block["symbolGenerator"].rlike(t.STABLE_ID),
        "font.sha256": font.isNotNull() & _not(font["sha256"].rlike(t.SHA256)), "font.upstreamCommit": font.isNotNull() & _not(font["upstreamCommit"].rlike(r"^[a-f0-9]{40}$")),
        **{f"font.{n}": font.isNotNull() & _not(font[n].rlike(t.STABLE_ID)) for n in ("artifact", "license", "rasterizer")},
    }


def capture_rules(block: Column, provenance: Column, as_of: str) -> dict[str, Column]:
    """Failing conditions of a capture's authorization; a pending deadline must not be past."""
    day = t.iso_date(block["deletionDeadline"])
    return {
        **{n: _not(block[n].rlike(t.OPAQUE_ID)) for n in ("authorizationRef", "encryptedStorageRef", "authorizedAccessRef")},
        **{n: _not(block[n]) for n in ("consentRecorded", "fictionalPayloadVerified")},
        "deletionDeadline": day.isNull(), "deletionAuditStatus": _not(block["deletionAuditStatus"].isin("PENDING", "DELETED", "WITHDRAWN")),
        "overdue": (block["deletionAuditStatus"] == "PENDING") & (day < F.lit(as_of).cast("date")),
        "capturePhase": _not(block["capturePhase"] == "DEVICE_VALIDATION"), "provenance": ~provenance.eqNullSafe(block["authorizationRef"]),
    }


def device_rules(device: Column) -> dict[str, Column]:
    """Failing conditions of a capture's device."""
    sizes = {n: _not(device[n] > 0) for n in ("width", "height", "frameRate")}
    return {"deviceClass": _not(device["deviceClass"].rlike(t.STABLE_ID)), "lens": _not(device["lens"].isin("FRONT", "REAR", "EXTERNAL")), **sizes}


def id_list_rules(ids: Column, empty: bool = True) -> dict[str, Column]:
    """Failing conditions of a list of ids: no list, repeated values, values that are no ids."""
    there = ids.isNotNull() if empty else F.size(ids) > 0
    return {"array": _not(there), "unique": F.size(F.array_distinct(ids)) != F.size(ids), "id": F.exists(ids, lambda i: _not(i.rlike(t.STABLE_ID)))}


def record_rules(as_of: str) -> dict[str, Column]:
    """Failing conditions of a manifest's fixture record, over its nested columns in their names there."""
    col = F.col
    rules = {
        "schemaVersion": _not(col("schemaVersion") == "1.0.0"), "corpusVersion": _not(col("corpusVersion").rlike(t.SEMVER)), "fixtureId": _not(col("fixtureId").rlike(t.STABLE_ID)),
        "sourcePath": _not(is_safe_path(col("sourcePath"))), "truthPath": _not(is_safe_path(col("truthPath"))), "sourceDigest": _not(col("sourceDigest").rlike(t.SHA256)),
        "provenanceRef": _blank(col("provenanceRef")), "mediaStreams": _not(col("mediaStreams") == F.array(F.lit("VIDEO"))),
        **{f"scenarioIds.{n}": c for n, c in id_list_rules(col("scenarioIds"), empty=False).items()},
        "leakageKeys": col("leakageKeys").isNull(), "leakageKeys.sourceGroupId": _not(col("leakageKeys.sourceGroupId").rlike(t.STABLE_ID)),
    }
    for key in ("actorIds", "payloadIds", "generatorSeeds", "roomMotionIds"):
        rules |= {f"leakageKeys.{key}.{n}": c for n, c in id_list_rules(col(f"leakageKeys.{key}")).items()}
    kind = col("sourceKind")
    rules["sourceKind.unsupported"] = _not(kind.isin(*BLOCKS))
    of_block = {
        "LICENSED_PUBLIC": public_rules(col("publicDataset")),
        "SYNTHETIC": synthetic_rules(col("syntheticSource")),
        "CONSENTED_CAPTURE": capture_rules(col("captureAuthorization"), col("provenanceRef"), as_of),
    }
    for wanted, name in BLOCKS.items():
        mine, there = F.coalesce(kind == wanted, F.lit(False)), col(name).isNotNull()
        rules |= {f"{name}.missing": mine & ~there, f"{name}.unexpected": ~mine & there}
        rules |= {f"{name}.{n}": mine & there & c for n, c in of_block[wanted].items()}
    capture = F.coalesce(kind == "CONSENTED_CAPTURE", F.lit(False))
    rules["deviceContext.missing"] = capture & col("deviceContext").isNull()
    rules |= {f"deviceContext.{n}": capture & col("deviceContext").isNotNull() & c for n, c in device_rules(col("deviceContext")).items()}
    return rules


def manifest_errors(rows: DataFrame, as_of: str) -> DataFrame:
    """Every rule of a manifest's fixture record, as rows (location, code); a code names the field and, where it has several, the rule.

    ``rows`` has the nested columns of the manifest, in their names there; location is the fixture's id. For files, inventory and splits
    see :func:`veilframe.operators.manifests.report`.
    """
    by_group = group_rule_errors(rows.withColumn("source_kind", F.col("sourceKind")), F.col("fixtureId"))
    return errors(rows, F.col("fixtureId"), record_rules(as_of)).unionByName(by_group)


def transform_rules(rotation: Column, crop: Column, matrix: Column) -> dict[str, Column]:
    """Failing conditions of a frame's transform."""
    number = lambda v: v.isNotNull() & ~F.isnan(v)
    return {"rotation": _not(rotation.isin(0, 90, 180, 270)), "crop": _not((F.size(crop) == 4) & F.forall(crop, lambda v: F.coalesce(v.between(0, 1), F.lit(False)))), "matrix": _not((F.size(matrix) == 9) & F.forall(matrix, number))}


def object_errors(rows: DataFrame, location: Column) -> DataFrame:
    """Rules of a frame's truth objects, as rows (location, place, code): ids valid and unique in their frame, category and role known, a
    polygon of at least three points in the unit square, visibility in [0, 1] (B13). ``rows`` has objects, an array of structs.
    """
    ids = F.transform("objects", lambda o: o["objectId"])
    one = rows.select(location.alias("__at"), ids.alias("__ids"), F.posexplode("objects").alias("place", "o"))
    o, unit = F.col("o"), lambda v: F.coalesce(v.between(0, 1), F.lit(False))
    bad_id = _not(o["objectId"].rlike(t.STABLE_ID))
    rules = {
        "objectId": bad_id, "duplicate": ~bad_id & (F.array_position("__ids", o["objectId"]) - 1 < F.col("place")),
        "category": _not(o["category"].isin(*CATEGORIES)), "role": _not(o["role"].isin(*ROLES)),
        "polygon": _not((F.size(o["polygon"]) >= 3) & F.forall(o["polygon"], lambda p: F.coalesce(F.size(p) == 2, F.lit(False)) & F.forall(p, unit))),
        "visibility": _not(o["visibility"].between(0, 1)),
    }
    codes = F.array_compact(F.array(*(F.when(fails, F.lit(code)) for code, fails in rules.items())))
    return one.select(F.col("__at").alias("location"), "place", F.explode(codes).alias("code"))


# The ids of the face corpus.
FACE_FIXTURE, FACE_OBJECT = r"^face-(?:dev|holdout)-[0-9]{2,6}$", r"^face-[a-f0-9]{8,32}$"


def face_truth_errors(objects: DataFrame) -> DataFrame:
    """Rules of the face corpus, as rows (fixture, frame, object, code): id patterns, a since-time exactly where protectable, neither
    negative nor after the frame; and, without a frame, objects whose role or since-time changes (B18).

    ``objects`` has fixture, frame, ts_ns, object, role, protectable and since_ns.
    """
    since, keys = F.col("since_ns"), ("fixture", "frame", "object")
    rules = {
        "fixture": _not(F.col("fixture").rlike(FACE_FIXTURE)), "object": _not(F.col("object").rlike(FACE_OBJECT)), "since": ~F.col("protectable").eqNullSafe(since.isNotNull()),
        "negative": since < 0, "early": since > F.col("ts_ns"),
    }
    codes = F.array_compact(F.array(*(F.when(fails, F.lit(code)) for code, fails in rules.items())))
    rows = objects.select(*keys, F.explode(codes).alias("code"))
    each = objects.groupBy("fixture", "object").agg(F.countDistinct("role").alias("roles"), F.countDistinct(F.when(F.col("protectable"), since)).alias("sinces"))
    constant = F.array_compact(F.array(F.when(F.col("roles") > 1, F.lit("role")), F.when(F.col("sinces") > 1, F.lit("since_changes"))))
    return rows.unionByName(each.select("fixture", F.lit(None).cast(dict(objects.dtypes)["frame"]).alias("frame"), "object", F.explode(constant).alias("code")))


def changing_roles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Objects whose role, or another constant, changes between frames."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("values")).where("values > 1")


def gated_category(truth: DataFrame, manifest: DataFrame, key: str, category: str, group: str) -> DataFrame:
    """Objects of a category that only one group may hold, elsewhere."""
    return truth.where(F.col("category") == category).join(manifest.select(key, "group"), key).where(F.col("group") != group)


def state_errors(rows: DataFrame, location: Column) -> DataFrame:
    """States whose action is another, and regional states without an object to protect."""
    wanted = reduce(lambda acc, kv: F.when(F.col("state") == kv[0], kv[1]).otherwise(acc), ACTIONS.items(), F.lit(None).cast("string"))
    protects = F.exists("objects", lambda o: o["protectable"] & ~o["role"].isin("HOST", "DECOY"))
    return errors(rows, location, {"action": F.col("action") != wanted, "nothing_to_protect": (F.col("state") == "REGIONAL_PROTECTION") & _not(protects), "state": _not(F.col("state").isin(*ACTIONS))})


def id_list_ok(ids: Column) -> Column:
    """All ids are valid and none occurs twice."""
    return (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda i: i.rlike(t.STABLE_ID))


def lane_findings_ok(lane: Column, categories: Column, bounds: Column, most_regions: int = 16, most_bounds: int = 64) -> Column:
    """A lane holds only its own category, and no more regions and bounds than allowed."""
    own = F.when(lane == "TEXT", "WATCHLIST_MATCH").when(lane == "BARCODE", "AUTO_BARCODE")
    few = (F.size(categories) <= most_regions) & (F.aggregate(bounds, F.lit(0), lambda a, n: a + n) <= most_bounds)
    return own.isNotNull() & F.forall(categories, lambda c: c == own) & few


def valid_boxes(boxes: Column) -> Column:
    """The boxes that are not marked invalid and have a width and height."""
    return F.filter(boxes, lambda b: (b["invalid"] == 0) & (b["w"] > 0) & (b["h"] > 0))


def rule_hits(docs: DataFrame, key: str, text: str, rules: dict[str, str], allowed: str | None = None) -> DataFrame:
    """Lines that a rule's pattern matches, with rule and line number; lines with the allowed pattern pass."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "__x"))
    if allowed:
        lines = lines.where(~F.col("__x").rlike(allowed))
    hits = F.array_compact(F.array(*(F.when(F.col("__x").rlike(p), F.lit(rule)) for rule, p in rules.items())))
    return lines.select(key, (F.col("line") + 1).alias("line"), F.explode(hits).alias("rule"))


def _is_dns(host: Column) -> Column:
    """Labels of 1 to 63 letters, digits and inner hyphens, at most 253 in all."""
    label = F.lit(r"^[\p{L}\p{Nd}](?:[\p{L}\p{Nd}-]{0,61}[\p{L}\p{Nd}])?$")
    return (F.length(host) <= 253) & F.forall(F.split(host, r"\.", -1), lambda x: F.rlike(x, label))


def _is_ipv4(host: Column) -> Column:
    """Four numbers of at most three digits, up to 255."""
    parts = F.split(host, r"\.", -1)
    return (F.size(parts) == 4) & F.forall(parts, lambda x: F.rlike(x, F.lit(r"^[0-9]{1,3}$")) & (x.try_cast("int") <= 255))


def _is_ipv6(host: Column) -> Column:
    """Eight groups of one to four hex digits, or fewer with one gap of two colons; no zone."""
    groups = F.filter(F.split(host, ":", -1), lambda x: x != "")
    gaps = (F.length(host) - F.length(F.replace(host, F.lit("::"), F.lit("")))) / 2
    hexes = F.forall(groups, lambda x: F.rlike(x, F.lit(r"^[0-9A-Fa-f]{1,4}$")))
    count = F.when(F.contains(host, F.lit("::")), F.size(groups) < 8).otherwise(F.size(groups) == 8)
    return F.contains(host, F.lit(":")) & ~F.contains(host, F.lit(":::")) & (gaps <= 1) & hexes & count


def endpoint_error(url: Column, schemes: list[str]) -> Column:
    """Why an endpoint is refused: scheme, host, port, or parts that it must not have; null if it is fine.

    The authority is read from the text, as a host in brackets is an IPv6 address; a host of digits and dots must be an IPv4 address.
    """
    part = lambda n: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", n)
    authority = part(2)
    where = lambda n: F.regexp_extract(authority, r"^(?:\[([^\]]*)\]|([^:\[]*))(:(.*))?$", n)
    bracketed, host, port = where(1), where(2), where(4)
    named = _is_ipv4(host) | (~F.rlike(host, F.lit(r"^[0-9.]+$")) & _is_dns(host))
    ok_host = F.when(F.startswith(authority, F.lit("[")), _is_ipv6(bracketed)).otherwise((host != "") & named)
    return (
        F.when(_not(F.lower(part(1)).isin(schemes)), "scheme")
        .when(F.contains(authority, F.lit("@")) | (part(4) != "") | (part(5) != ""), "extra")
        .when(_not(ok_host), "host")
        .when((where(3) != "") & _not(F.rlike(port, F.lit(r"^[0-9]{1,5}$")) & port.try_cast("int").between(1, 65535)), "port")
    )


def masked(rows: DataFrame, secret: str) -> DataFrame:
    """The rows with a secret replaced by a constant."""
    return rows.withColumn(secret, F.lit("****"))


def dismissible(decisions: DataFrame) -> DataFrame:
    """One row for each bound of a regional decision's code and watchlist regions."""
    regions = decisions.where("status = 'REGIONAL_SAFE'").select("session", "ts_ns", F.explode("regions").alias("r"))
    return regions.where(F.col("r.category").isin("AUTO_BARCODE", "WATCHLIST_MATCH")).select("session", "ts_ns", F.col("r.category").alias("category"), F.explode("r.bounds").alias("bound"))

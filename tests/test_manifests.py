"""The whole report of a manifest: by hand, record by record."""

import json

from veilframe.operators import manifests as m

DIGEST = "a" * 64


def _record(**changes):
    base = {
        "schemaVersion": "1.0.0", "corpusVersion": "1.0.0", "fixtureId": "fx:1", "group": "WIDER_FACE", "sourceKind": "LICENSED_PUBLIC", "split": "REGRESSION", "scenarioIds": ["scn-1"], "sourcePath": "a/1.jpg",
        "sourceDigest": DIGEST, "provenanceRef": "ref", "truthPath": "t/1.jsonl", "mediaStreams": ["VIDEO"],
        "leakageKeys": {"sourceGroupId": "src-1", "actorIds": [], "payloadIds": [], "generatorSeeds": [], "roomMotionIds": []},
        "publicDataset": {"sourceUrl": "https://x", "datasetVersion": "1", "license": "own", "allowedUsage": "any", "attribution": "us", "retrievedAt": "2024-01-01", "byteLength": 5, "selectionSeed": "seed-1", "sourceItemId": "i"},
    }
    return {k: v for k, v in {**base, **changes}.items() if v is not ...}


def _synthetic(n, split, **keys):
    return _record(
        fixtureId=f"syn:{n}", group="RENDERER", sourceKind="SYNTHETIC", split=split, sourcePath=f"s/{n}.mp4", publicDataset=..., sourceDigest=f"{n:064x}",
        syntheticSource={"generatorId": "gen", "generatorVersion": "1.0.0", "fictionalPayloadVerified": True}, leakageKeys={"sourceGroupId": f"src-{n}", "actorIds": [], "payloadIds": [], "generatorSeeds": [], "roomMotionIds": [], **keys},
    )


def _report(spark, texts, files=None, **options):
    texts = [t if t is None or isinstance(t, str) else json.dumps(t) for t in texts]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts, 1)], "line long, json string, code string").repartition(3)
    held = None if files is None else spark.createDataFrame(files, "path string, sha256 string, bytes long, line string")
    return sorted(((r.line, r.code, r.detail) for r in m.report(rows, "2024-05-01", held, **options).collect()), key=str)


def test_a_sound_manifest_has_no_errors(spark):
    assert _report(spark, [_record()], [("a/1.jpg", DIGEST, 5, "x")], expected=1) == []


def test_texts_that_are_no_objects(spark):
    assert _report(spark, [None, "", "{", "[1]", "7"]) == [(i, "json", None) for i in range(1, 6)]


def test_an_empty_manifest(spark):
    assert _report(spark, [], expected=2) == [(None, "empty", "0"), (None, "records", "0")]


def test_keys_of_records_and_blocks(spark):
    public = {**_record()["publicDataset"], "extra": 1}
    del public["license"]
    found = _report(spark, [_record(truthPath=..., odd=1, publicDataset=public), _record(fixtureId="fx:2", scenarioIds=["scn-1"], deep=[{"Raw-Text": 1}])])
    assert found == sorted([
        (1, "missing:truthPath", None), (1, "truthPath", None), (1, "unknown:odd", None), (1, "publicDataset.missing:license", None), (1, "publicDataset.license", None), (1, "publicDataset.unknown:extra", None),
        (2, "unknown:deep", None), (2, "forbidden:rawtext", None),
    ], key=str)


def test_blocks_of_another_kind_are_unexpected_but_not_read(spark):
    assert _report(spark, [_record(syntheticSource={"odd": 1})]) == [(1, "syntheticSource.unexpected", None)]


def test_a_font_has_all_its_keys(spark):
    one = _synthetic(1, "HOLDOUT")
    one["syntheticSource"]["font"] = {"artifact": "fnt", "sha256": DIGEST, "license": "own", "rasterizer": "ras", "size": 3}
    assert _report(spark, [one]) == sorted([(1, "syntheticSource.font.missing:upstreamCommit", None), (1, "syntheticSource.font.unknown:size", None), (1, "syntheticSource.font.upstreamCommit", None)], key=str)


def test_values_of_a_wrong_type(spark):
    assert _report(spark, [_record(publicDataset={**_record()["publicDataset"], "byteLength": "many"}, scenarioIds="scn-1")]) == [(1, "publicDataset.byteLength", None), (1, "scenarioIds.array", None)]


def test_every_record_after_the_first_of_an_id(spark):
    assert _report(spark, [_record(), _record(), _record(fixtureId="fx:2"), _record()]) == [(2, "fixtureId.duplicate", None), (4, "fixtureId.duplicate", None)]


def test_files_beside_their_records(spark):
    rows = [_record(), _record(fixtureId="fx:2", sourcePath="a/2.jpg"), _record(fixtureId="fx:3", sourcePath="a/3.jpg"), _record(fixtureId="fx:4", sourcePath="../4.jpg"), _synthetic(5, "HOLDOUT")]
    files = [("a/1.jpg", "b" * 64, 6, "x"), ("a/2.jpg", DIGEST, 5, "x"), ("s/5.mp4", f"{5:064x}", 99, "x")]
    assert _report(spark, rows, files) == sorted([(1, "sourceDigest.file", None), (1, "publicDataset.byteLength.file", None), (3, "sourcePath.absent", None), (4, "sourcePath", None)], key=str)


def test_profiles_and_expected_records(spark):
    assert _report(spark, [_synthetic(i, "HOLDOUT") for i in range(12)], profile="system-v1", expected=13) == [(None, "profile.FAULT_INJECTION", "0"), (None, "records", "12")]
    assert _report(spark, [_record()], profile="other") == [(None, "profile.unknown", "other")]


def test_values_that_both_splits_hold(spark):
    rows = [_synthetic(1, "DEVELOPMENT", actorIds=["a-1", "a-2"], generatorSeeds=["s-1"]), _synthetic(2, "HOLDOUT", actorIds=["a-2", "a-3"]), _synthetic(3, "HOLDOUT", actorIds=["a-3"], payloadIds=["s-1"])]
    rows += [{**_synthetic(4, "DEVELOPMENT"), "sourceDigest": f"{2:064x}"}, _record(leakageKeys={**_record()["leakageKeys"], "actorIds": ["a-1"]})]
    assert _report(spark, rows) == sorted([(None, "leakage.actorIds", "a-2"), (None, "leakage.sourceDigests", f"{2:064x}")], key=str)

"""Listings, records and the result cache by round trips."""

import json

import pytest
from pyspark.sql import functions as F

from lesionflow.operators import audit
from lesionflow.sources import cache, listing, records


def test_listing_against_manifest(spark, tmp_path):
    root = tmp_path / "Imaging"
    for name, size in (("P-1/week-000/CT1.nii.gz", 5), ("P-1/week-000/T2.nii.gz", 0), ("P-1/week-000/notes.txt", 3), ("P-2/week-004-1/DeepBraTumIA-segmentation/atlas/segmentation/seg_mask.nii.gz", 7), ("P-2/week-004-1/T1.nii.gz", 1), ("P-3/week-1/FLAIR.nii.gz", 2)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * size)
    listed = listing.files(spark, str(root))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    held = listing.items(listed)
    assert {(r.patient, r.timepoint, r.item, r.source, r.space, r.length) for r in held.collect()} == {
        ("P-1", "week-000", "CT1", "raw", "native", 5), ("P-2", "week-004-1", "DeepBraTumIA", "DeepBraTumIA", "atlas", 7), ("P-2", "week-004-1", "T1", "raw", "native", 1), ("P-3", "week-1", "FLAIR", "raw", "native", 2)}
    held = held.unionByName(spark.createDataFrame([("P-4", "week-1", "T1", "p", 0, "raw", "native")], held.schema))
    claims = [("P-4", "week-1", "T1", True), ("P-1", "week-000", "CT1", True), ("P-1", "week-000", "T2", True), ("P-1", "week-000", "T1", True), ("P-1", "week-000", "FLAIR", False), ("P-2", "week-004-1", "DeepBraTumIA", False), ("P-2", "week-004-1", "T1", None)]
    found = audit.manifest_audit(spark.createDataFrame(claims, "patient string, timepoint string, item string, present boolean"), held).collect()
    assert {(r.patient, r.item): (r.finding, r.manifest, r.archive) for r in found} == {
        ("P-4", "T1"): ("empty", True, True),
        ("P-1", "T2"): ("missing", True, False), ("P-1", "T1"): ("missing", True, False), ("P-2", "DeepBraTumIA"): ("unclaimed", False, True), ("P-2", "T1"): ("unclaimed", None, True), ("P-3", "FLAIR"): ("unlisted", None, True)}


def test_lock_of_two_shapes(spark, tmp_path):
    lock = {"criterion": {"deterministic": True}, "practice": {"n_patients": 3, "patients": [{"patient_id": "P-1", "n_assessable": 7, "rating_mix": {"PD": 3}}, "P-2", {"other": 1}]}, "held_out": {"patient_ids": ["P-3", "P-2"], "discipline": "closed"}}
    path = tmp_path / "lock.json"
    path.write_text(json.dumps(lock, indent=2))
    found = records.arms(spark, str(path))
    assert {r.patient: r.arm for r in found.collect()} == {"P-1": "practice", "P-2": "held_out", "P-3": "held_out"}
    assert records.arms(spark, str(tmp_path / "none.json")).count() == 0
    path.write_text(json.dumps({"held_out": {"patients": ["P-9"]}}))
    scans = spark.createDataFrame([("P-9",), ("P-1",)], "patient string")
    assert {r.patient: r.arm for r in records.with_arm(scans, records.arms(spark, str(path))).collect()} == {"P-9": "held_out", "P-1": "unassigned"}


@pytest.mark.parametrize("kind", sorted(records.VISITS))
def test_records_come_back(spark, tmp_path, kind):
    schema = records.fields(kind)
    value = {"string": "s \"x\"", "double": 1.5, "bigint": 7, "int": 3, "boolean": True, "array<int>": [1, 2], "array<double>": [0.5, -1.0], "map<string,bigint>": {"1": 4}, "map<string,double>": {"ET": 2.5}, "array<struct<code:string,status:string>>": [("a", "pass")]}
    rows = []
    for patient, timepoint, week in (("P-1", "week-010", 10.0), ("P-1", "week-002", 2.0), ("P-2", "week-x", None)):
        rows.append((patient, *({"timepoint": timepoint, "week": week}.get(f.name, None if patient == "P-2" else value[f.dataType.simpleString()]) for f in schema)))
    given = spark.createDataFrame(rows, "patient string, " + records.VISITS[kind])
    records.write_records(given, str(tmp_path / kind), kind)
    back = records.read_records(spark, str(tmp_path / kind), kind)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, given.collect()))
    text = {json.loads(r.value)["patient"]: json.loads(r.value) for r in spark.read.text(str(tmp_path / kind)).collect()}
    assert [v["timepoint"] for v in text["P-1"]["visits"]] == ["week-002", "week-010"] and text["P-1"]["n_visits"] == 2


def test_cache_holds_each_key_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "RANGES", 4)
    rows = lambda *ks: spark.createDataFrame([(f"P-{k:03d}", f"week-{k % 3}", k % 2 == 0) for k in ks], "patient string, timepoint string, measurable boolean")
    held = cache.ResultCache(spark, str(tmp_path / "flags"), ["patient", "timepoint"], "patient string, timepoint string, measurable boolean")
    assert held.rows().count() == 0 and held.missing(rows(1, 2)).count() == 2
    held.append(rows(*range(40)))
    held.append(rows(*range(30, 50)))
    held.append(rows(*range(30, 50)).withColumn("measurable", F.lit(None).cast("boolean")))
    assert sorted(r.patient for r in held.rows().collect()) == [f"P-{k:03d}" for k in range(50)] and held.rows().where("measurable IS NULL").count() == 0
    assert [r.patient for r in held.missing(rows(*range(45, 55), 50)).orderBy("patient").collect()] == [f"P-{k:03d}" for k in range(50, 55)]
    before = held.state()
    with monkeypatch.context() as killed:
        killed.setattr(cache.ResultCache, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            held.append(rows(*range(60)))
    assert held.state() == before and held.rows().count() == 50
    held.append(rows(*range(60)))
    assert held.rows().count() == 60 == held.rows().select("patient").distinct().count()
    untouched = [k for k, f in before["folders"].items() if held.state()["folders"][k] == f]
    held.append(rows(59, 61))
    assert held.rows().count() == 61 and (untouched or len(before["folders"]) > 1)
    # another append takes the next name first
    first, tried = held.state(), []
    real = cache.ResultCache._commit

    def beaten(self, state):
        if not tried:
            tried.append(1)
            other = cache.ResultCache(spark, str(tmp_path / "flags"), ["patient", "timepoint"], "patient string, timepoint string, measurable boolean")
            other.append(rows(70))
        return real(self, state)

    monkeypatch.setattr(cache.ResultCache, "_commit", beaten)
    held.append(rows(71))
    assert held.state()["number"] == first["number"] + 2 and held.rows().where("patient IN ('P-070', 'P-071')").count() == 2

"""The response rule, case by case and against a plain fold; views, readers, streaming."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lesionflow.functions import scalars
from lesionflow.operators import cohort, evaluate, rule, timeline, voxel
from lesionflow.plans.components import components
from lesionflow.sources import readers

SCAN = (
    "patient bigint, timepoint bigint, week double, rn int, enhancing_mm3 double, t2_flair_mm3 double, new_lesion boolean, clinical_deterioration boolean, steroids_increased boolean, "
    "non_measurable_only boolean, measurable_disease boolean, weeks_since_rt double, surgeries array<double>"
)


def scan(rn, volume, week=None, **more):
    row = {"patient": 1, "timepoint": rn, "week": float(8 * rn) if week is None else week, "rn": rn, "enhancing_mm3": volume, "t2_flair_mm3": None, "new_lesion": None, "clinical_deterioration": None,
           "steroids_increased": None, "non_measurable_only": None, "measurable_disease": None, "weeks_since_rt": None, "surgeries": None} | more
    return tuple(row.values())


def calls(spark, scans, **changes):
    rows = rule.trajectories(spark.createDataFrame(scans, SCAN), rule.profiles(spark, [rule.profile("mrano_volumetric", **changes)]))
    return {r.timepoint: r for r in rows.collect()}


def test_first_scan_is_the_reference_and_nadir_excludes_the_scan(spark):
    got = calls(spark, [scan(1, 1000.0), scan(2, 500.0), scan(3, 720.0), scan(4, 690.0)])
    assert [got[i].call for i in (1, 2, 3, 4)] == ["BASELINE", "SD", "PD", "SD"]
    assert got[3].vs_nadir == pytest.approx(0.44)


def test_unknown_is_not_false(spark):
    got = calls(spark, [scan(1, 1000.0), scan(2, None), scan(3, 900.0), scan(4, 900.0, new_lesion=True), scan(5, 900.0, new_lesion=False, clinical_deterioration=True)])
    assert [got[i].call for i in (2, 3, 4, 5)] == ["NE", "SD", "PD", "PD"]
    assert got[3].unknowns == ["new_lesion", "clinical"] and got[4].unknowns == []


def test_progression_comes_before_complete_response(spark):
    got = calls(spark, [scan(1, 1000.0), scan(2, 0.0, new_lesion=True), scan(3, 0.0), scan(4, 50.0)], confirm=False)
    assert [got[i].call for i in (2, 3, 4)] == ["PD", "CR", "PD"]


def test_steroids_window_and_measurability(spark):
    got = calls(spark, [scan(1, 1000.0, measurable_disease=False), scan(2, 0.0, steroids_increased=True), scan(3, 100.0), scan(4, 2000.0, weeks_since_rt=5.0)], confirm=False)
    assert (got[2].call, got[3].call, got[3].driver) == ("PR", "PD", "enhancing")
    assert (got[4].call, got[4].provisional, got[4].risk) == ("SD", "PD", True)
    got = calls(spark, [scan(1, 1000.0, measurable_disease=False), scan(2, 100.0), scan(3, 100.0)], confirm=False)
    assert (got[2].call, got[2].provisional, got[2].driver) == ("SD", "PR", "reference")


def test_confirmation_keeps_refutes_or_says_that_it_cannot_tell(spark):
    held = calls(spark, [scan(1, 1000.0), scan(2, 100.0), scan(3, 100.0)])
    assert (held[2].call, held[3].call) == ("PR", "PR") and "confirmation_followup" in held[3].unknowns
    lost = calls(spark, [scan(1, 1000.0), scan(2, 100.0), scan(3, 900.0)])
    assert (lost[2].call, lost[2].provisional, lost[2].driver) == ("SD", "PR", "confirmation")
    late = calls(spark, [scan(1, 1000.0), scan(2, 100.0, week=10.0), scan(3, 900.0, week=40.0)])
    assert late[2].call == "PR" and "confirmation_too_late" in late[2].unknowns
    undated = calls(spark, [scan(1, 1000.0), scan(2, 900.0), (*scan(3, 100.0)[:2], None, *scan(3, 100.0)[3:])])
    assert "confirmation_week" in undated[3].unknowns


def test_surgery_resets_the_reference(spark):
    rows = [scan(1, 1000.0, surgeries=[15.0]), scan(2, 100.0, surgeries=[15.0]), scan(3, 150.0, surgeries=[15.0])]
    got = calls(spark, rows)
    assert [got[i].call for i in (1, 2, 3)] == ["BASELINE", "BASELINE", "PD"]
    assert calls(spark, rows, reset_at_surgery=False)[2].call == "SD"


def fold(scans):
    """The volume-only rule as a plain loop."""
    out, base, nadir = [], None, None
    for i, s in enumerate(scans):
        v = s[4]
        if i == 0:
            out.append("BASELINE")
            base = nadir = v
            continue
        if v is None:
            call = "NE"
        elif nadir and (v - nadir) / nadir >= 0.4 and v - nadir >= 10 or nadir == 0 and v >= 10:
            call = "PD"
        elif v == 0:
            call = "CR"
        elif base and (v - base) / base <= -0.65 and base - v >= 10:
            call = "PR"
        else:
            call = "SD"
        out.append(call)
        nadir = v if nadir is None else nadir if v is None else min(nadir, v)
    return out


def test_random_trajectories_equal_a_plain_fold(spark):
    random.seed(2)
    scans, want = [], {}
    for p in range(120):
        own = [(p, p * 100 + i, *scan(i + 1, random.choice([None, 0.0, 5.0, 100.0, 300.0, 450.0, 1000.0]))[2:]) for i in range(random.randint(1, 8))]
        scans += own
        want |= dict(zip([s[1] for s in own], fold(own)))
    got = rule.trajectories(spark.createDataFrame(scans, SCAN), rule.profiles(spark, [rule.profile("enhancing_only")]))
    assert {r.timepoint: r.call for r in got.collect()} == want


def test_treatments_from_labels(spark):
    rows = [(1, 0.0, "Pre-Op"), (1, 1.0, "Post-Op"), (1, 20.0, "SD"), (2, 0.0, "Pre-Op"), (2, 9.0, "SD"), (3, 1.0, "Post-Op"), (3, 2.0, "Post-Op"), (3, 30.0, "PD"), (3, 31.0, "Post-Op"), (4, 5.0, "SD")]
    got = {r.patient: r for r in timeline.treatments(timeline.surgical_labels(spark.createDataFrame(rows, "patient int, week double, rating string"))).collect()}
    assert got[1].surgeries == [1.0] and got[1].rt_start == 5.0 and got[1].rt_end == 11.0
    assert got[2].surgeries is None and got[2].contradicted
    assert got[3].surgeries == [1.0, 31.0] and got[4].surgeries == []


@pytest.mark.parametrize("week, stage", [(-2.0, "before_surgery"), (0.0, "after_surgery"), (3.9, "after_surgery"), (4.0, "during_radiotherapy"), (10.0, "during_radiotherapy"), (12.9, "too_soon_after_radiotherapy"), (14.0, "after_radiotherapy")])
def test_placement_boundaries(spark, week, stage):
    scans = spark.createDataFrame([(1, 1, week)], "patient int, timepoint int, week double")
    record = spark.createDataFrame([(1, [0.0], 4.0, 10.0, False)], "patient int, surgeries array<double>, rt_start double, rt_end double, contradicted boolean")
    assert timeline.placed(scans, record).first().stage == stage


def test_confusion_keeps_empty_cells_and_odd_classes(spark):
    pairs = spark.createDataFrame([("SD", "SD"), ("PD", "SD"), ("XX", "PD")], "expert string, predicted string")
    cells = {(r.expert, r.predicted): r.n for r in evaluate.confusion(pairs).collect()}
    assert len(cells) == 17 and cells["CR", "CR"] == 0 and cells["XX", "PD"] == 1
    out = evaluate.summary(evaluate.class_figures(evaluate.confusion(pairs))).first()
    assert out.n == 3 and out.agreement == pytest.approx(1 / 3)
    assert evaluate.summary(evaluate.class_figures(evaluate.confusion(pairs.limit(0)))).first().agreement == 0


def test_bands_are_half_open(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 999.9, 1000.0, 59999.0, 60000.0, None)], "v double")
    assert [r[0] for r in rows.select(scalars.uncertainty_pp(F.col("v"))).collect()] == [36.6, 36.6, 14.8, 2.8, 1.5, None]


def test_components_equal_union_find(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_voxel_shapes(spark):
    block = [(1, 1, x, y, z, 1) for x in range(3) for y in range(3) for z in range(3)] + [(1, 1, 5, 5, 5, 1), (1, 1, 6, 6, 6, 1)]
    cells = spark.createDataFrame(block, "patient int, visit int, x int, y int, z int, label int")
    assert [tuple(r)[2:5] for r in voxel.erode(cells).collect()] == [(1, 1, 1)]
    assert voxel.surface(cells).count() == 28
    assert voxel.label_components(cells).select("root").distinct().count() == 2
    assert voxel.label_components(cells, voxel.HALF_6).select("root").distinct().count() == 3
    assert voxel.dilate(cells.where("x = 6"), 1, (0, 0, 0), (6, 6, 6)).count() == 8
    assert [r.n for r in voxel.lesions(cells, floor=20).collect()] == [27]


def test_average_ranks_and_sign_test(spark):
    rows = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0)], "v double")
    assert sorted(r[0] for r in rows.select(cohort.average_rank(F.col("v"))).collect()) == [1.0, 2.0, 3.5, 3.5]
    one = spark.createDataFrame([(1, 8), (4, 8), (0, 0)], "k long, n long")
    assert [round(r[0], 6) for r in one.select(evaluate.sign_test(F.col("k"), F.col("n"))).collect()] == [0.070312, 1.0, 1.0]


def test_readers_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Patient,Timepoint,CT1,FLAIR\nP1,week-000,x,\nP1,week-010, X ,x\n")
    assert [(r.CT1, r.FLAIR) for r in readers.manifest(spark, str(tmp_path / "m.csv"), ["CT1", "FLAIR"]).collect()] == [(True, False), (True, True)]
    (tmp_path / "r.csv").write_text('Patient,Date,"Rating (a, b)","Rating rationale (x)"\nP1,week-000,SD,none\nP1,week-000,SD,none\nP2,week-001,PD,a\nP2,week-001,SD,b\n')
    clean, odd = readers.ratings(spark, str(tmp_path / "r.csv"))
    assert {(r.patient, r.rating, r.rationale) for r in clean.collect()} == {("P1", "SD", "none"), ("P2", "SD", "b")}  # the later row counts
    assert [(r.patient, r.rating) for r in odd.collect()] == [("P2", "PD")]
    assert readers.cohort_file(spark, str(tmp_path / "r.csv")).columns == ["Patient", "Date", "Rating", "Rationale"]
    (tmp_path / "v/P1/week-000-2").mkdir(parents=True)
    (tmp_path / "v/P1/week-000-2/vol.json").write_text(json.dumps({"Enhancing_Core": 5.0, "Edema_Compartment": 2.0}))
    assert {(r.patient, r.timepoint, r.compartment, r.volume_mm3) for r in readers.volume_json(spark, str(tmp_path / "v")).collect()} == {("P1", "week-000-2", "enhancing", 5.0), ("P1", "week-000-2", "edema", 2.0)}
    (tmp_path / "lock.json").write_text(json.dumps({"practice": {"patients": [{"patient_id": "P1"}]}, "held_out": {"patient_ids": ["P2"]}}))
    assert {tuple(r) for r in readers.arms(spark, str(tmp_path / "lock.json")).collect()} == {("P1", "practice"), ("P2", "held_out")}
    rows = spark.createDataFrame([("a", "p", 1), ("b", "q", 2)], "profile string, patient string, week int")
    readers.write_calls(rows, str(tmp_path / "calls"))
    assert spark.read.parquet(str(tmp_path / "calls")).where("profile = 'b'").first().patient == "q"
    readers.write_patients(rows, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 2
    readers.write_worksheet(rows, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).columns[-2:] == ["verdict", "note"]
    new = readers.only_new(rows, rows.where("week = 1"), ["patient"])
    assert new.count() == 1
    rows.where("week = 1").write.parquet(str(tmp_path / "cache"))
    readers.append_results(new, str(tmp_path / "cache"), ["patient"])
    assert sorted(r.patient for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == ["p", "q"]
    volumes = spark.createDataFrame([("P1", "week-000", "atlas", "CT1", "edema", 2.0), ("P1", "week-000", "native", "CT1", "edema", 3.0)], "patient string, timepoint string, space string, modality string, compartment string, volume_mm3 double")
    readers.write_tidy_volumes(volumes, str(tmp_path / "volumes"))
    assert spark.read.parquet(str(tmp_path / "volumes")).where("patient = 'P1'").count() == 2
    volumes.write.csv(str(tmp_path / "tidy"), header=True)
    assert [r.volume_mm3 for r in readers.tidy_volumes(spark, str(tmp_path / "tidy")).collect()] == [2.0]


def test_streaming_calls_equal_the_batch_rule(spark, tmp_path):
    from lesionflow.streaming.calls import provisional_calls

    source = tmp_path / "in"
    volumes = [1000.0, 500.0, 720.0, None, 0.0, 50.0]
    for i, v in enumerate(volumes):
        spark.createDataFrame([(1, i, v)], "patient bigint, timepoint bigint, enhancing_mm3 double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("patient bigint, timepoint bigint, enhancing_mm3 double").option("maxFilesPerTrigger", 100).parquet(str(source))
    q = provisional_calls(stream).writeStream.format("memory").queryName("calls_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [r.call for r in spark.sql("SELECT call FROM calls_out ORDER BY timepoint").collect()]
    assert got == fold([scan(i + 1, v) for i, v in enumerate(volumes)])


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

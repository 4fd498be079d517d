"""The look-ahead on a stream against the batch rule's confirmation."""

import random

import pytest
from pyspark.sql import functions as F

from lesionflow.operators import rule
from lesionflow.streaming import confirmation


def batch_calls(spark, rows):
    """Final calls by the batch rule of first-pass calls (patient, timepoint, week, call)."""
    frame = spark.createDataFrame(rows, "patient bigint, timepoint bigint, week double, call string")
    sure = {c: F.lit(False) for c in ("new_lesion", "clinical_deterioration", "steroids_increased", "non_measurable_only")}
    more = {"n": F.row_number().over(rule.Window.partitionBy("patient").orderBy(F.col("week").asc_nulls_last(), "timepoint")), "profile": F.lit("p"), "driver": F.lit("enhancing"), "provisional": F.lit(None).cast("string"), "baseline_measurable": F.lit(True)}
    params = {k: F.lit(v) for k, v in rule.profile("p").items() if k != "profile"}
    numbers = {c: F.lit(1.0) for c in ("vs_nadir", "vs_baseline", "t2_vs_nadir", "t2_flair_mm3", "t2_nadir")}
    done = rule.confirmed(frame.withColumns(sure | more | params | numbers), 4.0)
    return {r.timepoint: (r.call, r.provisional, "".join(u for u in r.unknowns if u.startswith("confirmation"))) for r in done.collect()}


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd = random.Random(5)
    rows, t = [], 0
    for patient in range(1, 25):
        week = 0.0
        for _ in range(rnd.randrange(1, 9)):
            week += rnd.choice([1.0, 3.0, 4.0, 6.0, 12.0, 17.0, 30.0])
            t += 1
            rows.append((patient, t, None if rnd.random() < 0.08 else week, rnd.choice(["CR", "PR", "PR", "SD", "PD", "NE"])))
    want = batch_calls(spark, rows)
    schema = "patient bigint, timepoint bigint, week double, call string, at timestamp"
    source, out = tmp_path / "in", str(tmp_path / "out")
    stamped = [(*r, confirmation.event_time(r[2] or 0.0)) for r in rows]
    # in order of event time, some at once; the last row drives the watermark past all timers
    stamped = sorted((r for r in stamped if r[2] is None), key=lambda r: r[1]) + sorted((r for r in stamped if r[2] is not None), key=lambda r: r[2])
    steps = [stamped[i : i + 25] for i in range(0, len(stamped), 25)] + [[(0, 0, 4000.0, "SD", confirmation.event_time(4000.0))], [(0, -1, 4100.0, "SD", confirmation.event_time(4100.0))]]
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    for k, step in enumerate(steps):
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = confirmation.confirmed_calls(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = [r for r in spark.read.parquet(out).where("patient > 0").collect()]
    assert len(got) == len(rows) == len({r.timepoint for r in got})
    notes = {"refuted": ""}
    for r in got:
        call, provisional, note = want[r.timepoint]
        assert (r.call, r.provisional) == (call, provisional), (r, want[r.timepoint])
        own = notes.get(r.note, r.note) or ""
        assert own == note or {own, note} <= {"confirmation_followup", "confirmation_too_late"}, (r, note)
    assert {r.note for r in got} >= {"refuted", "confirmation_too_late", "confirmation_followup", None} or pytest.fail("not all outcomes")

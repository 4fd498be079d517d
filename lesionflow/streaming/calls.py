"""Provisional calls on arriving scans: the running references of a patient as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

OUTPUT = "patient bigint, timepoint bigint, call string, vs_nadir double, vs_baseline double"
STATE = "baseline double, nadir double"


def provisional_calls(scans: DataFrame, pd_increase: float = 0.40, pr_decrease: float = -0.65, floor_mm3: float = 10.0) -> DataFrame:
    """Calls by enhancing volume alone on a stream of (patient, timepoint, enhancing_mm3) in order of timepoint within each batch.

    State is the patient's first volume and smallest earlier volume. Confirmation needs later scans and stays with the batch
    rule. A scan without volume is NE and leaves the state as it is."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        baseline, nadir = state.get if state.exists else (None, None)
        started = state.exists
        rows = pd.concat(list(frames)).sort_values("timepoint")
        out = []
        for t, v in zip(rows["timepoint"], rows["enhancing_mm3"]):
            v = None if pd.isna(v) else float(v)
            vn = (v - nadir) / nadir if v is not None and nadir else None
            vb = (v - baseline) / baseline if v is not None and baseline else None
            if not started:
                call, baseline, started, vn, vb = "BASELINE", v, True, None, None
            elif v is None:
                call = "NE"
            elif vn is not None and vn >= pd_increase and abs(v - nadir) >= floor_mm3 or nadir == 0 and v >= max(floor_mm3, 1e-300):
                call = "PD"
            elif v == 0:
                call = "CR"
            elif vb is not None and vb <= pr_decrease and abs(v - baseline) >= floor_mm3:
                call = "PR"
            else:
                call = "SD"
            if v is not None:
                nadir = v if nadir is None else min(nadir, v)
            out.append((key[0], t, call, vn, vb))
        state.update((baseline, nadir))
        yield pd.DataFrame(out, columns=["patient", "timepoint", "call", "vs_nadir", "vs_baseline"])

    rows = scans.select("patient", "timepoint", "enhancing_mm3")
    return rows.groupBy("patient").applyInPandasWithState(advance, OUTPUT, STATE, "append", "NoTimeout")

"""Responses confirmed or demoted as later scans arrive: the rule's look-ahead on a stream, with timers in event time.

A complete or partial response waits in its patient's state for the first scan ``confirm_weeks`` or more after it. That scan decides: it confirms (a complete response needs another one, a
partial one either), refutes (the call becomes SD), or comes after more than ``confirm_max_weeks`` and so cannot tell, and the call stays. Where the watermark passes that limit before any
such scan has come, the timer lets the call stay, as no scan to come could change it any more, and the state of a patient who is not seen again is freed. All other calls pass at once."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

OUTPUT = "patient bigint, timepoint bigint, call string, provisional string, note string"
STATE = "timepoint bigint, week double, call string"
#: Week 0 of all patients in event time.
START = datetime(2000, 1, 1, tzinfo=timezone.utc)


def event_time(week: float) -> datetime:
    return START + timedelta(weeks=week)


class Confirmation(StatefulProcessor):
    """State: the patient's responses that wait."""

    def __init__(self, confirm_weeks: float, confirm_max_weeks: float):
        self.least, self.most, self.state = confirm_weeks, confirm_max_weeks, StructType.fromDDL(STATE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting = [(w[0], w[1], w[2]) for w in self.waiting.get()]
        for _, timepoint, week, call in sorted(((r["week"] is None, r["timepoint"], r["week"], r["call"]) for r in rows), key=lambda r: (r[0], r[2] or 0.0, r[1])):
            if week is None:
                yield Row(patient=key[0], timepoint=timepoint, call=call, provisional=None, note="confirmation_week" if call in ("CR", "PR") else None)
                continue
            left = []
            for w in waiting:
                gap = week - w[1]
                if gap < self.least:
                    left.append(w)
                elif gap > self.most:
                    yield Row(patient=key[0], timepoint=w[0], call=w[2], provisional=None, note="confirmation_too_late")
                elif call == "CR" or call == "PR" == w[2]:
                    yield Row(patient=key[0], timepoint=w[0], call=w[2], provisional=None, note=None)
                else:
                    yield Row(patient=key[0], timepoint=w[0], call="SD", provisional=w[2], note="refuted")
            waiting = left
            if call in ("CR", "PR"):
                waiting.append((timepoint, week, call))
                self.handle.registerTimer(int(event_time(week + self.most).timestamp() * 1000))
            else:
                yield Row(patient=key[0], timepoint=timepoint, call=call, provisional=None, note=None)
        self.waiting.put(waiting) if waiting else self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        reached = (datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc) - START) / timedelta(weeks=1)
        left = []
        for w in ((x[0], x[1], x[2]) for x in self.waiting.get()):
            if w[1] + self.most <= reached + 1e-6:
                yield Row(patient=key[0], timepoint=w[0], call=w[2], provisional=None, note="confirmation_followup")
            else:
                left.append(w)
        self.waiting.put(left) if left else self.waiting.clear()

    def close(self) -> None:
        pass


def confirmed_calls(first_calls: DataFrame, confirm_weeks: float = 4.0, confirm_max_weeks: float = 16.0, delay: str = "1 day") -> DataFrame:
    """Final calls of a stream of first-pass calls (patient, timepoint, week, call, at): ``at`` is ``event_time(week)``, undated scans come with a null week and any time. A patient's scans come
    in order of week but for those inside one batch or ``delay``. Needs the RocksDB state store."""
    rows = first_calls.select("patient", "timepoint", "week", "call", "at").withWatermark("at", delay)
    return rows.groupBy("patient").transformWithState(statefulProcessor=Confirmation(confirm_weeks, confirm_max_weeks), outputStructType=StructType.fromDDL(OUTPUT), outputMode="append", timeMode="EventTime")

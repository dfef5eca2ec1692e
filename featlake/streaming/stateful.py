"""Job life cycles as a stateful stream operator, one state per job.

Changes may come in any order: a job's state keeps every change that a later delivery could still
make a step, and a step that turns out to be another one is given again as a new revision. The
state of a job in the right order is its steps; changes before its creation wait for one. Changes
are reduced to these as they are read, so a job's repeated requests don't add up in a task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from featlake.operators.jobs import ACCEPTED, DISMISSED, FAILED, RUNNING, SUCCESSFUL
from featlake.session import use_disk_state

# The operator travels to the executors with the job, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Which requested status may follow which; end states are followed by nothing.
_NEXT = {
    None: (ACCEPTED,),
    ACCEPTED: (RUNNING, DISMISSED),
    RUNNING: (SUCCESSFUL, FAILED, DISMISSED),
}
_CHANGE = "at bigint, seq bigint, to_status string, progress int"
_STEPS = "job_identifier string, ts timestamp, seq bigint, status string, progress int, nth int, revision bigint"
_LAST = 2**63 - 1


def _needed(changes: pd.DataFrame) -> pd.DataFrame:
    """The changes, in order, that are steps or may become steps when earlier changes come.

    With further changes the creation, the first run after it, the first dismissal after it and the
    first outcome after that run only move to earlier ones, so what comes after each is not needed.
    """
    changes = changes.sort_values(["at", "seq"], kind="stable", ignore_index=True)
    wanted, place = changes["to_status"].to_numpy(), np.arange(len(changes))
    keep = np.zeros(len(changes), bool)

    def first(statuses: tuple[str, ...], after: int) -> int:
        ours = np.isin(wanted, statuses)
        found = np.flatnonzero(ours & (place > after))
        last = int(found[0]) if len(found) else len(changes)
        keep[ours & (place <= last)] = True
        return last

    created = first((ACCEPTED,), -1)
    first((DISMISSED,), created)
    first((SUCCESSFUL, FAILED), first((RUNNING,), created))
    return changes[keep]


def _taken(changes: pd.DataFrame) -> list[tuple]:
    """The steps among ordered changes."""
    wanted, taken, start, status = changes["to_status"].to_numpy(), [], 0, None
    while status in _NEXT:
        fitting = np.flatnonzero(np.isin(wanted[start:], _NEXT[status]))
        if not len(fitting):
            break
        start += int(fitting[0]) + 1
        taken.append(start - 1)
        status = wanted[start - 1]
    return _rows(changes.iloc[taken])


def _rows(changes: pd.DataFrame) -> list[tuple]:
    whole = [None if pd.isna(p) else int(p) for p in changes["progress"]]
    return list(zip(changes["at"].tolist(), changes["seq"].tolist(), changes["to_status"].tolist(), whole))


class _JobSteps(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._changes = handle.getListState("changes", _CHANGE)
        self._revision = handle.getValueState("revision", "revision bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["at", "seq", "to_status", "progress"]
        known = pd.DataFrame([tuple(c) for c in self._changes.get()] if self._changes.exists() else [], columns=names)
        had, before = _rows(known), _taken(known)
        for batch in rows:
            # Microseconds; changes without a time come last.
            at = batch["ts"].astype("datetime64[us]").astype("int64").where(batch["ts"].notna(), _LAST)
            batch = batch[names[1:]].assign(at=at)[names]
            known = _needed(pd.concat([known, batch]) if len(known) else batch)
        has, after = _rows(known), _taken(known)
        if has != had:
            self._changes.put(has)
        revised = [n for n in range(max(len(before), len(after))) if before[n : n + 1] != after[n : n + 1]]
        if revised:
            revision = (self._revision.get()[0] if self._revision.exists() else 0) + 1
            self._revision.update((revision,))
            # A step that is no more has no status.
            at, seq, status, progress = zip(*[after[n] if n < len(after) else (_LAST, None, None, None) for n in revised])
            yield pd.DataFrame(
                {
                    "job_identifier": key[0],
                    "ts": pd.Series(at).where(pd.Series(at) != _LAST).astype("Int64").astype("datetime64[us]"),
                    "seq": pd.array(seq, "Int64"),
                    "status": pd.Series(status, dtype=object),
                    "progress": pd.array(progress, "Int32"),
                    "nth": np.array(revised, np.int32),
                    "revision": np.full(len(revised), revision),
                }
            ).assign(progress=lambda d: d["progress"].clip(0, 100))

    def close(self) -> None:
        pass


def job_steps(changes: DataFrame) -> DataFrame:
    """A stream of requested changes to the stream of steps that jobs really take.

    ``changes`` has job_identifier, ts (timestamp), seq, to_status and progress. A step is given once
    if changes come in order. Otherwise a later ``revision`` of a job's ``nth`` step replaces the
    earlier ones, and one without a status takes it back; see ``last_revisions``.
    """
    use_disk_state(changes.sparkSession)
    rows = changes.select("job_identifier", "ts", F.col("seq").cast("bigint"), "to_status", F.col("progress").cast("int"))
    return rows.groupBy("job_identifier").transformWithStateInPandas(
        statefulProcessor=_JobSteps(), outputStructType=_STEPS, outputMode="Append", timeMode="None"
    )


def last_revisions(steps: DataFrame) -> DataFrame:
    """The steps that hold, of all rows that ``job_steps`` has given."""
    step = F.struct("ts", "seq", "status", "progress")
    last = steps.groupBy("job_identifier", "nth").agg(F.max_by(step, "revision").alias("step"))
    return last.select("job_identifier", "step.*").where(F.col("status").isNotNull())

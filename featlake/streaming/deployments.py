"""Claims and outcomes of deployments as a stateful stream operator, one state per process.

A claim counts unless the process is in progress, an outcome only if it is, and only with the hash of
the definition that is recorded. Once outcomes of other definitions are set aside, that depends on
the change before it in time alone. Changes may come in any order: a change that arrives late alters
the verdict on itself and on the one after it, and an altered verdict is given again as a revision.

Without a horizon the state of a process is its changes, which suits finite runs. With one, changes
that the watermark has passed are settled: only what the process was at last stays, event-time timers
settle processes that have fallen silent, and Spark drops changes that arrive later than that.
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

from featlake.operators.jobs import FAILED, IN_PROGRESS
from featlake.session import use_disk_state

# The operator travels to the executors with the job, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Verdicts on a change.
APPLIED, STALE, BUSY, IDLE, UNKNOWN = "applied", "stale outcome", "already in progress", "not in progress", "unknown process"
_PENDING = "at bigint, seq bigint, to_value string, applied boolean"
_VERDICTS = "process_identifier string, ts timestamp, seq bigint, to_value string, verdict string, revision bigint"
_COLUMNS = ["at", "seq", "to_value", "applied"]


def _judged(pending: pd.DataFrame, busy: bool) -> pd.DataFrame:
    """Changes in order of time, with whether each counts, after a process that was ``busy`` or not."""
    pending = pending.sort_values(["at", "seq"], kind="stable", ignore_index=True)
    claim = (pending["to_value"] == IN_PROGRESS).to_numpy(bool)
    before = np.concatenate([[busy], claim[:-1]])
    return pending.assign(applied=claim != before)


def _texts(changes: pd.DataFrame) -> np.ndarray:
    refused = np.where(changes["to_value"] == IN_PROGRESS, BUSY, IDLE)
    return np.where(changes["applied"].to_numpy(bool), APPLIED, refused)


class _Deployments(StatefulProcessor):
    def __init__(self, expires: bool):
        self._expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getListState("pending", _PENDING)
        self._settled = handle.getValueState("settled", "busy boolean")
        self._revision = handle.getValueState("revision", "revision bigint")

    def _known(self) -> pd.DataFrame:
        rows = [tuple(c) for c in self._pending.get()] if self._pending.exists() else []
        return pd.DataFrame(rows, columns=_COLUMNS)

    def _keep(self, pending: pd.DataFrame, watermark: int) -> None:
        """Settle what the watermark has passed, keep the rest and wake up when it passes more."""
        if self._expires:
            past = pending["at"].to_numpy(np.int64) <= watermark * 1000
            if past.any():
                self._settled.update((bool(pending["to_value"][past].iloc[-1] == IN_PROGRESS),))
                pending = pending[~past]
            if len(pending):
                self._handle.registerTimer(int(pending["at"].iloc[0]) // 1000 + 1)
        rows = list(pending[_COLUMNS].itertuples(index=False, name=None))
        self._pending.put(rows) if rows else self._pending.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True)
        given = given.assign(at=given["ts"].astype("datetime64[us]").astype("int64"))
        revision = (self._revision.get()[0] if self._revision.exists() else 0) + 1

        def verdicts(changes: pd.DataFrame, texts) -> pd.DataFrame:
            return pd.DataFrame(
                {
                    "process_identifier": key[0],
                    "ts": changes["at"].astype("int64").astype("datetime64[us]"),
                    "seq": changes["seq"].astype("int64"),
                    "to_value": changes["to_value"],
                    "verdict": texts,
                    "revision": np.int64(revision),
                }
            )

        unknown = given["known"].isna()
        if unknown.any():
            yield verdicts(given[unknown], UNKNOWN)
        stale = ~unknown & (given["to_value"] != IN_PROGRESS) & given["outdated"].fillna(False).astype(bool)
        if stale.any():
            yield verdicts(given[stale], STALE)
        live = given[~unknown & ~stale]
        if not len(live):
            return
        self._revision.update((revision,))
        known = self._known()
        busy = bool(self._settled.get()[0]) if self._settled.exists() else live["start"].iloc[0] == IN_PROGRESS
        fresh = live.assign(applied=None)[_COLUMNS]
        pending = _judged(pd.concat([known, fresh], ignore_index=True).assign(was=[*known["applied"], *fresh["applied"]]), busy)
        altered = pending[[w is None or bool(w) != a for w, a in zip(pending["was"], pending["applied"])]]
        yield verdicts(altered, _texts(altered))
        self._keep(pending, timerValues.getCurrentWatermarkInMs() if self._expires else 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._known(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def deployment_verdicts(changes: DataFrame, processes: DataFrame, remember: str | None = None) -> DataFrame:
    """A stream of requested changes to the stream of verdicts on them.

    ``changes`` has process_identifier, ts (timestamp), seq, to_value and definition_hash;
    ``processes`` has identifier, deployment and definition_hash. Every change gets a verdict:
    applied, or why it does not count; a later ``revision`` of a change's verdict replaces the
    earlier ones, see ``last_verdicts``. ``remember`` is the horizon of an endless stream.
    """
    use_disk_state(changes.sparkSession)
    facts = processes.select(
        F.col("identifier").alias("process_identifier"), F.lit(True).alias("known"),
        F.coalesce("deployment", F.lit(FAILED)).alias("start"), F.col("definition_hash").alias("_recorded"),
    )
    rows = changes.withWatermark("ts", remember) if remember else changes
    rows = rows.join(facts, "process_identifier", "left")
    outdated = ~F.col("definition_hash").eqNullSafe(F.col("_recorded"))
    rows = rows.select("process_identifier", "ts", F.col("seq").cast("bigint"), "to_value", "known", "start", outdated.alias("outdated"))
    return rows.groupBy("process_identifier").transformWithStateInPandas(
        statefulProcessor=_Deployments(remember is not None), outputStructType=_VERDICTS, outputMode="Append",
        timeMode="EventTime" if remember else "None",
    )


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """The verdicts that hold, of all rows that ``deployment_verdicts`` has given."""
    last = verdicts.groupBy("process_identifier", "ts", "seq").agg(F.max_by(F.struct("to_value", "verdict"), "revision").alias("last"))
    return last.select("process_identifier", "ts", "seq", "last.*")

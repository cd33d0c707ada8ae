"""Jobs as a state machine over a stream of their events, in any order of arrival, with event-time timers.

A job runs from its start until its first terminal event by time; one that runs for TIMEOUT is told as timed out when the
watermark passes that moment, and RETENTION after it ended it is told as pruned and forgotten.  Stages are appended while a
job runs.  State is bounded by the jobs of the retention and their stages' times.

Jobs are kept in GROUPS groups by a hash of their id, as columns: a call of the processor, its state and its timer are of a
group, so what a call costs isn't paid for each job.  A micro-batch reads and writes the state of the groups that it has events of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..ship import ship

MINUTE = 60_000
TIMEOUT, RETENTION = 60 * MINUTE, 7 * 24 * 60 * MINUTE
#: Events that arrive later than this behind the newest one may be missed.
DELAY = "10 minutes"
#: Groups of jobs; a stream keeps the number that its checkpoint was made with.
GROUPS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "id string, status string, created long, updated long, n_stages long, version long"
#: Terminal events, in the order in which they count at the same moment, and states; a state's number is its place.
ENDS = {"complete": "completed", "fail": "failed"}
STATES = np.array(["running", *ENDS.values(), "timeout"], object)
RUNNING, TIMED_OUT = 0, 3
NEVER = np.iinfo(np.int64).max


class Group:
    """Jobs as columns: id, when made (NEVER: not yet) and ended, state and how often told; and their stages' times, each with its job's place."""

    def __init__(self, jobs: bytes | None = None, stages: bytes | None = None):
        self.ids, self.status = pd.Index([], dtype=object), np.zeros(0, np.int8)
        self.created, self.updated, self.version, self.of, self.at = (np.zeros(0, np.int64) for _ in range(5))
        if jobs is not None:
            t = pa.ipc.open_stream(jobs).read_all()
            self.ids = pd.Index(t["id"].to_pylist(), dtype=object)
            self.status, self.created, self.updated, self.version = (t[c].to_numpy().copy() for c in ("status", "created", "updated", "version"))  # Arrow's are read-only
            s = pa.ipc.open_stream(stages).read_all()
            self.of, self.at = s["of"].to_numpy(), s["at"].to_numpy()

    def packed(self) -> tuple[bytes, bytes]:
        jobs = {"id": pa.array(self.ids.to_list(), pa.string()), "status": self.status, "created": self.created, "updated": self.updated, "version": self.version}
        return tuple(_bytes(pa.table(t)) for t in (jobs, {"of": self.of, "at": self.at}))

    def places(self, ids: pd.Series) -> np.ndarray:
        """Where each id's job is; new ones are added as running, without a start."""
        codes, found = pd.factorize(ids.astype(object).where(ids.notna(), None), use_na_sentinel=False)
        found = pd.Index([None if pd.isna(x) else x for x in found], dtype=object)
        at = self.ids.get_indexer(found)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.ids) + np.arange(len(new))
        self.ids = self.ids.append(found[new])
        self.status = np.append(self.status, np.zeros(len(new), np.int8))
        self.created = np.append(self.created, np.full(len(new), NEVER))
        self.updated, self.version = (np.append(x, np.zeros(len(new), np.int64)) for x in (self.updated, self.version))
        return at[codes]

    def take(self, frames: Iterator[pd.DataFrame]) -> np.ndarray:
        """Events (id, kind, ms) of a micro-batch, whatever their order; the places of the jobs that they change, each told once more."""
        was = len(self.ids)
        start, end, of, at = np.full(was, NEVER), np.full(was, NEVER), [self.of], [self.at]
        for frame in frames:
            place, kind, ms = self.places(frame["id"]), frame["kind"], frame["ms"].to_numpy().astype(np.int64)
            start, end = (np.append(x, np.full(len(self.ids) - len(x), NEVER)) for x in (start, end))
            m = (kind == "start").to_numpy()
            np.minimum.at(start, place[m], ms[m])
            for k, name in enumerate(ENDS):
                m = (kind == name).to_numpy()
                np.minimum.at(end, place[m], ms[m] * len(ENDS) + k)
            m = (kind == "stage").to_numpy()
            of.append(place[m])
            at.append(ms[m])
        before = self.created.copy(), self.status.copy(), self.updated.copy()
        better = start < self.created
        self.updated = np.where(better & (self.status == RUNNING), np.maximum(self.updated, start), self.updated)
        self.created = np.where(better, start, self.created)
        ms, k = np.divmod(end, len(ENDS))
        ends = (end < NEVER) & ((self.status == RUNNING) | ((self.status != TIMED_OUT) & (ms < self.updated)))
        self.status, self.updated = np.where(ends, 1 + k, self.status).astype(np.int8), np.where(ends, ms, self.updated)
        self.of, self.at = np.concatenate(of), np.concatenate(at)
        counts = self._counted()  # an end only moves to an earlier time, so stages after it never count again
        self.of, self.at = self.of[counts], self.at[counts]
        changed = np.flatnonzero((self.created != before[0]) | (self.status != before[1]) | (self.updated != before[2]))
        self.version[changed] += 1
        return changed

    def _counted(self) -> np.ndarray:
        return (self.status[self.of] == RUNNING) | (self.at <= self.updated[self.of])

    def due(self) -> np.ndarray:
        """When each job is next told without an event."""
        running = np.where(self.created < NEVER, self.created, NEVER - TIMEOUT) + TIMEOUT
        return np.where(self.status == RUNNING, running, self.updated + RETENTION)

    def expire(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Time out what has run too long, and forget what ended long ago."""
        late = np.flatnonzero((self.status == RUNNING) & (self.due() <= watermark))
        self.status[late], self.updated[late] = TIMED_OUT, self.created[late] + TIMEOUT
        self.version[late] += 1
        counts = self._counted()
        self.of, self.at = self.of[counts], self.at[counts]
        yield self.told(late)
        old = (self.status != RUNNING) & (self.due() <= watermark)
        self.version[old] += 1
        yield self.told(np.flatnonzero(old), "pruned")
        stays, place = ~old[self.of], np.cumsum(~old) - 1
        self.of, self.at = place[self.of[stays]], self.at[stays]
        self.ids = self.ids[~old]
        self.status, self.created, self.updated, self.version = (x[~old] for x in (self.status, self.created, self.updated, self.version))

    def told(self, places: np.ndarray, status: str | None = None) -> pd.DataFrame:
        made = self.created[places]
        n = np.bincount(self.of, minlength=len(self.ids))[places]
        created = pd.arrays.IntegerArray(made, made == NEVER)
        return pd.DataFrame({"id": self.ids[places], "status": status or STATES[self.status[places]], "created": created, "updated": self.updated[places], "n_stages": n, "version": self.version[places]})


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class JobMachine(StatefulProcessor):
    """The jobs of a group, and one timer for the next of them that is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("jobs", "jobs binary, stages binary")

    def _read(self) -> Group:
        return Group(*map(bytes, self._state.get())) if self._state.exists() else Group()

    def _write(self, group: Group) -> None:
        for t in list(self._handle.listTimers()):
            self._handle.deleteTimer(t)
        if not len(group.ids):
            self._state.clear()
            return
        self._state.update(group.packed())
        if (next_ := group.due().min()) < NEVER:
            self._handle.registerTimer(int(next_) - 1)  # timers before the watermark fire, and a job is due at its moment

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        group = self._read()
        changed = group.take(rows)
        self._write(group)
        if len(changed):
            yield group.told(changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        group = self._read()
        told = list(group.expire(timerValues.getCurrentWatermarkInMs()))
        self._write(group)
        yield from (t for t in told if len(t))

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, delay: str = DELAY, groups: int = GROUPS, clock: str = "at") -> DataFrame:
    """Each job's states as they change (id, status, created, updated, n_stages, version) from a stream of events (id, kind: start, stage, complete or fail; at, stage).

    The watermark follows the column `clock`, which is `at` unless events are told at another time than they are of.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    id_ = F.col("id").cast("string")
    rows = events.withWatermark(clock, delay).select(F.pmod(F.xxhash64(id_), F.lit(groups)).cast("int").alias("group"), id_.alias("id"), "kind", clock, F.unix_millis("at").alias("ms"))
    told = rows.groupBy("group").transformWithStateInPandas(JobMachine(), OUT, "Update", "EventTime")
    return told.withColumns({c: F.timestamp_millis(c) for c in ("created", "updated")})


def current(states: DataFrame) -> DataFrame:
    """The last state of each job that isn't pruned."""
    last = states.groupBy("id").agg(F.max_by(F.struct(*[c for c in states.columns if c != "id"]), "version").alias("_s"))
    return last.select("id", "_s.*").where("status <> 'pruned'").drop("version")

"""Streams that decide: job states with legal transitions and timers, and a rate limit that refuses.

Both keep state by key in RocksDB (``transformWithState``) and need its state store provider,
which ``drained`` sets for the query. An event is judged by what its key's state holds, in order of
time and id within a batch, so while batches follow each other in time, results do not depend on how
events are cut into them. Events that come behind later ones have a stated result of their own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quoin.operators.lifecycle import LIMITS, TRANSIENT
from quoin.sources.bridge import frame
from quoin.streaming.states import drained, events_stream

#: Which state may follow which; a new job has none. A confirmed job waits (pending)
#: or is taken up at once; without a file to annotate it is done after processing.
LEGAL: dict[str | None, list[str]] = {
    None: ["awaiting_confirmation"],
    "awaiting_confirmation": ["pending", "extracting"],
    "pending": ["extracting", "error"],
    "extracting": ["processing", "error"],
    "processing": ["annotating", "done", "error"],
    "annotating": ["done", "error"],
    "error": ["awaiting_confirmation"],
    "done": [],
}
#: A transient state that has lasted so long is an error; a finished job is forgotten.
STALE, KEEP = dt.timedelta(hours=6), dt.timedelta(days=7)
LATE = "1 hour"
FORGOTTEN = "forgotten"
_STATE = "status string, since long, seen long, legal long, illegal long, timed_out long"
#: Times are microseconds within the processors, whatever zone a session has.
MICRO, MINUTE = dt.timedelta(microseconds=1), 60_000_000
#: Answers that go out in one frame.
ANSWERS = 100_000


def due(status: str | None, since: int) -> int | None:
    """When a timer ends the state: stale ones and finished ones have one."""
    return since + STALE // MICRO if status in TRANSIENT else since + KEEP // MICRO if status == "done" else None


def after_timer(state: tuple, at: int) -> tuple:
    """The state once its timer has gone off by ``at``; a finished job begins anew."""
    status, since, seen, legal, illegal, timed_out = state
    end = due(status, since) if since is not None else None
    if end is None or at < end:
        return state
    return (None, None, seen, 0, 0, 0) if status == "done" else ("error", end, seen, legal, illegal, timed_out + 1)


def after_event(state: tuple, status: str, at: int) -> tuple:
    """The state after an event; one that is not legal, or older than the last, is counted only."""
    old, since, seen, legal, illegal, timed_out = after_timer(state, at)
    if (seen is not None and at < seen) or status not in LEGAL[old]:
        return old, since, at if seen is None else max(at, seen), legal, illegal + 1, timed_out
    return status, at, at, legal + 1, illegal, timed_out


class JobStates(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)

    def _told(self, key: tuple, state: tuple, at: int) -> Row:
        status, since, _, *counts = state
        return Row(job_id=key[0], status=status or FORGOTTEN, updated_at=at if since is None else since, at=at, legal=counts[0], illegal=counts[1], timed_out=counts[2])

    def _put(self, state: tuple) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end = due(state[0], state[1]) if state[1] is not None else None
        if end is not None:
            # a timer counts milliseconds; rounded up, none goes off before its time
            self.handle.registerTimer(-(-end // 1000))
        self.state.update(state)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = tuple(self.state.get()) if self.state.exists() else (None, None, None, 0, 0, 0)
        for row in sorted(rows, key=lambda r: (r.us, r.event_id)):
            state = after_event(state, row.status, row.us)
        self._put(state)
        yield self._told(key, state, state[2])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.state.exists():
            return
        old = tuple(self.state.get())
        at = due(old[0], old[1]) if old[1] is not None else None
        if at is None:
            return
        state = after_timer(old, at)
        if state[0] is None:
            self.state.clear()
        else:
            self._put(state)
        yield self._told(key, state, at)

    def close(self) -> None:
        pass


def micros(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))


def job_states(states: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of (job_id, ts, event_id, status) as updates (job_id, status, updated_at, at, legal,
    illegal, timed_out): one for each job that a batch touches and for each timer. Events that come
    later than ``late`` are dropped by the watermark."""
    schema = "job_id long, status string, updated_at long, at long, legal long, illegal long, timed_out long"
    timed = micros(states).withWatermark("ts", late)
    updates = timed.groupBy("job_id").transformWithState(JobStates(), schema, outputMode="Update", timeMode="EventTime")
    return updates.withColumns({c: F.timestamp_micros(c) for c in ("updated_at", "at")})


def last_updates(updates: DataFrame) -> DataFrame:
    """The last update of each job."""
    fields = ["status", "updated_at", "legal", "illegal", "timed_out"]
    last = F.max_by(F.struct(*fields), F.struct("at", F.col("legal") + F.col("illegal") + F.col("timed_out")))
    return updates.groupBy("job_id").agg(last.alias("u")).select("job_id", "u.*")


class Minutes(StatefulProcessor):
    """How many requests a client has made in each minute of the last hour."""

    def __init__(self, limits: dict[str, int], hours: int = 1):
        self.limits, self.span = limits, hours * 60

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.made = handle.getMapState("made", "minute long", "n long")
        self.newest = handle.getValueState("newest", "minute long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = [(f["us"].to_numpy(np.int64), f["event_id"].to_numpy(np.int64)) for f in rows]
        us, ids = (np.concatenate(c) for c in zip(*frames))
        order = np.lexsort((ids, us))
        us, ids = us[order], ids[order]
        newest = self.newest.get()[0] if self.newest.exists() else None
        # in order of time, so only what earlier batches brought can be too far ahead of a request
        minutes, first, where, counts = np.unique(us // MINUTE, return_index=True, return_inverse=True, return_counts=True)
        past = np.zeros(len(minutes), bool) if newest is None else minutes <= newest - self.span
        made = np.zeros(len(minutes), np.int64)
        for k in np.flatnonzero(~past):
            minute = (int(minutes[k]),)
            made[k] = self.made.getValue(minute)[0] if self.made.containsKey(minute) else 0
            self.made.updateValue(minute, (int(made[k] + counts[k]),))
            newest = minute[0] if newest is None else max(newest, minute[0])
        self.newest.update((newest,))
        for (minute,) in list(self.made.keys()):
            if minute <= newest - self.span:
                self.made.removeKey((minute,))
        n = made[where] + np.arange(len(us)) - first[where] + 1
        late = past[where]
        for k in range(0, len(us), ANSWERS):
            part = slice(k, k + ANSWERS)
            told = {"event_id": ids[part], "client": pd.array([key[0]], "Int64").repeat(len(ids[part])), "us": us[part], "late": late[part]}
            yield pd.DataFrame({**told, **{f"{name}_accepted": ~late[part] & (n[part] <= most) for name, most in self.limits.items()}})

    def close(self) -> None:
        pass


def decisions(requests: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """A stream of requests (event_id, client, ts) with what each limit says to each: the first
    ``limits`` requests of a client and minute are accepted, others refused. A request from an hour
    or more before its client's newest minute is late and refused. Every request is answered in the
    batch it comes with."""
    schema = "event_id long, client long, us long, late boolean, " + ", ".join(f"{name}_accepted boolean" for name in limits)
    answers = micros(requests).groupBy("client").transformWithStateInPandas(Minutes(limits), schema, outputMode="Append", timeMode="None")
    return answers.withColumn("ts", F.timestamp_micros("us")).drop("us")


# ── queries ────────────────────────────────────────────────────────────────

#: The events of a month as requests of two hours: microseconds are divided by this.
FASTER, CLIENTS, BEGAN = 360, 5, 1_704_067_200_000_000


def as_states(events: DataFrame) -> DataFrame:
    """Events as the states view of the data model has them."""
    names = {"click": "processing", "view": "extracting", "purchase": "done", "signup": "awaiting_confirmation"}
    status = F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("event_type")], F.lit("error"))
    return events.select(F.col("user_id").cast("long").alias("job_id"), "ts", F.col("event_id").cast("long"), status.alias("status"))


def as_requests(events: DataFrame) -> DataFrame:
    ts = F.expr(f"timestamp_micros({BEGAN} + (unix_micros(cast(ts AS timestamp)) - {BEGAN}) div {FASTER})")
    return events.select(F.col("event_id").cast("long"), (F.col("user_id") % CLIENTS).cast("long").alias("client"), ts.alias("ts"))


def query_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_updates(drained(job_states(as_states(events_stream(spark, sf_dir))), "update"))


def query_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(decisions(as_requests(events_stream(spark, sf_dir))), "append").drop("ts")


def _values(rows: Iterable[tuple]) -> str:
    return ", ".join(str(r) for r in rows)


_SECONDS = lambda d: int(d.total_seconds())
_TRANSIENT = ", ".join(f"'{s}'" for s in TRANSIENT)
_DUE = f"CASE WHEN status IN ({_TRANSIENT}) THEN since + INTERVAL {_SECONDS(STALE)} SECOND WHEN status = 'done' THEN since + INTERVAL {_SECONDS(KEEP)} SECOND END"
SQL = {
    "l01_status_machine_stream": f"""WITH RECURSIVE legal(a, b) AS (VALUES {_values((a or '', b) for a, bs in LEGAL.items() for b in bs)}),
  e AS (SELECT user_id AS job_id, ts, CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'extracting' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'awaiting_confirmation' ELSE 'error' END AS next, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  walk(job_id, n, ts, status, since, legal, illegal, timed_out) AS (
    SELECT DISTINCT job_id, 0::BIGINT, NULL::TIMESTAMP, '', NULL::TIMESTAMP, 0, 0, 0 FROM e
    UNION ALL
    SELECT job_id, n, ts, CASE WHEN ok THEN next ELSE status END, CASE WHEN ok THEN ts ELSE since END, legal + CASE WHEN ok THEN 1 ELSE 0 END, illegal + CASE WHEN ok THEN 0 ELSE 1 END, timed_out
    FROM (SELECT w.*, EXISTS (SELECT 1 FROM legal WHERE a = w.status AND b = w.next) AS ok
      FROM (SELECT e.job_id, e.n, e.ts, e.next, CASE WHEN NOT over THEN status WHEN status = 'done' THEN '' ELSE 'error' END AS status, CASE WHEN NOT over THEN since WHEN status = 'done' THEN NULL ELSE due END AS since,
          CASE WHEN over AND status = 'done' THEN 0 ELSE legal END AS legal, CASE WHEN over AND status = 'done' THEN 0 ELSE illegal END AS illegal, CASE WHEN NOT over THEN timed_out WHEN status = 'done' THEN 0 ELSE timed_out + 1 END AS timed_out
        FROM (SELECT *, {_DUE} AS due FROM walk) v JOIN e ON e.job_id = v.job_id AND e.n = v.n + 1, LATERAL (SELECT coalesce(e.ts >= due, false) AS over)) w)),
  last AS (SELECT *, {_DUE} AS due FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS back FROM walk) WHERE back = 1),
  fin AS (SELECT *, coalesce(due <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR, false) AS over FROM last)
  SELECT job_id, CASE WHEN over AND status = 'done' THEN '{FORGOTTEN}' WHEN over THEN 'error' WHEN status = '' THEN '{FORGOTTEN}' ELSE status END AS status, CASE WHEN over THEN due ELSE coalesce(since, ts) END AS updated_at,
    CASE WHEN over AND status = 'done' THEN 0 ELSE legal END::BIGINT AS legal, CASE WHEN over AND status = 'done' THEN 0 ELSE illegal END::BIGINT AS illegal, CASE WHEN over AND status = 'done' THEN 0 WHEN over THEN timed_out + 1 ELSE timed_out END::BIGINT AS timed_out FROM fin""",
    "l11_decisions_stream": f"""WITH r AS (SELECT event_id, user_id % {CLIENTS} AS client, make_timestamp({BEGAN} + (epoch_us(ts) - {BEGAN}) // {FASTER}) AS moment FROM events),
  n AS (SELECT event_id, client, row_number() OVER (PARTITION BY client, date_trunc('minute', moment) ORDER BY moment, event_id) AS n FROM r)
  SELECT event_id, client, false AS late, {', '.join(f'n <= {most} AS {name}_accepted' for name, most in LIMITS.items())} FROM n""",
}
QUERIES = {"l01_status_machine_stream": query_states, "l11_decisions_stream": query_decisions}

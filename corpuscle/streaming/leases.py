"""Queues for several consumers: jobs are leased, and a lease that is not renewed lapses.

Events (queue, at, kind, job, consumer) of a stream; kinds:
* add: a job comes into the queue (again, if it is done; one that is there already stays as it is);
* ask: a consumer asks for a job and gets the oldest that waits, for `lease` milliseconds;
* renew: its consumer keeps a job for another lease;
* done, fail: its consumer ends a job; a failed one waits again.
What comes back (queue, kind, job, consumer, until): granted, empty (nothing waits), renewed, done, failed, refused (the
consumer does not hold the job), lapsed.  A queue is a key, so its events are handled one at a time in whatever task has the
key: no two consumers hold one job.  A timer fires when a lease is over; the job then waits again, in its old place before
younger ones, and its late consumer is refused.  State and timers are checkpointed: a restart keeps leases, which lapse if
their consumers are gone, and needs no recovery of its own.

Within a batch events are taken in the order of `at`, then of kind (adds first), job and consumer.  Nulls in job or consumer
are names like others; kinds that are not known are refused.  Work of an event is constant but for jobs that lapsed or failed
and wait again, of which the oldest is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEASE = 60_000
OUT = "queue string, kind string, job string, consumer string, until long"
_ORDER = {"add": 0, "renew": 1, "done": 2, "fail": 3, "ask": 4}
WAITS, HELD, ENDED = 0, 1, 2


class Leases(StatefulProcessor):
    """The state of a queue: jobs by name, waiting jobs by number, waiting jobs that were held before, and the next numbers."""

    def __init__(self, lease: int = LEASE) -> None:
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job string", "number long, state int, consumer string, until long")
        self.waiting = handle.getMapState("waiting", "number long", "job string")
        self.again = handle.getMapState("again", "number long", "job string")
        self.ends = handle.getValueState("ends", "head long, tail long")

    def _take(self) -> tuple[int, str] | None:
        """The oldest waiting job, which leaves its list."""
        numbers = [k[0] for k in self.again.keys()]
        if numbers:
            number = min(numbers)
            job = self.again.getValue((number,))[0]
            self.again.removeKey((number,))
            return number, job
        head, tail = self.ends.get() if self.ends.exists() else (0, 0)
        if head >= tail:
            return None
        job = self.waiting.getValue((head,))[0]
        self.waiting.removeKey((head,))
        self.ends.update((head + 1, tail))
        return head, job

    def _event(self, kind: str, job: str, consumer: str, now: int) -> tuple:
        known = self.jobs.getValue((job,)) if kind != "ask" and self.jobs.containsKey((job,)) else None
        if kind == "add":
            if known is None or known[1] == ENDED:
                head, tail = self.ends.get() if self.ends.exists() else (0, 0)
                self.waiting.updateValue((tail,), (job,))
                self.ends.update((head, tail + 1))
                self.jobs.updateValue((job,), (tail, WAITS, "", 0))
            return ()
        if kind == "ask":
            found = self._take()
            if found is None:
                return "empty", None, consumer, None
            until = now + self.lease
            self.jobs.updateValue((found[1],), (found[0], HELD, consumer, until))
            self.handle.registerTimer(until)
            return "granted", found[1], consumer, until
        holds = known is not None and known[1] == HELD and known[2] == consumer and known[3] > now
        if not holds or kind not in _ORDER:
            return "refused", job, consumer, None
        if kind == "renew":
            until = now + self.lease
            self.jobs.updateValue((job,), (known[0], HELD, consumer, until))
            self.handle.registerTimer(until)
            return "renewed", job, consumer, until
        if kind == "done":
            self.jobs.updateValue((job,), (known[0], ENDED, "", 0))
            return "done", job, consumer, None
        self._back(job, known[0])
        return "failed", job, consumer, None

    def _back(self, job: str, number: int) -> None:
        self.jobs.updateValue((job,), (number, WAITS, "", 0))
        self.again.updateValue((number,), (job,))

    def _lapse(self, now: int) -> list[tuple]:
        out = []
        for (job,), (number, state, consumer, until) in list(self.jobs.iterator()):
            if state == HELD and until <= now:
                self._back(job, number)
                out.append(("lapsed", job, consumer, until))
        return out

    def _frame(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame([(key[0], *o) for o in out if o], columns=["queue", "kind", "job", "consumer", "until"])
        frame["until"] = frame["until"].astype("Int64")
        yield frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows))
        events["_order"] = events["kind"].map(_ORDER).fillna(9)
        events = events.sort_values(["at", "_order", "job", "consumer"], kind="stable")
        now = timerValues.getCurrentProcessingTimeInMs()
        name = lambda x: "" if x is None or x != x else str(x)
        yield from self._frame(key, [self._event(e.kind, name(e.job), name(e.consumer), now) for e in events.itertuples()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._frame(key, self._lapse(max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())))

    def close(self) -> None:
        pass


def leased(events: DataFrame, lease: int = LEASE) -> DataFrame:
    """OUT of a stream of events (queue string, at, kind, job, consumer); needs the RocksDB state store."""
    return events.groupBy("queue").transformWithStateInPandas(Leases(lease), OUT, "append", "processingTime")

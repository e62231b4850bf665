"""An outbox with leases: events are claimed, sent again after failures and lost senders, and given up.

A record tells what happened to an event: it is `new`, a sender says `sent` or `failed`.
A new event is claimed at once and leased; a failure, or a lease that runs out, makes it
wait and then be claimed anew, until its attempts are used up. Whatever comes of an event
later than its end, or a second time, changes nothing. The table form reads all records
and tells the states; the stream form keeps the states of open and of lately ended
events, and gives each claim and end when it is due.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

OPEN = ("claimed", "waiting")


@dataclass(frozen=True)
class Terms:
    """In seconds: how long a claim is leased, and how long a failed event waits. attempts: claims in all."""

    lease: int = 60
    delay: int = 300
    attempts: int = 3

    def after_failure(self, tried: int, at: int) -> tuple[str, int, int]:
        return ("failed", tried, at) if tried >= self.attempts else ("waiting", tried, at + self.delay)

    def passed(self, state: tuple[str, int, int], now: int) -> Iterator[tuple[tuple[str, int, int], int]]:
        """What time alone does up to now, each with when: a wait that ends, a lease that runs out. mark, the last of a state, is when it is next to change."""
        status, tried, mark = state
        while status in OPEN and mark <= now:
            at = mark
            status, tried, mark = ("claimed", tried + 1, at + self.lease) if status == "waiting" else self.after_failure(tried, at)
            yield (status, tried, mark), at

    def told(self, state: tuple[str, int, int] | None, kind: str, at: int) -> tuple[str, int, int] | None:
        """The state after a record; that of an event that isn't known begins with `new`."""
        if state is None:
            return ("claimed", 1, at + self.lease) if kind == "new" else None
        status, tried, _ = state
        if status in OPEN and kind == "sent":
            return "sent", tried, at
        if status == "claimed" and kind == "failed":
            return self.after_failure(tried, at)
        return state


def states(records: DataFrame, key: str, kind: str, at: str, order: str, terms: Terms, as_of: int) -> DataFrame:
    """(key, status, attempts) of every event at a time, in seconds: `claimed`, `waiting`, `sent` or `failed`.

    Records are dealt out by event and sorted by time, then by order, and told one after
    the other, so a task holds one state, however many records an event has. Records
    without a time, without an event, or later than as_of are left out; events that were
    never new have no state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, now = None, None
        for batch in batches:
            out = []
            for event, what, when in zip(batch["__key"], batch["__kind"], batch["__at"]):
                if event != who:
                    out.append((who, now))
                    who, now = event, None
                if now is not None:
                    for now, _ in terms.passed(now, when):
                        pass
                now = terms.told(now, what, when)
            yield ended(out)
        yield ended([(who, now)])

    def ended(out: list) -> pd.DataFrame:
        rows = []
        for event, now in out:
            if now is not None:
                for now, _ in terms.passed(now, as_of):
                    pass
                rows.append((event, now[0], now[1]))
        return pd.DataFrame(rows, columns=["__key", "status", "attempts"])

    rows = records.select(F.col(key).alias("__key"), F.col(kind).alias("__kind"), F.unix_seconds(F.col(at).cast("timestamp")).alias("__at"), F.col(order).alias("__order"))
    rows = rows.where(F.col("__key").isNotNull() & (F.col("__at") <= as_of))
    dealt = rows.repartition("__key").sortWithinPartitions("__key", "__at", "__order")
    key_type = records.schema[key].dataType.simpleString()
    return dealt.mapInPandas(run, f"__key {key_type}, status string, attempts int").withColumnRenamed("__key", key)


class _Lane(StatefulProcessor):
    """The events of a lane, by key, in a map; one timer, for the earliest that is to change."""

    def __init__(self, terms: Terms, remember: int):
        self.terms, self.remember = terms, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "event_key string", "status string, attempts int, mark long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out: list[Row] = []
        for r in sorted(rows, key=lambda r: (r["at"], r["turn"])):
            name = (r["event_key"],)
            now = tuple(self.events.getValue(name)) if self.events.containsKey(name) else None
            before = now
            if now is not None:
                now = self._let_pass(r["event_key"], now, r["at"], out)
            after = self.terms.told(now, r["kind"], r["at"])
            if after is not None and after != now and after[0] != "waiting":
                out.append(Row(event_key=r["event_key"], status=after[0], attempts=after[1], at=r["at"]))
            if after is not None and after != before:
                self.events.updateValue(name, after)
        self._wake()
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now_s = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // 1000
        out: list[Row] = []
        for name, state in list(self.events.iterator()):
            state = tuple(state)
            if state[0] in OPEN:
                after = self._let_pass(name[0], state, now_s, out)
                if after != state:
                    self.events.updateValue(tuple(name), after)
            elif state[2] + self.remember <= now_s:
                self.events.removeKey(tuple(name))
        self._wake()
        yield from out

    def _let_pass(self, event: str, state: tuple, now: int, out: list[Row]) -> tuple:
        for state, at in self.terms.passed(state, now):
            if state[0] != "waiting":
                out.append(Row(event_key=event, status=state[0], attempts=state[1], at=at))
        return state

    def _wake(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        marks = [s[2] if s[0] in OPEN else s[2] + self.remember for s in map(tuple, self.events.values())]
        if marks:
            self.handle.registerTimer(min(marks) * 1000)

    def close(self) -> None:
        pass


def outbox_stream(records: DataFrame, key: str, kind: str, at: str, order: str, terms: Terms, lanes: int = 64, remember: int = 86_400, lateness: str = "1 second") -> DataFrame:
    """(event_key, status, attempts, at) each time an event of a stream is claimed, sent or failed; at is in seconds.

    A claim is for a sender to act on, who answers with a record of `sent` or `failed`. The
    same event in a later batch isn't claimed again for as long as it is remembered: until
    `remember` seconds after its end. Waits and leases end with the watermark. An event
    lies in the lane its key decides; a lane's state is a map of its open and remembered
    events. Needs a RocksDB state store.
    """
    seen = F.col(at).cast("timestamp")
    rows = records.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(lanes)).cast("int").alias("lane"), F.col(key).cast("string").alias("event_key"), F.col(kind).alias("kind"), F.unix_seconds(seen).alias("at"), F.col(order).cast("long").alias("turn"), seen.alias("seen"))
    return rows.withWatermark("seen", lateness).groupBy("lane").transformWithState(_Lane(terms, remember), "event_key string, status string, attempts int, at long", "append", "EventTime")

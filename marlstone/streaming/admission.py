"""Exact sliding-window admission: a request that is refused doesn't count against its client."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(requests: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int) -> DataFrame:
    """requests with admitted: whether under limit earlier admitted ones lie within the window.

    Clients are dealt out and sorted by time; a task holds at most limit times.
    """
    width = seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, taken = None, deque()
        for batch in batches:
            out = []
            for who, at in zip(batch[key], batch["__at"]):
                if who != client:
                    client, taken = who, deque()
                while taken and taken[0] <= at - width:
                    taken.popleft()
                out.append(len(taken) < limit)
                if out[-1]:
                    taken.append(at)
            yield batch.drop(columns="__at").assign(admitted=out)

    rows = requests.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp")))
    dealt = rows.repartition(key).sortWithinPartitions(key, "__at", order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return dealt.mapInPandas(run, f"{schema}, admitted boolean")


def admit_stream(requests: DataFrame, key: str, ts: str, limit: int, seconds: int, lateness: str = "1 minute") -> DataFrame:
    """The same on a stream: (client, at, admitted), at in microseconds.

    State per client is the admitted times of one window, and goes when the watermark has
    passed it. A micro-batch is decided in the order of time, whatever the order within
    it; a request that comes in a later one than its successors is decided after them,
    and one later than lateness is dropped.
    """
    width = seconds * 1_000_000

    def run(client: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = deque(state.get[0] if state.exists else [])
        times = sorted(at for batch in batches for at in batch["__at"])
        out = []
        for at in times:
            while taken and taken[0] <= at - width:
                taken.popleft()
            out.append(len(taken) < limit)
            if out[-1]:
                taken.append(at)
        yield pd.DataFrame({"client": [str(client[0])] * len(times), "at": times, "admitted": out})
        state.update((sorted(map(int, taken)),))
        last = int(max([*taken, *times[-1:]]))
        state.setTimeoutTimestamp(max((last + width) // 1000, state.getCurrentWatermarkMs()) + 1)

    at = F.col(ts).cast("timestamp")
    rows = requests.withColumn("__ts", at).withWatermark("__ts", lateness).select(key, "__ts", F.unix_micros("__ts").alias("__at"))
    return rows.groupBy(key).applyInPandasWithState(run, "client string, at long, admitted boolean", "taken array<long>", "append", GroupStateTimeout.EventTimeTimeout)

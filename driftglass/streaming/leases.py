"""Leases in event time: something is held by a member from its first word until it has been silent for too long.

Claims about who holds a document and beacons that say which nodes are near are both of this kind. Keys are dealt to shelves. The state
of a shelf says of its keys' members when they were last heard and until when that lasts; a timer stands at the first end. So a lease
ends when the watermark passes its end, though no row of the key comes any more, and nothing is kept of what has ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftglass.session import beside

#: How long a node counts as near after a beacon of its own, and after one that others passed on.
DIRECT_S, DISTANT_S, WEB_S = 13, 45, 12
#: The end of a lease that has none: the last millisecond that a timestamp can be.
NEVER = 253_402_300_799_999

EVENTS = "key long, member long, event string, at timestamp"


#: State rows that keys are dealt to: a call for each key costs more than what it has to do.
SHELVES = 1024


def told(held: np.ndarray, new: np.ndarray, now: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(held, starts, ends) after new words. held: columns key, member, at, until; new: key, member, at, lease in ms (negative: it has no
    end); starts and ends: key, member, at. What ends before `now` is over."""
    until = np.where(new[:, 3] < 0, NEVER, new[:, 2] + new[:, 3])
    rows = np.column_stack([np.concatenate([held, np.column_stack([new[:, :3], until])]), np.concatenate([np.full(len(held), -1), np.arange(len(new))])])
    lease = np.concatenate([np.zeros(len(held), np.int64), new[:, 3]])
    rows = rows[np.lexsort((lease, rows[:, 2], rows[:, 4] >= 0, rows[:, 1], rows[:, 0]))]  # of a member first what it holds, then its words by time
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    head = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))] if len(rows) else rows
    late = (head[:, 4] < 0) & (rows[:, 4] >= 0) & (rows[:, 2] <= head[:, 2])
    late[1:] |= ~first[1:] & (rows[1:, 4] >= 0) & (rows[1:, 2] == rows[:-1, 2])  # of words of one time the first counts
    rows, first = rows[~late], first[~late]  # a member's first row is never late
    last = np.ones(len(rows), bool)
    last[:-1] = first[1:]
    lapsed = np.zeros(len(rows), bool)
    lapsed[1:] = ~first[1:] & (rows[1:, 2] > rows[:-1, 3])
    starts = rows[(first & (rows[:, 4] >= 0)) | lapsed][:, :3]
    over = last & (rows[:, 3] < now)
    over[:-1] |= lapsed[1:]
    return rows[last & ~over][:, :4], starts, rows[over][:, [0, 1, 3]]


class Leases(StatefulProcessor):
    """Turns rows (shelf, key, member, lease_ms, ts) into events (key, member, event, at): `start` when a member is heard that held
    nothing, `end` when its last word was longer than lease_ms ago (null: never). A word that is no newer than the member's last one is
    late and changes nothing. Rows that stand in one batch count in the order of their times, whatever order they come in. The state of
    a shelf is what its keys' members hold, four numbers each, as bytes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")

    def _step(self, new: np.ndarray, now: int, gone: bool = False) -> Iterator[pd.DataFrame]:
        """One timer a shelf, a millisecond beyond the first end. Which one stands follows from the ends before, unless it has gone off."""
        value = self.held.get()
        before = np.frombuffer(value[0], np.int64).reshape(-1, 4) if value else np.empty((0, 4), np.int64)
        held, starts, ends = told(before, new, now)
        if len(held):
            self.held.update((held.tobytes(),))
        elif len(before):
            self.held.clear()
        old, first = before[:, 3].min(initial=NEVER), held[:, 3].min(initial=NEVER)
        if gone or old != first:
            if old < NEVER and not gone:
                self.handle.deleteTimer(int(old) + 1)
            if first < NEVER:
                self.handle.registerTimer(int(first) + 1)
        if len(starts) + len(ends):
            rows = np.concatenate([starts, ends])
            yield pd.DataFrame({"key": rows[:, 0], "member": rows[:, 1], "event": ["start"] * len(starts) + ["end"] * len(ends), "at": pd.to_datetime(rows[:, 2], unit="ms")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        columns = new.key, new.member, new.ts.astype("datetime64[ms]").astype("int64"), new.lease_ms.fillna(-1)
        yield from self._step(np.column_stack([c.to_numpy(np.int64) for c in columns]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._step(np.empty((0, 4), np.int64), timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside spark whose streams keep timers and maps: these need the state store that spills to disk."""
    return beside(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def leases(rows: DataFrame, key: str, member: str, lease_ms: Column, late: str) -> DataFrame:
    """Events (key, member, event, at) of a stream of rows (key, member, ts) of a stateful_session(), each of which lasts for lease_ms.
    Rows that come more than `late` behind the newest are dropped; rows without key, member or time too."""
    rows = rows.where(F.col(key).isNotNull() & F.col(member).isNotNull() & F.col("ts").isNotNull())
    rows = rows.select(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(SHELVES)).alias("shelf"), F.col(key).cast("long").alias("key"), F.col(member).cast("long").alias("member"), lease_ms.cast("long").alias("lease_ms"), "ts")
    return rows.withWatermark("ts", late).groupBy("shelf").transformWithStateInPandas(Leases(), EVENTS, "Append", "EventTime")


def expiring_claims(claims: DataFrame, ttl_s: int, self_id: int | None = None, doc: str = "doc_id", node: str = "node_id", late: str = "1 minute") -> DataFrame:
    """Events (key, member, event, at) of claims (doc, node, ts) that a node holds a document: a claim is good for ttl_s seconds after it
    was last made; what a node knows of itself doesn't expire."""
    lease = F.lit(1000 * ttl_s) if self_id is None else F.when(F.col(node) != self_id, F.lit(1000 * ttl_s))
    return leases(claims, doc, node, lease, late)


def liveness(beacons: DataFrame, direct_s: int = DIRECT_S, distant_s: int = DISTANT_S, node: str = "node_id", hops: str = "hops", late: str = "1 minute") -> DataFrame:
    """Events (key, member, event, at) of beacons (node, hops, ts): key and member are the node, which is near (`start`) until it is not
    heard for direct_s seconds after a beacon of its own, or distant_s after one that was passed on (`end`); unknown hops are direct."""
    return leases(beacons, node, node, F.when(F.coalesce(F.col(hops), F.lit(1)) <= 1, 1000 * direct_s).otherwise(1000 * distant_s), late)


def holders_at(events: DataFrame) -> DataFrame:
    """(key, member, at): who holds what after the events so far, and since when. Of a member's events of one time the end is first."""
    last = events.groupBy("key", "member").agg(F.max(F.struct("at", "event")).alias("e"))
    return last.where("e.event = 'start'").select("key", "member", "e.at")

"""Sessions and job leases as state of a stream: what begins ends after a fixed time, whatever is seen meanwhile.

Both are one rule for each key: the first event (of a lease: the first claim) opens an interval of a fixed length; events inside it are counted and do not
prolong it; the first one at or after its end opens the next. An event-time timer forgets an interval once the watermark has
passed its end, so that state is one interval for each key that is active now. A lease ends early when its job is finished, and
one that nobody finishes in time is told as expired, by the timer or by the next claim, so that its job can be queued again."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, opened long, ends long, n long"


class Intervals(StatefulProcessor):
    """Rows (key, at: microseconds); emits the intervals that a batch has changed. Events of a batch are taken in order of time;
    one that comes after its interval was closed opens its own."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "opened long, n long")

    def _timer(self, opened: int) -> int:
        """The first whole millisecond behind the interval."""
        return -(-(opened + self.length) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.open.get() if self.open.exists() else None
        before, n = (held[0], held[1]) if held else (None, 0)
        opened, changed = before, {}
        for at in sorted(r.at for r in rows):
            if opened is None or at >= opened + self.length:
                opened, n = at, 0
            n += 1
            changed[opened] = n
        if opened != before:  # a call to the store each: the last interval's timer alone, whatever opened and ended before it
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(opened))
        self.open.update((opened, n))
        for start, count in changed.items():
            yield Row(key=key[0], opened=start, ends=start + self.length, n=count)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def intervals(events: DataFrame, key: str, time: str, length: str, late: str = "0 seconds") -> DataFrame:
    """(key, opened, ends, n) of each interval of a stream, again whenever its count grows: the last row of a (key, opened)
    holds. length and late are spans of time such as '12 hours'. An event without key or time opens nothing. Start it inside
    state_store()."""
    span = _microseconds(events.sparkSession, length)
    seen = F.col(time).cast("timestamp")
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), seen.alias("seen"), F.unix_micros(seen).alias("at"))
    found = rows.withWatermark("seen", late).groupBy("key").transformWithState(Intervals(span), OUT, "Update", "EventTime")
    return found.select("key", F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("ends").alias("ends"), "n")


HELD = "key string, opened long, ends long, state string, refused long"


class Leases(StatefulProcessor):
    """Rows (key, at: microseconds, claim); emits the leases that a batch has changed. Events of a batch are taken in order of time,
    a finish before a claim of the same time; a claim while the lease is held is refused, and counted."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "opened long, refused long")

    def _timer(self, opened: int) -> int:
        return -(-(opened + self.length) // 1000)

    def _row(self, key: tuple, opened: int, state: str, refused: int) -> Row:
        return Row(key=key[0], opened=opened, ends=opened + self.length, state=state, refused=refused)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.lease.get() if self.lease.exists() else None
        before = held = (held[0], held[1]) if held else None
        changed: dict[int, Row] = {}
        for at, claim in sorted((r.at, r.claim) for r in rows):
            if held and at >= held[0] + self.length:
                changed[held[0]] = self._row(key, held[0], "expired", held[1])
                held = None
            if held and claim:
                held = (held[0], held[1] + 1)
            elif held and at > held[0]:
                changed[held[0]] = self._row(key, held[0], "done", held[1])
                held = None
            elif claim:
                held = (at, 0)
            if held:
                changed[held[0]] = self._row(key, held[0], "held", held[1])
        if before and (not held or held[0] != before[0]):
            self.handle.deleteTimer(self._timer(before[0]))
        if held and (not before or held[0] != before[0]):
            self.handle.registerTimer(self._timer(held[0]))
        if held:
            self.lease.update(held)
        else:
            self.lease.clear()
        yield from changed.values()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if self.lease.exists():
            opened, refused = self.lease.get()
            self.lease.clear()
            yield self._row(key, opened, "expired", refused)

    def close(self) -> None:
        pass


def _microseconds(spark: SparkSession, length: str) -> int:
    return spark.sql(f"SELECT unix_micros(timestamp'2000-01-01' + INTERVAL {length}) - unix_micros(timestamp'2000-01-01')").first()[0]


def leases(events: DataFrame, key: str, time: str, claim: Column, length: str, late: str = "0 seconds") -> DataFrame:
    """(key, opened, ends, state held, done or expired, refused) of each lease of a stream, again whenever it changes: the claim that
    opens one holds its key for `length` or until the first later event that is no claim. An event without key, time or kind
    counts for nothing, and so do a finish of what is not held and what comes more than `late` behind the latest time of earlier
    batches. Start it inside state_store()."""
    seen = F.col(time).cast("timestamp")
    kept = events.where(F.col(key).isNotNull() & F.col(time).isNotNull() & claim.isNotNull())
    rows = kept.select(F.col(key).cast("string").alias("key"), seen.alias("seen"), F.unix_micros(seen).alias("at"), claim.alias("claim"))
    found = rows.withWatermark("seen", late).groupBy("key").transformWithState(Leases(_microseconds(events.sparkSession, length)), HELD, "Update", "EventTime")
    return found.select("key", F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("ends").alias("ends"), "state", "refused")


def last_leases(changes: DataFrame) -> DataFrame:
    """The last row of each lease among all that a stream has emitted: an ended one stays ended."""
    last = F.max(F.struct((F.col("state") != "held").alias("ended"), "refused", "state"))
    return changes.groupBy("key", "opened").agg(F.max("ends").alias("ends"), last.alias("last")).select("key", "opened", "ends", "last.state", "last.refused")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store, for the streams that are started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def last_states(changes: DataFrame) -> DataFrame:
    """The last row of each interval among all that a stream has emitted."""
    return changes.groupBy("key", "opened").agg(F.max("ends").alias("ends"), F.max("n").alias("n"))

"""Alerts as keyed state over a log of conditions: raised, escalated and resolved, the same on a stream as over a table.

A log has a key (a rule, or a rule and its source), a time, whether the condition holds or is over, and a severity. A
condition that holds raises an alert unless one of its key is open and younger than the cooldown; it is over with the
next row that says so, and a resolved alert does not hold back the next. An alert that is still open after a time is
escalated, once, to the next severity. Rows of one time count in a fixed order: ends first, then the severest.

On a stream, rows wait in the state of their key until the watermark has passed them, so rows that come late within the
watermark's delay count in their place. Timers of event time wake the key for its next row and for its escalation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.observability import SEVERITY_ORDER

OUTPUT = "key string, event string, at timestamp, severity string, raised_at timestamp"
_COLUMNS = ["key", "event", "at", "severity", "raised_at"]
#: From the least severe on.
_RISING = [s for s in reversed(SEVERITY_ORDER)]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Policy:
    """Minutes of cooldown by key (and for all other keys), and minutes until an open alert is escalated."""

    cooldown: dict[str, int]
    other_cooldown: int = 60
    escalate_after: int = 240

    def quiet_ms(self, key: str) -> int:
        return 60_000 * self.cooldown.get(key, self.other_cooldown)


def _place(severity: str | None) -> int:
    return _RISING.index(severity) if severity in _RISING else -1


def in_order(row: tuple) -> tuple:
    """The order of rows (at, holds, severity) of a key."""
    return row[0], bool(row[1]), -_place(row[2]), row[2] or ""


class Alert:
    """The last alert of a key: None, or its start, severity, whether it was escalated and whether it is open."""

    def __init__(self, policy: Policy, key: str, held: tuple | None = None):
        self.policy, self.key, self.held = policy, key, held

    def due(self) -> int | None:
        """When the alert is escalated, if nothing happens before."""
        if self.held is None or not self.held[3] or self.held[2]:
            return None
        return self.held[0] + 60_000 * self.policy.escalate_after

    def until(self, now: int) -> Iterator[tuple]:
        """What time alone brings about, up to now."""
        due = self.due()
        if due is not None and due <= now:
            raised, severity, _, is_open = self.held
            severity = _RISING[min(_place(severity) + 1, len(_RISING) - 1)]
            self.held = (raised, severity, True, is_open)
            yield "escalated", due, severity, raised

    def seen(self, at: int, holds: bool, severity: str | None) -> Iterator[tuple]:
        """What a row of the log brings about."""
        yield from self.until(at)
        is_open = self.held is not None and self.held[3]
        if holds and not (is_open and at - self.held[0] <= self.policy.quiet_ms(self.key)):
            self.held = (at, severity, False, True)
            yield "raised", at, severity, at
        elif not holds and is_open:
            raised, last, escalated, _ = self.held
            self.held = (raised, last, escalated, False)
            yield "resolved", at, last, raised


def _rows(found: list[tuple[str, tuple]]) -> pd.DataFrame:
    """Alerts (key, (event, ms, severity, raised ms)) as rows of OUTPUT."""
    text = lambda values: pd.Series(values, dtype=object)
    time = lambda values: pd.to_datetime(pd.Series(values, dtype="int64"), unit="ms")
    return pd.DataFrame({"key": text([k for k, _ in found]), "event": text([e[0] for _, e in found]), "at": time([e[1] for _, e in found]), "severity": text([e[2] for _, e in found]), "raised_at": time([e[3] for _, e in found])}, columns=_COLUMNS)


def _log(df: DataFrame, key: str, at: str, holds: str, severity: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), F.col(holds).alias("holds"), F.col(severity).alias("severity")).filter("key is not null and at is not null and holds is not null")


class AlertProcessor(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, holds boolean, severity string")
        self.last = handle.getValueState("last", "raised long, severity string, escalated boolean, is_open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            own = [(int(m), bool(h), s) for m, h, s in zip(part["ms"], part["holds"], part["severity"])]
            self.waiting.appendList(own)
            for ms in {r[0] for r in own}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed is complete; a timer that is set now would wait for a further batch
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = sorted((tuple(r) for r in self.waiting.get()), key=in_order)
        come = [r for r in rows if r[0] <= now]
        alert = Alert(self.policy, key[0], tuple(self.last.get()) if self.last.exists() else None)
        found = [x for r in come for x in alert.seen(*r)]
        found += alert.until(now)
        if come:
            self.waiting.clear()
            if later := rows[len(come) :]:
                self.waiting.put(later)
        if found:
            self.last.update(alert.held)
            if (due := alert.due()) is not None:
                self.handle.registerTimer(due)
            yield _rows([(key[0], x) for x in found])

    def close(self) -> None:
        pass


def streamed(log: DataFrame, policy: Policy, *, key: str = "key", at: str = "at", holds: str = "holds", severity: str = "severity", late: str = "10 minutes") -> DataFrame:
    """The alerts of a stream: key, event (raised, escalated, resolved), at, severity, raised_at. Sets the state store that timers need."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = _log(log, key, at, holds, severity).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(AlertProcessor(policy), OUTPUT, "Append", "EventTime")


def raised_alerts(log: DataFrame, policy: Policy, until, *, key: str = "key", at: str = "at", holds: str = "holds", severity: str = "severity") -> DataFrame:
    """The alerts of a table, with the escalations that are due until a time (rows after it do not count).

    Rows are dealt by key and walked in order; a task holds the last alert of one key, however long its log is.
    """
    millis = F.unix_millis(F.lit(until).cast("timestamp"))
    place = F.coalesce(*[F.when(F.col("severity") == s, F.lit(-i)) for i, s in enumerate(_RISING)], F.lit(1))
    rows = _log(log, key, at, holds, severity).withColumn("until", millis).filter("ms <= until")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alert, end = None, 0
        for part in parts:
            found: list[tuple[str, tuple]] = []
            for k, ms, h, s, end in zip(part["key"], part["ms"].tolist(), part["holds"].tolist(), part["severity"], part["until"].tolist()):
                if alert is None or alert.key != k:
                    found += [(alert.key, x) for x in alert.until(end)] if alert else []
                    alert = Alert(policy, k)
                found += [(k, x) for x in alert.seen(ms, h, s)]
            yield _rows(found)
        if alert:
            yield _rows([(alert.key, x) for x in alert.until(end)])

    ordered = rows.repartition("key").sortWithinPartitions("key", "ms", "holds", place, "severity")
    return ordered.select("key", "ms", "holds", "severity", "until").mapInPandas(walk, OUTPUT)

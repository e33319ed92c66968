"""Alert life cycle as keyed state: open, merge, resolve."""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftwatch.catalog import RESOLVE_AFTER_SECONDS, SEVERITIES
from driftwatch.streaming.windows import DELAY

# Facts of the newest reading that an alert shows.
FACTS = ["host", "ensemble_score", "severity"]
TIMES = ["created_at", "last_seen_at", "resolved_at"]
# Further facts, which travel as one JSON text and come out as the columns they were.
MORE_FACTS = ["service_name", "detected_by", "triggering_metrics", "escalation_probability", "explanation_text",
              "contributing_features"]
STATE = ("created long, last_seen long, count long, rank int, host string, score double, facts string, opened long")
MERGED = "MERGED"
# Times cross the Python border as microseconds, which no time zone setting can shift.
CHANGES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("last_seen_at", T.LongType()),
    T.StructField("resolved_at", T.LongType()),
    T.StructField("occurrence_count", T.LongType()),
    T.StructField("severity", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("facts", T.StringType()),
])


# What the change log holds without further facts.
CHANGE_LOG = T.StructType([T.StructField(f.name, T.TimestampType() if f.name in TIMES else f.dataType) for f in CHANGES if f.name != "facts"])


class Alert(NamedTuple):
    """Anomalies that belong together; times in microseconds."""

    created: int
    last_seen: int
    count: int
    rank: int
    host: str
    score: float
    facts: str = ""
    # When the alert began as it was first told, which names it; 0 if it has not been told yet.
    opened: int = 0


def intervals(rows: pd.DataFrame, gap: int) -> list[Alert]:
    """The alerts within one batch of rows of a fingerprint, in order of time."""
    at = rows["micros"].to_numpy()
    order = np.argsort(at, kind="stable")
    at = at[order]
    rank = rows["severity"].map(SEVERITIES.index).to_numpy()[order]
    host, score = rows["host"].to_numpy()[order], rows["ensemble_score"].to_numpy()[order]
    facts = rows["facts"].to_numpy()[order] if "facts" in rows else np.full(len(at), "")
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > gap]))
    last = np.append(first[1:], len(at)) - 1
    return [
        Alert(int(at[a]), int(at[b]), int(b - a + 1), int(rank[a:b + 1].max()), host[b], float(score[b]),
              facts[b])
        for a, b in zip(first, last)
    ]


def merged(alerts: list[Alert], gap: int) -> list[Alert]:
    """Join alerts that are at most `gap` apart: facts of the newest, highest severity, all readings counted."""
    out: list[Alert] = []
    for alert in sorted(alerts):
        if out and alert.created - out[-1].last_seen <= gap:
            old = out[-1]
            newest = alert if alert.last_seen >= old.last_seen else old
            out[-1] = Alert(old.created, newest.last_seen, old.count + alert.count, max(old.rank, alert.rank),
                            newest.host, newest.score, newest.facts, old.opened or alert.opened)
        else:
            out.append(alert)
    return out


class AlertLifecycle(StatefulProcessor):
    """The open alerts of a fingerprint.

    Readings may come in any order within the watermark's delay: all alerts stay open until the watermark has passed
    their last reading by more than the gap, and a reading between two of them joins them to one. The joined alert keeps the name of
    the earlier one; the other is told as MERGED.
    """

    def __init__(self, gap_seconds: float):
        self.gap = int(gap_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alerts = handle.getListState("alerts", STATE)

    def _change(self, fingerprint: str, alert: Alert, status: str) -> dict:
        return {
            "id": hashlib.sha256(f"{fingerprint}|{alert.opened}".encode()).hexdigest(),
            "fingerprint": fingerprint, "version": 2 * alert.count + (status != "ACTIVE"), "status": status,
            "created_at": alert.created, "last_seen_at": alert.last_seen,
            "resolved_at": alert.last_seen + self.gap if status == "RESOLVED" else None,
            "occurrence_count": alert.count, "severity": SEVERITIES[alert.rank], "host": alert.host,
            "anomaly_score": alert.score, "facts": alert.facts,
        }

    @staticmethod
    def _table(changes: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(changes, columns=CHANGES.names).astype({"resolved_at": "Int64"})

    def _due(self, alert: Alert) -> int:
        return (alert.last_seen + self.gap) // 1000 + 1

    def _keep(self, alerts: list[Alert]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if alerts:
            self.alerts.put([tuple(a) for a in alerts])
            self.handle.registerTimer(min(map(self._due, alerts)))
        else:
            self.alerts.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Batches of rows are reduced to alerts one after the other, so the rows are never held together.
        known = [Alert(*a) for a in self.alerts.get()]
        alerts = known
        for part in rows:
            alerts = merged(alerts + intervals(part, self.gap), self.gap)
        alerts = [a._replace(opened=a.opened or a.created) for a in alerts]
        names = {a.opened for a in alerts}
        self._keep(alerts)
        changes = [self._change(key[0], a, MERGED) for a in known if a.opened not in names]
        changes += [self._change(key[0], a, "ACTIVE") for a in alerts if a not in known]
        yield self._table(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        alerts = [Alert(*a) for a in self.alerts.get()]
        self._keep([a for a in alerts if self._due(a) > now])
        yield self._table([self._change(key[0], a, "RESOLVED") for a in alerts if self._due(a) <= now])

    def close(self) -> None:
        pass


def alert_changes(candidates: DataFrame, gap_seconds: float = RESOLVE_AFTER_SECONDS, delay: str = DELAY) -> DataFrame:
    """Change log of alerts from a stream of alert candidates (fingerprint, timestamp, host, ensemble_score, severity and any
    of MORE_FACTS).

    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    more = [c for c in MORE_FACTS if c in candidates.columns]
    facts = F.to_json(F.struct(*more)) if more else F.lit("")
    changes = (
        candidates.select("fingerprint", "timestamp", F.unix_micros("timestamp").alias("micros"), *FACTS,
                          facts.alias("facts"))
        .withWatermark("timestamp", delay)
        .groupBy("fingerprint")
        .transformWithStateInPandas(AlertLifecycle(gap_seconds), CHANGES, "append", "EventTime")
    )
    changes = changes.withColumns({c: F.timestamp_micros(c) for c in TIMES})
    if not more:
        return changes.drop("facts")
    read = F.from_json("facts", candidates.select(*more).schema)
    return changes.withColumn("facts", read).select(*(c for c in changes.columns if c != "facts"), "facts.*")

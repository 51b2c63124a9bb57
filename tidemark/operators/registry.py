"""The registry of a system's own events: which there are, in which groups, and which groups are on.

Names are a prefix of the reporting system and a fixed rest; the prefixes are parameters.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, group string, value_type string, units string, payload_keys array<string>"

# Rest of the name, rest of the group, value type, units, payload keys.
ENGINE_EVENTS = [
    ("engine.started", "lifecycle", "int32", "ms_to_ready", ["version", "root_dir", "db_count"]),
    ("engine.shutdown.clean", "lifecycle", "int32", "ms_to_drain", ["db_count"]),
    ("engine.shutdown.dirty", "lifecycle", "none", "", ["detected_at_startup", "prev_wal_bytes"]),
    ("engine.flush.completed", "lifecycle", "int32", "bytes_written", ["dbs_flushed", "ms"]),
    ("internal_events.group.toggled", "lifecycle", "none", "", ["group", "from", "to", "source"]),
    ("db.created", "db", "none", "", ["db", "partition_mode", "retention_action"]),
    ("db.deleted", "db", "none", "", ["db"]),
    ("db.opened", "db", "int32", "ms_to_open", ["db", "metric_count", "event_count", "partition_count"]),
    ("partition.sealed", "partition", "int32", "record_count", ["db", "file", "partition_key", "bytes"]),
    ("partition.deleted", "partition", "int32", "bytes_freed", ["db", "partition_key", "files_removed", "retention_reason"]),
    ("partition.archived", "partition", "int32", "bytes", ["db", "partition_key", "tar_path"]),
    ("partition.optimized", "partition", "int32", "bytes_saved", ["db", "partition_key", "file", "source_bytes", "dest_bytes"]),
    ("partition.flush.slow", "partition.slow", "float32", "ms", ["db", "file", "partition_key"]),
    ("wal.replayed", "wal", "int32", "records_replayed", ["db", "file", "bytes_scanned"]),
    ("wal.tail_truncated", "wal", "int32", "bytes", ["db", "file", "reason"]),
    ("wal.segment.rotated", "wal", "int32", "segment_size_bytes", ["db", "file"]),
    ("wal.reset", "wal", "int32", "bytes_reclaimed", ["db", "file"]),
    ("wal.fsync.slow", "wal.fsync", "float32", "ms", ["db", "file"]),
    ("wal.fsync.error", "wal.fsync", "none", "", ["db", "file", "err"]),
    ("catalog.metric.added", "catalog", "int32", "metric_id", ["db", "name", "value_type"]),
    ("catalog.event.added", "catalog", "int32", "event_id", ["db", "name", "value_type"]),
    ("catalog.full", "catalog", "int32", "cap", ["db", "kind"]),
    ("catalog.write.failed", "catalog", "none", "", ["db", "file", "err"]),
    ("ingest.rejected.stale", "ingest.reject", "int32", "count_this_window", ["db", "top_offenders"]),
    ("ingest.rejected.payload_too_large", "ingest.reject", "int32", "bytes", ["db", "name"]),
    ("ingest.spike.force_flush", "ingest.spike", "int32", "page_bytes", ["db", "layer"]),
    ("disk.low", "disk", "int32", "bytes_free", ["mount", "threshold_bytes"]),
    ("disk.write.error", "disk", "none", "", ["file", "err"]),
    ("rollup.window.emitted", "rollup", "int32", "records_written", ["src_metric", "dst_metric", "window"]),
    ("rollup.catchup.started", "rollup", "int32", "windows_pending", ["src_metric", "dst_metric"]),
    ("rollup.catchup.completed", "rollup", "int32", "windows_caught_up", ["src_metric", "dst_metric", "ms"]),
    ("http.listener.started", "http", "none", "", ["addr"]),
    ("http.listener.stopped", "http", "none", "", ["addr", "reason"]),
    ("mqtt.connected", "mqtt", "none", "", ["broker"]),
    ("mqtt.disconnected", "mqtt", "none", "", ["broker", "reason"]),
    ("mqtt.subscription.dropped", "mqtt", "int32", "count", ["broker", "topic"]),
    ("auth.failure", "auth", "int32", "count_this_window", ["addr", "route", "top_users"]),
    ("retention.sweep.started", "retention", "int32", "candidate_partitions", []),
    ("retention.sweep.completed", "retention", "int32", "partitions_actioned", ["deleted", "archived", "kept", "ms"]),
]
COLLECTOR_EVENTS = [
    ("started", "lifecycle", "int32", "collector_count", ["version", "target_db", "target_url"]),
    ("stopped.clean", "lifecycle", "int32", "ms_to_drain", []),
    ("config.reloaded", "lifecycle", "none", "", []),
    ("target.disconnected", "target", "none", "", ["url", "err"]),
    ("target.reconnected", "target", "int32", "outage_ms", ["url"]),
    ("buffer.flush.failed", "buffer", "int32", "queued_samples", ["err"]),
    ("buffer.high_water", "buffer", "int32", "queued_samples", ["capacity"]),
    ("buffer.dropped", "buffer", "int32", "count_this_window", []),
    ("collector.started", "collector", "none", "", ["name", "interval_seconds"]),
    ("collector.failed", "collector", "int32", "consecutive_failures", ["name", "err"]),
    ("collector.recovered", "collector", "int32", "outage_ms", ["name"]),
    ("host.boot", "host", "none", "", ["kernel", "uptime_seconds"]),
    ("host.disk.low", "host", "int32", "bytes_free", ["mount"]),
    ("host.temp.crossed", "host", "float32", "celsius", ["sensor", "threshold_celsius"]),
    ("threshold.disk.sd_write_probe.slow", "threshold", "float32", "ms", ["collector", "metric", "threshold", "observed"]),
]
#: Groups that are off unless switched on, by the rest of their names.
OFF_ENGINE, OFF_COLLECTOR = ("wal", "wal.fsync", "ingest.reject"), ("host",)


def rows(engine: str = "engine", collector: str = "collector") -> list[tuple]:
    return [(f"{prefix}.{name}", f"{prefix}.{group}", *rest) for prefix, table in ((engine, ENGINE_EVENTS), (collector, COLLECTOR_EVENTS)) for name, group, *rest in table]


def registry(spark: SparkSession, engine: str = "engine", collector: str = "collector") -> DataFrame:
    return spark.createDataFrame(rows(engine, collector), SCHEMA)


def groups(engine: str = "engine", collector: str = "collector", toggles: dict[str, bool] | None = None) -> dict[str, bool]:
    """Each group and whether it is on; a toggle of an unknown group is an error."""
    off = {f"{engine}.{g}" for g in OFF_ENGINE} | {f"{collector}.{g}" for g in OFF_COLLECTOR}
    out = {r[1]: r[1] not in off for r in rows(engine, collector)}
    for g, on in (toggles or {}).items():
        if g not in out:
            raise ValueError(f"unknown group {g!r}")
        out[g] = on
    return out


def of_group(events: DataFrame, registry_: DataFrame, group: str, limit: int = 100) -> DataFrame:
    """The newest events whose name is in the group."""
    from .events import newest

    if registry_.where(F.col("group") == group).isEmpty():
        raise ValueError(f"unknown group {group!r}")
    wanted = registry_.where(F.col("group") == group).select("name")  # part of a registry of 54 rows
    return newest(events.join(F.broadcast(wanted), "name", "left_semi"), limit)


def emitted(events: DataFrame, registry_: DataFrame, state: dict[str, bool], own_db: str = "internal") -> DataFrame:
    """Events of groups that are on, except those about the database they would be written to."""
    on = [g for g, s in state.items() if s]
    known = registry_.where(F.col("group").isin(on)).select("name")
    return events.join(F.broadcast(known), "name", "left_semi").where(F.col("source_db").isNull() | (F.col("source_db") != own_db))


class Emitter:
    """Events of a system about itself: those of groups that are on wait in a queue of bounded length for flush; what finds it full is dropped and counted."""

    def __init__(self, most: int = 1024, own_db: str = "internal", toggles: dict[str, bool] | None = None, engine: str = "engine", collector: str = "collector"):
        self.most, self.own_db, self.dropped = most, own_db, 0
        self.on = groups(engine, collector, toggles)
        self.known = {r[0]: r for r in rows(engine, collector)}
        self.waiting: list[tuple] = []

    def toggle(self, group: str, on: bool) -> None:
        if group not in self.on:
            raise ValueError(f"unknown group {group!r}")
        self.on[group] = on

    def emit(self, name: str, ts_ns: int, value: float | None = None, payload: dict | None = None, source_db: str = "") -> bool:
        """Whether the event is queued. An event about the database that it would be written to is never queued, as it would cause the next one."""
        if name not in self.known:
            raise ValueError(f"unknown event {name!r}")
        if not self.on[self.known[name][1]] or source_db == self.own_db:
            return False
        if len(self.waiting) >= self.most:
            self.dropped += 1
            return False
        self.waiting.append((name, ts_ns, value, payload))
        return True

    def bodies(self) -> list[str]:
        """What waits, as JSON events; nothing waits after it. A value's spelling follows the event's type."""
        out = []
        for name, ts_ns, value, payload in self.waiting:
            kind = self.known[name][2]
            typed = None if value is None or kind == "none" else int(value) if kind == "int32" else float(value)
            out.append(json.dumps({"db": self.own_db, "name": name, "ts": ts_ns, "value": typed, "payload": payload}))
        self.waiting = []
        return out

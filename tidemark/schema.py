"""Canonical schemas. ts_ns is the truth; timestamps in microseconds are made for display only."""

SAMPLES = "db string, metric string, ts_ns bigint, value_type string, int32_value int, float32_value float, value float, seq bigint, partition_key string"
EVENTS = "db string, name string, event_id int, ts_ns bigint, value_type string, int32_value int, float32_value float, payload binary, seq bigint, partition_key string"
CATALOG = "db string, name string, id int, value_type string, last_ts_ns bigint"
CHECKPOINTS = "db string, job_id string, completed_ts_ns bigint, seq bigint"
MAX_METRICS, MAX_EVENTS = 65_535, 1_023
MAX_PAYLOAD = 4_096

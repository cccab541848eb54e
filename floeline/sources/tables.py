"""Schemas of the state tables. Times and durations are unix nanoseconds in LONG columns; 0 means unset."""

from __future__ import annotations

# Fixed values of the state's format.
SCHEMAS = {
    "runs": "id string, workflow string, kind string, status string, queue string, priority long, input string, output string, error string, attempts long, max_attempts long, run_at long, created_at long, started_at long, completed_at long, concurrency_key string, parent_id string, parent_step string, trace_parent string, unique_key string, paused_at long, dead_lettered_at long, sequence_key string, seq long, ephemeral long, groups_json string",
    "steps": "id string, run_id string, name string, task string, ord long, status string, depends_on array<string>, queue string, priority long, input string, output string, error string, attempts long, max_attempts long, timeout_ns long, run_at long, created_at long, started_at long, completed_at long, concurrency_key string, key_limit long, claimed_at long, resume_at long, wait_kind string, wait_event string, labels array<string>, worker_id string, lease_expires_at long, sequence_key string, seq long",
    "step_keys": "step_id string, name string, value string, key_limit long",
    "step_journal": "step_id string, idx long, kind string, wkey string, event string, wake_at long, deadline long, registered long, payload string, result string, err string, done boolean, timed_out boolean",
    "events": "seq long, name string, payload string, created_at long",
    "subscriptions": "event string, task string, created_at long",
    "crons": "name string, spec string, task string, input string, next_at long, created_at long",
    "logs": "seq long, run_id string, step string, at long, level string, message string",
    "queue_pauses": "queue string, paused_at long",
    "counters": "name string, next long",
}
KEYS = {
    "runs": ["id"], "steps": ["id"], "step_keys": ["step_id", "name"], "step_journal": ["step_id", "idx"], "events": ["seq"],
    "subscriptions": ["event", "task"], "crons": ["name"], "logs": ["seq"], "queue_pauses": ["queue"], "counters": ["name"],
}
TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED", "INTERRUPTED")
ACTIVE = ("QUEUED", "RUNNING", "BLOCKED", "SUSPENDED")

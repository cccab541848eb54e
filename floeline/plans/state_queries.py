"""SQL wording of the state queries and transitions: the oracles of ``floeline.catalog``, and its queries where no operator is named."""

from __future__ import annotations

from floeline.sources.state import NOW

DUE = f"((s.status = 'QUEUED' AND s.run_at <= {NOW}) OR (s.status = 'SUSPENDED' AND s.resume_at > 0 AND s.resume_at <= {NOW}))"
TERMINAL = "('SUCCEEDED','FAILED','CANCELLED','INTERRUPTED')"
RANK = "CASE status WHEN 'FAILED' THEN 5 WHEN 'CANCELLED' THEN 4 WHEN 'INTERRUPTED' THEN 3 WHEN 'SUCCEEDED' THEN 1 ELSE 2 END"
UNRANK = "CASE MAX(rank) WHEN 5 THEN 'FAILED' WHEN 4 THEN 'CANCELLED' WHEN 3 THEN 'INTERRUPTED' WHEN 2 THEN 'RUNNING' ELSE 'SUCCEEDED' END"
#: Gates decorrelated to aggregates and joins; the label gate is for a worker with {gpu}.
CANDIDATES = f"""
SELECT s.id, s.queue, s.status, s.priority, s.run_at, s.ord, s.concurrency_key, s.key_limit, COALESCE(k.running, 0) AS running,
 CAST(ROW_NUMBER() OVER (PARTITION BY s.queue ORDER BY s.priority DESC, s.run_at, s.ord, s.id) AS BIGINT) AS rn
FROM {{steps}} s
 LEFT JOIN (SELECT concurrency_key, COUNT(*) AS running FROM {{steps}} WHERE status = 'RUNNING' AND concurrency_key <> '' GROUP BY concurrency_key) k ON k.concurrency_key = s.concurrency_key
 LEFT JOIN (SELECT sequence_key, MIN(seq) AS head FROM {{steps}} WHERE sequence_key <> '' AND status IN ('QUEUED','RUNNING','BLOCKED','SUSPENDED') GROUP BY sequence_key) q ON q.sequence_key = s.sequence_key
 LEFT ANTI JOIN {{queue_pauses}} p ON p.queue = s.queue
 LEFT ANTI JOIN (SELECT id FROM {{runs}} WHERE status = 'PAUSED') r ON r.id = s.run_id
 LEFT ANTI JOIN (SELECT k.step_id FROM {{step_keys}} k JOIN (SELECT k.name, k.value, COUNT(*) AS n FROM {{step_keys}} k JOIN {{steps}} x ON x.id = k.step_id WHERE x.status = 'RUNNING' GROUP BY k.name, k.value) n
   ON n.name = k.name AND n.value = k.value WHERE k.key_limit > 0 AND n.n >= k.key_limit) g ON g.step_id = s.id
WHERE {DUE} AND (s.concurrency_key = '' OR s.key_limit <= 0 OR COALESCE(k.running, 0) < s.key_limit)
 AND (s.sequence_key = '' OR s.seq <= COALESCE(q.head, s.seq)) AND s.labels IN ('', 'gpu')
"""
SLOTS = 200
#: When the event of ``deliver_event`` comes.
EVENT_AT = 1704067200000000000 + 10 * 86400000000000
CLAIM = f"SELECT * FROM ({CANDIDATES}) c WHERE rn <= {SLOTS}"
DEPS = "SELECT s.run_id, s.id, s.name, TRIM(d.dep) AS dep FROM (SELECT run_id, id, name, status, depends_on FROM {steps} WHERE depends_on <> '') s"

QUERIES: dict[str, str] = {
    # aggregations
    "runs_by_status": "SELECT status, COUNT(*) AS n FROM {runs} GROUP BY status",
    "queue_depth": "SELECT queue, SUM(CASE WHEN status='QUEUED' THEN 1 ELSE 0 END)::BIGINT AS queued, SUM(CASE WHEN status='RUNNING' THEN 1 ELSE 0 END)::BIGINT AS running, SUM(CASE WHEN status='SUSPENDED' THEN 1 ELSE 0 END)::BIGINT AS suspended, SUM(CASE WHEN status='BLOCKED' THEN 1 ELSE 0 END)::BIGINT AS blocked FROM {steps} WHERE status IN ('QUEUED','RUNNING','SUSPENDED','BLOCKED') GROUP BY queue",
    "steps_per_run": "SELECT run_id, COUNT(*) AS n FROM {steps} GROUP BY run_id",
    "running_per_key": "SELECT concurrency_key, COUNT(*) AS n FROM {steps} WHERE status='RUNNING' AND concurrency_key <> '' GROUP BY concurrency_key",
    "rate_remaining": f"SELECT q.queue, GREATEST(CAST(0 AS BIGINT), 2400 - COALESCE(w.n, 0)) AS remaining FROM (SELECT DISTINCT queue FROM {{steps}}) q LEFT JOIN (SELECT queue, COUNT(*) AS n FROM {{steps}} WHERE claimed_at >= {NOW} - 2592000000000000 GROUP BY queue) w ON w.queue = q.queue",
    "next_due": f"SELECT COALESCE(MIN(t), 0) AS due FROM (SELECT run_at AS t FROM {{steps}} WHERE status='QUEUED' UNION ALL SELECT resume_at FROM {{steps}} WHERE status='SUSPENDED' AND resume_at > 0) x",
    "run_outcome": "SELECT run_id, CASE WHEN SUM(CASE WHEN status='FAILED' THEN 1 ELSE 0 END) > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS outcome, MAX(ord) AS last_ord, MAX(CASE WHEN back = 1 THEN qty END) AS output, MAX(CASE WHEN bad = 1 THEN error END) AS error FROM (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY ord DESC) AS back, CASE WHEN status='FAILED' THEN ROW_NUMBER() OVER (PARTITION BY run_id, status ORDER BY ord) END AS bad FROM {steps} s) s GROUP BY run_id HAVING SUM(CASE WHEN status IN ('QUEUED','RUNNING','BLOCKED','SUSPENDED') THEN 1 ELSE 0 END) = 0",
    "group_status": f"SELECT run_id, {UNRANK} AS status FROM (SELECT run_id, {RANK} AS rank FROM {{steps}}) x GROUP BY run_id",
    "known_queues": "SELECT DISTINCT queue FROM {steps}",
    # lookups, filters, pages
    "get_run": "SELECT id, workflow, kind, status, queue, priority, created_at FROM {runs} WHERE id = 'r42'",
    "get_steps": "SELECT id, name, ord, status, depends_on FROM {steps} WHERE run_id = 'r42' ORDER BY ord LIMIT 10000",
    "dep_outputs": "SELECT run_id, name, qty AS output FROM {steps} WHERE status = 'SUCCEEDED' AND name IN ('s0','s1')",
    "list_runs_page": "SELECT id, workflow, status, created_at FROM {runs} WHERE status='RUNNING' AND workflow='wf_3' ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 20",
    "dead_letters": "SELECT id, workflow, dead_lettered_at FROM {runs} WHERE dead_lettered_at > 0 ORDER BY dead_lettered_at DESC, id DESC LIMIT 100",
    "run_children": "SELECT parent_id, id, created_at, CAST(ROW_NUMBER() OVER (PARTITION BY parent_id ORDER BY created_at, id) AS BIGINT) AS pos FROM {runs} WHERE parent_id <> ''",
    "event_page": "SELECT seq, name, payload FROM {emitted} ORDER BY seq DESC LIMIT 100",
    "log_tail": "SELECT seq, run_id, level, message FROM (SELECT * FROM {logs} ORDER BY seq DESC LIMIT 500) x ORDER BY seq",
    "orphan_logs": "SELECT l.seq, l.run_id FROM {logs} l LEFT ANTI JOIN {runs} r ON r.id = l.run_id",
    # scheduling
    "claim_candidates": CLAIM,
    "claim_admitted": f"SELECT id, queue, rn FROM (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY queue, concurrency_key ORDER BY rn) AS k FROM ({CLAIM}) c) x WHERE concurrency_key = '' OR key_limit <= 0 OR running + k <= key_limit",
    "label_routing": "SELECT labels, status, COUNT(*) AS n FROM {steps} WHERE labels IN ('', 'gpu') GROUP BY labels, status UNION ALL SELECT labels || ' on both', status, COUNT(*) AS n FROM {steps} WHERE labels IN ('', 'gpu', 'gpu,linux') GROUP BY labels, status",
    "sequence_heads": "SELECT sequence_key, MIN(seq) AS head, COUNT(*) AS waiting FROM {steps} WHERE sequence_key <> '' AND status IN ('QUEUED','RUNNING','BLOCKED','SUSPENDED') GROUP BY sequence_key",
    "sliding_window_violations": "SELECT id, queue, n FROM (SELECT id, queue, CAST(COUNT(*) OVER (PARTITION BY queue ORDER BY claimed_at RANGE BETWEEN 86400000000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM {steps} WHERE claimed_at > 0) x WHERE n > 5",
    "seq_allocation": "SELECT id, 1000 + CAST(ROW_NUMBER() OVER (ORDER BY created_at, id) AS BIGINT) AS allotted FROM {runs} WHERE status = 'QUEUED' AND custkey % 5 = 0",
    "unique_resolution": f"SELECT id, workflow, ukey, CASE WHEN k = 1 THEN 'INSERT' ELSE 'REUSE' END AS action, owner FROM (SELECT id, workflow, custkey AS ukey, ROW_NUMBER() OVER (PARTITION BY workflow, custkey ORDER BY created_at, id) AS k, FIRST_VALUE(id) OVER (PARTITION BY workflow, custkey ORDER BY created_at, id) AS owner FROM {{runs}} WHERE status NOT IN {TERMINAL}) x",
    # transitions
    "ready_steps": "SELECT b.id FROM (SELECT s.id, s.run_id, x.dep FROM {steps} s <unnest>) b LEFT JOIN {steps} d ON d.run_id = b.run_id AND d.name = b.dep GROUP BY b.id HAVING MIN(CASE WHEN COALESCE(d.status, '') = 'SUCCEEDED' THEN 1 ELSE 0 END) = 1",
    "final_fail_cancels": "SELECT s.id, CASE WHEN s.status = 'RUNNING' AND s.attempts >= s.max_attempts THEN 'FAILED' ELSE 'CANCELLED' END AS status FROM {steps} s WHERE s.status IN ('QUEUED','RUNNING','BLOCKED','SUSPENDED') AND s.run_id IN (SELECT run_id FROM {steps} WHERE status = 'RUNNING' AND attempts >= max_attempts)",
    "cancel_run": f"SELECT s.id, CASE WHEN s.status='RUNNING' THEN 'SIGNAL' ELSE 'CANCELLED' END AS action FROM {{steps}} s JOIN {{runs}} r ON r.id = s.run_id WHERE r.status NOT IN {TERMINAL} AND r.workflow = 'wf_4' AND s.status IN ('QUEUED','BLOCKED','SUSPENDED','RUNNING')",
    "pause_runs": f"SELECT r.id, COUNT(CASE WHEN s.status='RUNNING' THEN 1 END) AS requeued FROM {{runs}} r LEFT JOIN {{steps}} s ON s.run_id = r.id WHERE r.status NOT IN {TERMINAL} AND r.status <> 'PAUSED' AND r.workflow='wf_5' GROUP BY r.id",
    "resume_runs": f"SELECT s.id, CAST({NOW} AS BIGINT) AS run_at FROM {{steps}} s JOIN {{runs}} r ON r.id = s.run_id WHERE r.status='PAUSED' AND s.status='QUEUED'",
    "snooze_runs": f"SELECT r.id FROM {{runs}} r LEFT ANTI JOIN (SELECT run_id FROM {{steps}} WHERE status='RUNNING') s ON s.run_id = r.id WHERE r.status NOT IN {TERMINAL}",
    "park_steps": f"SELECT id, GREATEST(CAST(0 AS BIGINT), attempts - 1) AS attempts, CAST(0 AS BIGINT) AS claimed_at, CAST({NOW} + 5000000000 AS BIGINT) AS run_at, 'QUEUED' AS status FROM {{steps}} WHERE status='RUNNING'",
    "dead_letter_retry": "SELECT s.id, CASE WHEN s.depends_on = '' THEN 'QUEUED' ELSE 'BLOCKED' END AS status, CAST(0 AS BIGINT) AS attempts FROM {steps} s JOIN {runs} r ON r.id = s.run_id WHERE r.status='FAILED' AND r.dead_lettered_at > 0",
    "purge_selection": f"SELECT r.id, r.completed_at FROM {{runs}} r LEFT ANTI JOIN (SELECT run_id FROM {{steps}} WHERE status='RUNNING') s ON s.run_id = r.id WHERE r.status IN {TERMINAL} AND r.completed_at > 0 AND r.completed_at < {NOW}",
    "purge_counts": f"SELECT COUNT(*) AS steps, COUNT(DISTINCT s.run_id) AS runs FROM {{steps}} s JOIN (SELECT id FROM {{runs}} WHERE status IN {TERMINAL} AND completed_at > 0 AND completed_at < {NOW}) r ON r.id = s.run_id WHERE s.run_id NOT IN (SELECT run_id FROM {{steps}} WHERE status = 'RUNNING')",
    "expired_leases": f"SELECT s.id, 'QUEUED' AS status, '' AS worker_id, CAST({NOW} AS BIGINT) AS run_at, s.attempts FROM {{steps}} s JOIN {{runs}} r ON r.id = s.run_id WHERE s.status='RUNNING' AND s.lease_expires_at > 0 AND s.lease_expires_at < {NOW} AND r.status NOT IN {TERMINAL}",
    "lease_heartbeat": f"SELECT id, CAST({NOW} + 30000000000 AS BIGINT) AS lease_expires_at FROM {{steps}} WHERE status='RUNNING' AND worker_id='w1'",
    "interrupt_sweep": "SELECT r.id, 'INTERRUPTED' AS status FROM {runs} r WHERE r.status = 'RUNNING' AND r.id IN (SELECT run_id FROM {steps} WHERE status = 'RUNNING' AND worker_id = 'w2') AND r.id NOT IN (SELECT run_id FROM {steps} WHERE status IN ('QUEUED','BLOCKED','SUSPENDED') OR (status = 'RUNNING' AND worker_id <> 'w2'))",
    "recover_requeue": "SELECT s.id, 'QUEUED' AS status FROM {steps} s JOIN {runs} r ON r.id = s.run_id WHERE s.status IN ('RUNNING','INTERRUPTED') AND r.status IN ('RUNNING','INTERRUPTED')",
    "recover_fail": "SELECT id, 'FAILED' AS status FROM {runs} WHERE status IN ('RUNNING','INTERRUPTED')",
    # events and time
    "deliver_event": f"SELECT w.step_id FROM {{waits}} w JOIN {{steps}} s ON s.id = w.step_id JOIN {{runs}} r ON r.id = s.run_id WHERE w.event = 'click' AND w.registered <= {EVENT_AT} AND (w.deadline = 0 OR w.deadline > {EVENT_AT}) AND r.status NOT IN {TERMINAL}",
    "event_bindings": "SELECT s.task, e.seq FROM {emitted} e JOIN {subscriptions} s ON s.event = e.name",
    "wait_resolution": "SELECT w.step_id, MIN(e.created_at) AS delivered_at, CASE WHEN MIN(e.created_at) IS NOT NULL THEN 'DELIVERED' WHEN MAX(w.deadline) > 0 THEN 'TIMEOUT' ELSE 'WAITING' END AS outcome FROM {waits} w LEFT JOIN {emitted} e ON e.name = w.event AND e.created_at >= w.registered AND (w.deadline = 0 OR e.created_at < w.deadline) GROUP BY w.step_id",
    "backoff_schedule": "SELECT id, attempts, CAST(CASE attempts WHEN 1 THEN 500000000 WHEN 2 THEN 1000000000 ELSE 2000000000 END AS BIGINT) AS delay FROM {steps} WHERE status='RUNNING'",
    # graphs
    "dag_edges": "SELECT s.run_id, x.dep AS src, s.name AS dst FROM {steps} s <unnest_all>",
    "group_expansion": "SELECT a.run_id, a.name AS step, b.name AS dep FROM {steps} a JOIN {steps} b ON a.run_id = b.run_id AND a.ord >= 2 AND b.ord < 2",
    "run_tree": "WITH RECURSIVE t(id, root, depth) AS (SELECT id, id, 0 FROM {runs} WHERE parent_id = '' UNION ALL SELECT r.id, t.root, t.depth + 1 FROM {runs} r JOIN t ON r.parent_id = t.id WHERE t.depth < 8) SELECT id, root, CAST(depth AS BIGINT) AS depth FROM t",
}
UNNEST = {
    "spark": {"<unnest_all>": "LATERAL VIEW EXPLODE(SPLIT(s.depends_on, ',')) x AS dep WHERE s.depends_on <> ''", "<unnest>": "LATERAL VIEW EXPLODE(SPLIT(s.depends_on, ',')) x AS dep WHERE s.status = 'BLOCKED' AND s.depends_on <> ''"},
    "duck": {"<unnest_all>": ", UNNEST(STRING_SPLIT(s.depends_on, ',')) x(dep) WHERE s.depends_on <> ''", "<unnest>": ", UNNEST(STRING_SPLIT(s.depends_on, ',')) x(dep) WHERE s.status = 'BLOCKED' AND s.depends_on <> ''"},
}
#: Of each customer's live (or queued) runs by age: n of them, places from the oldest (up) and from the newest (down); two may stay.
VICTIMS = {
    "newest": ("status NOT IN " + TERMINAL, "n > 2 AND down = 1"),
    "in_progress": ("status NOT IN " + TERMINAL, "n > 2 AND (CASE WHEN status = 'RUNNING' THEN earlier ELSE busy + earlier END) < n - 2"),
    "except_newest": ("status = 'QUEUED'", "down > 2"),
    "except_oldest": ("status = 'QUEUED'", "up > 2"),
}
for _name, (_of, _hit) in VICTIMS.items():
    QUERIES[f"key_strategy_victims_{_name}"] = f"""SELECT id, custkey FROM (SELECT id, custkey, status, COUNT(*) OVER (PARTITION BY custkey) AS n,
 SUM(CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END) OVER (PARTITION BY custkey) AS busy,
 COUNT(*) OVER (PARTITION BY custkey, CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END ORDER BY seq, created_at, id) - 1 AS earlier,
 ROW_NUMBER() OVER (PARTITION BY custkey ORDER BY seq, created_at, id) AS up, ROW_NUMBER() OVER (PARTITION BY custkey ORDER BY seq DESC, created_at DESC, id DESC) AS down
 FROM {{runs}} WHERE {_of}) x WHERE {_hit}"""


def text_for(name: str, engine: str) -> str:
    text = QUERIES[name]
    for k, v in UNNEST[engine].items():
        text = text.replace(k, v)
    if engine == "duck":
        text = text.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")
    return text

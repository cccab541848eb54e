"""The workflow state tables, derived from the driver tables by one SQL text for both engines.

Times are unix nanoseconds in LONG columns; 0 means unset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The fixed clock of all queries (nanoseconds).
NOW = 900000000000000000

SPARK = {"epoch": "unix_micros", "cast": "::timestamp", "text": "STRING"}
DUCK = {"epoch": "epoch_us", "cast": "", "text": "VARCHAR"}

RUNS = """
SELECT CONCAT('r', CAST(o_orderkey AS <text>)) AS id, CONCAT('wf_', CAST(o_custkey % 10 AS <text>)) AS workflow,
 CASE WHEN o_orderkey % 4 = 0 THEN 'workflow' ELSE 'task' END AS kind,
 CASE WHEN o_orderstatus='F' THEN CASE o_orderkey % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'INTERRUPTED' WHEN 3 THEN 'FAILED' ELSE 'SUCCEEDED' END
      WHEN o_orderstatus='P' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'PAUSED' ELSE 'RUNNING' END ELSE 'QUEUED' END AS status,
 o_orderpriority AS queue, CAST(o_orderkey % 5 AS BIGINT) AS priority, <epoch>(o_orderdate<cast>) * 1000 AS created_at,
 CASE WHEN o_orderstatus='F' THEN <epoch>(o_orderdate<cast>) * 1000 + (o_orderkey % 97 + 1) * 60000000000 ELSE 0 END AS completed_at,
 CASE WHEN o_orderstatus='F' AND o_orderkey % 10 = 3 THEN <epoch>(o_orderdate<cast>) * 1000 + (o_orderkey % 97 + 1) * 60000000000 ELSE 0 END AS dead_lettered_at,
 CASE WHEN o_orderkey % 3 = 0 AND o_orderkey >= 7 THEN CONCAT('r', CAST(CAST((o_orderkey - o_orderkey % 7) / 7 AS BIGINT) AS <text>)) ELSE '' END AS parent_id,
 CASE WHEN o_orderkey % 3 = 0 AND o_orderkey >= 7 THEN CONCAT('s', CAST(o_orderkey % 2 AS <text>)) ELSE '' END AS parent_step,
 o_custkey AS custkey, o_orderkey AS seq FROM {orders}
"""
STEPS = """
SELECT b.*, 1 + qty % 3 AS attempts, CAST(3 AS BIGINT) AS max_attempts,
 CASE WHEN status IN ('RUNNING','SUSPENDED','SUCCEEDED','FAILED') THEN run_at + (sk % 10) * 1000000000 ELSE 0 END AS claimed_at,
 CASE WHEN status = 'SUSPENDED' AND sk % 3 <> 0 THEN run_at + (pk % 7) * 86400000000000 ELSE 0 END AS resume_at,
 CASE WHEN status = 'SUSPENDED' THEN CASE WHEN sk % 3 = 2 THEN 'sleep' ELSE 'wait' END ELSE '' END AS wait_kind,
 CASE WHEN status = 'SUSPENDED' AND sk % 3 <> 2 THEN CASE pk % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END ELSE '' END AS wait_event,
 CASE WHEN status = 'RUNNING' THEN CONCAT('w', CAST(sk % 3 AS <text>)) ELSE '' END AS worker_id,
 CASE WHEN status = 'RUNNING' THEN run_at + (sk % 10) * 1000000000 + 30000000000 ELSE 0 END AS lease_expires_at,
 CASE WHEN status = 'FAILED' THEN CONCAT('boom ', CAST(pk AS <text>)) ELSE '' END AS error
FROM (SELECT CONCAT(r.id, '/s', CAST(o AS <text>)) AS id, r.id AS run_id, CONCAT('s', CAST(o AS <text>)) AS name, CAST(o AS BIGINT) AS ord,
 CASE WHEN r.status IN ('SUCCEEDED') THEN 'SUCCEEDED'
      WHEN r.status IN ('FAILED','CANCELLED','INTERRUPTED') THEN CASE WHEN o = 0 THEN 'SUCCEEDED' WHEN o = 1 AND r.status='FAILED' THEN 'FAILED' ELSE 'CANCELLED' END
      WHEN r.status IN ('RUNNING','PAUSED') THEN CASE WHEN o = 0 THEN 'SUCCEEDED' WHEN o = 1 THEN CASE l_partkey % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'SUSPENDED' WHEN 2 THEN 'QUEUED' ELSE 'SUCCEEDED' END ELSE 'BLOCKED' END
      ELSE CASE WHEN o = 0 THEN 'QUEUED' ELSE 'BLOCKED' END END AS status,
 CASE WHEN o = 0 THEN '' WHEN o % 2 = 1 THEN 's0' ELSE CONCAT('s', CAST(o-1 AS <text>), ',s', CAST(o-2 AS <text>)) END AS depends_on,
 r.queue, r.priority, r.created_at + (l_partkey % 50) * 86400000000000 AS run_at,
 CASE WHEN r.custkey % 3 = 0 THEN '' ELSE CONCAT('k', CAST(r.custkey AS <text>)) END AS concurrency_key, CAST(CASE WHEN r.custkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS key_limit,
 CASE WHEN r.custkey % 5 = 0 THEN CONCAT('q', CAST(r.custkey AS <text>)) ELSE '' END AS sequence_key, r.seq,
 CASE l_suppkey % 4 WHEN 0 THEN 'gpu' WHEN 1 THEN 'gpu,linux' ELSE '' END AS labels, r.custkey, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS qty
 FROM (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS o FROM {lineitem} l) l JOIN {runs} r ON r.seq = l.l_orderkey) b
"""
STEP_KEYS = """
SELECT id AS step_id, 'cust' AS name, CAST(custkey % 50 AS <text>) AS value, CAST(CASE WHEN custkey % 50 < 10 THEN 1 ELSE 1000000 END AS BIGINT) AS key_limit FROM {steps}
UNION ALL SELECT id, 'part', CAST(pk % 20 AS <text>), CAST(CASE WHEN pk % 20 = 4 THEN 1 ELSE 1000000 END AS BIGINT) FROM {steps} WHERE pk % 2 = 0
"""
LOGS = """
SELECT event_id AS seq, CONCAT('r', CAST(event_id * 7 AS <text>)) AS run_id, 's0' AS step,
 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level, props AS message FROM {events}
"""
EMITTED = "SELECT event_id AS seq, event_type AS name, props AS payload, <epoch>(ts<cast>) * 1000 AS created_at FROM {events}"
WAITS = """
SELECT id AS step_id, wait_event AS event, 1704067200000000000 + (pk % 29) * 86400000000000 AS registered,
 CASE WHEN resume_at = 0 THEN 0 ELSE 1704067200000000000 + (pk % 29) * 86400000000000 + (sk % 6 + 1) * 1800000000000 END AS deadline
FROM {steps} WHERE status = 'SUSPENDED' AND wait_kind = 'wait'
"""
PAUSES = "SELECT '5-LOW' AS queue"
SUBSCRIPTIONS = "SELECT 'purchase' AS event, 'charge' AS task UNION ALL SELECT 'purchase', 'notify' UNION ALL SELECT 'error', 'page_oncall'"
#: In order of dependence.
TABLES = {"runs": RUNS, "steps": STEPS, "step_keys": STEP_KEYS, "logs": LOGS, "emitted": EMITTED, "waits": WAITS, "queue_pauses": PAUSES, "subscriptions": SUBSCRIPTIONS}
DRIVER = ("orders", "lineitem", "events")
#: Steps that a task sorts, about, where they are dealt by their number.
TASK_ROWS = 250_000


def _said(text: str, engine: dict) -> str:
    for k, v in engine.items():
        text = text.replace(f"<{k}>", v)
    return text


def _names(text: str) -> list[str]:
    return [n for n in (*DRIVER, *TABLES) if "{" + n + "}" in text]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a state table as a lazy DataFrame over driver tables."""
    if name in DRIVER:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run_sql(spark, sf_dir, TABLES[name])


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs a query text whose {names} are tables of the state."""
    return spark.sql(_said(text, SPARK), **{n: table(spark, sf_dir, n) for n in _names(text)})


def dealt_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    """The steps, numbered in as many tasks as their number asks for, so that a task's memory does not grow with the table; that
    number of tasks, the session's at least, or None for a table of one task, which Spark deals as it likes."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = 1 + lines.count() // TASK_ROWS
    if tasks == 1:
        return table(spark, sf_dir, "steps"), None
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sql(_said(STEPS, SPARK), lineitem=lines.repartition(tasks, "l_orderkey"), runs=table(spark, sf_dir, "runs")), tasks


def duck_sql(text: str) -> str:
    """The same for DuckDB over the driver's views: state tables become common table expressions."""
    needed: dict[str, str] = {}

    def need(t: str) -> None:
        for n in _names(t):
            if n in TABLES and n not in needed:
                need(TABLES[n])
                needed[n] = TABLES[n]

    need(text)
    fill = {n: n for n in (*DRIVER, *TABLES)}
    said = lambda t: _said(t, DUCK).format(**fill)
    clauses = ", ".join(f"{n} AS ({said(t)})" for n, t in needed.items())
    return (f"WITH {clauses} " if clauses else "") + said(text)

"""Contract views over the driver tables, in SQL that Spark and DuckDB both read.

``{name}`` stands for a driver table or another view, ``$ms(x)`` for the epoch milliseconds of a timestamp. All times
of the views are epoch milliseconds (bigint).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from telemill.session import table

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"

VIEWS: dict[str, str] = {
    "executions": f"""
        select event_id as exec_id, concat('task-', cast(event_id as string)) as task_id, event_type as task_type,
          concat('worker-', cast(user_id % 5 as string)) as worker_id, $ms(ts) as dispatched_ms, event_id % 50 as wait_ms,
          cast(floor(value * 10) as bigint) + 1 as exec_ms, case when event_id % 20 = 0 then 'FAILED' else 'COMPLETED' end as status,
          {_K} % 7 as queue_len, {_K} as input_size, event_id % 3 + 1 as attempt, event_id % 10 + 1 as priority,
          concat('trace-', cast(user_id as string)) as trace_id, cast(event_id % 3 as string) as run_no
        from {{events}}""",
    "submissions": f"""
        select event_id as sub_id, case when event_id % 101 = 0 then ' ' else concat('sub-', cast(event_id - event_id % 2 * (event_id % 4) as string)) end as task_id,
          case event_id % 15 when 0 then 'CPU_TASK' when 1 then 'MATRIX_TASK' when 2 then 'SLEEP_TASK' when 3 then 'MAPREDUCE_TASK' when 4 then 'SORT_TASK' when 5 then 'HASH_TASK' when 6 then 'COMPRESS_TASK' when 7 then 'MONTE_CARLO_TASK' when 8 then 'FILE_IO_TASK' when 9 then 'HTTP_TASK' when 10 then 'DB_QUERY_TASK' when 11 then 'GRAPH_TASK' when 12 then 'ML_INFER_TASK' when 13 then 'WORKFLOW_TASK' when 14 then 'IMAGE_TASK' end as type, user_id % 12 as priority,
          case cast(floor(event_id / 15) as bigint) % 9 when 0 then concat('n=', cast({_K} * 3000000 as string)) when 1 then concat('size=', cast({_K} * 20 as string), ', threads=', cast({_K} as string), ', mode=mpi')
            when 2 then concat('ms=', cast({_K} as string), ', failRate=', cast({_K} % 3 as string), '.5') when 3 then concat('url=http://h/', cast({_K} as string), ', timeout=', cast({_K} as string))
            when 4 then 'rows=abc, rounds=7' when 5 then 'dataset=d, job=wordcount' when 6 then 'broken' when 7 then concat('size_mb=', cast({_K} * 30 as string), ', level=', cast({_K} % 12 as string), ', type=sorted, mode=both, seed=5')
            else concat('batch=', cast({_K} as string), ', model=overload, nodes=', cast({_K} - 3 as string), ', algo=dfs, samples=12, dag=x') end as input
        from {{events}}""",
    "samples": f"""
        select event_id as sample_id, concat('worker-', cast(user_id % 5 as string)) as worker_id, $ms(ts) as ts_ms,
          case when value > 100.0 then 100.0 else value end as cpu_pct, {_K} % 9 as queue_len, {_K} % 4 as active_threads,
          event_id % 11 as mem_units from {{events}}""",
    "workers": """
        select * from (values ('worker-0', cast(2 as bigint), 2.0e0, true), ('worker-1', cast(4 as bigint), 1.0e0, true), ('worker-2', cast(8 as bigint), 1.0e0, true),
          ('worker-3', cast(4 as bigint), 1.0e0, false), ('worker-9', cast(0 as bigint), 2.0e0, true)) as w(worker_id, pool_size, slowdown, healthy)""",
    "ships": "select l_orderkey as k, $ms(max(l_shipdate)) as shipped_ms, count(*) as n_parts from {lineitem} group by l_orderkey",
    "tasks": """
        select concat('task-', cast(o_orderkey as string)) as task_id, o_orderkey as task_no, o_orderpriority as task_type,
          case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'RUNNING' else 'FAILED' end as status, c_mktsegment as strategy,
          concat('worker-', cast(o_custkey % 5 as string)) as worker_id, concat('client-', cast(o_custkey as string)) as client_id,
          o_custkey % 10 + 1 as priority, o_orderkey % 5 as attempts, $ms(o_orderdate) as submitted_ms, $ms(o_orderdate) + o_orderkey % 7001 as started_ms,
          case when o_orderstatus = 'O' then null else coalesce(shipped_ms, $ms(o_orderdate)) end as completed_ms,
          case when o_orderkey % 4 = 0 then null else $ms(o_orderdate) + 5184000000 end as deadline_ms, cast(floor(o_totalprice) as bigint) as exec_ms
        from {orders} o join {customer} c on o.o_custkey = c.c_custkey left join {ships} s on s.k = o.o_orderkey""",
    "outcomes": """
        select exec_id, task_id, task_type, worker_id, dispatched_ms + wait_ms + exec_ms as ts_ms, exec_ms as actual_ms,
          cast(exec_ms + (exec_id * 37) % 401 - 200 as double) as pred_ms, cast(abs((exec_id * 37) % 401 - 200) as double) as abs_error_ms,
          exec_id % 9 = 0 as cold_start, concat('v', cast(exec_id % 2 + 1 as string)) as model_version
        from {executions} where status = 'COMPLETED'""",
    "failures": """
        select event_id as failure_id, concat('worker-', cast(user_id % 5 as string)) as node_id, $ms(ts) as detected_ms from {events} where event_type = 'error'""",
    "recoveries": """
        select event_id as recovery_id, concat('worker-', cast(user_id % 5 as string)) as node_id, $ms(ts) as recovered_ms from {events} where event_type = 'signup'""",
    "log_events": f"""
        select concat('node-', cast(user_id % 3 as string)) as node, event_id as seq, $ms(ts) as physical_ms, event_id * 7 % 1009 + event_id as lamport,
          case event_type when 'view' then 'DISPATCH' when 'click' then 'RESULT' when 'error' then 'WORKER_DEAD' when 'signup' then 'WORKER_JOINED' else 'ELECTION' end as type,
          concat('task-', cast(event_id % 997 as string)) as task_id, concat('trace-', cast({_K} as string)) as trace_id, props from {{events}}""",
    "replication": """
        select concat('node-', cast(user_id % 3 as string)) as node_id, event_id - event_id % 7 as seq_no, $ms(ts) as applied_ms, concat('task-', cast(event_id % 997 as string)) as task_id,
          event_id * 13 % 5003 as lamport, concat('node-', cast(user_id % 4 as string)) as origin, event_type as op from {events}""",
    "clock_sync": """
        select concat('node-', cast(user_id % 6 as string)) as node_id, cast(floor(event_id / 6) as bigint) as round_no, $ms(ts) as ts_ms,
          cast(floor(value * 3) as bigint) - 100 as offset_ms from {events}""",
    "replay": """
        select concat(r_name, '/', c_mktsegment, '/', cast(year(o_orderdate) as string)) as run_id, r_name as scenario,
          case c_mktsegment when 'BUILDING' then 'predictive' else lower(c_mktsegment) end as strategy, cast(year(o_orderdate) as bigint) as rep,
          o_orderkey as task_no, o_orderpriority as task_type, $ms(o_orderdate) + o_orderkey % 86400000 as submit_ms,
          case when o_orderstatus = 'P' and o_orderkey % 3 = 0 then null else $ms(o_orderdate) + o_orderkey % 86400000 + (o_orderkey * 31) % 700001 end as start_ms,
          case when o_orderstatus = 'O' then null else $ms(o_orderdate) + o_orderkey % 86400000 + (o_orderkey * 31) % 700001 + cast(floor(o_totalprice) as bigint) end as end_ms,
          case when o_orderstatus = 'O' then null else (o_orderkey * 31) % 700001 + cast(floor(o_totalprice) as bigint) end as latency_ms,
          case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'RUNNING' else 'FAILED' end as status,
          concat('worker-', cast(o_custkey % 4 as string)) as worker, cast(floor(o_totalprice) as bigint) as exec_ms
        from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey""",
    "run_metrics": """
        select run_id, scenario, strategy, rep, count(*) as tasks, sum(case when status = 'COMPLETED' then 1 else 0 end) as completed,
          avg(case when status = 'COMPLETED' then cast(latency_ms as double) end) as latency_ms,
          sum(case when status = 'COMPLETED' then 1 else 0 end) * 1000.0e0 / greatest(1, max(end_ms) - min(submit_ms)) as throughput,
          100.0e0 * sum(case when status = 'FAILED' or latency_ms > 500000 then 1 else 0 end) / count(*) as sla_violations
        from {replay} group by run_id, scenario, strategy, rep""",
    "snapshots": """
        select exec_id, task_id, worker_id as home_worker, task_type, priority, dispatched_ms, input_size from {executions}""",
    "candidates": """
        select e.task_id, e.exec_id, e.task_type, e.priority, w.worker_id, w.pool_size, (e.exec_id * 7 + w.pool_size) % 5 as active, (e.input_size + w.pool_size * 3) % 6 as queue_len,
          cast((e.exec_id * 11 + w.pool_size * 17) % 101 as double) as cpu_pct, cast((e.exec_id * 5 + w.pool_size * 29) % 101 as double) as mem_pct,
          cast((e.exec_id + w.pool_size) % 4 * 50 as double) as avg_exec_ms,
          case when e.exec_id % 13 = 0 and w.worker_id = 'worker-2' then null else cast(40 + (e.exec_id * 3 + w.pool_size * 19) % 200 as double) end as pred_exec_ms,
          cast((e.exec_id * 17 + w.pool_size * 23) % 100 as double) / 100 as overload_prob
        from {executions} e cross join {workers} w where w.healthy""",
    "edges": """
        select p_partkey as src, (p_partkey + 1) % n as dst from {part}, (select count(*) as n from {part}) as t
        union all select p_partkey, (p_partkey + 2) % n from {part}, (select count(*) as n from {part}) as t
        union all select p_partkey, (p_partkey * 31 + 7) % n from {part}, (select count(*) as n from {part}) as t""",
    "dag": """
        select concat('wf-', cast(p_partkey % 20 as string)) as workflow_id, cast(floor(p_partkey / 20) as bigint) as node,
          case when p_partkey < 20 then null else cast(floor((floor(p_partkey / 20) - 1) / 2) as bigint) end as parent,
          case when p_partkey % 11 = 0 then 'FAILED' when p_partkey % 5 < 3 and p_partkey % 11 <> 5 then 'COMPLETED' else 'BLOCKED' end as status from {part}""",
    "scored": """
        select exec_id, task_type, case when exec_ms > 600 then 1 else 0 end as label, cast((exec_ms * 7 + exec_id * 13) % 997 + case when exec_ms > 600 then 400 else 0 end as double) / 1397 as score,
          cast(exec_ms as double) as actual, cast(exec_ms + (exec_id * 37) % 401 - 200 as double) as predicted from {executions}""",
}

_HOLE = re.compile(r"\{(\w+)\}")


def needs(text: str) -> list[str]:
    """Names that a text refers to, in order."""
    return list(dict.fromkeys(_HOLE.findall(text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A contract view or driver table as a lazy frame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = _balanced(VIEWS[name], "$ms(", "unix_millis(cast(", " as timestamp))")
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in needs(text)})


def _balanced(text: str, opening: str, before: str, after: str) -> str:
    """Replace each ``opening`` x ``)`` by ``before`` x ``after``, with x up to the bracket that closes it."""
    while (at := text.find(opening)) >= 0:
        depth, i = 1, at + len(opening)
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[:at] + before + text[at + len(opening) : i - 1] + after + text[i:]
    return text


def oracle(text: str) -> str:
    """DuckDB SQL of ``text``: its views as common table expressions in front."""
    order: list[str] = []

    def visit(body: str) -> None:
        for n in needs(body):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(text)
    plain = lambda body: _balanced(_HOLE.sub(r"\1", body), "$ms(", "(epoch_us(", ") // 1000)")
    heads = [f"{n} as ({plain(VIEWS[n])})" for n in order]
    body = plain(text).strip()
    if body.lower().startswith("with recursive"):
        return "with recursive " + ", ".join([*heads, body[len("with recursive") :].strip()])
    if body.lower().startswith("with "):
        return "with " + ", ".join([*heads, body[5:]])
    return ("with " + ", ".join(heads) + " " if heads else "") + body

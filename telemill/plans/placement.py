"""Registered placement, graph and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.operators import graphs, placement
from telemill.plans.registry import plan

_PICK = "select task_id, worker_id, round(s, 6) as score from (select task_id, worker_id, {s} as s, row_number() over (partition by task_id order by {s}, worker_id) as r from {{candidates}}) where r = 1"
_LOAD = "cast(active + queue_len as double)"
_RES = "(0.4::double * cpu_pct / 100 + 0.2::double * mem_pct / 100 + 0.4::double * (active + queue_len) / greatest(1, pool_size))"


@plan("place_least_loaded", _PICK.format(s=_LOAD))
def _(candidates):
    return placement.place(candidates, "least_loaded").withColumn("score", F.round("score", 6))


@plan("pick_lowest", _PICK.format(s="pred_exec_ms").replace("from {candidates}", "from {candidates} where pred_exec_ms is not null"))
def _(candidates):
    return placement.pick_lowest(candidates, F.col("pred_exec_ms")).withColumn("score", F.round("score", 6))


@plan("place_resource_aware", "with c as (select task_id, worker_id, round(" + _RES + ", 9) as s from {candidates}) select task_id, worker_id, round(s, 6) as score from c qualify row_number() over (partition by task_id order by s, worker_id) = 1")
def _(candidates):
    return placement.pick_lowest(candidates, F.round(placement.resource_aware(), 9)).withColumn("score", F.round("score", 6))


@plan("place_predictive", """
with s as (select *, case when priority >= 8 then 0.5 else 0.8 end as cap, count(*) filter (pred_exec_ms is null) over (partition by task_id) > 0 as missing, min(overload_prob) over (partition by task_id) as least_p from {candidates}),
t as (select *, greatest(0, queue_len) * (case when avg_exec_ms > 0 then avg_exec_ms else pred_exec_ms end) / greatest(1, pool_size) as wait from s),
u as (select *, case when missing then cast(active + queue_len as double) when not (least_p <= cap and overload_prob > cap) then (wait + pred_exec_ms) * (1 + overload_prob) end as score from t)
select task_id, worker_id, round(score, 6) as score, case when missing then 'no prediction' end as fallback from u where score is not null
qualify row_number() over (partition by task_id order by score, worker_id) = 1""")
def _(candidates):
    return placement.predictive(candidates)


@plan("place_round_robin", """
with w as (select worker_id, row_number() over (order by worker_id) - 1 as i, count(*) over () as n from {workers}), t as (select exec_id, row_number() over (order by exec_id) - 1 as pos from {executions})
select exec_id, worker_id from t join w on t.pos % w.n = w.i""")
def _(executions, workers):
    return placement.round_robin(executions.select("exec_id"), workers, "exec_id")


@plan("place_random", """
with w as (select list(worker_id order by worker_id) as ids from {workers})
select exec_id, ids[('0x' || md5(concat(exec_id, ':42'))[1:15])::bigint % len(ids) + 1] as worker_id from {executions}, w""")
def _(executions, workers):
    return placement.random_choice(executions.select("exec_id"), workers, "exec_id", 42)


@plan("candidate_workers", """
with f as (select worker_id, count(*) % 7 as n from {executions} group by 1),
r as (select w.worker_id, pool_size from {workers} w left join f on f.worker_id = w.worker_id where healthy and coalesce(n, 0) < greatest(1, round(pool_size * 1.0))),
p as (select e.task_id, r.worker_id, r.pool_size, e.worker_id as avoid, count(*) filter (r.worker_id <> e.worker_id) over (partition by e.task_id) as others from {executions} e cross join r)
select task_id, worker_id, pool_size from p where worker_id <> avoid or others = 0""")
def _(executions, workers):
    flight = executions.groupBy("worker_id").agg((F.count("*") % 7).alias("n"))
    tasks = executions.select("task_id", F.col("worker_id").alias("avoid"))
    return placement.open_candidates(tasks, workers, flight, 1.0).select("task_id", "worker_id", "pool_size")


@plan("decision_breakdown", """
select task_id, count(*) as n, '[' || string_agg('{"worker_id":"' || worker_id || '","score":' || coalesce(cast(round(pred_exec_ms, 4) as varchar), 'null') || '}', ',' order by worker_id) || ']' as breakdown
from {candidates} group by task_id""")
def _(candidates):
    return placement.breakdown(candidates, F.col("pred_exec_ms"))


@plan("edge_build", """
select p_partkey as src, unnest([(p_partkey + 1) % n, (p_partkey + 2) % n, (p_partkey * 15 + 7) % n]) as dst from {part}, (select count(*) as n from {part})""")
def _(part):
    return graphs.edge_build(part.select(F.col("p_partkey").alias("src")), part.count(), 7)


_NODES = "n as (select distinct src as node from {edges} union select dst from {edges}), c as (select count(*) as c from n), d as (select src, count(*) as o from {edges} group by 1)"


@plan("pagerank", f"""
with recursive {_NODES}, l as (select e.src, e.dst, d.o from {{edges}} e join d on d.src = e.src),
r(i, node, rank) as (select 0, node, 1.0::double / c from n, c union all
  select i, node, 0.15::double / c + 0.85::double * coalesce(g, 0) from (
    select r.i + 1 as i, l.dst as node, sum(r.rank / l.o) as g from r join l on l.src = r.node where r.i < 20 group by 1, 2), c)
select node, round(rank, 12) as rank from r where i = 20""")
def _(edges):
    return graphs.pagerank(edges).select("node", F.round("rank", 12).alias("rank"))


@plan("bfs", """
with recursive r(node, hops) as (select 0::bigint, 0 union select e.dst, r.hops + 1 from r join {edges} e on e.src = r.node where r.hops < 40)
select node, min(hops) as hops from r group by node""")
def _(edges):
    return graphs.bfs(edges, 0)


@plan("dag_levels", """
with recursive r(workflow_id, node, level) as (select workflow_id, node, 0 from {dag} where parent is null union all select d.workflow_id, d.node, r.level + 1 from r join {dag} d on d.workflow_id = r.workflow_id and d.parent = r.node and d.node <> d.parent)
select workflow_id, node, max(level) as level from r group by 1, 2 union all select distinct workflow_id, node, null::int from {dag} d where not exists (select 1 from r where r.workflow_id = d.workflow_id and r.node = d.node)""")
def _(dag):
    return graphs.dag_levels(dag)


@plan("dag_validate", """
select workflow_id, node, 'duplicate' as problem from {dag} group by workflow_id, node, parent having count(*) > 1 union select workflow_id, node, 'self-dependency' from {dag} where node = parent
union select workflow_id, node, 'unknown parent' from {dag} d where parent is not null and not exists (select 1 from {dag} p where p.workflow_id = d.workflow_id and p.node = d.parent)
union select workflow_id, null, 'too many tasks' from {dag} group by 1 having count(distinct node) > 50
union select workflow_id, node, 'reference to a non-parent' from {dag} d where node % 7 = 3 and not exists (select 1 from {dag} p where p.workflow_id = d.workflow_id and p.node = d.node and p.parent = d.node - 2)""")
def _(dag):
    refs = F.when(F.col("node") % 7 == 3, F.array(F.col("node") - 2, F.col("parent"))).otherwise(F.array("parent"))
    return graphs.dag_validate(dag.withColumn("refs", F.array_compact(refs)), 50)


@plan("dag_cancel", """
with recursive r(workflow_id, node) as (select distinct workflow_id, node from {dag} where status = 'FAILED' union select d.workflow_id, d.node from r join {dag} d on d.workflow_id = r.workflow_id and d.parent = r.node where d.status = 'BLOCKED')
select r.workflow_id, r.node from r join {dag} d on d.workflow_id = r.workflow_id and d.node = r.node where d.status = 'BLOCKED'""")
def _(dag):
    return graphs.dag_cancel(dag)


@plan("dag_ready", """
select d.workflow_id, d.node from {dag} d left join {dag} p on p.workflow_id = d.workflow_id and p.node = d.parent where d.status = 'BLOCKED'
group by 1, 2 having bool_and(d.parent is null or coalesce(p.status = 'COMPLETED', false))""")
def _(dag):
    return graphs.dag_ready(dag)


@plan("matmul", """
select i::int as i, j::int as j, round(sum(x * y), 4) as value from (
  select a.i - 1 as i, b.i - 1 as j, e.embedding[a.i]::double as x, e.embedding[b.i]::double as y from {embeddings} e, range(1, 65) a(i), range(1, 65) b(i)) group by 1, 2""")
def _(embeddings):
    return graphs.gram(embeddings, "embedding").withColumn("value", F.round("value", 4))


@plan("matmul_product", """
with e as (select vec_id, embedding::double[] as v from {embeddings}),
g as (select list(t order by k) as t from (select k, sum(v[k] * list_sum(v)) as t from e, range(1, 65) r(k) group by k))
select vec_id, round(list_inner_product(v, t), 3) as row_sum from e, g""")
def _(embeddings):
    rows = embeddings.select("vec_id", "embedding")
    made = graphs.product(rows, graphs.matrix_rows(graphs.gram(embeddings, "embedding")), "vec_id", "embedding")
    return made.select("vec_id", F.round(F.aggregate("product", F.lit(0.0), lambda a, x: a + x), 3).alias("row_sum"))


@plan("lww_merge", """
select task_id, lamport, origin, op from {replication} qualify row_number() over (partition by task_id order by lamport desc, origin desc, op desc) = 1""")
def _(replication):
    return graphs.lww_merge(replication)


@plan("clock_round", """
with m as (select round_no, list_sort(list(offset_ms)) as o from {clock_sync} group by 1), k as (select round_no, o, o[len(o) // 2 + 1] as median_ms from m),
f as (select *, list_filter(o, lambda x: abs(x - median_ms) <= 150) as kept from k)
select round_no, median_ms, len(kept) as n_kept, o[-1] - o[1] as spread_ms, kept[-1] - kept[1] as kept_spread_ms, trunc(list_sum(kept)::double / len(kept))::bigint as mean_ms from f""")
def _(clock_sync):
    return graphs.clock_round(clock_sync, 150)

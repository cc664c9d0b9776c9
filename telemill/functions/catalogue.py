"""Fixed values of the task catalogue: types, profiles, parameters, status changes, model inputs."""

from __future__ import annotations

# Task types a worker can run, in the order of the model inputs, and resource profiles.
TASK_TYPES = [
    "CPU_TASK", "MATRIX_TASK", "SLEEP_TASK", "MAPREDUCE_TASK", "SORT_TASK", "HASH_TASK", "COMPRESS_TASK", "MONTE_CARLO_TASK",
    "FILE_IO_TASK", "HTTP_TASK", "DB_QUERY_TASK", "GRAPH_TASK", "ML_INFER_TASK",
]
PROFILES = ["CPU_BOUND", "MEMORY_BOUND", "IO_BOUND", "NETWORK_BOUND", "PARALLEL"]
PROFILE_OF = {
    "CPU_TASK": "CPU_BOUND", "HASH_TASK": "CPU_BOUND", "MONTE_CARLO_TASK": "CPU_BOUND", "ML_INFER_TASK": "CPU_BOUND",
    "SORT_TASK": "MEMORY_BOUND", "COMPRESS_TASK": "MEMORY_BOUND", "GRAPH_TASK": "MEMORY_BOUND",
    "SLEEP_TASK": "IO_BOUND", "FILE_IO_TASK": "IO_BOUND", "DB_QUERY_TASK": "IO_BOUND", "HTTP_TASK": "NETWORK_BOUND",
    "MATRIX_TASK": "PARALLEL", "MAPREDUCE_TASK": "PARALLEL",
}
NEVER_CACHED = ["SLEEP_TASK", "HTTP_TASK", "FILE_IO_TASK", "DB_QUERY_TASK"]

_ANY = 2**63 - 1
# Parameters by type as (type, key, kind, required, low, high, choices).
PARAMETERS: list[tuple[str, str, str, bool, float, float, tuple[str, ...]]] = [
    ("CPU_TASK", "n", "number", True, 2, 100_000_000, ()),
    ("SLEEP_TASK", "ms", "number", True, 0, 60_000, ()),
    ("SLEEP_TASK", "seed", "number", False, 0, _ANY, ()),
    ("SLEEP_TASK", "failRate", "fraction", False, 0, 1, ()),
    ("MATRIX_TASK", "size", "number", True, 1, 1_000, ()),
    ("MATRIX_TASK", "threads", "number", False, 1, 64, ()),
    ("MATRIX_TASK", "procs", "number", False, 1, 64, ()),
    ("MATRIX_TASK", "seed", "number", False, 0, _ANY, ()),
    ("MATRIX_TASK", "mode", "choice", False, 0, 0, ("local", "threads", "mpi")),
    ("HASH_TASK", "rounds", "number", True, 1, 20_000_000, ()),
    ("MONTE_CARLO_TASK", "samples", "number", True, 1, 500_000_000, ()),
    ("MONTE_CARLO_TASK", "seed", "number", False, 0, _ANY, ()),
    ("SORT_TASK", "n", "number", True, 2, 20_000_000, ()),
    ("SORT_TASK", "type", "choice", False, 0, 0, ("random", "sorted", "reversed")),
    ("COMPRESS_TASK", "size_mb", "number", True, 1, 512, ()),
    ("COMPRESS_TASK", "level", "number", False, 1, 9, ()),
    ("GRAPH_TASK", "nodes", "number", True, 2, 5_000_000, ()),
    ("GRAPH_TASK", "algo", "choice", False, 0, 0, ("bfs", "pagerank")),
    ("GRAPH_TASK", "seed", "number", False, 0, _ANY, ()),
    ("FILE_IO_TASK", "size_mb", "number", True, 1, 2_048, ()),
    ("FILE_IO_TASK", "mode", "choice", False, 0, 0, ("write", "read", "both")),
    ("HTTP_TASK", "timeout", "number", True, 1, 120_000, ()),
    ("HTTP_TASK", "url", "url", True, 0, 0, ()),
    ("WORKFLOW_TASK", "dag", "text", True, 0, 0, ()),
    ("DB_QUERY_TASK", "rows", "number", True, 1, 200_000, ()),
    ("MAPREDUCE_TASK", "dataset", "text", True, 0, 0, ()),
    ("MAPREDUCE_TASK", "job", "choice", True, 0, 0, ("avg_exec", "wordcount")),
    ("ML_INFER_TASK", "batch", "number", True, 1, 1_000_000, ()),
    ("ML_INFER_TASK", "model", "choice", True, 0, 0, ("exec_time", "queue_forecast", "overload")),
    ("ML_INFER_TASK", "seed", "number", False, 0, _ANY, ()),
]
#: The first required number of a type is the size of its work.
SIZE_KEYS: dict[str, str] = {}
for _type, _key, _kind, _required, *_ in PARAMETERS:
    if _kind == "number" and _required:
        SIZE_KEYS.setdefault(_type, _key)
KNOWN_TYPES = list(dict.fromkeys(p[0] for p in PARAMETERS))

# Status changes that a task may make.
LEGAL_CHANGES = [
    ("BLOCKED", "QUEUED"), ("BLOCKED", "CANCELLED"), ("QUEUED", "RUNNING"), ("QUEUED", "CANCELLED"), ("RUNNING", "COMPLETED"), ("RUNNING", "FAILED"), ("RUNNING", "QUEUED"),
]

# Numeric model inputs and what stands in for a null.
NUMERIC_DEFAULTS = {
    "priority": 5.0, "worker_cores": 1.0, "worker_pool_size": 1.0, "worker_slowdown": 1.0, "concurrent_tasks_on_worker": 0.0, "cpu_pct": 0.0, "mem_pct": 0.0,
    "active_threads": 0.0, "queue_len": 0.0, "arrival_rate": 0.0, "win_arrival_rate": 0.0, "win_queue_len_mean": 0.0, "win_queue_len_max": 0.0,
}

"""Column expressions over task inputs, statuses and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill.functions import catalogue


def kv_parse(text: Column) -> Column:
    """``k=v, k=v`` as struct(valid, pairs): trailing empty segments are dropped, the last of equal keys wins.

    Invalid (pairs null): an empty segment, a missing value, or a key that isn't a word. Only the first ``=`` splits.
    """
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[,]+$", "")
    parts = F.transform(F.split(trimmed, ","), lambda p: F.trim(p))
    good = F.forall(parts, lambda p: p.rlike(r"^[A-Za-z_][A-Za-z0-9_]* *=.*[^ ]"))
    keys = F.transform(parts, lambda p: F.trim(F.substring_index(p, "=", 1)))
    values = F.transform(parts, lambda p: F.trim(F.regexp_extract(p, "^[^=]*=(.*)$", 1)))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["k"]))
    return F.struct(good.alias("valid"), F.when(good, F.map_from_entries(last)).alias("pairs"))


def _by_type(task_type: Column, values: dict[str, str]) -> Column:
    """The value of a type, null for others."""
    return F.coalesce(*[F.when(task_type == kind, F.lit(value)) for kind, value in values.items()])


def input_size(task_type: Column, pairs: Column, text: Column, keys: dict[str, str] = catalogue.SIZE_KEYS) -> Column:
    """The first required number of the type, with or without a sign, else the length of the text."""
    number = F.try_element_at(pairs, _by_type(task_type, keys))
    return F.coalesce(F.when(number.rlike("^[+-]?[0-9]+$"), number.try_cast("long")), F.length(text).cast("long"), F.lit(0).cast("long"))


def problems(*rules: tuple[Column, str]) -> Column:
    """The names of all rules that are broken, in order."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for broken, name in rules]), lambda x: x.isNotNull())


def input_problems(task_type: Column, kv: Column, rules: list[tuple] = catalogue.PARAMETERS) -> Column:
    """Every problem of a parsed input (struct of kv_parse): its form, or missing, not numeric, out of range, not a choice, no URL."""
    made: list[tuple[Column, str]] = [(~kv["valid"], "input: not key=value")]
    for kind, key, form, required, low, high, choices in rules:
        value = F.try_element_at(kv["pairs"], F.lit(key))
        own = (task_type == kind) & kv["valid"]
        if required:
            made.append((own & value.isNull(), f"{key}: missing"))
        given = own & value.isNotNull()
        if form in ("number", "fraction"):
            number = value.rlike("^[+-]?[0-9]{1,18}$") if form == "number" else value.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
            made.append((given & ~number, f"{key}: not a number"))
            made.append((given & number & ~value.cast("double").between(float(low), float(high)), f"{key}: out of range"))
        elif form == "choice":
            made.append((given & ~value.isin(*choices), f"{key}: not a choice"))
        elif form == "url":
            made.append((given & ~(value.rlike("^https?://") & (F.length(value) >= 10)), f"{key}: no URL"))
    return problems(*made)


def task_problems(task_id: Column, task_type: Column, text: Column, priority: Column, copies: Column, kv: Column, max_chars: int = 100_000) -> Column:
    """Problems of a submission: id, type, input and its parameters, priority; ``copies`` is how often its id occurs."""
    head = [
        (F.coalesce(F.trim(task_id), F.lit("")) == "", "task_id: empty"),
        (copies > 1, "task_id: exists already"),
        (~F.coalesce(task_type.isin(*catalogue.KNOWN_TYPES), F.lit(False)), "type: not supported"),
        (F.coalesce(text, F.lit("")) == "", "input: empty"),
        (F.length(text) > max_chars, "input: too long"),
    ]
    tail = [(~F.coalesce(priority.between(1, 10), F.lit(False)), "priority: not 1 to 10")]
    return F.concat(problems(*head), F.when(F.coalesce(text, F.lit("")) != "", input_problems(task_type, kv)).otherwise(F.array().cast("array<string>")), problems(*tail))


def cache_key(task_type: Column, pairs: Column, text: Column) -> Column:
    """SHA-256 of the type and the parameters sorted by name; of the trimmed text if it has no parameters."""
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.sha2(F.concat(task_type, F.lit("|"), F.coalesce(listed, F.trim(text))), 256)


def event_words(kind: Column, details: Column) -> Column:
    """The event type as one word, and the words of the detail text."""
    return F.concat(F.array(kind), F.regexp_extract_all(F.coalesce(details, F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_.-]*"), F.lit(0)))


def sla_met(status: Column, completed: Column, deadline: Column) -> Column:
    return deadline.isNotNull() & (status == "COMPLETED") & F.coalesce(completed <= deadline, F.lit(False))


def over_ms(completed: Column, deadline: Column) -> Column:
    return F.when(deadline.isNotNull() & completed.isNotNull(), F.greatest(F.lit(0), completed - deadline))


def log_target(ms: Column) -> Column:
    return F.log1p(ms)


def from_log_target(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.expm1(x))


def retry_delay(attempt: Column, base: int, most: int) -> Column:
    """base x 2^(attempt - 1), at most ``most``; without jitter."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)) - 1)).cast("long")


def straggler_limit(predicted: Column, p90: Column, k: float) -> Column:
    """The larger of k x prediction and p90, whichever exist; null with neither."""
    return F.greatest(k * predicted, p90)


def profile_of_type(task_type: Column) -> Column:
    """The resource profile of a type, empty for unknown ones."""
    return F.coalesce(_by_type(task_type, catalogue.PROFILE_OF), F.lit(""))


def feature_columns(present: list[str]) -> dict[str, Column]:
    """The 51 model inputs by name from those execution columns that are ``present``; nulls and NaN take their default.

    Type and profile marks, log1p of the size and the same by type, 13 numbers, busy and queue ratio to the pool (at
    least 1), log1p of the recent mean, and whether there is a prior mean, its log1p and that of its count.
    """

    def number(name: str, default: float | None = None) -> Column:
        if name not in present:
            return F.lit(default).cast("double")
        value = F.col(name).cast("double")
        clean = F.when(~F.isnan(value), value)
        return clean if default is None else F.coalesce(clean, F.lit(default))

    least = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    mark = lambda c, v: F.coalesce((c == v).cast("double"), F.lit(0.0))
    kind = F.col("task_type")
    profile = F.col("resource_profile") if "resource_profile" in present else profile_of_type(kind)
    size = F.log1p(least(number("input_size")))
    numbers = {n: number(n, d) for n, d in catalogue.NUMERIC_DEFAULTS.items()}
    pool = F.greatest(numbers["worker_pool_size"], F.lit(1.0))
    count, mean = number("prior_type_worker_count", 0.0), number("prior_type_worker_mean_ms")
    has_prior = (count > 0) & mean.isNotNull()
    return (
        {f"type_{t}": mark(kind, t) for t in catalogue.TASK_TYPES}
        | {f"profile_{p}": mark(profile, p) for p in catalogue.PROFILES}
        | {"log_size": size}
        | {f"log_size_x_{t}": size * mark(kind, t) for t in catalogue.TASK_TYPES}
        | numbers
        | {"busy_ratio": numbers["active_threads"] / pool, "queue_ratio": numbers["queue_len"] / pool, "log_avg_exec_recent": F.log1p(least(number("avg_exec_recent")))}
        | {"has_prior": has_prior.cast("double"), "log_prior_mean_ms": F.when(has_prior, F.log1p(least(mean))).otherwise(0.0), "log_prior_count": F.log1p(least(count))}
    )


def resolve_refs(text: Column, results: Column) -> Column:
    """``${task.result}`` replaced by the result in the map, unknown ones by nothing."""
    names = F.regexp_extract_all(text, F.lit(r"\$\{([A-Za-z0-9_-]+)\.result\}"), F.lit(1))
    return F.aggregate(
        F.array_distinct(names), text, lambda acc, n: F.replace(acc, F.concat(F.lit("${"), n, F.lit(".result}")), F.coalesce(F.try_element_at(results, n), F.lit("")))
    )

"""Registered queries over the driver tables, with their SQL twins."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telemill.sources import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, oracle: str | None = None):
    """Register a function of contract views (its parameters' names) under ``name``, with the SQL that it must equal."""

    def keep(f: Callable[..., DataFrame]):
        needed = list(inspect.signature(f).parameters)
        QUERIES[name] = lambda spark, sf_dir: f(*[bindings.view(spark, sf_dir, n) for n in needed])
        if oracle:
            ORACLES[name] = bindings.oracle(oracle)
        return f

    return keep

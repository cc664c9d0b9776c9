"""Imports every module that registers queries."""

from telemill.plans import aggregates, features, files, learning, models, placement  # noqa: F401

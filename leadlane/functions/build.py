"""Reuse of column expressions between plans."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext

T = TypeVar("T")


def built_once(build: Callable[..., T]) -> Callable[..., T]:
    """Keep what a function without DataFrame arguments builds.

    Columns are immutable and name their inputs, so one set serves every plan. Building the several hundred
    expressions of the rule tables anew costs about a second of round trips to the JVM per plan.
    """
    kept: dict = {}

    @wraps(build)
    def get(*args) -> T:
        key = (SparkContext._gateway, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get

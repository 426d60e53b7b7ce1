"""Keeping large column expressions, which are costly to build but do not depend on a DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column


def build_once(fn: Callable[[], Column]) -> Callable[[], Column]:
    """Build the expression once per JVM and reuse it."""
    kept: dict[int, Column] = {}

    @functools.wraps(fn)
    def cached() -> Column:
        key = id(SparkContext._gateway)
        if key not in kept:
            kept[key] = fn()
        return kept[key]

    return cached

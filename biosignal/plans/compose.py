"""Pipelines of DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


def compose(steps: list[Step]) -> Step:
    """One function of several, the last of the list applied first: compose([f, g])(x) = f(g(x))."""
    return lambda df: reduce(lambda d, step: d.transform(step), reversed(steps), df)


def rcompose(steps: list[Step]) -> Step:
    """One function of several, the first of the list applied first: rcompose([f, g])(x) = g(f(x))."""
    return lambda df: reduce(lambda d, step: d.transform(step), steps, df)

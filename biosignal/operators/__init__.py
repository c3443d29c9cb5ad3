"""Relational, ordered, pairwise and sequential operators."""

from biosignal.operators.windows import irregular, rolling  # noqa: F401

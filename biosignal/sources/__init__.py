"""Readers and adapters that project tables to the engine's schemas."""

from biosignal.sources.tables import load, valid_fixes  # noqa: F401

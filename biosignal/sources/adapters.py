"""Adapters from tables to series, for columns that are not named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biosignal.operators.frames import series

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """The numeric columns of a table in order, but for those left out."""
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in without]


def signal(df: DataFrame, entity: str, order: list[str], value: str | None = None) -> DataFrame:
    """(entity, idx, ts_us, x): a series per entity in the order given (its first column is a timestamp); by default of the
    first numeric column that is neither the entity nor part of the order."""
    value = value or numeric_columns(df, (entity, *order))[0]
    return series(df, entity, order, value)


def sampling_rate(df: DataFrame) -> DataFrame:
    """(entity, fs): rate in Hz after the first two rows of each series (entity, idx, ts_us); NULL for a single row."""
    first = df.where(F.col("idx") < 2).groupBy("entity").agg((F.max("ts_us") - F.min("ts_us")).alias("step"))
    return first.select("entity", F.try_divide(F.lit(1e6), F.col("step")).alias("fs"))

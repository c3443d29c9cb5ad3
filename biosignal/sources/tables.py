"""Table readers, and what counts as a valid fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder (a file or a directory of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01, of a timestamp with or without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def is_valid_fix(lat: Column, lon: Column) -> Column:
    """Both coordinates present and in range, and not both zero; NaN is out of range."""
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def valid_fixes(df: DataFrame, *keep: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The valid fixes, with the columns of keep and both coordinates. Repeated rows are still in it."""
    return df.where(is_valid_fix(F.col(lat), F.col(lon))).select(*keep, F.col(lat).cast("double").alias("latitude"), F.col(lon).cast("double").alias("longitude"))


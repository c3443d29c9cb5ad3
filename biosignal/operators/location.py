"""Location features of point series (entity, idx, ts, latitude, longitude)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosignal.functions.scalars import haversine, in_daily_range
from biosignal.operators.frames import near, ordered
from biosignal.operators.information import label_entropy


def successive_distance(df: DataFrame, into: str = "distance") -> DataFrame:
    """Distance in km to the row before; 0 in the first row."""
    w = near()
    d = haversine(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return ordered(df, {into: F.coalesce(d, F.lit(0.0))}, 1, 0)


def home(df: DataFrame, start: str = "23:00", end: str = "06:00", ts: str = "ts") -> DataFrame:
    """(entity, home_lat, home_lon): medians of the rows at night."""
    night = df.where(in_daily_range(ts, start, end))
    return night.groupBy("entity").agg(F.median("latitude").alias("home_lat"), F.median("longitude").alias("home_lon"))


def distance_from_home(df: DataFrame, homes: DataFrame | None = None, into: str = "home_distance", **night) -> DataFrame:
    """Distance in km to the entity's home, which is found at night if not given; NULL without a home."""
    j = df.join(homes if homes is not None else home(df, **night), "entity", "left")
    return j.withColumn(into, haversine("latitude", "longitude", "home_lat", "home_lon")).drop("home_lat", "home_lon")


def proportion_home_stay(df: DataFrame, limit: float = 0.1, homes: DataFrame | None = None, **night) -> DataFrame:
    """(entity, home_stay): share of rows less than `limit` km from home; rows without a place count in the total."""
    d = distance_from_home(df, homes, **night)
    return d.groupBy("entity").agg((F.count_if(F.col("home_distance") < limit) / F.count(F.lit(1))).alias("home_stay"))


def outer_distances(a: DataFrame, b: DataFrame, by: str = "entity") -> DataFrame:
    """(by, i, j, distance): from each point (i, latitude, longitude) of a group of a to each (j, ...) of the same group of b."""
    b = b.select(by, "j", F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"))
    return a.join(b, by).select(by, "i", "j", haversine("latitude", "longitude", "__lat", "__lon").alias("distance"))


def cluster_totals(df: DataFrame, label: str = "label") -> DataFrame:
    """(entity, label, n)."""
    return df.groupBy("entity", label).agg(F.count(F.lit(1)).alias("n"))


def num_clusters(df: DataFrame, label: str = "label", include_noise: bool = True) -> DataFrame:
    """(entity, clusters): distinct labels, the noise label among them unless left out."""
    d = df if include_noise else df.where(F.col(label) != -1)
    return d.groupBy("entity").agg(F.count_distinct(label).alias("clusters"))


def cluster_entropy(df: DataFrame, label: str = "label", normalized: bool = False, include_noise: bool = True) -> DataFrame:
    """(entity, entropy) of the labels; normalized: divided by ln of their number, NULL for one label."""
    e = label_entropy(df, label, include_noise=include_noise)
    return e.select("entity", F.try_divide(F.col("entropy"), F.nullif(F.ln("clusters"), F.lit(0.0))).alias("entropy")) if normalized else e.select("entity", "entropy")

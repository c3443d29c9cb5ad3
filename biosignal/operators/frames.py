"""Order inside an entity without putting an entity into one task.

A series is a table (entity, idx, x) with idx = 0, 1, 2, ... in each entity. Operators that look a bounded number of rows
back and ahead run over chunks of idx with a margin (framed), so that an entity with a third of all rows is spread over
many tasks. Ranks and running sums over a whole entity take two phases: inside chunks, and over the chunks' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biosignal.sources.tables import micros

CHUNK = 8192
DAY_US = 86_400_000_000


def framed(df: DataFrame, before: int, after: int, entity: str = "entity", idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """The rows with a chunk number and own = true, and again, with own = false, for the chunks whose margin they are in."""
    low, high = F.floor((F.col(idx) - after) / chunk).cast("bigint"), F.floor((F.col(idx) + before) / chunk).cast("bigint")
    out = df.withColumn("chunk", F.explode(F.sequence(F.greatest(low, F.lit(0).cast("bigint")), high)))
    return out.withColumn("own", F.floor(F.col(idx) / chunk) == F.col("chunk"))


def near(entity: str = "entity", idx: str = "idx"):
    """The window of a chunk in order."""
    return Window.partitionBy(entity, "chunk").orderBy(idx)


def owned(df: DataFrame) -> DataFrame:
    return df.where("own").drop("chunk", "own")


def ordered(df: DataFrame, columns: dict[str, Column], before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Add columns that look at most `before` rows back and `after` rows ahead, over the window near()."""
    return owned(framed(df, before, after, chunk=chunk).withColumns(columns))


def series(df: DataFrame, entity: Column | str, order: list[str], value: Column | str, keep: dict[str, Column] | None = None, bucket_us: int = DAY_US, name: str = "x") -> DataFrame:
    """(entity, idx, ts_us, x, kept columns): a series per entity in the order given, whose first column is a timestamp.

    Rows without an entity or a time take no part. Ties of the order are broken by the value. The rank inside a bucket of
    time is added to the number of rows in the buckets before it.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rest = [f"__o{k}" for k in range(1, len(order))]
    base = df.where(F.col(order[0]).isNotNull()).select(col(entity).alias("entity"), micros(order[0]).alias("ts_us"), *[F.col(o).alias(r) for o, r in zip(order[1:], rest, strict=True)], col(value).cast("double").alias(name), *[c.alias(n) for n, c in (keep or {}).items()])
    base = base.where(F.col("entity").isNotNull()).withColumn("__b", F.floor(F.col("ts_us") / bucket_us).cast("bigint"))
    counts = base.groupBy("entity", "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("entity").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("entity", "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("entity", "__b").orderBy("ts_us", *rest, name)
    out = base.withColumn("__r", F.row_number().over(inside) - 1).join(counts, ["entity", "__b"])
    return out.withColumn("idx", (F.col("__r") + F.col("__before")).cast("bigint")).drop("__b", "__r", "__before", *rest)


def running_sum(df: DataFrame, value: Column | str, into: str, chunk: int = CHUNK) -> DataFrame:
    """Add the sum of `value` up to each row of its entity; a NULL adds nothing."""
    v = F.col(value) if isinstance(value, str) else value
    c = df.withColumn("__v", v).withColumn("__c", F.floor(F.col("idx") / chunk).cast("bigint"))
    totals = c.groupBy("entity", "__c").agg(F.sum("__v").alias("__t"))
    w = Window.partitionBy("entity").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("entity", "__c", F.coalesce(F.sum("__t").over(w), F.lit(0.0)).alias("__before"))
    inside = Window.partitionBy("entity", "__c").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    out = c.withColumn("__s", F.sum("__v").over(inside)).join(totals, ["entity", "__c"])
    return out.withColumn(into, F.col("__s") + F.col("__before")).drop("__v", "__c", "__s", "__before")

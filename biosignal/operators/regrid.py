"""Irregular readings onto a regular grid, by intervals of validity.

A reading is taken as a step function: it holds from its time to that of the next reading of the same value column, to
the end of the hold or to the end of the recording. These intervals are cut at the edges of the grid's cells; a cell's
mean is weighted by time, its coverage is the part of the cell that some interval covers.

All of it is columns and window frames. A recording is cut into blocks of `block` cells; a reading goes to the blocks
that its hold reaches (one, seldom two), so one recording with a third of all rows is spread over many tasks, and a
single exchange by (source, block) serves the order, the intervals and the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biosignal.sources.tables import micros


def _div(a: Column, b: Column) -> Column:
    """Integer quotient, rounded down; b is positive."""
    return F.floor((a - F.pmod(a, b)) / b).cast("bigint")


def regular_grid(readings: DataFrame, recordings: DataFrame, values: list[str], source: str = "rec_id", order: str = "idx", ts: str = "ts", started: str = "started", ended: str = "ended", step_ms: str = "step_ms", *, hold_steps: int = 4, block: int = 1024) -> DataFrame:
    """A row per recording and grid cell: (source, slot, start_us) and, of each value column v, v_mean, v_coverage, v_readings.

    v_readings counts the readings with a time in the cell and a value that is neither NULL nor NaN. v_mean is weighted
    by time over the covered part and NULL where nothing covers the cell: such a period is marked by v_coverage = 0.
    Of readings at the same time the last by `order` holds; rows that repeat (source, order, time) count once. Readings
    without a source, or with a time outside [started, ended), take no part. Recordings without start, end or a positive
    step have no grid; recordings without readings have one without coverage. Other columns of either input are ignored.
    """
    r = recordings.select(F.col(source).alias("source"), micros(started).alias("t0"), micros(ended).alias("t1"), (F.col(step_ms).cast("bigint") * 1000).alias("step"))
    r = r.where((F.col("step") > 0) & (F.col("t1") > F.col("t0")) & F.col("source").isNotNull())
    span = F.col("step") * block
    x = readings.select(F.col(source).alias("source"), F.col(order).alias("ord"), micros(ts).alias("us"), *[F.nanvl(F.col(v).cast("double"), F.lit(None)).alias(f"v{k}") for k, v in enumerate(values)])
    x = x.join(r, "source").where((F.col("us") >= F.col("t0")) & (F.col("us") < F.col("t1")))
    x = x.withColumn("us", F.col("us") - F.col("t0")).withColumn("len", F.col("t1") - F.col("t0")).drop("t0", "t1")
    reach = F.least(F.col("us") + F.col("step") * hold_steps - 1, F.col("len") - 1)
    x = x.withColumn("blk", F.explode(F.sequence(_div(F.col("us"), span), _div(F.greatest(reach, F.col("us")), span))))
    x = x.repartition("source", "blk")

    w = Window.partitionBy("source", "blk").orderBy("us", "ord")
    again = F.coalesce((F.lag("us").over(w) == F.col("us")) & F.lag("ord").over(w).eqNullSafe(F.col("ord")), F.lit(False))
    x = x.withColumn("again", again).where(~F.col("again")).drop("again")
    for k in range(len(values)):
        x = x.withColumn(f"t{k}", F.when(F.col(f"v{k}").isNotNull(), F.col("us")))
    over = "OVER (PARTITION BY source, blk ORDER BY us, ord)"
    for k in range(len(values)):
        x = x.withColumn(f"n{k}", F.expr(f"lead(t{k}) IGNORE NULLS {over}"))
    hold = F.col("us") + F.col("step") * hold_steps
    for k in range(len(values)):
        until = F.least(hold, F.col("len"), F.col(f"n{k}"))
        x = x.withColumn(f"n{k}", F.when(F.col(f"t{k}").isNotNull(), F.greatest(until, F.col("us"))))
    last = F.greatest(F.col("us"), *[F.coalesce(F.col(f"n{k}") - 1, F.col("us")) for k in range(len(values))])
    first_slot, last_slot = F.col("blk") * block, F.col("blk") * block + block - 1
    low, high = F.greatest(_div(F.col("us"), F.col("step")), first_slot), F.least(_div(last, F.col("step")), last_slot)
    x = x.withColumn("slot", F.explode(F.when(low <= high, F.sequence(low, high))))
    a, b = F.col("slot") * F.col("step"), F.least((F.col("slot") + 1) * F.col("step"), F.col("len"))
    parts: list[Column] = []
    for k in range(len(values)):
        weight = F.greatest(F.least(F.col(f"n{k}"), b) - F.greatest(F.col("us"), a), F.lit(0))
        weight = F.when(F.col(f"t{k}").isNotNull(), weight).otherwise(F.lit(0)).cast("bigint")
        here = (F.col(f"t{k}").isNotNull() & (F.col("us") >= a) & (F.col("us") < b)).cast("bigint")
        parts += [weight.alias(f"w{k}"), F.when(weight > 0, F.col(f"v{k}") * weight).otherwise(F.lit(0.0)).alias(f"s{k}"), here.alias(f"c{k}"), F.when(here == 1, F.col(f"v{k}")).otherwise(F.lit(0.0)).alias(f"p{k}")]
    cells = x.select("source", "blk", "slot", *parts)

    slots = F.ceil((F.col("t1") - F.col("t0")) / F.col("step")).cast("bigint")
    grid = r.select("source", "step", "t0", "t1", slots.alias("slots")).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), _div(F.col("slots") - 1, F.lit(block)))))
    grid = grid.repartition("source", "blk").withColumn("slot", F.explode(F.sequence(F.col("blk") * block, F.least(F.col("blk") * block + block, F.col("slots")) - 1)))
    length = F.least((F.col("slot") + 1) * F.col("step"), F.col("t1") - F.col("t0")) - F.col("slot") * F.col("step")
    none = [F.lit(0).cast("bigint"), F.lit(0.0), F.lit(0).cast("bigint"), F.lit(0.0)] * len(values)
    names = [f"{c}{k}" for k in range(len(values)) for c in "wscp"]
    empty = grid.select("source", "blk", "slot", *[z.alias(n) for z, n in zip(none, names, strict=True)], (F.col("t0") + F.col("slot") * F.col("step")).alias("start_us"), length.alias("length"))
    both = cells.select("*", F.lit(None).cast("bigint").alias("start_us"), F.lit(None).cast("bigint").alias("length")).unionByName(empty)
    total = both.groupBy("source", "blk", "slot").agg(*[F.sum(n).alias(n) for n in names], F.max("start_us").alias("start_us"), F.max("length").alias("length"))
    out = [F.col("source").alias(source), "slot", "start_us"]
    for k, v in enumerate(values):
        mean = F.when(F.col(f"w{k}") > 0, F.col(f"s{k}") / F.col(f"w{k}")).otherwise(F.try_divide(F.col(f"p{k}"), F.col(f"c{k}")))
        out += [mean.alias(f"{v}_mean"), (F.col(f"w{k}") / F.col("length")).alias(f"{v}_coverage"), F.col(f"c{k}").alias(f"{v}_readings")]
    return total.select(*out)


def missing_cells(grid: DataFrame, values: list[str], source: str = "rec_id") -> DataFrame:
    """(source, axis, slot) of the cells without a reading, of each value column."""
    axes = F.explode(F.array_compact(F.array(*[F.when(F.col(f"{v}_readings") == 0, F.lit(v)) for v in values])))
    return grid.select(source, axes.alias("axis"), "slot")

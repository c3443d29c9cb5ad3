"""Ordered maps and time-domain features of series (entity, idx, x)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biosignal.functions import aggregates as A
from biosignal.functions.scalars import dead_band
from biosignal.operators.frames import CHUNK, framed, near, ordered, owned, running_sum


def _gradient(x: Column) -> Column:
    before, after = F.lag(x).over(near()), F.lead(x).over(near())
    return F.coalesce((after - before) / 2, after - x, x - before)


def gradient(df: DataFrame, x: str = "x", into: str = "gradient", chunk: int = CHUNK) -> DataFrame:
    """Central differences, one-sided at the ends; NULL for a series of one row."""
    return ordered(df, {into: _gradient(F.col(x))}, 1, 1, chunk)


def zero_crossings(df: DataFrame, x: str = "x", threshold: float = 0.0, into: str = "crossing") -> DataFrame:
    """Whether the sign (positive or not) changes from the row before; the first row of a series is left out."""
    flat = dead_band(x, threshold)
    out = framed(df, 1, 0).withColumn("__p", flat > 0)
    out = out.withColumn(into, F.col("__p") != F.lag("__p").over(near()))
    return owned(out).where(F.col(into).isNotNull()).drop("__p")


def moving_average(df: DataFrame, window: int, x: str = "x", into: str = "average") -> DataFrame:
    """Centred box filter over zero-padded rows, divided by the window even at the ends."""
    back, ahead = window // 2, (window - 1) // 2
    return ordered(df, {into: F.sum(x).over(near().rowsBetween(-back, ahead)) / window}, back, ahead)


def pt_differentiate(df: DataFrame, x: str = "x", into: str = "derivative", five_point: bool = False) -> DataFrame:
    """x / 8, or with five_point the five-point derivative with zeros before the start."""
    if not five_point:
        return df.withColumn(into, F.col(x) / 8)
    at = lambda k: F.lag(x, k, 0.0).over(near())
    return ordered(df, {into: (F.col(x) + 2 * at(1) - 2 * at(3) - at(4)) / 8}, 4, 0)


def slope_sum(df: DataFrame, window: int, x: str = "x", into: str = "slope_sum", rectify: bool = False) -> DataFrame:
    """Sum of the `window` differences before each row; 0 in the first `window` rows and the last. rectify: rising ones only."""
    if not rectify:
        total = F.col(x) - F.lag(x, window).over(near())
        back = window
    else:
        step = F.greatest(F.col(x) - F.lag(x).over(near()), F.lit(0.0))
        df = ordered(df, {"__step": step}, 1, 0)
        total, back = F.sum("__step").over(near().rowsBetween(-(window - 1), 0)), window
    inside = (F.col("idx") >= window) & F.lead(x).over(near()).isNotNull()
    return ordered(df, {into: F.when(inside, total).otherwise(F.lit(0.0))}, back, 1).drop("__step")


def find_peaks(df: DataFrame, x: str = "x", comp: Callable[[Column, Column], Column] = lambda a, b: a > b) -> DataFrame:
    """The interior rows that compare with both neighbours."""
    v = F.col(x)
    return ordered(df, {"__peak": comp(v, F.lag(x).over(near())) & comp(v, F.lead(x).over(near()))}, 1, 1).where("__peak").drop("__peak")


def pairwise(df: DataFrame, x: str = "x") -> DataFrame:
    """(entity, idx, x, next): consecutive pairs."""
    return ordered(df, {"next": F.lead(x).over(near()), "__there": F.lead("idx").over(near())}, 0, 1).where(F.col("__there").isNotNull()).drop("__there")


def count(df: DataFrame, start: int = 0, step: int = 1, into: str = "count") -> DataFrame:
    """start, start + step, ... along each series."""
    return df.withColumn(into, F.lit(start) + F.lit(step) * F.col("idx"))


def differences(df: DataFrame, x: str = "x", into: str = "diff") -> DataFrame:
    """x less the row before; NULL in the first row."""
    return ordered(df, {into: F.col(x) - F.lag(x).over(near())}, 1, 0)


def line_length(df: DataFrame) -> DataFrame:
    return differences(df).groupBy("entity").agg(A.line_length("diff").alias("line_length"))


def zero_crossing_count(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    flags = zero_crossings(df, threshold=threshold).groupBy("entity").agg(F.sum(F.col("crossing").cast("bigint")).alias("crossings"))
    return df.select("entity").distinct().join(flags, "entity", "left").select("entity", F.coalesce("crossings", F.lit(0).cast("bigint")).alias("crossings"))


def with_derivatives(df: DataFrame) -> DataFrame:
    """Add the first and second derivative of x as d1 and d2."""
    return owned(framed(df, 2, 2).withColumn("d1", _gradient(F.col("x"))).withColumn("d2", _gradient(F.col("d1"))))


def hjorth_parameters(df: DataFrame) -> DataFrame:
    """(entity, activity, mobility, complexity)."""
    a = {"activity": A.hjorth_activity("x"), "mobility": A.hjorth_mobility("x", "d1"), "complexity": A.hjorth_complexity("x", "d1", "d2")}
    return with_derivatives(df).groupBy("entity").agg(*[c.alias(n) for n, c in a.items()])


def hurst(df: DataFrame, lags: range = range(2, 64)) -> DataFrame:
    """(entity, hurst): twice the slope of ln of the root of the deviation of x[t + lag] - x[t] on ln lag; NULL for short series.

    All lags are frames of one window, and one aggregate.
    """
    f = owned(framed(df, 0, max(lags)).withColumns({f"d{k}": F.lead("x", k).over(near()) - F.col("x") for k in lags}))
    a = f.groupBy("entity").agg(*[F.stddev_pop(f"d{k}").alias(f"s{k}") for k in lags], F.count(F.lit(1)).alias("n"))
    points = F.array(*[F.struct(F.lit(float(np.log(k))).alias("u"), F.when(F.col(f"s{k}") > 0, F.ln(F.sqrt(f"s{k}"))).alias("v")) for k in lags])
    p = a.withColumn("p", F.explode(points))
    whole = (F.count("p.v") == len(lags)) & (F.max("n") > max(lags) + 1)
    return p.groupBy("entity").agg(F.when(whole, 2 * F.regr_slope("p.v", "p.u")).alias("hurst"))


def profile(df: DataFrame) -> DataFrame:
    """Running sum of x less the series' mean."""
    m = df.groupBy("entity").agg(F.avg("x").alias("__m"))
    return running_sum(df.join(m, "entity"), F.col("x") - F.col("__m"), "profile").drop("__m")


def dfa(df: DataFrame, windows: list[int], order: int = 1, overlap: float = 0) -> DataFrame:
    """(entity, dfa): slope of ln F(w) on ln w, F(w) the mean over windows of the root mean square residual of a fit of the
    profile. Windows of at most order + 1 rows and series with fewer rows than the largest window give NULL."""
    p = profile(df)
    steps = {w: max(int(w * (100 - overlap) / 100), 1) for w in windows}
    sizes = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(steps[w]).alias("step")) for w in windows]))
    p = p.select("entity", "idx", "profile", sizes.alias("s")).select("entity", "idx", "profile", "s.w", "s.step")
    low = F.greatest(F.ceil((F.col("idx") - F.col("w") + 1) / F.col("step")), F.lit(0)).cast("bigint")
    p = p.withColumn("k", F.explode(F.sequence(low, F.floor(F.col("idx") / F.col("step")).cast("bigint"))))
    # residuals of the fit from orthogonal polynomials of the place in the window: their sums add up on the map side
    w, u = F.col("w").cast("double"), (F.col("idx") - F.col("k") * F.col("step")).cast("double")
    q, square = [F.lit(1.0), u - (w - 1) / 2], w
    for j in range(1, order):
        q.append(q[1] * q[j] - j * j * (w * w - j * j) / (4 * (4 * j * j - 1)) * q[j - 1])
    p = p.withColumns({f"q{j}": q[j] for j in range(1, order + 1)})
    fits = p.groupBy("entity", "w", "k").agg(F.count(F.lit(1)).alias("n"), F.var_pop("profile").alias("yy"), *[F.covar_pop(f"q{j}", "profile").alias(f"c{j}") for j in range(1, order + 1)])
    fits = fits.where((F.col("n") == F.col("w")) & (F.col("w") > order + 1))
    explained = F.lit(0.0)
    for j in range(1, order + 1):
        square = square * (w * w - j * j) * (j * j / (4 * (4 * j * j - 1)))  # sum of the squares of q_j
        explained = explained + F.col(f"c{j}") * F.col(f"c{j}") * w * w / square
    fits = fits.withColumn("ssr", F.greatest(F.col("yy") * w - explained, F.lit(0.0)))
    f = fits.groupBy("entity", "w").agg(F.avg(F.sqrt(F.col("ssr") / F.col("w"))).alias("f"))
    whole = F.count(F.when(F.col("f") > 0, 1)) == len(windows)
    return f.groupBy("entity").agg(F.when(whole, F.regr_slope(F.when(F.col("f") > 0, F.ln("f")), F.ln("w"))).alias("dfa"))

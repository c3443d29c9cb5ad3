"""Features over windows of a series: count windows, windows of time over an irregular index, and given bounds.

Every function takes its features as {name: feature}; one pass computes them all. A feature is one of

* an aggregate column over the window's rows, such as F.avg("x");
* a function of `Rows`, which gives such a column from values that look at neighbours, such as lambda w: A.rmssd(w.d).
  What looks over an edge of the window is NULL, as if the window were a series of its own: the first difference of a
  window is that of its second row;
* opaque(f): any Python function of the window's values in order. The values of a window meet in one array for it.

The first two kinds are sums that add up on the map side; rows meet their windows by arithmetic on their place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biosignal.operators.frames import CHUNK, framed, near, owned

REACH = 2


class Rows:
    """The columns of a window's rows: x, the values k rows before and after, and what follows from them."""

    def __init__(self, x: str):
        self.x = F.col(x)

    def before(self, k: int = 1) -> Column:
        return F.col(f"__x-{k}")

    def after(self, k: int = 1) -> Column:
        return F.col(f"__x+{k}")

    @property
    def d(self) -> Column:
        """x less the row before; NULL in the window's first row."""
        return self.x - self.before()

    @property
    def s(self) -> Column:
        """x plus the row before."""
        return self.x + self.before()

    @staticmethod
    def _slope(before: Column, here: Column, after: Column) -> Column:
        return F.coalesce((after - before) / 2, after - here, here - before)

    @property
    def d1(self) -> Column:
        """First derivative: central differences, one-sided at the window's ends."""
        return self._slope(self.before(), self.x, self.after())

    @property
    def d2(self) -> Column:
        """Derivative of the first derivative."""
        back = F.when(self.before().isNotNull(), self._slope(self.before(2), self.before(), self.x))
        ahead = F.when(self.after().isNotNull(), self._slope(self.x, self.after(), self.after(2)))
        return self._slope(back, self.d1, ahead)

    def crossing(self, threshold: float = 0.0) -> Column:
        """Whether the sign (positive or not, values up to the threshold being none) changes from the row before."""
        sign = lambda c: F.when(F.abs(c) <= threshold, F.lit(0.0)).otherwise(c) > 0
        return F.when(self.before().isNotNull(), sign(self.x) != sign(self.before()))


Feature = Column | Callable[[Rows], Column]


class opaque:
    """A feature by a Python function of the window's values, an array in order. NULLs are NaN. The result may have any shape
    that `returns` can say, such as "array<double>"."""

    def __init__(self, function: Callable[[np.ndarray], object], returns: str = "double"):
        self.function, self.returns = function, returns

    def held(self, x: str, order: str) -> Column:
        return F.collect_list(F.struct(order, x))

    def applied(self, held: str, x: str) -> Column:
        f = self.function

        def run(windows: pd.Series) -> pd.Series:
            return pd.Series([None if w is None else f(np.array(w, float)) for w in windows])

        run.__annotations__ = {"windows": pd.Series, "return": pd.Series}
        values = F.transform(F.array_sort(held), lambda r: F.coalesce(r[x].cast("double"), F.lit(float("nan"))))
        return F.pandas_udf(run, self.returns)(values)


def _columns(features: dict, x: str, order: str) -> dict[str, Column]:
    """The features as aggregate columns; an opaque one as the array it will be applied to."""
    return {n: f if isinstance(f, Column) else f.held(x, order) if isinstance(f, opaque) else f(Rows(x)) for n, f in features.items()}


def _finished(df: DataFrame, features: dict, x: str) -> DataFrame:
    return df.withColumns({n: f.applied(n, x) for n, f in features.items() if isinstance(f, opaque)})


def _looks_around(features: dict) -> bool:
    return any(not isinstance(f, (Column, opaque)) for f in features.values())


def _neighbours(df: DataFrame, x: str, place: str) -> DataFrame:
    """Add the values and places of the rows up to REACH before and after."""
    added = {}
    for k in range(1, REACH + 1):
        for sign, f in (("-", F.lag), ("+", F.lead)):
            added |= {f"__x{sign}{k}": f(x, k).over(near()), f"__at{sign}{k}": f(place, k).over(near())}
    return owned(framed(df, REACH, REACH).withColumns(added))


def _cut(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Neighbours that are not in low <= place < high are NULL."""
    names = [f"{s}{k}" for k in range(1, REACH + 1) for s in "-+"]
    return rows.withColumns({f"__x{n}": F.when((F.col(f"__at{n}") >= low) & (F.col(f"__at{n}") < high), F.col(f"__x{n}")) for n in names})


def view(df: DataFrame, size: int, step: int = 1, x: str = "x") -> DataFrame:
    """(entity, window, values): the rows of each full window of `size` rows as an array."""
    return rolling(df, {"values": F.collect_list(x)}, size, step)


def rolling(df: DataFrame, features: dict[str, Feature | opaque], size: int, step: int = 1, chunk: int = CHUNK, x: str = "x") -> DataFrame:
    """(entity, window, features): count windows [window * step, window * step + size), full ones only."""
    if size < 1 or step < 1:
        raise ValueError("size and step must be positive")
    if _looks_around(features):
        low = F.greatest(F.ceil((F.col("idx") - size + 1) / step), F.lit(0)).cast("bigint")
        high = F.floor(F.col("idx") / step).cast("bigint")
        rows = _neighbours(df, x, "idx").withColumn("window", F.explode(F.when(low <= high, F.sequence(low, high))))
        start = F.col("window") * step
        a = _aggregated(_cut(rows, start, start + size), _columns(features, x, "idx"), size)
        return _finished(a, features, x).select("entity", "window", *features)
    frame = near().rowsBetween(0, size - 1)
    f = framed(df, 0, size - 1, chunk=chunk).withColumns({**{n: c.over(frame) for n, c in _columns(features, x, "idx").items()}, "__n": F.count(F.lit(1)).over(frame)})
    f = owned(f).where((F.col("idx") % step == 0) & (F.col("__n") == size))
    return _finished(f, features, x).select("entity", (F.col("idx") / step).cast("bigint").alias("window"), *features)


def over_bounds(df: DataFrame, bounds: DataFrame, features: dict[str, Feature | opaque], min_window_len: int = 1, block: int = 4096, x: str = "x") -> DataFrame:
    """(entity, window, features): over the rows lo <= idx < hi of each row (entity, window, lo, hi) of bounds.

    Windows with fewer than min_window_len rows have NULL features. Rows meet windows by blocks of idx.
    """
    b = bounds.where(F.col("lo") < F.col("hi")).select("entity", "window", "lo", "hi")
    b = b.withColumn("__b", F.explode(F.sequence(F.floor(F.col("lo") / block).cast("bigint"), F.floor((F.col("hi") - 1) / block).cast("bigint"))))
    rows = (_neighbours(df, x, "idx") if _looks_around(features) else df).withColumn("__b", F.floor(F.col("idx") / block).cast("bigint"))
    j = rows.join(b, ["entity", "__b"]).where((F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")))
    if _looks_around(features):
        j = _cut(j, F.col("lo"), F.col("hi"))
    return _guarded(j, bounds.select("entity", "window"), features, min_window_len, x, "idx")


def _aggregated(rows: DataFrame, columns: dict[str, Column], least: int) -> DataFrame:
    g = rows.groupBy("entity", "window")
    count, others = F.count(F.lit(1)).alias("__n"), [c.alias(n) for n, c in columns.items()]
    a = g.agg(count, *others)
    try:
        a._jdf.queryExecution().sparkPlan()
    except AnalysisException:  # pandas aggregates stand in no plan with those of the engine
        a = g.agg(*others).join(g.agg(count), ["entity", "window"])
    return a.where(F.col("__n") >= max(1, least)).drop("__n")


def _guarded(rows: DataFrame, grid: DataFrame, features: dict[str, Feature | opaque], least: int, x: str, order: str) -> DataFrame:
    a = _finished(_aggregated(rows, _columns(features, x, order), least), features, x)
    return grid.join(a, ["entity", "window"], "left").select(*grid.columns, *features)


def time_grid(df: DataFrame, size: int, step: int, ts: str = "ts_us") -> DataFrame:
    """(entity, t0, windows): windows start at the first row's time and every step before the last row's."""
    g = df.groupBy("entity").agg(F.min(ts).alias("t0"), F.max(ts).alias("__t1"))
    return g.select("entity", "t0", F.ceil((F.col("__t1") - F.col("t0")) / step).cast("bigint").alias("windows")).where(F.col("windows") > 0)


def irregular(df: DataFrame, features: dict[str, Feature | opaque], size: int, step: int, min_window_len: int = 1, ts: str = "ts_us", x: str = "x") -> DataFrame:
    """(entity, window, start, features): windows of `size` over an integer index such as microseconds, one every `step`.

    They are anchored at each entity's first row; the last ones may be partial; empty ones are kept with NULL features.
    Features that look at neighbours or at an order need `idx`, the order of the rows.
    """
    grid = time_grid(df, size, step, ts)
    o = F.col(ts) - F.col("t0")
    low = F.greatest(F.floor((o - size) / step) + 1, F.lit(0)).cast("bigint")
    high = F.least(F.floor(o / step).cast("bigint"), F.col("windows") - 1)
    rows = (_neighbours(df, x, ts) if _looks_around(features) else df).join(grid, "entity")
    rows = rows.withColumn("window", F.explode(F.when(low <= high, F.sequence(low, high))))
    start = F.col("t0") + F.col("window") * step
    if _looks_around(features):
        rows = _cut(rows, start, start + size)
    whole = grid.withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("windows") - 1)))
    return _guarded(rows, whole.select("entity", "window", start.alias("start")), features, min_window_len, x, "idx" if "idx" in df.columns else ts)

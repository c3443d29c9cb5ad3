"""Heart-rate variability of interval series (entity, idx, nni)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biosignal.functions import aggregates as A
from biosignal.functions.scalars import td_factor
from biosignal.operators import windows
from biosignal.operators.frames import framed, near, owned, running_sum
from biosignal.session import materialise


def with_steps(df: DataFrame) -> DataFrame:
    """Add d, the difference from the interval before, and s, the sum with it; NULL in the first row."""
    before = F.lag("nni").over(near())
    return owned(framed(df, 1, 0).withColumn("d", F.col("nni") - before).withColumn("s", F.col("nni") + before))


def time_domain(df: DataFrame, unit: str = "ms", x: float = 50.0) -> DataFrame:
    """(entity, sdnn, rmssd, sdsd, ssd, pnnx): one window pass and one aggregate. x in ms."""
    a = {"sdnn": A.sdnn("nni"), "rmssd": A.rmssd("d"), "sdsd": A.sdsd("d"), "ssd": A.ssd("d"), "pnnx": A.pnnx("d", unit, x)}
    return with_steps(df).groupBy("entity").agg(*[c.alias(n) for n, c in a.items()])


def poincare(df: DataFrame, factor: float = 1 / math.sqrt(2)) -> DataFrame:
    """(entity, sd1, sd2, csi, cvi, mcsi) of the Lorenz plot."""
    a = {"sd1": A.csi_sd1("d", factor), "sd2": A.csi_sd2("s", factor), "csi": A.lorenz_csi("d", "s"), "cvi": A.lorenz_cvi("d", "s"), "mcsi": A.lorenz_mcsi("d", "s")}
    return with_steps(df).groupBy("entity").agg(*[c.alias(n) for n, c in a.items()])


def cumulative(df: DataFrame) -> DataFrame:
    """Add the running sum of the intervals as `elapsed`."""
    return running_sum(df, "nni", "elapsed")


def windowed_deviation(df: DataFrame, interval: float = 300, unit: str | None = None, ts: str | None = None, skip_empty: bool = False) -> DataFrame:
    """(entity, sdann, sdnni): deviation of the windows' means, mean of the windows' deviations; windows of `interval` s.

    ts: an index in microseconds. Without one the index is the running sum of the intervals, whose unit must be given. An
    empty window makes both NULL unless skip_empty.
    """
    if ts is None:
        if unit is None:
            raise ValueError("give an index or the unit of the intervals")
        micro = td_factor(unit) / 1e3
        # read for the windows and for the rows: written once, as running sums read their input twice already
        df, ts = materialise(cumulative(df).select("entity", "nni", F.round(F.col("elapsed") * micro).cast("bigint").alias("__us"))), "__us"
    size = int(interval * 1e6)
    w = windows.irregular(df, {"m": F.avg("nni"), "s": F.stddev_pop("nni")}, size, size, ts=ts)
    whole = F.lit(True) if skip_empty else F.count("m") == F.count(F.lit(1))
    return w.groupBy("entity").agg(F.when(whole, F.stddev_pop("m")).alias("sdann"), F.when(whole, F.avg("s")).alias("sdnni"))


def peak_frequency(spectrum: DataFrame, low: float | None = None, high: float | None = None, aligned: bool = False) -> DataFrame:
    """(entity, peak): frequency at the largest density of [low, high], of a spectrum (entity, k, freq, psd).

    By default the position among the masked rows is looked up among all rows; aligned: the frequency of the row itself.
    """
    from biosignal.functions.scalars import in_band

    w = Window.partitionBy("entity").orderBy("freq")
    masked = spectrum.where(in_band("freq", low, high)).withColumn("at", F.row_number().over(w))
    best = masked.groupBy("entity").agg(F.max_by(F.struct("at", "freq"), F.struct(F.col("psd"), -F.col("freq"))).alias("b"))
    if aligned:
        return best.select("entity", F.col("b.freq").alias("peak"))
    all_ = spectrum.withColumn("at", F.row_number().over(w)).select("entity", "at", F.col("freq").alias("peak"))
    return best.select("entity", F.col("b.at").alias("at")).join(all_, ["entity", "at"]).select("entity", "peak")

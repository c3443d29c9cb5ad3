"""Aggregates over a series: columns to use in agg(), or over a frame. NULL is skipped, an undefined result is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minmax(x) -> Column:
    return F.struct(F.min(x).alias("min"), F.max(x).alias("max"))


def drange(x) -> Column:
    return F.max(x) - F.min(x)


def interquartile_range(x) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(x, 0.75) - F.percentile(x, 0.25)


def mode(x) -> Column:
    """The most frequent value, the smallest of ties."""
    return F.mode(x, True)


def skewness(x) -> Column:
    """Population skewness; 0 for a constant."""
    return F.when(F.count(x) > 0, F.coalesce(F.skewness(x), F.lit(0.0)))


def kurtosis(x) -> Column:
    """Fourth moment over squared variance, not the excess; 0 for a constant."""
    return F.when(F.count(x) > 0, F.coalesce(F.kurtosis(x) + 3, F.lit(0.0)))


def kurtosis_excess(x) -> Column:
    """kurtosis less 3, so -3 for a constant."""
    return kurtosis(x) - 3


def coeff_var(x) -> Column:
    return F.try_divide(F.stddev_pop(x), F.avg(x))


mean, median, std, var, dmin, dmax = F.avg, F.median, F.stddev_pop, F.var_pop, F.min, F.max


def percentile(x, q: float) -> Column:
    """Exact percentile, q from 0 to 100, with linear interpolation."""
    return F.percentile(x, q / 100)


def o1fit(x, y) -> Column:
    """Least-squares line: struct(intercept, slope)."""
    return F.struct(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def magnitude_dot(x, y, z) -> Column:
    """Root of the sum of all squares of three axes."""
    x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
    return F.sqrt(F.sum(x * x + y * y + z * z))


def location_variance(lat, lon, log: bool = False) -> Column:
    v = F.var_pop(lat) + F.var_pop(lon)
    return F.ln(v) if log else v


def power_band(psd, freq, low: float | None = None, high: float | None = None) -> Column:
    """Sum of magnitudes with low <= freq <= high."""
    from biosignal.functions.scalars import in_band

    return F.coalesce(F.sum(F.when(in_band(freq, low, high), F.abs(psd))), F.lit(0.0))


def relative_power_band(psd, freq, low: float | None = None, high: float | None = None) -> Column:
    return F.try_divide(power_band(psd, freq, low, high), F.sum(F.abs(psd)))


def peak_frequency(psd, freq, low: float | None = None, high: float | None = None) -> Column:
    """Frequency of the largest density in [low, high); the lowest of ties."""
    from biosignal.functions.scalars import in_band

    freq = F.col(freq) if isinstance(freq, str) else freq
    return F.max_by(freq, F.when(in_band(freq, low, high, half_open=True), F.struct(F.col(psd) if isinstance(psd, str) else psd, -freq)))


# Features of a series with the columns that frames give it: d = x less the row before, s = x plus the row before, and the
# first two derivatives d1 and d2. As aggregates they work over a whole series and over any window.


def line_length(d) -> Column:
    return F.coalesce(F.sum(F.abs(d)), F.lit(0.0))


def crossing_count(flag) -> Column:
    return F.coalesce(F.sum(F.col(flag).cast("bigint") if isinstance(flag, str) else flag.cast("bigint")), F.lit(0).cast("bigint"))


def hjorth_activity(x) -> Column:
    return F.var_pop(x)


def hjorth_mobility(x, d1) -> Column:
    return F.sqrt(F.try_divide(F.var_pop(d1), F.var_pop(x)))


def hjorth_complexity(x, d1, d2) -> Column:
    return F.try_divide(hjorth_mobility(d1, d2), hjorth_mobility(x, d1))


def sdnn(nni) -> Column:
    return F.stddev_pop(nni)


def rmssd(d) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.sqrt(F.avg(d * d))


def ssd(d) -> Column:
    return F.sum(d)


def sdsd(d) -> Column:
    return F.stddev_pop(d)


def pnnx(d, unit: str = "ms", x: float = 50.0) -> Column:
    """Share of steps of more than x milliseconds, either way; d is in the unit."""
    from biosignal.functions.scalars import td_factor

    d = F.col(d) if isinstance(d, str) else d
    return F.avg(F.when(d.isNotNull(), (F.abs(d) > x * 1e6 / td_factor(unit)).cast("double")))


def pnn50(d, unit: str = "ms") -> Column:
    return pnnx(d, unit, 50.0)


def csi_sd1(d, factor: float = 0.5**0.5) -> Column:
    return factor * F.stddev_pop(d)


def csi_sd2(s, factor: float = 0.5**0.5) -> Column:
    return factor * F.stddev_pop(s)


def lorenz_csi(d, s) -> Column:
    return F.try_divide(csi_sd1(d), csi_sd2(s))


def lorenz_cvi(d, s) -> Column:
    """Logarithm of SD1 SD2; NULL where it is zero."""
    product = csi_sd1(d) * csi_sd2(s)
    return F.when(product > 0, F.log10(product))


def lorenz_mcsi(d, s) -> Column:
    return F.try_divide(csi_sd1(d) * csi_sd1(d), csi_sd2(s))

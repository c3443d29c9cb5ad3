"""Row-scalar functions: columns in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Twice the earth's radius in km, and nanoseconds of each unit of time.
DIAMETER_KM = 12742.018
UNIT_NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km of points in degrees."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(DIAMETER_KM) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def roll(y, z) -> Column:
    """Roll angle in degrees."""
    return F.degrees(F.atan2(_c(y), _c(z)))


def pitch(x, y, z) -> Column:
    """Pitch angle in degrees."""
    return F.degrees(F.atan2(-_c(x), F.sqrt(_c(y) * _c(y) + _c(z) * _c(z))))


def magnitude(x, y, z) -> Column:
    """Length of the vector of three axes."""
    return F.sqrt(_c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z))


def td_factor(unit: str) -> int:
    """Nanoseconds of a unit of time (ns, us, ms, s)."""
    if unit not in UNIT_NS:
        raise ValueError(f"unknown unit of time: {unit!r}")
    return UNIT_NS[unit]


def nni_to_ms(nni, current_unit: str = "ns") -> Column:
    """Intervals in milliseconds."""
    return _c(nni) * (td_factor(current_unit) / 1e6)


def absolute(x) -> Column:
    return F.abs(_c(x))


def identity(x: Column) -> Column:
    return x


def in_daily_range(ts, start: str = "23:00", end: str = "06:00") -> Column:
    """Whether the time of day lies between start and end, both included; a start after the end wraps midnight."""
    pad = lambda s: s + ":00" * (2 - s.count(":"))
    low, high = pad(start) + ".000000", pad(end) + ".000000"
    t = F.date_format(_c(ts), "HH:mm:ss.SSSSSS")
    return t.between(low, high) if low <= high else (t >= low) | (t <= high)


def within_radius(distance, limit: float) -> Column:
    return _c(distance) < limit


def in_band(freq, low: float | None = None, high: float | None = None, half_open: bool = False) -> Column:
    """Whether a frequency lies in [low, high], or in [low, high) if half_open; a missing bound is open."""
    f, out = _c(freq), F.lit(True)
    if low is not None:
        out = out & (f >= low)
    if high is not None:
        out = out & ((f < high) if half_open else (f <= high))
    return out


def dead_band(x, threshold: float) -> Column:
    """0 where the amplitude is at most the threshold."""
    return F.when(F.abs(_c(x)) <= threshold, F.lit(0.0)).otherwise(_c(x))

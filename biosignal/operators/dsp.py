"""Butterworth filters, applied forwards and backwards (zero phase)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biosignal.operators.blocks import changes, map_segments
from biosignal.operators.frames import CHUNK, framed


def _digital(cutoff: float | tuple[float, float], freq: float, order: int, kind: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital Butterworth filter."""
    wn = np.atleast_1d(np.asarray(cutoff, float)) / (freq / 2)
    if ((wn <= 0) | (wn >= 1)).any():
        raise ValueError("cutoff must lie between 0 and half the sampling rate")
    poles = -np.exp(1j * np.pi * np.arange(1 - order, order, 2) / (2 * order))
    warped = 4 * np.tan(np.pi * wn / 2)
    if kind == "lowpass":
        zeros, poles, gain = np.zeros(0), poles * warped[0], warped[0] ** order
    elif kind == "highpass":
        gain = np.real(1 / np.prod(-poles))
        zeros, poles = np.zeros(order), warped[0] / poles
    elif kind == "bandpass":
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        zeros, poles, gain = np.zeros(order), np.r_[half + root, half - root], width**order
    else:
        raise ValueError(f"unknown kind of filter: {kind!r}")
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    z = np.r_[(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))]
    return np.real(z), (4 + poles) / (4 - poles), float(gain)


def design(cutoff: float | tuple[float, float], freq: float, order: int = 5, kind: str = "highpass") -> tuple[np.ndarray, np.ndarray]:
    """Polynomials (b, a) of a digital Butterworth filter; kind: lowpass, highpass or bandpass."""
    zeros, poles, gain = _digital(cutoff, freq, order, kind)
    return gain * np.poly(zeros), np.real(np.poly(poles))


class Sections:
    """A filter as a chain of sections of second order, which keeps the digits that a recursion over the polynomials of a
    narrow band loses: row (b0, b1, b2, a1, a2) a section. `edge` is the padding, three times the length of the polynomials."""

    def __init__(self, cutoff: float | tuple[float, float], freq: float, order: int = 5, kind: str = "highpass"):
        zeros, poles, gain = _digital(cutoff, freq, order, kind)
        up = poles[poles.imag > 1e-12]
        real = np.sort(poles.real[np.abs(poles.imag) <= 1e-12])
        pairs = [(p, p.conj()) for p in up] + [tuple(real[k : k + 2]) for k in range(0, len(real), 2)]
        left = sorted(zeros)  # one from each end, so that a band-pass section has a zero at both
        rows = []
        for pair in pairs:
            mine = [left.pop(), left.pop(0)] if len(pair) == 2 else [left.pop()]
            b, a = np.real(np.poly(mine)), np.real(np.poly(pair))
            rows.append(np.r_[b, np.zeros(3 - len(b)), a[1:], np.zeros(3 - len(a))])
        self.rows = np.array(rows)
        self.rows[:, :3] *= gain ** (1 / len(rows))
        self.edge = 3 * (len(poles) + 1)
        self.radius = float(np.abs(poles).max())
        #: output of each section for a constant input of 1 into the first
        self.level = np.cumprod(self.rows[:, :3].sum(axis=1) / (1 + self.rows[:, 3:].sum(axis=1)))
        self.level[np.abs(self.level) < 1e-12] = 0.0

    def run(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The filtered x[step, series], all series at once, as if each had been constant at `first` before.

        At a tick a section works on the output of the one before it at the tick before, so that all sections take one step
        together; the constant past leaves their states as they are until their first row arrives.
        """
        count = len(self.rows)
        b0, b1, b2, a1, a2 = (c[:, None] for c in self.rows.T)
        level = self.level[:, None] * first
        into = np.concatenate([first[None], level[:-1]])
        z1 = level - b0 * into
        z2 = b2 * into - a2 * level
        out, y = np.empty_like(x), np.empty_like(x)
        into = np.concatenate([first[None], level[:-1]])
        for k in range(len(x) + count - 1):
            into[0] = x[min(k, len(x) - 1)]
            out = b0 * into + z1
            z1 = b1 * into - a1 * out + z2
            z2 = b2 * into - a2 * out
            into[1:] = out[:-1]
            if k >= count - 1:
                y[k - count + 1] = out[-1]
        return y


def filtfilt(f: Sections, x: np.ndarray) -> np.ndarray:
    """Zero-phase filter of the columns of x[step, series], with odd extension of `edge` steps."""
    if len(x) <= f.edge:
        raise ValueError(f"a series must be longer than {f.edge} rows")
    return filtfilt_many(f, [x])[0]


def filtfilt_many(f: Sections, series: list[np.ndarray]) -> list[np.ndarray]:
    """filtfilt of arrays [step, column] of several lengths, each as if alone: a step of the recursion serves them all.

    A longer neighbour's steps behind a series' end do not reach back into it, so that short ones are only padded; lengths
    within a factor of two go together.
    """
    edge = f.edge
    out: list[np.ndarray] = [None] * len(series)
    todo = sorted(range(len(series)), key=lambda k: -len(series[k]))
    while todo:
        longest = len(series[todo[0]])
        batch = [k for k in todo if 2 * len(series[k]) >= longest]
        todo = todo[len(batch) :]
        width = [series[k].shape[1] for k in batch]
        at = np.r_[0, np.cumsum(width)]
        x = np.zeros((longest + 2 * edge, at[-1]))
        for k, c in zip(batch, at):
            v = series[k]
            x[: len(v) + 2 * edge, c : c + v.shape[1]] = np.concatenate([2 * v[:1] - v[edge:0:-1], v, 2 * v[-1:] - v[-2 : -edge - 2 : -1]])
        y = f.run(x, x[0])
        for k, c in zip(batch, at):
            n, w = len(series[k]) + 2 * edge, series[k].shape[1]
            x[:n, c : c + w] = y[:n, c : c + w][::-1]
        y = f.run(x, x[0])
        for k, c in zip(batch, at):
            n, w = len(series[k]) + 2 * edge, series[k].shape[1]
            out[k] = y[:n, c : c + w][::-1][edge:-edge]
    return out


def settling(f: Sections, least: float = 1e-15) -> int:
    """Rows after which a filter has forgotten its start, up to a share of `least`, and no fewer than its padding."""
    return int(np.ceil(np.log(least) / np.log(f.radius))) + f.edge + 1


def chunks(df: DataFrame, margin: int, chunk: int = CHUNK) -> DataFrame:
    """Rows framed for a kernel that needs `margin` rows on both sides; a margin is a quarter of its chunk at most."""
    return framed(df, margin, margin, chunk=max(chunk, 4 * margin))


def filter_segments(block: pd.DataFrame, columns: list[str], f: Sections) -> np.ndarray:
    """The filtered columns of a block of (entity, chunk) segments; NaN where a series is too short for the padding."""
    start = np.flatnonzero(changes(block, ["entity", "chunk"]))
    end = np.r_[start[1:], len(block)]
    values = block[columns].to_numpy(float)
    out = np.full(values.shape, np.nan)
    long = [(s, e) for s, e in zip(start, end) if e - s > f.edge]
    for (s, e), y in zip(long, filtfilt_many(f, [values[s:e] for s, e in long])):
        out[s:e] = y
    return out


def butterworth(df: DataFrame, cutoff: float | tuple[float, float], freq: float, order: int = 5, kind: str = "highpass", columns: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Filter columns of the series (entity, idx, ...); by default all numeric ones but entity and idx.

    Series shorter than the padding of the filter give NULL. A long series is filtered in chunks: a filter forgets its
    start, so that a margin in which it has settled gives each chunk the values of the whole series to about 1e-15 of them.
    """
    f = Sections(cutoff, freq, order, kind)
    numeric = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)
    columns = columns or [c.name for c in df.schema if isinstance(c.dataType, numeric) and c.name not in ("entity", "idx")]
    rows = chunks(df.select("entity", "idx", *[F.col(c).cast("double").alias(c) for c in columns]), settling(f), chunk)
    schema = f"entity {dict(df.dtypes)['entity']}, idx bigint, " + ", ".join(f"`{c}` double" for c in columns)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        y = filter_segments(block, columns, f)
        return block.assign(**{c: y[:, k] for k, c in enumerate(columns)})[block.own][["entity", "idx", *columns]]

    out = map_segments(rows, ["entity", "chunk"], ["idx"], run, schema)
    return out.select("entity", "idx", *[F.nanvl(c, F.lit(None)).alias(c) for c in columns])


def linear_filter(df: DataFrame, freq: float, cutoff: float | tuple[float, float] = 0.5, order: int = 5, columns: list[str] | None = None) -> DataFrame:
    """Movement without gravity: high-pass for one cutoff, band-pass for a pair."""
    return butterworth(df, cutoff, freq, order, "bandpass" if isinstance(cutoff, (tuple, list)) else "highpass", columns)


def gravity_filter(df: DataFrame, freq: float, cutoff: float = 0.5, order: int = 5, columns: list[str] | None = None) -> DataFrame:
    """Gravity without movement: low-pass."""
    return butterworth(df, cutoff, freq, order, "lowpass", columns)


def bandpass(df: DataFrame, fs: float, low: float = 5, high: float = 15, order: int = 5) -> DataFrame:
    return butterworth(df, (low, high), fs, order, "bandpass", ["x"])

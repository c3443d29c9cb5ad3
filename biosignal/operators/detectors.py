"""Detectors of heart beats and pulses, and the quality of beats.

Filters and everything that looks a bounded number of rows around (maxima, slopes, neighbourhoods) work on chunks of a
series with a margin. The decisions depend on earlier ones: they walk the candidates of a series in order, a few numbers
each, or for pulses and the quality of beats the series itself, which then is one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosignal.operators.blocks import changes, map_segments
from biosignal.operators.dsp import Sections, chunks, filter_segments, filtfilt, settling
from biosignal.operators.frames import CHUNK


def box_average(x: np.ndarray, window: int) -> np.ndarray:
    """Centred box filter with zeros outside; a window longer than the series is an error."""
    if window > len(x):
        raise ValueError("the window is longer than the series")
    return np.convolve(x, np.ones(window), "same") / window


def _band(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    return filtfilt(Sections((low, high), fs, 5, "bandpass"), x[:, None])[:, 0]


def pan_tompkins(x: np.ndarray, fs: float) -> np.ndarray:
    """Band 5-15 Hz, derivative (x / 8), square, average over 0.2 s."""
    return box_average((_band(x, fs, 5, 15) / 8) ** 2, int(0.2 * fs))


def hamilton_tompkins(x: np.ndarray, fs: float) -> np.ndarray:
    """Band 3-25 Hz, absolute derivative (x / 8), average over 0.08 s."""
    return box_average(np.abs(_band(x, fs, 3, 25) / 8), int(0.08 * fs))


def interior_peaks(x: np.ndarray) -> np.ndarray:
    return 1 + np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:]))


def peak_facts(f: np.ndarray, peaks: np.ndarray, fs: float) -> pd.DataFrame:
    """What the decisions need to know of each peak of a filtered signal: its height, whether it is the highest of 0.2 s to
    both sides, whether the signal rises and falls within 0.05 s of it, and the steepest rise there."""
    wide, slim, reach = int(fs * 0.2), int(fs * 0.05), fs * 0.05
    slope = np.diff(f)
    highest, turns, steep = np.zeros(len(peaks), bool), np.zeros(len(peaks), bool), np.full(len(peaks), -np.inf)
    for k, p in enumerate(peaks.tolist()):
        highest[k] = f[p] >= f[max(0, p - wide) : p + wide].max()
        if not highest[k]:
            continue
        d = slope[max(0, p - slim) : max(0, p + slim - 1)]
        turns[k] = (d > 0).any() and (d < 0).any()
        a, b = int(max(0, p - reach)), int(p + reach)
        steep[k] = slope[a : b - 1].max(initial=-np.inf) if b - a > 1 else -np.inf
    return pd.DataFrame({"height": f[peaks], "highest": highest, "turns": turns, "steep": steep})


class BeatRule:
    """Which peaks are beats, one after the other, by the published rules of Hamilton and Tompkins.

    The last accepted and rejected positions fill two rings that start at position 0, where the signal is `first`; the
    threshold lies `share` of the way from the rings' noise level to their beat level and moves after every peak. What a rule
    knows are plain values, vars(rule), from which of() makes it again.
    """

    def __init__(self, first: float, fs: float, buffer: int = 12, share: float = 0.3125):
        self.fs, self.share = fs, share
        self.places, self.high, self.low = [0] * buffer, [first] * buffer, [first] * buffer
        self.threshold, self.accepted, self.rejected, self.last, self.rise = 0.0, 0, 0, 0, 0.0

    @classmethod
    def of(cls, known: dict) -> "BeatRule":
        rule = cls.__new__(cls)
        rule.__dict__.update(known)
        return rule

    def accepts(self, place: int, height: float, highest: bool, turns: bool, steep: float) -> bool:
        """Whether the next peak is a beat."""
        ok, since, size = False, place - self.last, len(self.places)
        if highest:
            if height > self.threshold and turns:
                ok = not (self.last and since < 0.36 * self.fs and steep < 0.5 * self.rise)
            if not ok and self.accepted > 1 and height > 0.5 * self.threshold:
                ok = since >= 1.5 * (max(self.places) - min(self.places)) / (size - 1)
        if ok:
            self.places[self.accepted % size], self.high[self.accepted % size] = place, height
            self.accepted, self.last, self.rise = self.accepted + 1, place, steep
        else:
            self.low[self.rejected % size] = height
            self.rejected += 1
        floor = sum(self.low) / size
        self.threshold = floor + self.share * (sum(self.high) / size - floor)
        return ok


def accept_beats(at: np.ndarray, facts: pd.DataFrame, first: float, fs: float) -> np.ndarray:
    """Which of the peaks at these positions are beats."""
    rule = BeatRule(first, fs)
    return np.array([rule.accepts(*row) for row in zip(at.tolist(), facts.height.tolist(), facts.highest.tolist(), facts.turns.tolist(), facts.steep.tolist())], bool)


def r_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Positions of the beats of one series."""
    f = hamilton_tompkins(x, fs)
    at = interior_peaks(f)
    return at[accept_beats(at, peak_facts(f, at, fs), f[0], fs)]


def lagged_rise(x: np.ndarray, w: int) -> np.ndarray:
    """x less x of w rows before, 0 in the first w rows and the last."""
    out = np.zeros(len(x))
    if len(x) > w + 1:
        out[w:-1] = x[w:-1] - x[: -w - 1]
    return out


class OnsetRule:
    """Onsets of pulses by a threshold that follows the last ten amplitudes; the last ten seconds of what is known give none.

    With backtracking, after ten seconds without an onset the walk goes back to five seconds further than it last went back
    to (the last onset at first), and the ring of amplitudes takes the level of what follows the last onset. The threshold
    itself moves with the next onset only.

    Slopes may come in pieces: held ones are those from `base` on, as far back as the walk may still look.
    """

    def __init__(self, sr: int, backtracking: float = 0.0):
        self.sr, self.backtracking, self.reach, self.ten = sr, backtracking, int(sr / (1000 / 150)), 10 * sr
        self.ring, self.turn, self.cut = [], 0, 0.0
        self.i, self.last, self.back, self.base, self.held = self.reach, 0, 0, 0, []

    @classmethod
    def of(cls, known: dict) -> "OnsetRule":
        rule = cls.__new__(cls)
        rule.__dict__.update(known)
        return rule

    def take(self, slopes: np.ndarray) -> list[int]:
        """The onsets that are certain with these slopes behind those before."""
        x = np.r_[self.held, slopes]
        end = self.base + len(x)
        onsets: list[int] = []
        at = lambda a, b: x[max(0, a - self.base) : max(0, b - self.base)]
        if not self.ring and end > self.ten:
            head = x[: self.ten]
            level = float(head.mean() + 2 * head.std())
            self.ring, self.cut = [level] * 10, level - float(head.std())
        while self.ring and self.i < end - self.ten:
            if x[self.i - self.base] > self.cut:
                self.last = self.back = self.i - self.reach + int(np.argmax(at(self.i - self.reach, self.i + self.reach)))
                onsets.append(self.last)
                self.turn = (self.turn + 1) % len(self.ring)
                self.ring[self.turn] = float(x[self.last - self.base])
                self.cut = float(np.median(self.ring) - 2 * np.std(self.ring))
                self.i += 3 * self.reach - 1
            self.i += 1
            if self.backtracking and self.last < self.i - self.ten:
                self.ring = [3 * float(at(self.last + self.sr, self.last + 11 * self.sr).mean())] * 10
                self.i = self.back + self.reach
                self.back += 5 * self.sr
        keep = max(self.base, min(self.i - self.reach, self.last if self.backtracking else self.i - self.reach) if self.ring else 0)
        self.held, self.base = x[keep - self.base :].tolist(), keep
        return onsets


def pulse_onsets_of(slopes: np.ndarray, sr: int, backtracking: float = 0.0) -> np.ndarray:
    """The onsets of a whole series of slopes."""
    return np.array(OnsetRule(sr, backtracking).take(slopes), np.int64)


def pulse_onsets(x: np.ndarray, sr: int, backtracking: float = 0.0) -> np.ndarray:
    """Band 0.5-20 Hz, slope sum over 0.15 s, adaptive threshold."""
    return pulse_onsets_of(lagged_rise(_band(x, sr, 0.5, 20), int(sr / (1000 / 150))), sr, backtracking)


def correlations(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson correlation of y with each row; 0 where either is constant."""
    a, b = rows - rows.mean(axis=1, keepdims=True), y - y.mean()
    norm = np.sqrt((a**2).sum(axis=1) * (b**2).sum())
    return np.divide(a @ b, norm, out=np.zeros(len(rows)), where=norm > 0)


def _beats(x: np.ndarray, peaks: np.ndarray, sr: int) -> np.ndarray:
    """A row per peak: the second around it, with zeros outside the signal."""
    half = sr // 2
    padded = np.concatenate([np.zeros(half), x, np.zeros(half)])
    return sliding_window_view(padded, 2 * half)[np.minimum(peaks, len(x))]


def beat_correlation(x: np.ndarray, peaks: np.ndarray, sr: int, buffer: int = 24) -> np.ndarray:
    """Mean correlation of each beat with the last `buffer` beats; the ring starts with beats 1 ... buffer - 1."""
    out = np.full(len(peaks), np.nan)
    if len(peaks) < buffer:
        return out
    beats = _beats(x, peaks, sr)
    ring = np.full((buffer, beats.shape[1]), np.nan)
    ring[1:] = beats[1:buffer]
    for i, beat in enumerate(beats):
        full = ~np.isnan(ring[:, 0])
        out[i] = correlations(ring[full], beat).mean()
        if i:  # the first beat is scored only
            ring[i % buffer] = beat
    return out


def beat_correlation_bi(x: np.ndarray, peaks: np.ndarray, sr: int, buffer: int = 12) -> np.ndarray:
    """The larger of the mean correlations with the `buffer` beats before and after; the first buffer - 1 scores are 0.

    Both rings start with rows of zeros, which correlate with nothing; beats 1 ... buffer - 1 stand in the ring of what
    follows. A beat whose second reaches over an end of the signal is scored with zeros there and enters no ring; over the
    end, with the beats before it only. A following beat in the last second leaves its place in the ring as it was.
    """
    out = np.full(len(peaks), np.nan)
    if len(peaks) < buffer:
        return out
    beats, half = _beats(x, peaks, sr), sr // 2
    before, after = np.zeros((buffer, beats.shape[1])), np.zeros((buffer, beats.shape[1]))
    after[1:] = beats[1:buffer]
    out[: buffer - 1] = 0.0
    for i in range(buffer - 1, len(peaks)):
        back = correlations(before, beats[i]).mean()
        if peaks[i] + half > len(x):
            out[i] = back
            continue
        out[i] = max(back, correlations(after, beats[i]).mean())
        if peaks[i] <= half:
            continue
        before[i % buffer] = beats[i]
        if i + buffer >= len(peaks):
            after[i % buffer] = 0
        elif peaks[i + buffer] < len(x) - sr:
            after[i % buffer] = beats[i + buffer]
    return out


def _per_series(df: DataFrame, kernel, schema: str, columns: list[str]) -> DataFrame:
    """Run kernel(frame of one series) -> dict of arrays for each series."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        start = np.flatnonzero(changes(block, ["entity"]))
        out = [pd.DataFrame({"entity": block.entity.iloc[a], **kernel(block.iloc[a:b])}) for a, b in zip(start, np.r_[start[1:], len(block)])]
        return pd.concat(out, ignore_index=True)

    kind = dict(df.dtypes)["entity"]
    return map_segments(df.select("entity", "idx", *columns), ["entity"], ["idx"], run, f"entity {kind}, {schema}")


PADDING = 3 * 11  # of a band-pass filter of fifth order


def _filtered(df: DataFrame, low: float, high: float, after, fs: float, width: int, chunk: int) -> DataFrame:
    f = Sections((low, high), fs, 5, "bandpass")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        y = filter_segments(block, ["x"], f)[:, 0]
        start = np.flatnonzero(changes(block, ["entity", "chunk"]))
        for s, e in zip(start, np.r_[start[1:], len(block)]):
            y[s:e] = box_average(after(y[s:e] / 8), width) if e - s > max(PADDING, width - 1) else np.nan
        return pd.DataFrame({"entity": block.entity, "idx": block.idx, "y": y})[block.own]

    rows = chunks(df.select("entity", "idx", F.col("x").cast("double").alias("x")), settling(f) + width, chunk)
    out = map_segments(rows, ["entity", "chunk"], ["idx"], run, f"entity {dict(df.dtypes)['entity']}, idx bigint, y double")
    return out.select("entity", "idx", F.nanvl("y", F.lit(None)).alias("y"))


def filter_pan_tompkins(df: DataFrame, fs: float, chunk: int = CHUNK) -> DataFrame:
    """(entity, idx, y): band 5-15 Hz, derivative, square, average over 0.2 s; NULL for series too short to filter."""
    return _filtered(df, 5, 15, np.square, fs, int(0.2 * fs), chunk)


def filter_hamilton_tompkins(df: DataFrame, fs: float, chunk: int = CHUNK) -> DataFrame:
    """(entity, idx, y): band 3-25 Hz, absolute derivative, average over 0.08 s; NULL for series too short to filter."""
    return _filtered(df, 3, 25, np.abs, fs, int(0.08 * fs), chunk)


def rpeaks_hamilton_tompkins(df: DataFrame, fs: float | None = None, ts: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(entity, idx[, ts]): the beats of ECG series (entity, idx, x). Short series have none.

    Without a rate it is taken from the first two values of ts, in microseconds, of each series; a series then is one task.
    With a rate, filter and peaks are found in chunks, and only the peaks of a series come together.
    """
    if fs is None and ts is None:
        raise ValueError("give the sampling rate or a column of times")
    kind = dict(df.dtypes)
    times = [ts] if ts else []
    schema = "idx bigint" + (f", ts {kind[ts]}" if ts else "")
    if fs is None:

        def kernel(g: pd.DataFrame) -> dict:
            x = g.x.to_numpy(float)
            at = np.zeros(0, np.int64)
            if len(x) > PADDING:
                at = r_peaks(x, 1e6 / (g[ts].iloc[1] - g[ts].iloc[0]))
            return {"idx": g.idx.to_numpy()[at], "ts": g[ts].to_numpy()[at]}

        return _per_series(df, kernel, schema, ["x", ts])
    around = int(fs * 0.2) + 2
    y = filter_hamilton_tompkins(df, fs, chunk).where(F.col("y").isNotNull())
    if ts:
        y = y.join(df.select("entity", "idx", F.col(ts).alias("__ts")), ["entity", "idx"])

    def peaks(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        start = np.flatnonzero(changes(block, ["entity", "chunk"]))
        for s, e in zip(start, np.r_[start[1:], len(block)]):
            g = block.iloc[s:e]
            f = g.y.to_numpy()
            at = interior_peaks(f)
            at = at[g.own.to_numpy()[at]]
            if g.idx.iloc[0] == 0:  # the level that the rings start with
                out.append(pd.DataFrame({"entity": g.entity.iloc[:1], "idx": [-1], "height": f[:1], "highest": False, "turns": False, "steep": 0.0, **({"ts": g["__ts"].iloc[:1]} if ts else {})}))
            out.append(peak_facts(f, at, fs).assign(entity=g.entity.iloc[0], idx=g.idx.to_numpy()[at], **({"ts": g["__ts"].to_numpy()[at]} if ts else {})))
        return pd.concat(out, ignore_index=True)[[*names]]

    names = ["entity", "idx", "height", "highest", "turns", "steep", *(["ts"] if ts else [])]
    found = map_segments(chunks(y, around, chunk), ["entity", "chunk"], ["idx"], peaks, f"entity {kind['entity']}, idx bigint, height double, highest boolean, turns boolean, steep double" + (f", ts {kind[ts]}" if ts else ""))

    def decide(g: pd.DataFrame) -> dict:
        ok = accept_beats(g.idx.to_numpy()[1:], g.iloc[1:], g.height.iloc[0], fs)
        return {"idx": g.idx.to_numpy()[1:][ok], **({"ts": g["ts"].to_numpy()[1:][ok]} if ts else {})}

    return _per_series(found, decide, schema, ["height", "highest", "turns", "steep", *(["ts"] if ts else [])])


def pulse_onset_physionet(df: DataFrame, sampling_rate: int, backtracking: float = 0.0) -> DataFrame:
    """(entity, idx): the onsets of pulses of PPG series (entity, idx, x)."""

    def kernel(g: pd.DataFrame) -> dict:
        x = g.x.to_numpy(float)
        at = pulse_onsets(x, sampling_rate, backtracking) if len(x) > PADDING else np.zeros(0, np.int64)
        return {"idx": g.idx.to_numpy()[at]}

    return _per_series(df, kernel, "idx bigint", ["x"])


def beat_quality(df: DataFrame, peaks: DataFrame, sampling_rate: int, buffer: int | None = None, both_sides: bool = False) -> DataFrame:
    """(entity, idx, quality): how alike each beat is to those around it; peaks are rows (entity, idx). NULL: too few beats."""
    score = beat_correlation_bi if both_sides else beat_correlation
    marked = df.join(peaks.select("entity", "idx", F.lit(True).alias("peak")).distinct(), ["entity", "idx"], "left").withColumn("peak", F.coalesce("peak", F.lit(False)))

    def kernel(g: pd.DataFrame) -> dict:
        at = np.flatnonzero(g.peak.to_numpy(bool))
        q = score(g.x.to_numpy(float), at, sampling_rate, buffer or (12 if both_sides else 24))
        return {"idx": g.idx.to_numpy()[at], "quality": q}

    out = _per_series(marked, kernel, "idx bigint, quality double", ["x", "peak"])
    return out.select("entity", "idx", F.nanvl("quality", F.lit(None)).alias("quality"))

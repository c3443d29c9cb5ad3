"""Features of unbounded series: sliding statistics with late data, and detectors whose state is carried between batches."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biosignal.operators.detectors import BeatRule, OnsetRule, interior_peaks, peak_facts


def sliding_features(stream: DataFrame, features: dict[str, Column], size: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", entity: str = "entity", ts: str = "ts") -> DataFrame:
    """(entity, start, end, features) over windows of time; rows later than `late` behind the newest are dropped."""
    g = stream.withWatermark(ts, late).groupBy(entity, F.window(ts, size, slide).alias("w"))
    return g.agg(*[c.alias(n) for n, c in features.items()]).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *features)


def sessions(stream: DataFrame, features: dict[str, Column], gap: str = "30 minutes", late: str = "10 minutes", entity: str = "entity", ts: str = "ts") -> DataFrame:
    """(entity, start, end, features) over runs of rows without a gap."""
    g = stream.withWatermark(ts, late).groupBy(entity, F.session_window(ts, gap).alias("w"))
    return g.agg(*[c.alias(n) for n, c in features.items()]).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *features)


def _peaks(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = list(state.get) if state.exists else [None, None, None, None]
    i0, x0, i1, x1 = last
    rows = []
    batch = pd.concat(list(frames)).sort_values("idx")
    for i, x in zip(batch.idx.tolist(), batch.x.tolist()):
        if i1 is not None and i <= i1:
            continue  # seen before, or late
        if x0 is not None and x1 > x0 and x1 > x:
            rows.append((key[0], i1, x1))
        i0, x0, i1, x1 = i1, x1, i, x
    state.update((i0, x0, i1, x1))
    yield pd.DataFrame(rows, columns=["entity", "idx", "x"])


def peaks(stream: DataFrame) -> DataFrame:
    """(entity, idx, x): interior maxima of streams (entity, idx, x) that arrive in order; two rows of state an entity."""
    kind = dict(stream.dtypes)["entity"]
    return stream.select("entity", "idx", "x").groupBy("entity").applyInPandasWithState(_peaks, f"entity {kind}, idx bigint, x double", "i0 bigint, x0 double, i1 bigint, x1 double", "append", "NoTimeout")


def beats(stream: DataFrame, fs: float) -> DataFrame:
    """(entity, idx): the beats of streams (entity, idx, y) of a filtered ECG that arrive in order, as soon as 0.2 s behind a
    peak are known. State of an entity: the rule and the last half second; rows seen before are passed over."""
    wide = int(fs * 0.2) + 2

    def step(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {"next": 0, "base": 0, "held": [], "rule": None}
        batch = pd.concat(list(frames)).sort_values("idx")
        batch = batch[batch.idx >= known["next"]].drop_duplicates("idx")
        rows: list[tuple] = []
        if len(batch):
            y, base, before = np.r_[known["held"], batch.y.to_numpy(float)], known["base"], known["next"]
            rule = BeatRule.of(known["rule"]) if known["rule"] else BeatRule(float(y[0]), fs)
            # peaks that have all they need, and had not in the batch before
            at = interior_peaks(y)
            at = at[(base + at + wide < base + len(y)) & (base + at + wide >= before)]
            f = peak_facts(y, at, fs)
            rows = [(key[0], int(base + p)) for p, *fact in zip(at.tolist(), f.height.tolist(), f.highest.tolist(), f.turns.tolist(), f.steep.tolist()) if rule.accepts(base + p, *fact)]
            keep = max(0, len(y) - 2 * wide - 2)
            known = {"next": base + len(y), "base": base + keep, "held": y[keep:].tolist(), "rule": vars(rule)}
        state.update((json.dumps(known),))
        yield pd.DataFrame(rows, columns=["entity", "idx"])

    kind = dict(stream.dtypes)["entity"]
    return stream.select("entity", "idx", "y").groupBy("entity").applyInPandasWithState(step, f"entity {kind}, idx bigint", "known string", "append", "NoTimeout")


def pulse_onsets(stream: DataFrame, sampling_rate: int, backtracking: float = 0.0) -> DataFrame:
    """(entity, idx): the onsets of streams (entity, idx, x) of slope sums that arrive in order, ten seconds behind the newest.
    State of an entity: the rule and some ten seconds, with backtracking as far back as the last onset."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rule = OnsetRule.of(json.loads(state.get[0])) if state.exists else OnsetRule(sampling_rate, backtracking)
        batch = pd.concat(list(frames)).sort_values("idx")
        batch = batch[batch.idx >= rule.base + len(rule.held)].drop_duplicates("idx")
        rows = [(key[0], i) for i in rule.take(batch.x.to_numpy(float))]
        state.update((json.dumps(vars(rule)),))
        yield pd.DataFrame(rows, columns=["entity", "idx"])

    kind = dict(stream.dtypes)["entity"]
    return stream.select("entity", "idx", "x").groupBy("entity").applyInPandasWithState(step, f"entity {kind}, idx bigint", "known string", "append", "NoTimeout")

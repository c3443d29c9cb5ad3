"""Stops and trips from location pings, by ordered density reachability.

The distance of two fixes of a device is aware of time: the larger of the metres between them and of the seconds between
them, at `valley_m` metres for `window_s` seconds. A fix's core distance is the radius that holds `dense_s` seconds of the
device's time; its reachability is the smallest max(core distance of a neighbour, distance to it). In order of time these
values are a reachability plot: its valleys (at most `valley_m`) are runs of staying, its ridges runs of moving. Fixes more
than `window_s` seconds apart are farther from each other than any valley is deep, so that the plot need not look at them. The plot is made for chunks of a day with a margin of `window_s`, so that a device with a third
of all pings is spread over as many tasks as it has days; a second pass joins the runs (a few dozen a day) in order.
Fixes with too few others within `window_s` (a phone that saves power) are left to the second pass, which sees the fixes
before and after however far away in time: 15 minutes hold two of them at most, so they are no more than 200 runs a day.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosignal.operators.blocks import changes, map_segments
from biosignal.sources.tables import micros, valid_fixes

#: Metres of a degree of latitude on the sphere with 2R = 12742.018 km.
DEGREE_M = 12742018.0 * np.pi / 360
DAY_US = 86_400_000_000

RUN_SCHEMA = "entity {entity}, start_us bigint, end_us bigint, staying boolean, fixes bigint, latitude double, longitude double, path_m double, gap_s double, sparse boolean, first_lat double, first_lon double, last_lat double, last_lon double"
OUT_SCHEMA = "entity {entity}, kind string, start_us bigint, end_us bigint, duration_s double, distance_m double, fixes bigint, latitude double, longitude double"


def metres(lat1, lon1, lat2, lon2):
    """Distance in metres of points near each other, and a lower bound of the order of it for far ones; works across the 180th meridian."""
    dlon = np.abs(lon1 - lon2)
    dlon = np.minimum(dlon, 360 - dlon)
    return DEGREE_M * np.hypot(lat1 - lat2, dlon * np.cos(np.radians((lat1 + lat2) / 2)))


def _dwell(t: np.ndarray, seg: np.ndarray, most: float) -> np.ndarray:
    """Seconds that each fix stands for: half the time to its neighbours, each half at most `most`."""
    half = np.where(seg[1:] == seg[:-1], np.minimum(np.diff(t) / 2, most), 0.0)
    out = np.zeros(len(t))
    out[1:] += half
    out[:-1] += half
    return out


def _window(seg: np.ndarray, t: np.ndarray, window_s: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last row (exclusive) within `window_s` of each row of the same segment."""
    start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    since = t - np.repeat(t[start], np.diff(np.r_[start, len(t)]))
    key = seg * (since.max() + 3 * window_s + 1) + since
    return np.searchsorted(key, key - window_s), np.searchsorted(key, key + window_s, side="right")


CELLS = 1_500_000


def reachability(seg: np.ndarray, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, window_s: float, dense_s: float, valley_m: float = 110.0) -> np.ndarray:
    """Reachability of fixes in order of (seg, t), each segment for itself.

    Distances to all neighbours are held for slices of rows, of CELLS distances each, and only as long as a core distance that
    they wait for may come: two or three slices, whatever the rate of pings and the length of the segments.
    """
    n = len(t)
    lo, hi = _window(seg, t, window_s)
    weight = _dwell(t, seg, window_s / 4)
    core, out, waiting, at = np.empty(n), np.empty(n), [], 0
    while at < n:
        end = min(n, at + 2048)
        width = int((hi[at:end] - lo[at:end]).max())
        if width * (end - at) > CELLS:  # dense pings: fewer rows at once
            end = at + max(1, CELLS // width)
            width = int((hi[at:end] - lo[at:end]).max())
        near = (lo[at:end, None] + np.arange(width)).astype(np.int32)
        real = near < hi[at:end, None]
        near = np.minimum(near, n - 1)
        d = np.maximum(metres(lat[at:end, None], lon[at:end, None], lat[near], lon[near]), np.abs(t[at:end, None] - t[near]) * (valley_m / window_s)).astype(np.float32)
        d[~real] = np.inf
        order = np.argsort(d, axis=1)
        held = np.cumsum(np.take_along_axis(np.where(real, weight[near], 0).astype(np.float32), order, 1), axis=1, dtype=np.float64)
        need = np.minimum(dense_s, 0.6 * held[:, -1])
        first = np.argmax(held >= need[:, None] - 1e-4, axis=1)
        core[at:end] = np.take_along_axis(d, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]
        core[at:end] = np.where(held[:, -1] < 60, np.inf, core[at:end])
        waiting.append((at, end, near, d))
        at = end
        while waiting and int(hi[waiting[0][0] : waiting[0][1]].max()) <= at:
            a, e, near, d = waiting.pop(0)
            by = np.maximum(core[near], d)
            by[np.arange(e - a), np.arange(a, e) - lo[a:e]] = np.inf  # not from itself
            out[a:e] = by.min(axis=1, initial=np.inf)
    return out


def _median3(x: np.ndarray, forward: bool) -> np.ndarray:
    """Median of each value and the two after it (or before it)."""
    a, b = (np.r_[x[1:], x[-1:]], np.r_[x[2:], x[-1:], x[-1:]][: len(x)]) if forward else (np.r_[x[:1], x[:-1]], np.r_[x[:1], x[:1], x[:-2]][: len(x)])
    return np.maximum(np.minimum(x, a), np.minimum(np.maximum(x, a), b))


def _runs(block: pd.DataFrame, window_s: float, dense_s: float, valley_m: float) -> pd.DataFrame:
    same = ~changes(block, ["entity", "chunk", "us", "latitude", "longitude"])
    block = block[~same].reset_index(drop=True)
    seg = np.cumsum(changes(block, ["entity", "chunk"])) - 1
    us, lat, lon = block.us.to_numpy(), block.latitude.to_numpy(), block.longitude.to_numpy()
    t = (us - us.min()) / 1e6
    reach = reachability(seg, t, lat, lon, window_s, dense_s, valley_m)
    stay = reach <= valley_m
    # the window tells nothing of a fix alone in it or with one other, which may be wrong
    lo, hi = _window(seg, t, window_s)
    lone = ~stay & (hi - lo <= 2)
    sparse = lone | np.isinf(reach)
    own = block.own.to_numpy(bool)
    # longitudes of a segment are continued over the 180th meridian
    first = np.repeat(lon[np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])], np.bincount(seg))
    flat = first + (lon - first + 180) % 360 - 180
    # a jump between two places without a fix on the way splits a valley
    v = np.flatnonzero(stay)
    jump = np.zeros(len(t), bool)
    if len(v) > 1:
        a, b = v[:-1], v[1:]
        apart = metres(lat[a], flat[a], lat[b], flat[b]) > valley_m
        before = (_median3(lat[v], False)[:-1], _median3(flat[v], False)[:-1])
        after = (_median3(lat[v], True)[1:], _median3(flat[v], True)[1:])
        jump[b] = apart & (metres(*before, *after) > 0.8 * valley_m)
    rows = np.flatnonzero(own)
    if not len(rows):
        return pd.DataFrame(columns=[c.split()[0] for c in RUN_SCHEMA.split(", ")])
    s, v, j, l, p = seg[rows], stay[rows], jump[rows], lone[rows], sparse[rows]
    new = np.r_[True, (s[1:] != s[:-1]) | (v[1:] != v[:-1]) | (j[1:] & v[1:]) | l[1:] | l[:-1] | (p[1:] != p[:-1]) | (p[1:] & (np.diff(t[rows]) > window_s))]
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(rows)] - 1
    step = np.r_[0.0, metres(lat[rows][:-1], flat[rows][:-1], lat[rows][1:], flat[rows][1:])]
    gap = np.r_[0.0, np.diff(t[rows])]
    step[start] = gap[start] = 0
    f = pd.DataFrame({"run": run, "latitude": lat[rows], "longitude": flat[rows], "step": step, "gap": gap}).groupby("run")
    middle = f[["latitude", "longitude"]].median()
    out = pd.DataFrame({
        "entity": block.entity.to_numpy()[rows][start], "start_us": us[rows][start], "end_us": us[rows][end], "staying": v[start], "fixes": end - start + 1,
        "latitude": middle.latitude.to_numpy(), "longitude": (middle.longitude.to_numpy() + 180) % 360 - 180, "path_m": f.step.sum().to_numpy(), "gap_s": f.gap.max().to_numpy(), "sparse": p[start],
        "first_lat": lat[rows][start], "first_lon": lon[rows][start], "last_lat": lat[rows][end], "last_lon": lon[rows][end],
    })
    return out


def _settle(runs: list, radius_m: float, valley_m: float, max_wrong: int) -> list[dict]:
    """Runs with the sparse ones staying that lie at the place of a stay, or of another sparse one, before or after them."""

    def near(i: int, step: int) -> bool:
        r, passed, at = runs[i], 0, i + step
        while 0 <= at < len(runs) and passed <= max_wrong:
            o = runs[at]
            if (o["staying"] or o["sparse"]) and metres(o["latitude"], o["longitude"], r["latitude"], r["longitude"]) <= (radius_m if o["staying"] else valley_m):
                return True
            if o["staying"]:
                return False
            passed, at = passed + o["fixes"], at + step
        return False

    return [r | {"staying": True} if r["sparse"] and (near(i, -1) or near(i, 1)) else r for i, r in enumerate(runs)]


def _join_runs(runs: list, radius_m: float, max_wrong: int) -> list[dict]:
    """Runs in order of time to valleys, each with what lies between it and the valley before it."""
    out: list[dict] = []
    between = {"fixes": 0, "path": 0.0, "gap": 0.0}
    last = None
    for r in runs:
        gap = (r["start_us"] - last["end_us"]) / 1e6 if last else 0.0
        path = float(metres(last["last_lat"], last["last_lon"], r["first_lat"], r["first_lon"])) if last else 0.0
        last = r
        between["gap"] = max(between["gap"], gap, r.get("gap_s", 0) if not r["staying"] else 0.0)
        between["path"] += path
        if not r["staying"]:
            between["fixes"] += r["fixes"]
            between["path"] += r["path_m"]
            continue
        top = out[-1] if out else None
        if top and between["fixes"] <= max_wrong and metres(top["latitude"], top["longitude"], r["latitude"], r["longitude"]) <= radius_m:
            n, m = top["fixes"], r["fixes"]
            turn = (r["longitude"] - top["longitude"] + 180) % 360 - 180
            top |= {"latitude": (top["latitude"] * n + r["latitude"] * m) / (n + m), "longitude": top["longitude"] + turn * m / (n + m), "fixes": n + m, "end_us": r["end_us"], "last_lat": r["last_lat"], "last_lon": r["last_lon"]}
        else:
            out.append(dict(r) | {"before": dict(between)})
        between = {"fixes": 0, "path": 0.0, "gap": 0.0}
    return out


def _episodes(frame: pd.DataFrame, radius_m: float, valley_m: float, min_stop_s: float, halt_s: float, max_wrong: int, gap_s: float) -> pd.DataFrame:
    rows = []
    least = (min_stop_s + halt_s) / 2 * 1e6
    for entity, g in frame.groupby("entity", sort=False):
        runs = _settle(g.to_dict("records"), radius_m, valley_m, max_wrong)
        valleys = _join_runs(runs, radius_m, max_wrong)
        # valleys too short for a stop are halts: they become part of the way, and what is around them may join
        longer = [v for v in valleys if v["end_us"] - v["start_us"] >= least]
        kept = {(v["start_us"], v["end_us"]) for v in longer}
        if len(longer) < len(valleys):
            spans = sorted(kept)
            at, again = 0, []
            for r in runs:
                while at < len(spans) and spans[at][1] < r["start_us"]:
                    at += 1
                inside = at < len(spans) and spans[at][0] <= r["start_us"]
                again.append(r if inside or not r["staying"] else r | {"staying": False})
            longer = _join_runs(again, radius_m, max_wrong)
        longer = [v for v in longer if v["end_us"] - v["start_us"] >= least]
        if not longer:
            continue
        longer[0]["start_us"] = min(r["start_us"] for r in runs)
        longer[-1]["end_us"] = max(r["end_us"] for r in runs)
        for k, s in enumerate(longer):
            if k:
                p, b = longer[k - 1], s["before"]
                differs = metres(p["latitude"], p["longitude"], s["latitude"], s["longitude"]) > radius_m
                if not (b["gap"] > gap_s and differs):
                    rows.append((entity, "trip", p["end_us"], s["start_us"], (s["start_us"] - p["end_us"]) / 1e6, b["path"], b["fixes"], None, None))
            rows.append((entity, "stop", s["start_us"], s["end_us"], (s["end_us"] - s["start_us"]) / 1e6, 0.0, s["fixes"], s["latitude"], (s["longitude"] + 180) % 360 - 180))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT_SCHEMA.split(", ")])


def stops_and_trips(df: DataFrame, entity: str = "entity", ts: str = "ts", lat: str = "latitude", lon: str = "longitude", *, radius_m: float = 150.0, valley_m: float = 110.0, min_stop_s: float = 900.0, halt_s: float = 300.0, max_wrong: int = 3, gap_s: float = 7200.0, window_s: float = 900.0, dense_s: float = 600.0) -> DataFrame:
    """(entity, kind, start_us, end_us, duration_s, distance_m, fixes, latitude, longitude): a row per stop and trip.

    Rows without an entity, a time or valid coordinates take no part; repeated rows count once; order of arrival does
    not matter. A device that never stays gives no row. An empty table gives an empty result. Other columns of the
    input are ignored, whatever their names. distance_m of a trip is the length of its way over the fixes.
    """
    kind = dict(df.dtypes)[entity]
    fixes = valid_fixes(df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()), F.col(entity).alias("entity"), micros(ts).alias("us"), lat=lat, lon=lon)
    chunk = F.floor(F.col("us") / F.lit(DAY_US)).cast("bigint")
    margin = int(window_s * 1e6)
    reach = F.explode(F.sequence(F.floor((F.col("us") - margin) / F.lit(DAY_US)).cast("bigint"), F.floor((F.col("us") + margin) / F.lit(DAY_US)).cast("bigint")))
    chunks = fixes.select("entity", "us", "latitude", "longitude", chunk.alias("home"), reach.alias("chunk")).withColumn("own", F.col("home") == F.col("chunk")).drop("home")
    runs = map_segments(chunks, ["entity", "chunk"], ["us", "latitude", "longitude"], lambda b: _runs(b, window_s, dense_s, valley_m), RUN_SCHEMA.format(entity=kind))
    return map_segments(runs, ["entity"], ["start_us"], lambda b: _episodes(b, radius_m, valley_m, min_stop_s, halt_s, max_wrong, gap_s), OUT_SCHEMA.format(entity=kind))

import math

import numpy as np
from pyspark.sql import functions as F

from biosignal.operators.outliers import implausible_readings, kalman_flags

SCHEMA = "rec_id bigint, idx bigint, x double, nni double, chunk string, ord string, v0 string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(r, int(i), None if x is None else float(x), None if n is None else float(n), "a", "b", "c", "d") for r, i, x, n in rows], SCHEMA)


def flags(df, *values, **more):
    return {(r.signal, r.rec_id, r.idx, r.kind) for r in implausible_readings(df, list(values), **more).collect()}


def calm(n, seed=1, sd=1.0):
    return np.random.default_rng(seed).normal(5, sd, n)


def test_spikes_of_axes(spark):
    x = calm(900)
    x[300:400] += np.random.default_rng(2).uniform(-15, 15, 100)  # lively movement is sound
    want = {50: 60.0, 51: -70.0, 200: 45.0, 350: 80.0, 700: 61.0, 701: 62.0, 702: 64.0}
    for k, v in want.items():
        x[k] = v
    rows = [(1, i, v, None) for i, v in enumerate(x)] + [(2, i, v, None) for i, v in enumerate(calm(300, 3))]
    got = flags(frame(spark, rows), "x", chunk=128)
    assert got == {("x", 1, k, "spike") for k in want}


def test_stuck_over_chunks_and_missing(spark):
    x = list(calm(200))
    for k in range(60, 70):
        x[k] = 7.25
    for k in range(75, 80):
        x[k] = 7.25
    for k in range(70, 75):
        x[k] = None if k % 2 else float("nan")
    for k in range(100, 114):
        x[k] = 3.5  # fourteen are not stuck
    for k in range(120, 160):
        x[k] = 2.5
    rows = [(1, i, v, None) for i, v in enumerate(x)]
    want = {("x", 1, k, "stuck") for k in [*range(60, 70), *range(75, 80), *range(120, 160)]}
    for chunk in (8, 16, 64, 512):
        assert {g for g in flags(frame(spark, rows + rows[::4]), "x", chunk=chunk, margin=8) if g[3] == "stuck"} == want


def test_stuck_level_far_away_hides_no_spikes(spark):
    for level in (300.0, 40.0):  # above the spikes, and less than a factor of two below them
        x = calm(900)
        x[500:540] = level
        want = {50: 60.0, 51: -70.0, 200: 65.0, 700: 61.0}
        for k, v in want.items():
            x[k] = v
        rows = [(1, i, v, None) for i, v in enumerate(x)]
        for chunk in (128, 520):  # inside a chunk, and over the edge of two
            got = flags(frame(spark, rows), "x", chunk=chunk)
            assert got == {("x", 1, k, "spike") for k in want} | {("x", 1, k, "stuck") for k in range(500, 540)}, (level, chunk)


def test_impossible(spark):
    x = calm(100)
    x[10:16] = 500.0  # more than three in a row
    x[20] = math.inf
    d = frame(spark, [(1, i, v, None) for i, v in enumerate(x)]).withColumn("scale", F.lit(100.0))
    got = flags(d, "x", limits={"x": (-F.col("scale"), F.col("scale"))})
    assert {g[2] for g in got if g[3] == "impossible"} == {*range(10, 16), 20}


def test_intervals(spark):
    rng = np.random.default_rng(4)
    level = 900 + 250 * np.sin(np.arange(800) / 60)  # effort and recovery
    n = level * rng.uniform(0.93, 1.07, 800)
    want = {}
    for k, f in ((30, 1.9), (31, 1.8), (200, 0.5), (450, 3.0), (451, 2.9), (452, 2.95), (700, 0.45)):
        n[k] = level[k] * f
        want[k] = "spike"
    n[500], n[501] = -5.0, 40_000.0
    rows = [(1, i, None, v) for i, v in enumerate(n)]
    got = flags(frame(spark, rows[::-1] + rows[:50]), "nni", ratio=True, limits={"nni": (200.0, 3000.0)}, threshold=2.2, chunk=100, margin=20)
    assert {g[2] for g in got} == {*want, 500, 501}


def test_null_keys_empty_and_constant(spark):
    rows = [(None, 1, 3.0, None)] * 20 + [(1, k, 4.0, None) for k in range(10)] + [(2, k, None, None) for k in range(30)]
    d = frame(spark, rows)
    assert flags(d, "x") == set()
    assert flags(d.where(F.lit(False)), "x") == set()
    assert flags(d, "nni", ratio=True) == set()


def test_filter_withholds_flagged_readings():
    z = np.zeros((60, 1))
    z[30] = 50
    f = kalman_flags(z, np.zeros(1), np.ones(1), 0.05, 3.0, 3, True)
    assert f[30, 0] and f.sum() == 1


def test_spikes_beside_a_stuck_run(spark):
    x = np.random.default_rng(0).normal(0, 1, 2000)
    want = {100: 20.0, 500: -19.0, 900: 25.0, 1300: 21.0, 1700: -22.0}
    for k, v in want.items():
        x[k] = v
    x[1000:1020] = 24.0
    for chunk in (512, 1010):
        got = flags(frame(spark, [(1, i, v, None) for i, v in enumerate(x)]), "x", chunk=chunk)
        assert got == {("x", 1, k, "spike") for k in want} | {("x", 1, k, "stuck") for k in range(1000, 1020)}


def test_runs_over_groups_of_chunks(spark, monkeypatch):
    """Runs of equal values over any number of chunks and groups, against a plain count."""
    from biosignal.operators import outliers

    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(5, 1, 60).round(2), rng.integers(1, 31, 60))
    x[rng.random(len(x)) < 0.1] = np.nan
    want, run = set(), []
    for i, v in [*enumerate(x), (None, None)]:
        if v is not None and np.isnan(v):
            continue
        if run and (v is None or v != x[run[-1]]):
            want |= set(run) if len(run) >= 15 else set()
            run = []
        run.append(i)
    monkeypatch.setattr(outliers, "GROUP", 3)
    for chunk in (4, 7, 64):
        got = {g[2] for g in flags(frame(spark, [(1, i, v, None) for i, v in enumerate(x)]), "x", chunk=chunk, margin=4) if g[3] == "stuck"}
        assert got == want


def test_longest_level_of_runs():
    from biosignal.operators.outliers import _long_level

    rng = np.random.default_rng(1)
    far, seg = rng.random(40), np.repeat([0, 1, 2], [3, 20, 17])
    for i, got in enumerate(_long_level(far, seg, 4)):
        runs = [far[a : a + 4].min() for a in range(max(0, i - 3), min(i, 36) + 1) if seg[a] == seg[a + 3]]
        assert got == max(runs, default=-np.inf)

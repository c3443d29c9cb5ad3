import datetime as dt
import math
import random

from pyspark.sql import functions as F

from biosignal.operators.regrid import missing_cells, regular_grid

T0 = dt.datetime(2024, 1, 1)
READ = "rec_id bigint, idx bigint, ts timestamp, x double, y double, slot string, t0 string, step string"
REC = "rec_id bigint, started timestamp, ended timestamp, step_ms bigint, idx string, x string"


def frames(spark, readings, recordings):
    at = lambda ms: None if ms is None else T0 + dt.timedelta(milliseconds=ms)
    a = spark.createDataFrame([(r, i, at(ms), x, y, "s", "t", "u") for r, i, ms, x, y in readings], READ)
    b = spark.createDataFrame([(r, at(s), at(e), step, "i", "x") for r, s, e, step in recordings], REC)
    return a, b


def brute(readings, recordings, hold=4):
    out = {}
    for rec, s, e, step in recordings:
        if s is None or e is None or not step or e <= s:
            continue
        n = math.ceil((e - s) / step)
        for axis in (3, 4):
            own = sorted({(t[2], t[1], t[axis]) for t in readings if t[0] == rec and t[2] is not None and s <= t[2] < e and t[axis] is not None and t[axis] == t[axis]})
            for k in range(n):
                a, b = s + k * step, min(s + (k + 1) * step, e)
                w = v = c = 0
                plain = []
                for q, (ms, _, x) in enumerate(own):
                    until = min(ms + hold * step, e, own[q + 1][0] if q + 1 < len(own) else e)
                    o = max(0, min(until, b) - max(ms, a))
                    w, v = w + o, v + o * x
                    if a <= ms < b:
                        c += 1
                        plain.append(x)
                mean = v / w if w else sum(plain) / c if c else None
                out[rec, k, axis] = (mean, w / (b - a), c)
    return out


def compare(spark, readings, recordings, block):
    a, b = frames(spark, readings, recordings)
    got = {}
    for r in regular_grid(a, b, ["x", "y"], block=block).collect():
        got[r.rec_id, r.slot, 3] = (r.x_mean, r.x_coverage, r.x_readings)
        got[r.rec_id, r.slot, 4] = (r.y_mean, r.y_coverage, r.y_readings)
    want = brute(readings, recordings)
    assert got.keys() == want.keys()
    for k, (m, c, n) in want.items():
        assert got[k][2] == n and math.isclose(got[k][1], c, abs_tol=1e-9), k
        assert (m is None) == (got[k][0] is None) and (m is None or math.isclose(m, got[k][0], rel_tol=1e-9, abs_tol=1e-9)), k
    missing = {(r.rec_id, r.slot, 3 if r.axis == "x" else 4) for r in missing_cells(regular_grid(a, b, ["x", "y"], block=block), ["x", "y"]).collect()}
    assert missing == {k for k, v in want.items() if v[2] == 0}


def test_random_recordings_against_brute_force(spark):
    rng = random.Random(5)
    readings, recordings = [], [(1, 0, 95_500, 1000), (2, 500, 20_000, 500), (3, 0, 5_000, 1000), (4, 0, 1000, 0), (5, 10, 10, 100), (6, None, 5, 1)]
    for rec, s, e in ((1, 0, 95_500), (2, 500, 20_000)):
        t, i = s, 0
        while t < e + 500:
            v = [rng.choice([None, float("nan"), round(rng.uniform(-9, 9), 3)]) if rng.random() < 0.3 else round(rng.uniform(-9, 9), 3) for _ in range(2)]
            readings.append((rec, i, t - 300, *v))
            if rng.random() < 0.1:
                readings.append(readings[-1])
            t += rng.choice([130, 400, 900, 1500, 7000])
            i += 1
    readings += [(1, 9001, None, 1.0, 1.0), (None, 9002, 100, 1.0, 1.0), (1, 9003, 10_000_000, 1.0, 1.0), (77, 1, 100, 1.0, 1.0)]
    readings += [(1, 9004, 4000, 2.0, 3.0), (1, 9005, 4000, 5.0, 6.0)]  # a tie in time
    rng.shuffle(readings)
    for block in (1, 7, 1024):
        compare(spark, readings, recordings, block)


def test_one_recording_with_most_rows_is_spread(spark):
    a, b = frames(spark, [(1, i, i * 100, 1.0, None) for i in range(3000)], [(1, 0, 300_000, 100)])
    g = regular_grid(a, b, ["x", "y"], block=128)
    assert g.count() == 3000 and g.where("x_readings = 1 and x_coverage = 1 and y_readings = 0 and y_mean is null").count() == 3000
    assert "hashpartitioning(source" in g._jdf.queryExecution().toString()


def test_empty(spark):
    a, b = frames(spark, [], [(1, 0, 2500, 1000)])
    rows = regular_grid(a, b, ["x", "y"]).orderBy("slot").collect()
    assert [r.slot for r in rows] == [0, 1, 2] and all(r.x_coverage == 0 and r.x_mean is None for r in rows)
    assert regular_grid(a, b.where(F.lit(False)), ["x"]).count() == 0

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from biosignal.operators.trips import reachability, stops_and_trips

T0 = dt.datetime(2024, 3, 1, 20, 0)
SCHEMA = "ping_id bigint, entity bigint, ts timestamp, latitude double, longitude double"
M = 1 / 111194.9


def track(parts, entity=1, lat=10.0, lon=20.0, seed=1, noise=10.0):
    """parts: (seconds, north m, east m) to stay at, or ('go', seconds, north, east) to move to, or ('gap', seconds)."""
    rng = np.random.default_rng(seed)
    t, at, rows = 0.0, (0.0, 0.0), []
    for p in parts:
        if p[0] == "gap":
            t += p[1]
        elif p[0] == "go":
            for k in range(1, int(p[1] / 30)):
                f = k * 30 / p[1]
                rows.append((t + k * 30, at[0] + f * (p[2] - at[0]), at[1] + f * (p[3] - at[1])))
            t, at = t + p[1], (p[2], p[3])
        else:
            at = (p[1], p[2])
            rows += [(t + k, *(np.array(at) + rng.normal(0, noise, 2))) for k in range(0, int(p[0]) + 1, 90)]
            t += p[0]
    wrap = lambda x: (x + 180) % 360 - 180
    return [(i + entity * 100000, entity, T0 + dt.timedelta(seconds=s), float(lat + y * M), float(wrap(lon + x * M / np.cos(np.radians(lat))))) for i, (s, y, x) in enumerate(rows)]


def found(spark, rows, **more):
    d = stops_and_trips(spark.createDataFrame(rows, SCHEMA), **more)
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    return sorted((r.start_us / 1e6 - base, r.end_us / 1e6 - base, r.kind, r.distance_m) for r in d.collect())


DAY = [(3600, 0, 0), ("go", 900, 6000, 3000), (7200, 6000, 3000), ("go", 900, 0, 0), (20000, 0, 0)]


def check(out):
    kinds = [k for _, _, k, _ in out]
    assert kinds == ["stop", "trip", "stop", "trip", "stop"]
    edges = [3600, 4500, 11700, 12600]
    got = [out[1][0], out[1][1], out[3][0], out[3][1]]
    assert all(abs(a - b) <= 120 for a, b in zip(got, edges)), got
    assert out[0][0] == 0 and out[-1][1] >= 32500


def test_day_over_midnight(spark):
    out = found(spark, track(DAY))
    check(out)
    assert abs(out[1][3] - np.hypot(6000, 3000)) < 500


@pytest.mark.parametrize("lat,lon", [(-17.5, 179.999), (78.0, -179.9995), (0.0, 0.0)])
def test_anywhere_on_the_globe(spark, lat, lon):
    rows = [r for r in track(DAY, lat=lat, lon=lon) if not (r[3] == 0 and r[4] == 0)]
    check(found(spark, rows))


def test_wrong_fixes_repeats_nulls_and_order(spark):
    rows = track(DAY)
    wrong = [(900000 + k, 1, rows[i][2] + dt.timedelta(seconds=20), 10.05, 20.05) for k, i in enumerate((5, 6, 7, 90, 160))]
    junk = [(950000, 1, T0, None, 20.0), (950001, 1, T0, 999.0, 20.0), (950002, 1, None, 10.0, 20.0), (950003, None, T0, 10.0, 20.0), (950004, 1, T0, float("nan"), 20.0), (950005, 1, T0, 0.0, 0.0), (None, 2, T0, 10.0, 20.0)]
    check(found(spark, (rows + wrong + junk + rows[::3])[::-1]))


def test_gap_ends_nothing_at_the_same_place(spark):
    out = found(spark, track([(3600, 0, 0), ("gap", 4 * 3600), (3600, 0, 0)]))
    assert [k for _, _, k, _ in out] == ["stop"] and out[0][1] - out[0][0] >= 6 * 3600 - 100


def test_long_gap_to_another_place_has_no_trip(spark):
    out = found(spark, track([(3600, 0, 0), ("gap", 3 * 3600), (3600, 4000, 0)]))
    assert [k for _, _, k, _ in out] == ["stop", "stop"]
    assert abs(out[0][1] - 3600) < 100 and abs(out[1][0] - 4 * 3600) < 100


def test_short_gap_to_another_place_is_a_trip(spark):
    out = found(spark, track([(3600, 0, 0), ("gap", 3600), (3600, 4000, 0)]))
    assert [k for _, _, k, _ in out] == ["stop", "trip", "stop"]


def test_halt_belongs_to_the_trip(spark):
    out = found(spark, track([(3600, 0, 0), ("go", 600, 5000, 0), (240, 5000, 0), ("go", 600, 9000, 0), (3600, 9000, 0)]))
    assert [k for _, _, k, _ in out] == ["stop", "trip", "stop"]


def test_round_trip_to_the_same_place(spark):
    out = found(spark, track([(3600, 0, 0), ("go", 600, 900, 0), ("go", 600, 0, 0), (3600, 0, 0)]))
    assert [k for _, _, k, _ in out] == ["stop", "trip", "stop"]


NIGHT = 14 * 3600


def at_place(out, *edges, within=100):
    assert len(out) == len(edges) and all(abs(a - b) <= within for o, e in zip(out, edges) for a, b in zip(o[:2], e)), out


@pytest.mark.parametrize("every", [14, 40, 140])
def test_still_phone_with_few_pings(spark, every):
    rows = track([(NIGHT, 0, 0)])[::every]
    out = found(spark, rows)
    assert [k for _, _, k, _ in out] == ["stop"]
    at_place(out, (0, (len(rows) - 1) * every * 90))


def test_few_pings_inside_a_stay(spark):
    rows = track([(NIGHT, 0, 0)])
    out = found(spark, rows[:60] + rows[60:300:14] + rows[300:])
    assert [k for _, _, k, _ in out] == ["stop"]
    at_place(out, (0, NIGHT))


def test_few_pings_at_two_places(spark):
    rows = track([(6300, 0, 0), ("gap", 1260), (NIGHT, 4000, 0)])
    rows = rows[:71:14] + rows[71::14]
    out = found(spark, rows)
    assert [k for _, _, k, _ in out] == ["stop", "trip", "stop"]
    at_place(out, (0, 6300), (6300, 7560), (7560, 7560 + NIGHT), within=1300)


def test_few_pings_and_wrong_ones(spark):
    rows = [list(r) for r in track([(NIGHT, 0, 0)])[::14]]
    for k in (4, 11, 12, 13):
        rows[k][3] += 0.05 + 0.01 * k
    # a wrong fix near a sound one in time
    beside = [(800000 + k, 1, rows[k][2] + dt.timedelta(seconds=300), 10.3 + k / 100, 20.0) for k in (7, 8, 9, 20)]
    out = found(spark, [tuple(r) for r in rows] + beside)
    assert [k for _, _, k, _ in out] == ["stop"]


def test_few_pings_on_the_way(spark):
    assert found(spark, track([("go", NIGHT, 900000, 0)])[::42]) == []


def test_never_staying_and_empty(spark):
    assert found(spark, track([("go", 7200, 90000, 0)])) == []
    assert found(spark, []) == []


def test_clashing_columns_and_other_key(spark):
    d = spark.createDataFrame(track(DAY), SCHEMA).withColumnsRenamed({"entity": "phone"})
    for c in ("us", "chunk", "own", "home", "entity", "staying", "kind"):
        d = d.withColumn(c, F.lit("x"))
    d = d.withColumn("phone", F.concat(F.lit("p"), "phone"))
    out = stops_and_trips(d, entity="phone").collect()
    assert {r.entity for r in out} == {"p1"} and len(out) == 5


def test_reachability_is_low_where_a_device_stays():
    t = np.arange(0, 3600, 60.0)
    lat = np.where(t < 2400, 10.0, 10.0 + (t - 2400) * 10 * M)
    r = reachability(np.zeros(len(t), int), t, lat, np.full(len(t), 20.0), 900, 600)
    # ten minutes of dwell reach five minutes to both sides, 110 m for 900 s
    assert r[t < 1800].max() < 37 and r[t > 2700].min() > 500


def test_plot_of_dense_pings_holds_a_few_slices(monkeypatch):
    """The same values whatever the size of the slices, over a day's end of one device and another one."""
    from biosignal.operators import trips

    rng = np.random.default_rng(6)
    t = np.sort(rng.uniform(0, 6000, 700))
    seg = np.repeat([0, 1], [500, 200])
    t = np.r_[np.sort(t[:500]), np.sort(t[500:])]
    lat, lon = 10 + np.cumsum(rng.normal(0, 5, 700)) * M, 20 + rng.normal(0, 10, 700) * M
    whole = reachability(seg, t, lat, lon, 900, 600)
    for cells in (1, 5_000, 40_000):
        monkeypatch.setattr(trips, "CELLS", cells)
        assert reachability(seg, t, lat, lon, 900, 600) == pytest.approx(whole)
    d = np.maximum(trips.metres(lat[:500, None], lon[:500, None], lat[:500], lon[:500]), np.abs(t[:500, None] - t[:500]) * 110 / 900)
    d[np.abs(t[:500, None] - t[:500]) > 900] = np.inf
    weight = trips._dwell(t[:500], seg[:500], 225)
    core = np.empty(500)
    for i in range(500):
        order = np.argsort(d[i])
        held = np.cumsum(np.where(np.isinf(d[i][order]), 0, weight[order]))
        core[i] = d[i][order][np.argmax(held >= min(600, 0.6 * held[-1]) - 1e-4)]
    np.fill_diagonal(d, np.inf)
    assert np.maximum(core, d).min(axis=1) == pytest.approx(whole[:500], rel=1e-4)

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from biosignal.operators.nearby import containing_regions, great_circle, near_pairs

SCHEMA = "ping_id bigint, entity bigint, latitude double, longitude double, strip string, block string, n string"


def points(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute(rows, m):
    rows = sorted({r for r in rows if None not in r and abs(r[2]) <= 90 and abs(r[3]) <= 180 and not (r[2] == 0 and r[3] == 0)})
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] != b[1] and a[0] != b[0] and great_circle(a[2], a[3], b[2], b[3]) <= m:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def scatter(lat, lon, n, seed, spread=60.0, owners=4):
    rng = np.random.default_rng(seed)
    y, x = rng.normal(0, spread, n) / 111194.9, rng.normal(0, spread, n) / 111194.9 / max(1e-6, math.cos(math.radians(min(abs(lat), 89.9999))))
    return [(seed * 10000 + k, int(rng.integers(owners)), float(np.clip(lat + a, -90, 90)), float((lon + b + 180) % 360 - 180)) for k, (a, b) in enumerate(zip(y, x))]


@pytest.mark.parametrize("block", [40_000, 40])
def test_against_brute_force(spark, block):
    rows = []
    for k, (lat, lon) in enumerate([(10.0, 20.0), (-17.5, 180.0), (89.9995, 10.0), (0.002, 0.0), (69.3, -0.0001), (-89.9999, 170.0)], 1):
        rows += scatter(lat, lon, 120, k)
    rows += [(900001, 1, 50.0, 5.0), (900002, 2, 50.0, 5.0), (900003, 1, 50.0, 5.0), (900002, 2, 50.0, 5.0)]
    rows += [(None, 1, 50.0, 5.0), (900004, None, 50.0, 5.0), (900005, 3, None, 5.0), (900006, 3, 999.0, 5.0), (900007, 3, float("nan"), 5.0), (900008, 1, 0.0, 0.0), (900009, 2, 0.0, 0.0)]
    got = [(r.left_id, r.right_id) for r in near_pairs(points(spark, rows), 20.0, max_block=block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 20.0)


def test_place_with_most_points_is_cut_into_tiles(spark):
    rows = scatter(45.0, 7.0, 600, 3, spread=15.0, owners=2)
    got = [(r.left_id, r.right_id) for r in near_pairs(points(spark, rows), 20.0, max_block=100).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 20.0)


def test_names_as_ids(spark):
    rows = scatter(45.0, 7.0, 80, 3)
    d = points(spark, rows).withColumn("ping_id", F.concat(F.lit("p"), "ping_id")).withColumn("entity", F.concat(F.lit("e"), "entity"))
    got = {(r.left_id, r.right_id) for r in near_pairs(d, 20.0).collect()}
    assert got == {tuple(sorted((f"p{a}", f"p{b}"))) for a, b in brute(rows, 20.0)}


def test_one_owner_and_empty(spark):
    assert near_pairs(points(spark, scatter(45.0, 7.0, 300, 3, owners=1)), 20.0).count() == 0
    assert near_pairs(points(spark, []), 20.0).count() == 0


RINGS = {
    1: [(0, 0), (0, 2), (2, 2), (2, 0)],
    2: [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (1.0, 0.9), (0.5, 1.5), (0.5, 0.5)],  # concave, closed, nested
    3: [(10, 179.5), (10, -179.4), (11, -179.5), (11.2, 179.6)],  # over the 180th meridian
    4: [(60, -0.5), (61, -0.5), (61, 0.5), (60, 0.5)],
    5: [(5, 5), (6, 6)],  # no ring
}


def inside(ring, y, x):
    base = ring[0][1]
    p = [(a, base + (b - base + 180) % 360 - 180) for a, b in ring]
    for turn in (-360, 0, 360):
        c = False
        for (y1, x1), (y2, x2) in zip(p, p[1:] + p[:1]):
            if (y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) <= x + turn:
                c = not c
        if c:
            return True
    return False


def test_regions_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, 1, float(y), float(x)) for k, (y, x) in enumerate(np.c_[rng.uniform(-0.5, 2.5, 200), rng.uniform(-0.5, 2.5, 200)])]
    rows += [(1000 + k, 1, float(y), float((x + 180) % 360 - 180)) for k, (y, x) in enumerate(np.c_[rng.uniform(9.5, 11.5, 150), rng.uniform(179, 181, 150)])]
    rows += [(2000 + k, 1, float(y), float(x)) for k, (y, x) in enumerate(np.c_[rng.uniform(59, 62, 100), rng.uniform(-1, 1, 100)])]
    rows += [(3000, 1, None, 1.0), (None, 1, 1.0, 1.0), rows[0], rows[1]]
    z = [(k, s, float(y), float(x), "n") for k, ring in RINGS.items() for s, (y, x) in enumerate(ring)] + [(None, 0, 1.0, 1.0, "n"), (1, 99, None, 1.0, "n")]
    rng.shuffle(z)
    zones = spark.createDataFrame([(None if a is None else int(a), int(b), None if c is None else float(c), float(d), e) for a, b, c, d, e in z], "zone_id bigint, seq int, latitude double, longitude double, edges string")
    got = [(r.id, r.zone) for r in containing_regions(points(spark, rows), zones).collect()]
    want = {(r[0], k) for r in rows if r[0] is not None and r[2] is not None for k, ring in RINGS.items() if len(ring) > 2 and inside(ring, r[2], r[3])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert containing_regions(points(spark, []), zones).count() == 0
    assert containing_regions(points(spark, rows), zones.where(F.lit(False))).count() == 0


def test_blocks_of_many_owners_and_of_few():
    """One sweep of all points and a sweep an owner give the pairs of brute force."""
    from biosignal.operators.nearby import _sweep

    rng = np.random.default_rng(11)
    for n, owners, width in ((300, 250, 400), (300, 3, 60), (300, 3, 4000), (40, 1, 10)):
        lat, lon = 10 + rng.uniform(0, width, n) / 111194.9, 20 + rng.uniform(0, width, n) / 111194.9
        who = rng.integers(0, owners, n)
        block = pd.DataFrame({"strip": 1, "block": 2, "tile": "0-0", "lon": lon, "lat": lat, "id": np.arange(n), "owner": who, "home": True, "dlon": 0.0004, "part": 0})
        got = _sweep(block.sort_values(["lon", "lat", "id"]), 20.0)
        d = great_circle(lat[:, None], lon[:, None], lat, lon)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= 20 and who[i] != who[j]}
        assert set(zip(got.left_id, got.right_id)) == want and len(got) == len(want)

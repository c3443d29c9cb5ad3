"""Points near other points, and the regions that contain a point.

Near pairs. The globe is cut into strips of latitude, each into blocks of longitude; a point goes to every block that
lies within the distance of it, so strips and blocks overlap by that distance. Partitions are ranges of strips and blocks.
Inside a block the points are ordered by longitude and swept with an active window, and distances are verified. Points of one
owner are no pairs: where few owners pile up, each is swept against the others, where many do, all at once. Of the blocks that see a pair, the one that holds
the point with the smaller id in its core owns it.

Blocks are counted first (with map-side combining). A block whose points all belong to one owner cannot hold a pair and
its points are not moved at all: that is where a phone lies for days. A block with more than `max_block` points is cut
into tiles: its points are salted into g parts, and each pair of parts is a task of its own, so that no task is larger
than two parts however many points pile up.

Regions. The edges of every ring are cut into strips; a point joins the edges of its strip and block, and the parity
of the edges west of it tells whether it is inside. Rings of any size work, as only the edges of one strip meet a point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biosignal.operators.blocks import changes, map_segments
from biosignal.operators.trips import DEGREE_M
from biosignal.sources.tables import valid_fixes

DIAMETER_M = 12742018.0


def great_circle(lat1, lon1, lat2, lon2):
    """Haversine distance in metres of NumPy arrays of degrees."""
    a, b, c, d = np.radians(lat1), np.radians(lon1), np.radians(lat2), np.radians(lon2)
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return DIAMETER_M * np.arcsin(np.sqrt(np.minimum(h, 1)))


def _strip_blocks(strip: Column, height: float, width_m: float) -> Column:
    """Number of blocks round the globe in a strip; 1 next to a pole."""
    top = F.least(F.greatest(F.abs(strip * height), F.abs((strip + 1) * height)) + height, F.lit(90.0))
    return F.greatest(F.floor(F.cos(F.radians(top)) * (360 * DEGREE_M / width_m)), F.lit(1)).cast("bigint")


def _reach_degrees(strip: Column, height: float, distance_m: float) -> Column:
    """Longitudes that points of a strip can be apart and still be within the distance; 360 near a pole."""
    top = F.least(F.greatest(F.abs(strip * height), F.abs((strip + 1) * height)) + 2 * distance_m / DEGREE_M, F.lit(90.0))
    ratio = F.sin(F.lit(distance_m / DIAMETER_M)) / F.cos(F.radians(top))
    return F.when((top < 89.99) & (ratio < 0.5), F.degrees(F.lit(2.0) * F.asin(F.least(ratio, F.lit(0.5)))) * 1.001).otherwise(F.lit(360.0))


def _in_blocks(points: DataFrame, distance_m: float, height: float) -> DataFrame:
    """Each point in every (strip, block) within the distance of it; home where it lies in the block itself."""
    reach = distance_m / DEGREE_M * 1.0001
    low, high = F.floor((F.col("lat") - reach) / height).cast("bigint"), F.floor((F.col("lat") + reach) / height).cast("bigint")
    p = points.withColumn("home_strip", F.floor(F.col("lat") / height).cast("bigint")).withColumn("strip", F.explode(F.sequence(low, high)))
    p = p.withColumn("blocks", _strip_blocks(F.col("strip"), height, height * DEGREE_M)).withColumn("dlon", _reach_degrees(F.col("strip"), height, distance_m))
    east = F.pmod(F.col("lon") + 180.0, F.lit(360.0))
    at = lambda x: F.floor(x / 360 * F.col("blocks")).cast("bigint")
    first, last = at(east - F.col("dlon")), F.least(at(east + F.col("dlon")), at(east - F.col("dlon")) + F.col("blocks") - 1)
    p = p.withColumn("turn", F.explode(F.sequence(first, last))).withColumn("block", F.pmod(F.col("turn"), F.col("blocks")))
    return p.withColumn("home", (F.col("strip") == F.col("home_strip")) & (F.pmod(at(east), F.col("blocks")) == F.col("block"))).drop("home_strip", "blocks", "turn")


def _sweep(block: pd.DataFrame, distance_m: float) -> pd.DataFrame:
    """Pairs of different owners within the distance, of blocks in order of longitude."""
    block = block[changes(block, ["strip", "block", "tile", "lon", "lat", "id"])]
    start = np.flatnonzero(changes(block, ["strip", "block", "tile"]))
    ends = np.r_[start[1:], len(block)]
    ids, lat, lon, part, tile = (block[c].to_numpy() for c in ("id", "lat", "lon", "part", "tile"))
    home, dlon = block.home.to_numpy(bool), block.dlon.to_numpy()
    owner = pd.factorize(block.owner)[0]
    left, right, far = [], [], []
    for a, b in zip(start, ends):
        at = slice(a, b)
        base, reach = lon[a], dlon[a]
        x = (lon[at] - base + 180) % 360 - 180 if reach < 360 else np.zeros(b - a)
        rank = np.argsort(x, kind="stable")
        x, who, sub, la, lo, no, hm = x[rank], owner[at][rank], part[at][rank], lat[at][rank], lon[at][rank], ids[at][rank], home[at][rank]
        tiles = tile[a].split("-")
        cross = len(tiles) == 2 and tiles[0] != tiles[1]
        groups = np.unique(who)
        if len(groups) < 2:
            continue

        def verify(i: np.ndarray, j: np.ndarray) -> None:
            ok = (np.abs(la[i] - la[j]) <= distance_m / DEGREE_M * 1.0001) & (who[i] != who[j])
            if cross:
                ok &= sub[i] != sub[j]
            i, j = i[ok], j[ok]
            d = great_circle(la[i], lo[i], la[j], lo[j])
            smaller = np.where(no[i] < no[j], i, j)
            ok = (d <= distance_m) & hm[smaller] & (no[i] != no[j])
            left.append(np.minimum(no[i], no[j])[ok])
            right.append(np.maximum(no[i], no[j])[ok])
            far.append(d[ok])

        def windows(mine: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            """Each of `mine` with the `other` from low to high, some millions of pairs at once."""
            todo = 0
            while todo < len(mine):
                upto = todo + max(1, int(np.searchsorted(np.cumsum((high - low)[todo:]), 2_000_000)))
                n = (high - low)[todo:upto]
                i = np.repeat(mine[todo:upto], n)
                verify(i, other[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[todo:upto], n)])
                todo = upto

        every = np.arange(len(x))
        end = np.searchsorted(x, x + reach, side="right")
        if int((end - every - 1).sum()) <= len(groups) * len(x):
            windows(every, every, every + 1, end)
            continue
        # the active window of each point, against the points of the owners after its own
        order = np.argsort(who, kind="stable")
        bounds = np.r_[np.searchsorted(who[order], groups), len(order)]
        rest = np.ones(len(x), bool)
        for k in range(len(groups)):
            mine = order[bounds[k] : bounds[k + 1]]
            rest[mine] = False
            other = np.flatnonzero(rest)
            if not len(other):
                break
            windows(mine, other, np.searchsorted(x[other], x[mine] - reach), np.searchsorted(x[other], x[mine] + reach, side="right"))
    if not left:
        return pd.DataFrame({"left_id": [], "right_id": [], "distance_m": []})
    return pd.DataFrame({"left_id": np.concatenate(left), "right_id": np.concatenate(right), "distance_m": np.concatenate(far)})


def near_pairs(df: DataFrame, distance_m: float, id: str = "ping_id", owner: str = "entity", lat: str = "latitude", lon: str = "longitude", *, height: float = 0.002, max_block: int = 40_000) -> DataFrame:
    """(left_id, right_id, distance_m): pairs of points of different owners at most `distance_m` apart, left_id < right_id.

    Points without an id, an owner or valid coordinates take no part; a repeated point counts once; points at the same
    place are a pair at distance 0. Works across the 180th meridian and at the poles. Empty in, empty out. The height of a
    strip (degrees) must be larger than the distance.
    """
    kind = dict(df.dtypes)[id]
    if distance_m / DEGREE_M > height:
        height = 4 * distance_m / DEGREE_M
    p = valid_fixes(df.where(F.col(id).isNotNull() & F.col(owner).isNotNull()), F.col(id).alias("id"), F.col(owner).alias("owner"), lat=lat, lon=lon)
    p = p.withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    p = _in_blocks(p, distance_m, height)
    count = p.groupBy("strip", "block").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("a"), F.max("owner").alias("b"))
    kept = count.where(F.col("a") != F.col("b")).select("strip", "block", F.greatest(F.ceil(F.col("n") / (max_block / 2)), F.lit(1)).cast("int").alias("parts"))
    kept = kept.withColumn("parts", F.when(F.col("parts") <= 2, F.lit(1)).otherwise(F.col("parts")))
    p = p.join(kept, ["strip", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.concat_ws("-", F.least(q, F.col("part")).cast("string"), F.greatest(q, F.col("part")).cast("string")))
    p = p.select("id", "owner", "lat", "lon", "strip", "block", "dlon", "home", "part", F.explode(tile).alias("tile"))
    return map_segments(p, ["strip", "block", "tile"], ["lon", "lat", "id"], lambda b: _sweep(b, distance_m), f"left_id {kind}, right_id {kind}, distance_m double", ranged=True)


def ring_edges(zones: DataFrame, zone: str = "zone_id", seq: str = "seq", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(zone, y1, x1, y2, x2): the edges of each closed ring, with x continued over the 180th meridian from its first corner."""
    z = zones.where(F.col(zone).isNotNull()).select(F.col(zone).alias("zone"), F.col(seq).alias("seq"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    z = z.where(F.coalesce((F.abs("y") <= 90) & (F.abs("x") <= 180), F.lit(False)))
    w = Window.partitionBy("zone").orderBy("seq", "y", "x")
    base = F.first("x").over(w)
    z = z.withColumn("x", base + F.pmod(F.col("x") - base + 180.0, F.lit(360.0)) - 180.0)
    z = z.withColumn("y2", F.coalesce(F.lead("y").over(w), F.first("y").over(w))).withColumn("x2", F.coalesce(F.lead("x").over(w), F.first("x").over(w)))
    return z.select("zone", F.col("y").alias("y1"), F.col("x").alias("x1"), "y2", "x2")


def containing_regions(df: DataFrame, zones: DataFrame, id: str = "ping_id", lat: str = "latitude", lon: str = "longitude", zone: str = "zone_id", seq: str = "seq", *, height: float = 0.25) -> DataFrame:
    """(id, zone): the regions that contain each valid point; a point in several gives several rows, in none gives none.

    Rings go either way round and may repeat their first corner; edges are straight in degrees. A point on a western or
    southern edge is inside, on an eastern or northern one outside. Corners without a place are left out; rings of fewer
    than three corners contain nothing. Repeated points count once, where they repeat within the same place.
    """
    e = ring_edges(zones, zone, seq, lat, lon).withColumn("low", F.least("y1", "y2")).withColumn("high", F.greatest("y1", "y2")).where(F.col("low") < F.col("high"))
    e = e.withColumn("strip", F.explode(F.sequence(F.floor(F.col("low") / height).cast("bigint"), F.floor(F.col("high") / height).cast("bigint"))))
    s = e.groupBy("zone", "strip").agg(F.collect_list(F.struct("y1", "x1", "y2", "x2")).alias("edges"), F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"), F.min("low").alias("south"), F.max("high").alias("north"))
    # points are looked for at x, x - 360 and x + 360, as a ring over the 180th meridian is continued past it
    s = s.withColumn("turn", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)))).where((F.col("west") + F.col("turn") <= 180) & (F.col("east") + F.col("turn") >= -180))
    s = s.withColumn("col", F.explode(F.sequence(F.floor((F.col("west") + F.col("turn")) / height).cast("bigint"), F.floor((F.col("east") + F.col("turn")) / height).cast("bigint"))))
    p = valid_fixes(df.where(F.col(id).isNotNull()), F.col(id).alias("id"), lat=lat, lon=lon)
    p = p.withColumn("strip", F.floor(F.col("latitude") / height).cast("bigint")).withColumn("col", F.floor(F.col("longitude") / height).cast("bigint"))
    x, y = F.col("longitude") - F.col("turn"), F.col("latitude")
    j = p.join(s, ["strip", "col"]).where((x >= F.col("west")) & (x <= F.col("east")) & (y >= F.col("south")) & (y <= F.col("north")))

    def west_of(e: Column) -> Column:
        crosses = (e["y1"] <= y) != (e["y2"] <= y)
        at = e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
        return crosses & (at <= x)

    inside = F.size(F.filter(F.col("edges"), west_of)) % 2 == 1
    return j.where(inside).select("id", "zone").distinct()

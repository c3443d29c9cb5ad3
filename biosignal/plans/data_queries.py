"""The pN_ queries of the general problems of TESTDATA.md, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biosignal.operators.nearby import containing_regions, near_pairs
from biosignal.operators.outliers import implausible_readings
from biosignal.operators.regrid import missing_cells, regular_grid
from biosignal.operators.trips import stops_and_trips
from biosignal.sources.tables import load

SLOT_US = 900_000_000


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stops and trips of every phone, in slots of 15 minutes."""
    found = stops_and_trips(load(spark, folder, "android_phone_location"))
    slot = lambda c: F.floor(F.col(c) / SLOT_US).cast("bigint")
    return found.select("entity", "kind", slot("start_us").alias("start_slot"), slot("end_us").alias("end_slot"))


def p1_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Stops and trips with their times, durations, distances and places."""
    return stops_and_trips(load(spark, folder, "android_phone_location"))


def _acc_grid(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid(load(spark, folder, "acceleration"), load(spark, folder, "recordings").where(F.col("sensor") == "acc"), ["x", "y", "z"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Grid slots of the acceleration recordings without a reading, by axis."""
    return missing_cells(_acc_grid(spark, folder), ["x", "y", "z"])


def p2_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The regular series: time-weighted means and coverage of every cell."""
    grid = _acc_grid(spark, folder)
    return grid.select("rec_id", "slot", *[F.round(F.col(f"{v}_{what}") + 1e-10, 6).alias(f"{v}_{what}") for v in "xyz" for what in ("mean", "coverage")], *[f"{v}_readings" for v in "xyz"])


NEAR_M = 20.0


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of fixes of different phones at most 20 m apart, and the zones that contain a fix."""
    fixes = load(spark, folder, "android_phone_location")
    near = near_pairs(fixes, NEAR_M).select(F.lit("near").alias("kind"), "left_id", "right_id")
    inside = containing_regions(fixes, load(spark, folder, "zones")).select(F.lit("inside").alias("kind"), F.col("id").alias("left_id"), F.col("zone").alias("right_id"))
    return near.unionByName(inside)


def p3_near_distances(spark: SparkSession, folder: str) -> DataFrame:
    """The near pairs with their distance in centimetres."""
    pairs = near_pairs(load(spark, folder, "android_phone_location"), NEAR_M)
    return pairs.select("left_id", "right_id", F.floor(F.col("distance_m") * 10).cast("bigint").alias("decimetres"))


#: Milliseconds of each unit, and what an interval between heart beats can be.
UNIT_MS = {"ns": 1e-6, "us": 1e-3, "ms": 1.0, "s": 1e3}
HEART_MS = (200.0, 3000.0)


def _axes(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible readings of the acceleration axes; a sensor cannot give more than its full scale."""
    scale = load(spark, folder, "recordings").select(F.col("rec_id").alias("rec"), F.nanvl("full_scale", F.lit(None)).alias("scale")).where(F.col("scale").isNotNull())
    x = load(spark, folder, "acceleration").select("rec_id", "idx", "x", "y", "z").join(scale, F.col("rec_id") == F.col("rec"), "left")
    limit = (-F.col("scale") * (1 + 1e-9), F.col("scale") * (1 + 1e-9))
    return implausible_readings(x, ["x", "y", "z"], limits={v: limit for v in "xyz"})


def _beats(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible intervals between heart beats, in milliseconds. A row without a unit has the one of its recording."""
    beats = load(spark, folder, "intervals").select("rec_id", "idx", "nni", "unit")
    unit = beats.where(F.col("unit").isin(*UNIT_MS)).groupBy(F.col("rec_id").alias("rec")).agg(F.min("unit").alias("usual"))
    beats = beats.join(unit, F.col("rec_id") == F.col("rec"), "left").withColumn("unit", F.coalesce("unit", "usual"))
    factor = F.coalesce(*[F.when(F.col("unit") == u, F.lit(f)) for u, f in UNIT_MS.items()])
    beats = beats.select("rec_id", "idx", (F.nanvl("nni", F.lit(None)) * factor).alias("nni"))
    return implausible_readings(beats, ["nni"], limits={"nni": HEART_MS}, ratio=True, threshold=2.2)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that are spikes, stuck or impossible."""
    both = _axes(spark, folder).unionByName(_beats(spark, folder))
    return both.select("signal", "rec_id", "idx").distinct()


def p5_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many readings of each signal and recording are implausible, by kind."""
    both = _axes(spark, folder).unionByName(_beats(spark, folder))
    return both.groupBy("signal", "rec_id", "kind").agg(F.count(F.lit(1)).alias("readings"))


QUERIES = {"p1_found": p1_found, "p1_episodes": p1_episodes, "p2_found": p2_found, "p2_grid": p2_grid, "p3_found": p3_found, "p3_near_distances": p3_near_distances, "p5_found": p5_found, "p5_kinds": p5_kinds}

_GRID = """
rec AS (SELECT rec_id, epoch_us(started) AS t0, epoch_us(ended) AS t1, step_ms * 1000 AS step FROM recordings
        WHERE sensor = 'acc' AND step_ms > 0 AND ended > started),
grid AS (SELECT rec_id, t0, t1, step, unnest(range(0, CAST(ceil((t1 - t0) / step::DOUBLE) AS BIGINT))) AS slot FROM rec),
reading AS (SELECT DISTINCT a.rec_id, a.idx, epoch_us(a.ts) - r.t0 AS us, a.x, a.y, a.z, r.step, r.t1 - r.t0 AS len
            FROM acceleration a JOIN rec r USING (rec_id) WHERE epoch_us(a.ts) >= r.t0 AND epoch_us(a.ts) < r.t1),
long AS (SELECT rec_id, idx, us, step, len, 'x' AS axis, x AS v FROM reading UNION ALL
         SELECT rec_id, idx, us, step, len, 'y', y FROM reading UNION ALL
         SELECT rec_id, idx, us, step, len, 'z', z FROM reading),
valid AS (SELECT * FROM long WHERE v IS NOT NULL AND NOT isnan(v))"""

_FIXES = """
fix AS (SELECT DISTINCT ping_id, entity, latitude AS y, longitude AS x FROM android_phone_location
        WHERE abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0))"""
_NEAR = """
cell AS (SELECT *, CAST(floor(y / 0.0002) AS BIGINT) AS strip FROM fix),
other AS (SELECT ping_id, entity, y, x, strip + unnest([-1, 0, 1]) AS strip FROM cell),
pair AS (SELECT a.ping_id AS left_id, b.ping_id AS right_id,
                12742018 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) AS m
         FROM cell a JOIN other b ON a.strip = b.strip AND a.ping_id < b.ping_id AND a.entity <> b.entity AND abs(a.y - b.y) <= 0.00018
         WHERE least(abs(a.x - b.x), 360 - abs(a.x - b.x)) * cos(radians(least(abs(a.y), abs(b.y)))) <= 0.0004)"""

#: The definition of TESTDATA.md over whole recordings, without a filter.
_IMPLAUSIBLE = """
WITH acc AS (SELECT DISTINCT rec_id, idx, x, y, z FROM acceleration WHERE rec_id IS NOT NULL AND idx IS NOT NULL),
long AS (SELECT 'x' AS signal, rec_id, idx, x AS v FROM acc UNION ALL SELECT 'y', rec_id, idx, y FROM acc UNION ALL SELECT 'z', rec_id, idx, z FROM acc),
usual AS (SELECT rec_id, min(unit) AS unit FROM intervals GROUP BY rec_id),
beat AS (SELECT DISTINCT 'nni' AS signal, i.rec_id, idx, nni * CASE coalesce(i.unit, u.unit) WHEN 'ns' THEN 1e-6 WHEN 'us' THEN 1e-3 WHEN 'ms' THEN 1e0 WHEN 's' THEN 1e3 END AS v FROM intervals i JOIN usual u USING (rec_id)),
there AS (SELECT l.*, row_number() OVER (PARTITION BY signal, rec_id ORDER BY idx) AS n,
        CASE WHEN signal = 'nni' THEN v < 200 OR v > 3000 ELSE isinf(v) OR coalesce(abs(v) > r.full_scale * (1 + 1e-9) AND NOT isnan(r.full_scale), false) END AS impossible
        FROM (SELECT * FROM long UNION ALL SELECT * FROM beat) l LEFT JOIN recordings r USING (rec_id) WHERE v IS NOT NULL AND NOT isnan(v)),
island AS (SELECT *, n - row_number() OVER (PARTITION BY signal, rec_id, v ORDER BY n) AS i FROM there),
runs AS (SELECT *, count(*) OVER (PARTITION BY signal, rec_id, v, i) >= 15 AS stuck FROM island),
good AS (SELECT *, row_number() OVER (PARTITION BY signal, rec_id ORDER BY idx) AS k FROM runs WHERE NOT impossible),
-- spikes of axes: the lowest gap of a factor of two in the distances from the median above which eight of ten readings come in runs of three at most
middle AS (SELECT signal, rec_id, quantile_disc(v, 0.5) AS m FROM good WHERE signal <> 'nni' GROUP BY ALL),
far AS (SELECT g.signal, g.rec_id, g.idx, g.k, g.stuck, abs(g.v - m) AS far FROM good g JOIN middle USING (signal, rec_id)),
gap AS (SELECT signal, rec_id, far AS least FROM (SELECT signal, rec_id, far, lag(far) OVER (PARTITION BY signal, rec_id ORDER BY far) AS below FROM far WHERE NOT stuck AND far > 0) WHERE far >= 2 * below),
above AS (SELECT f.*, least, f.k - row_number() OVER (PARTITION BY f.signal, f.rec_id, least ORDER BY f.k) AS run FROM far f JOIN gap g ON g.signal = f.signal AND g.rec_id = f.rec_id AND f.far >= least),
sized AS (SELECT *, count(*) OVER (PARTITION BY signal, rec_id, least, run) AS length FROM above),
valid AS (SELECT signal, rec_id, min(least) AS least FROM (SELECT signal, rec_id, least FROM sized WHERE NOT stuck GROUP BY ALL HAVING avg(CASE WHEN length <= 3 THEN 1 ELSE 0 END) >= 0.8) GROUP BY ALL),
-- spikes of intervals: over 40 % off the median of the four sound ones before and after; those over 28 % off a running median are not sound
rough AS (SELECT *, median(v) OVER (PARTITION BY rec_id ORDER BY k ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM good WHERE signal = 'nni'),
sound AS (SELECT rec_id, v, k, row_number() OVER (PARTITION BY rec_id ORDER BY k) AS s FROM rough WHERE abs(v / m - 1) <= 0.28),
off AS (SELECT r.rec_id, r.idx, r.v, coalesce(max(s.s), 0) AS s FROM rough r LEFT JOIN sound s ON s.rec_id = r.rec_id AND s.k < r.k WHERE abs(r.v / r.m - 1) > 0.28 GROUP BY ALL),
based AS (SELECT o.rec_id, o.idx, o.v, median(s.v) AS base FROM off o JOIN sound s ON s.rec_id = o.rec_id AND s.s BETWEEN o.s - 3 AND o.s + 4 GROUP BY ALL),
found AS (
  SELECT signal, rec_id, idx, 'impossible' AS kind FROM runs WHERE impossible
  UNION ALL SELECT signal, rec_id, idx, 'stuck' FROM runs WHERE stuck
  UNION ALL SELECT f.signal, f.rec_id, f.idx, 'spike' FROM far f JOIN valid g ON g.signal = f.signal AND g.rec_id = f.rec_id AND f.far >= g.least WHERE NOT stuck
  UNION ALL SELECT 'nni', rec_id, idx, 'spike' FROM based WHERE abs(v / base - 1) > 0.4)"""

SQL = {
    "p5_found": f"{_IMPLAUSIBLE} SELECT DISTINCT signal, rec_id, idx FROM found",
    "p5_kinds": f"{_IMPLAUSIBLE} SELECT signal, rec_id, kind, count(DISTINCT idx) AS readings FROM found GROUP BY ALL",
    "p3_near_distances": f"""WITH {_FIXES}, {_NEAR}
SELECT left_id, right_id, CAST(floor(m * 10) AS BIGINT) AS decimetres FROM pair WHERE m <= 20""",
    "p3_found": f"""WITH {_FIXES}, {_NEAR},
corner AS (SELECT zone_id, seq, latitude AS y, first_value(longitude) OVER (PARTITION BY zone_id ORDER BY seq) AS base, longitude FROM zones),
ring AS (SELECT zone_id, seq, y, CASE WHEN longitude - base > 180 THEN longitude - 360 WHEN longitude - base < -180 THEN longitude + 360 ELSE longitude END AS x FROM corner),
edge AS (SELECT zone_id, y AS y1, x AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2
         FROM ring WINDOW w AS (PARTITION BY zone_id ORDER BY seq)),
box AS (SELECT zone_id, min(y) AS south, max(y) AS north, min(x) AS west, max(x) AS east FROM ring GROUP BY zone_id),
turned AS (SELECT f.ping_id, f.y, f.x + t.turn AS x FROM fix f CROSS JOIN (SELECT unnest([-360, 0, 360]) AS turn) t),
seen AS (SELECT f.ping_id, f.y, f.x, b.zone_id FROM turned f JOIN box b ON f.y BETWEEN b.south AND b.north AND f.x BETWEEN b.west AND b.east),
inside AS (SELECT s.ping_id, s.zone_id FROM seen s JOIN edge e USING (zone_id)
           WHERE (e.y1 <= s.y) <> (e.y2 <= s.y) AND e.x1 + (s.y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) <= s.x
           GROUP BY s.ping_id, s.x, s.zone_id HAVING count(*) % 2 = 1)
SELECT 'near' AS kind, left_id, right_id FROM pair WHERE m <= 20
UNION ALL SELECT DISTINCT 'inside', ping_id, zone_id FROM inside""",
    "p2_found": f"""WITH {_GRID},
axes AS (SELECT unnest(['x', 'y', 'z']) AS axis)
SELECT g.rec_id, a.axis, g.slot FROM grid g CROSS JOIN axes a
WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.rec_id = g.rec_id AND v.axis = a.axis AND v.us // v.step = g.slot)""",
    "p2_grid": f"""WITH {_GRID},
held AS (SELECT *, least(us + 4 * step, len, coalesce(lead(us) OVER (PARTITION BY rec_id, axis ORDER BY us, idx), len)) AS until FROM valid),
cut AS (SELECT rec_id, axis, us, v, until, step, len, unnest(range(us // step, greatest(us, until - 1) // step + 1)) AS slot FROM held),
part AS (SELECT rec_id, axis, slot, v, greatest(least(until, (slot + 1) * step, len) - greatest(us, slot * step), 0) AS w,
                CASE WHEN us // step = slot THEN 1 ELSE 0 END AS here FROM cut),
cell AS (SELECT rec_id, axis, slot, sum(w) AS w, sum(v * w) AS s, sum(here) AS c, sum(v * here) AS p FROM part GROUP BY ALL),
wide AS (SELECT g.rec_id, g.slot, least((g.slot + 1) * g.step, g.t1 - g.t0) - g.slot * g.step AS length, c.axis, c.w, c.c,
                CASE WHEN c.w > 0 THEN c.s / c.w ELSE c.p / nullif(c.c, 0) END AS mean
         FROM grid g LEFT JOIN cell c USING (rec_id, slot))
SELECT rec_id, slot, """
    + ", ".join(f"round(max(mean) FILTER (axis = '{v}') + 1e-10, 6) AS {v}_mean, round(coalesce(max(w) FILTER (axis = '{v}'), 0) / max(length)::DOUBLE + 1e-10, 6) AS {v}_coverage, CAST(coalesce(max(c) FILTER (axis = '{v}'), 0) AS BIGINT) AS {v}_readings" for v in "xyz")
    + " FROM wide GROUP BY rec_id, slot",
}

"""Registered queries of the signal operators over the tables, each over whole tables, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biosignal.functions import aggregates as A
from biosignal.functions import scalars as S
from biosignal.operators import density, detectors, dsp, frames, hrv, information, location, rqa, spectral, timedom, windows
from biosignal.plans.compose import compose, rcompose
from biosignal.sources.adapters import sampling_rate, signal
from biosignal.sources.tables import load, micros

QUERIES: dict = {}
SQL: dict[str, str] = {}


NUDGE = 1e-9
DAY = 86_400_000_000


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, other columns as they are. At six digits, sums in another order must not fall on either side of a
    half: NUDGE is added, in the SQL as well."""
    return df.select(*[F.round(F.col(c) + (NUDGE if digits == 6 else 0.0), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def significant(c, digits: int = 5) -> Column:
    """A number of any size rounded to significant digits, by powers of ten that are exact."""
    c = F.col(c) if isinstance(c, str) else c
    e = F.floor(F.log10(F.abs(c)))
    up, down = F.pow(F.lit(10.0), F.greatest(e, F.lit(0))), F.pow(F.lit(10.0), F.greatest(-e, F.lit(0)))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * down / up, digits - 1) / down * up)


def significant_sql(c: str, digits: int = 5) -> str:
    e = f"floor(log10(nullif(abs({c}), 0)))"
    up, down = f"pow(10.0, greatest({e}, 0))", f"pow(10.0, greatest(-{e}, 0))"
    return f"CASE WHEN {c} = 0 THEN 0.0 ELSE round(({c}) * {down} / {up}, {digits - 1}) / {down} * {up} END"


# ------------------------------------------------------------------ views of the tables


def sig(spark: SparkSession, folder: str) -> DataFrame:
    """(entity, ts_us, x, idx): a series per user."""
    return frames.series(load(spark, folder, "events"), "user_id", ["ts", "event_id"], "value")


def centred(spark: SparkSession, folder: str) -> DataFrame:
    """sig with x less 100: it has zero crossings."""
    return sig(spark, folder).withColumn("x", F.col("x") - 100)


def sig_long(spark: SparkSession, folder: str) -> DataFrame:
    """A long series per type of event."""
    return frames.series(load(spark, folder, "events"), "event_type", ["ts", "event_id"], "value")


def nni(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals in milliseconds."""
    return frames.series(load(spark, folder, "events"), "user_id", ["ts", "event_id"], F.lit(600.0) + F.col("value"), name="nni")


def geo(spark: SparkSession, folder: str) -> DataFrame:
    """A track per user."""
    place = {"ts": F.col("ts"), "latitude": F.lit(51.0) + F.col("value") / 10000.0, "longitude": (F.col("event_id") % 97 - 48).cast("double") / 10000.0}
    return frames.series(load(spark, folder, "events"), "user_id", ["ts", "event_id"], "value", keep=place)


def acc(spark: SparkSession, folder: str) -> DataFrame:
    """Acceleration readings with all three axes."""
    v = load(spark, folder, "acceleration").select("rec_id", "idx", "ts", "entity", "x", "y", "z")
    there = F.lit(True)
    for c in "xyz":
        there = there & F.col(c).isNotNull() & ~F.isnan(c)
    return v.where(there).distinct()


def labels(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "embeddings")
    return e.select((F.col("vec_id") % 5).alias("entity"), "vec_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("label"))


def spectrum(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "embeddings").select(F.col("vec_id").alias("entity"), F.posexplode("embedding").alias("k", "v"))
    return e.select("entity", F.col("k").cast("bigint").alias("k"), (F.col("k") / F.lit(100.0)).alias("freq"), F.abs(F.col("v").cast("double")).alias("psd"))


_ORDER = "CAST(row_number() OVER (PARTITION BY {e} ORDER BY ts, event_id) - 1 AS BIGINT) AS idx"
V_SIG = f"sig AS (SELECT user_id AS entity, {_ORDER.format(e='user_id')}, ts, value AS x FROM events)"
V_CEN = f"sig AS (SELECT user_id AS entity, {_ORDER.format(e='user_id')}, ts, value - 100 AS x FROM events)"
V_LONG = f"sig AS (SELECT event_type AS entity, {_ORDER.format(e='event_type')}, ts, value AS x FROM events)"
V_NNI = f"nni AS (SELECT user_id AS entity, {_ORDER.format(e='user_id')}, ts, CAST(600 AS DOUBLE) + value AS nni FROM events)"
V_GEO = f"geo AS (SELECT user_id AS entity, {_ORDER.format(e='user_id')}, ts, CAST(51 AS DOUBLE) + value / CAST(10000 AS DOUBLE) AS latitude, CAST(event_id % 97 - 48 AS DOUBLE) / CAST(10000 AS DOUBLE) AS longitude FROM events)"
V_ACC = "acc AS (SELECT DISTINCT rec_id, idx, ts, entity, x, y, z FROM acceleration WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z))"
V_LAB = "lab AS (SELECT vec_id % 5 AS entity, vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS label FROM embeddings)"
V_SPEC = "spec AS (SELECT vec_id AS entity, CAST(pos AS BIGINT) AS k, CAST(pos AS DOUBLE) / CAST(100 AS DOUBLE) AS freq, abs(CAST(col AS DOUBLE)) AS psd FROM (SELECT vec_id, unnest(embedding) AS col, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"
W = "OVER (PARTITION BY entity ORDER BY idx)"


def hav_sql(a: str, b: str, c: str, d: str) -> str:
    return f"12742.018 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


# ------------------------------------------------------------------ statistics


@query
def stats_summary(spark, folder):
    d = sig(spark, folder).groupBy("entity")
    a = d.agg(A.mean("x").alias("mean"), A.median("x").alias("median"), A.std("x").alias("std"), A.var("x").alias("var"), A.minmax("x").alias("mm"), A.drange("x").alias("drange"), A.percentile("x", 90).alias("p90"))
    return rounded(a.select("entity", "mean", "median", "std", "var", F.col("mm.min").alias("dmin"), F.col("mm.max").alias("dmax"), "drange", "p90"))


SQL["stats_summary"] = f"WITH {V_SIG} SELECT entity, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, round(var_pop(x), 6) AS var, round(min(x), 6) AS dmin, round(max(x), 6) AS dmax, round(max(x) - min(x), 6) AS drange, round(quantile_cont(x, 0.9), 6) AS p90 FROM sig GROUP BY entity"


@query
def stats_iqr(spark, folder):
    return rounded(sig(spark, folder).groupBy("entity").agg(A.interquartile_range("x").alias("iqr")))


SQL["stats_iqr"] = f"WITH {V_SIG} SELECT entity, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM sig GROUP BY entity"


@query
def stats_mode(spark, folder):
    return rounded(sig_long(spark, folder).groupBy("entity").agg(A.mode("x").alias("mode")))


SQL["stats_mode"] = f"WITH {V_LONG}, c AS (SELECT entity, x, count(*) AS n FROM sig GROUP BY ALL) SELECT entity, round(x, 6) AS mode FROM c QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, x) = 1"


@query
def stats_moments(spark, folder):
    return rounded(sig(spark, folder).groupBy("entity").agg(A.skewness("x").alias("skewness"), A.kurtosis("x").alias("kurtosis"), A.kurtosis_excess("x").alias("kurtosis_excess")))


SQL["stats_moments"] = f"WITH {V_SIG}, m AS (SELECT entity, avg(x) AS mu, stddev_pop(x) AS sd FROM sig GROUP BY entity) SELECT entity, round(CASE WHEN max(sd) = 0 THEN 0 ELSE avg(pow(x - mu, 3)) / pow(max(sd), 3) END, 6) AS skewness, round(CASE WHEN max(sd) = 0 THEN 0 ELSE avg(pow(x - mu, 4)) / pow(max(sd), 4) END, 6) AS kurtosis, round(CASE WHEN max(sd) = 0 THEN 0 ELSE avg(pow(x - mu, 4)) / pow(max(sd), 4) END - 3, 6) AS kurtosis_excess FROM sig JOIN m USING (entity) GROUP BY entity"


@query
def stats_coeff_var(spark, folder):
    return rounded(sig(spark, folder).groupBy("entity").agg(A.coeff_var("x").alias("coeff_var")))


SQL["stats_coeff_var"] = f"WITH {V_SIG} SELECT entity, round(stddev_pop(x) / nullif(avg(x), 0), 6) AS coeff_var FROM sig GROUP BY entity"



@query
def frame_signal(spark, folder):
    """A series of the first numeric column that is neither the entity nor part of the order."""
    return rounded(signal(load(spark, folder, "events"), "event_type", ["ts", "event_id", "user_id"]).select("entity", "idx", "x"))


SQL["frame_signal"] = "WITH s AS (SELECT event_type AS entity, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id, user_id) - 1 AS BIGINT) AS idx, value AS x FROM events) SELECT entity, idx, round(x, 6) AS x FROM s"


@query
def frame_rate(spark, folder):
    """Sampling rate after the first two readings of each recording."""
    a = load(spark, folder, "acceleration").where(F.col("ts").isNotNull()).select("rec_id", "idx", "ts").distinct()
    return sampling_rate(frames.series(a, "rec_id", ["ts", "idx"], F.col("idx"))).select("entity", significant("fs").alias("fs"))


SQL["frame_rate"] = f"WITH a AS (SELECT DISTINCT rec_id AS entity, idx, epoch_us(ts) AS us FROM acceleration WHERE ts IS NOT NULL AND rec_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us, idx) AS n FROM a), f AS (SELECT entity, 1e6 / nullif(max(us) - min(us), 0) AS fs FROM r WHERE n <= 2 GROUP BY entity) SELECT entity, {significant_sql('fs')} AS fs FROM f"


@query
def scalar_absolute(spark, folder):
    """Absolute and identical values."""
    return rounded(centred(spark, folder).select("entity", "idx", S.absolute("x").alias("size"), S.identity(F.col("x")).alias("same")))


SQL["scalar_absolute"] = f"WITH {V_CEN} SELECT entity, idx, round(abs(x), 6) AS size, round(x, 6) AS same FROM sig"

# ------------------------------------------------------------------ time domain

_GRAD = f"coalesce((lead(x) {W} - lag(x) {W}) / 2, lead(x) {W} - x, x - lag(x) {W})"


@query
def timedom_gradient(spark, folder):
    return rounded(timedom.gradient(centred(spark, folder)).select("entity", "idx", "gradient"))


SQL["timedom_gradient"] = f"WITH {V_CEN} SELECT entity, idx, round({_GRAD}, 6) AS gradient FROM sig"


@query
def timedom_hjorth(spark, folder):
    return rounded(timedom.hjorth_parameters(centred(spark, folder)))


SQL["timedom_hjorth"] = f"WITH {V_CEN}, a AS (SELECT entity, idx, x AS x0, {_GRAD} AS x FROM sig), b AS (SELECT entity, x0, x AS d1, {_GRAD} AS d2 FROM a) SELECT entity, round(var_pop(x0), 6) AS activity, round(sqrt(var_pop(d1) / nullif(var_pop(x0), 0)), 6) AS mobility, round(sqrt(var_pop(d2) / nullif(var_pop(d1), 0)) / nullif(sqrt(var_pop(d1) / nullif(var_pop(x0), 0)), 0), 6) AS complexity FROM b GROUP BY entity"


@query
def timedom_line_length(spark, folder):
    return rounded(timedom.line_length(sig(spark, folder)))


SQL["timedom_line_length"] = f"WITH {V_SIG}, d AS (SELECT entity, abs(x - lag(x) {W}) AS d FROM sig) SELECT entity, round(coalesce(sum(d), 0), 6) AS line_length FROM d GROUP BY entity"


@query
def timedom_zero_crossings(spark, folder):
    return timedom.zero_crossings(centred(spark, folder), threshold=20).select("entity", "idx", "crossing")


SQL["timedom_zero_crossings"] = f"WITH {V_CEN}, p AS (SELECT entity, idx, (CASE WHEN abs(x) <= 20 THEN 0 ELSE x END) > 0 AS p FROM sig), c AS (SELECT entity, idx, p <> lag(p) {W} AS crossing FROM p) SELECT * FROM c WHERE crossing IS NOT NULL"


@query
def timedom_zero_crossing_count(spark, folder):
    return timedom.zero_crossing_count(centred(spark, folder))


SQL["timedom_zero_crossing_count"] = f"WITH {V_CEN}, p AS (SELECT entity, idx, x > 0 AS p FROM sig), c AS (SELECT entity, p <> lag(p) {W} AS c FROM p) SELECT entity, CAST(count(*) FILTER (c) AS BIGINT) AS crossings FROM c GROUP BY entity"


@query
def timedom_o1fit(spark, folder):
    f = sig(spark, folder).groupBy("entity").agg(A.o1fit(F.col("idx").cast("double"), F.col("x")).alias("f"))
    return rounded(f.select("entity", "f.intercept", "f.slope"))


SQL["timedom_o1fit"] = f"WITH {V_SIG} SELECT entity, round(regr_intercept(x, idx::DOUBLE), 6) AS intercept, round(regr_slope(x, idx::DOUBLE), 6) AS slope FROM sig GROUP BY entity"


@query
def timedom_o1fit_multi(spark, folder):
    """One fit of each axis on the order, for every recording. A reading takes part in the fits of the axes that it has."""
    v = load(spark, folder, "acceleration").select("rec_id", "idx", "x", "y", "z").distinct()
    there = lambda c: F.nanvl(c, F.lit(None))
    t = F.col("idx").cast("double")
    a = v.groupBy("rec_id").agg(*[A.o1fit(t, there(c)).alias(c) for c in "xyz"])
    return a.select("rec_id", *[significant(F.col(f"{c}.{p}")).alias(f"{c}_{p}") for c in "xyz" for p in ("intercept", "slope")])


SQL["timedom_o1fit_multi"] = "WITH acc AS (SELECT DISTINCT rec_id, idx, " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in "xyz") + " FROM acceleration), f AS (SELECT rec_id, " + ", ".join(f"regr_intercept({c}, idx::DOUBLE) AS {c}_intercept, regr_slope({c}, idx::DOUBLE) AS {c}_slope" for c in "xyz") + " FROM acc GROUP BY rec_id) SELECT rec_id, " + ", ".join(f"{significant_sql(f'{c}_{p}')} AS {c}_{p}" for c in "xyz" for p in ("intercept", "slope")) + " FROM f"


@query
def timedom_hurst(spark, folder):
    return rounded(timedom.hurst(sig_long(spark, folder), range(2, 20)))


SQL["timedom_hurst"] = f"WITH {V_LONG}, l AS (SELECT unnest(range(2, 20)) AS l), d AS (SELECT a.entity, l, b.x - a.x AS d FROM sig a CROSS JOIN l JOIN sig b ON b.entity = a.entity AND b.idx = a.idx + l), s AS (SELECT entity, l, stddev_pop(d) AS s FROM d GROUP BY ALL) SELECT entity, round(2 * regr_slope(ln(sqrt(s)), ln(l)), 6) AS hurst FROM s GROUP BY entity"


@query
def timedom_dfa(spark, folder):
    return rounded(timedom.dfa(sig_long(spark, folder), [8, 16, 32, 64]))


SQL["timedom_dfa"] = f"WITH {V_LONG}, m AS (SELECT *, x - avg(x) OVER (PARTITION BY entity) AS c FROM sig), p AS (SELECT entity, idx, sum(c) {W} AS y FROM m), w AS (SELECT unnest([8, 16, 32, 64]) AS w), k AS (SELECT entity, w, idx // w AS k, idx % w AS u, y FROM p CROSS JOIN w), f AS (SELECT entity, w, k, count(*) AS n, greatest(regr_syy(y, u::DOUBLE) - pow(regr_sxy(y, u::DOUBLE), 2) / regr_sxx(y, u::DOUBLE), 0) AS ssr FROM k GROUP BY ALL HAVING count(*) = w), g AS (SELECT entity, w, avg(sqrt(ssr / w)) AS f FROM f GROUP BY ALL) SELECT entity, round(regr_slope(ln(f), ln(w)), 6) AS dfa FROM g GROUP BY entity"


@query
def timedom_hurst_default(spark, folder):
    """All the lags from 2 to 63."""
    return rounded(timedom.hurst(sig_long(spark, folder)))


SQL["timedom_hurst_default"] = SQL["timedom_hurst"].replace("range(2, 20)", "range(2, 64)")


@query
def timedom_dfa_second(spark, folder):
    """Fits of second order over windows that overlap by half."""
    return rounded(timedom.dfa(sig_long(spark, folder), [8, 16, 32, 64], order=2, overlap=50))


SQL["timedom_dfa_second"] = f"WITH {V_LONG}, m AS (SELECT *, x - avg(x) OVER (PARTITION BY entity) AS c FROM sig), p AS (SELECT entity, idx, sum(c) {W} AS y FROM m), w AS (SELECT unnest([8, 16, 32, 64]) AS w), k AS (SELECT entity, w, unnest([idx // (w // 2) - 1, idx // (w // 2)]) AS k, idx, y FROM p CROSS JOIN w), u AS (SELECT entity, w, k, idx - k * (w // 2) - (w - 1) / 2.0 AS t, y FROM k WHERE k >= 0), f AS (SELECT entity, w, k, greatest(var_pop(y) * w - pow(covar_pop(y, t) * w, 2) / (var_pop(t) * w) - pow(covar_pop(y, t * t) * w, 2) / (var_pop(t * t) * w), 0) AS ssr FROM u GROUP BY entity, w, k HAVING count(*) = w), g AS (SELECT entity, w, avg(sqrt(ssr / w)) AS f FROM f GROUP BY ALL) SELECT entity, round(regr_slope(ln(f), ln(w)), 6) AS dfa FROM g GROUP BY entity"

# ------------------------------------------------------------------ windows


@query
def roll_count_mean(spark, folder):
    return rounded(windows.rolling(sig(spark, folder), {"mean": A.mean("x")}, 8, 4))


SQL["roll_count_mean"] = f"WITH {V_SIG}, r AS (SELECT entity, idx, avg(x) OVER f AS mean, count(*) OVER f AS n FROM sig WINDOW f AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT entity, idx // 4 AS window, round(mean, 6) AS mean FROM r WHERE idx % 4 = 0 AND n = 8"


@query
def roll_count_multi(spark, folder):
    return rounded(windows.rolling(sig(spark, folder), {"low": A.dmin("x"), "high": A.dmax("x"), "sd": A.std("x")}, 5, 2))


SQL["roll_count_multi"] = f"WITH {V_SIG}, r AS (SELECT entity, idx, min(x) OVER f AS low, max(x) OVER f AS high, stddev_pop(x) OVER f AS sd, count(*) OVER f AS n FROM sig WINDOW f AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT entity, idx // 2 AS window, round(low, 6) AS low, round(high, 6) AS high, round(sd, 6) AS sd FROM r WHERE idx % 2 = 0 AND n = 5"


@query
def roll_view(spark, folder):
    """The rows of each full window, unnested."""
    v = windows.view(sig(spark, folder), 4, 3).select("entity", "window", F.posexplode("values").alias("pos", "x"))
    return rounded(v)


SQL["roll_view"] = f"WITH {V_SIG}, s AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM sig), w AS (SELECT entity, unnest(range(0, (max(n) - 4) // 3 + 1)) AS window FROM s GROUP BY entity HAVING max(n) >= 4) SELECT w.entity, w.window, CAST(s.idx - w.window * 3 AS INTEGER) AS pos, round(s.x, 6) AS x FROM w JOIN s ON s.entity = w.entity AND s.idx >= w.window * 3 AND s.idx < w.window * 3 + 4"


def _bounds(s: DataFrame) -> DataFrame:
    """Windows [10 w, 10 w + w) of each series: the first one is empty."""
    n = s.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    w = n.select("entity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / 10).cast("bigint"))).alias("window"))
    return w.select("entity", "window", (F.col("window") * 10).alias("lo"), (F.col("window") * 11).alias("hi"))


@query
def roll_bounds(spark, folder):
    s = sig(spark, folder)
    return rounded(windows.over_bounds(s, _bounds(s), {"mean": A.mean("x"), "total": F.sum("x")}, min_window_len=2))


SQL["roll_bounds"] = f"WITH {V_SIG}, w AS (SELECT entity, unnest(range(0, count(*) // 10 + 1)) AS window FROM sig GROUP BY entity) SELECT w.entity, w.window, round(CASE WHEN count(s.x) >= 2 THEN avg(s.x) END, 6) AS mean, round(CASE WHEN count(s.x) >= 2 THEN sum(s.x) END, 6) AS total FROM w LEFT JOIN sig s ON s.entity = w.entity AND s.idx >= w.window * 10 AND s.idx < w.window * 11 GROUP BY ALL"



def _time_sql(size: int, step: int, select: str) -> str:
    return (
        f"WITH {V_SIG}, g AS (SELECT entity, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM sig GROUP BY entity), "
        f"w AS (SELECT entity, t0, unnest(range(0, CAST(ceil((t1 - t0) / {step}::DOUBLE) AS BIGINT))) AS window FROM g) "
        f"SELECT w.entity, w.window, w.t0 + w.window * {step} AS start, {select} FROM w LEFT JOIN sig s ON s.entity = w.entity "
        f"AND epoch_us(s.ts) >= w.t0 + w.window * {step} AND epoch_us(s.ts) < w.t0 + w.window * {step} + {size} GROUP BY ALL"
    )


@query
def roll_time_mean(spark, folder):
    return rounded(windows.irregular(sig(spark, folder), {"mean": A.mean("x")}, 2 * DAY, DAY))


SQL["roll_time_mean"] = _time_sql(2 * DAY, DAY, "round(avg(s.x), 6) AS mean")


@query
def roll_time_multi(spark, folder):
    return rounded(windows.irregular(sig(spark, folder), {"mean": A.mean("x"), "sd": A.std("x"), "n": F.count("x")}, DAY, DAY).fillna(0, ["n"]))


SQL["roll_time_multi"] = _time_sql(DAY, DAY, "round(avg(s.x), 6) AS mean, round(stddev_pop(s.x), 6) AS sd, count(s.x) AS n")


@query
def roll_time_minlen(spark, folder):
    """Steps larger than windows, and a least number of rows."""
    return rounded(windows.irregular(sig(spark, folder), {"mean": A.mean("x")}, DAY, 2 * DAY, min_window_len=2))


SQL["roll_time_minlen"] = _time_sql(DAY, 2 * DAY, "round(CASE WHEN count(s.x) >= 2 THEN avg(s.x) END, 6) AS mean")



@query
def roll_hjorth(spark, folder):
    """Hjorth parameters, line length and crossings of windows of ten rows: derivatives end at a window's edges."""
    f = {
        "activity": lambda w: A.hjorth_activity(w.x), "mobility": lambda w: A.hjorth_mobility(w.x, w.d1), "complexity": lambda w: A.hjorth_complexity(w.x, w.d1, w.d2),
        "line": lambda w: A.line_length(w.d), "crossings": lambda w: A.crossing_count(w.crossing()),
    }
    return rounded(windows.rolling(centred(spark, folder), f, 10, 5))


_IN = "OVER (PARTITION BY entity, \"window\" ORDER BY idx)"
_IN_GRAD = _GRAD.replace(W, _IN)
SQL["roll_hjorth"] = f"WITH {V_CEN}, n AS (SELECT entity, unnest(range(0, (count(*) - 10) // 5 + 1)) AS \"window\" FROM sig GROUP BY entity HAVING count(*) >= 10), r AS (SELECT n.entity, n.\"window\", s.idx, s.x AS v, s.x FROM n JOIN sig s ON s.entity = n.entity AND s.idx >= n.\"window\" * 5 AND s.idx < n.\"window\" * 5 + 10), a AS (SELECT *, x - lag(x) {_IN} AS d, (x > 0) <> (lag(x) {_IN} > 0) AS c, {_IN_GRAD} AS d1 FROM r), b AS (SELECT entity, \"window\", idx, v, d, c, d1 AS x FROM a), e AS (SELECT *, {_IN_GRAD} AS d2 FROM b) SELECT entity, \"window\", round(var_pop(v), 6) AS activity, round(sqrt(var_pop(x) / nullif(var_pop(v), 0)), 6) AS mobility, round(sqrt(var_pop(d2) / nullif(var_pop(x), 0)) / nullif(sqrt(var_pop(x) / nullif(var_pop(v), 0)), 0), 6) AS complexity, round(sum(abs(d)), 6) AS line, CAST(count(*) FILTER (c) AS BIGINT) AS crossings FROM e GROUP BY entity, \"window\""


def _deviation(v: np.ndarray) -> float:
    """Median distance from the median: a function that is no aggregate of the engine."""
    return float(np.median(np.abs(v - np.median(v))))


_MAD = {"mad": windows.opaque(_deviation)}


@query
def roll_opaque(spark, folder):
    """A Python function over windows of time."""
    return rounded(windows.irregular(sig(spark, folder), _MAD, 5 * DAY, 2 * DAY, min_window_len=2))


SQL["roll_opaque"] = _time_sql(5 * DAY, 2 * DAY, "round(CASE WHEN count(s.x) >= 2 THEN mad(s.x) END, 6) AS mad")


@query
def roll_opaque_count(spark, folder):
    """A Python function over count windows."""
    return rounded(windows.rolling(sig(spark, folder), _MAD, 9, 4))


SQL["roll_opaque_count"] = f"WITH {V_SIG}, n AS (SELECT entity, unnest(range(0, (count(*) - 9) // 4 + 1)) AS window FROM sig GROUP BY entity HAVING count(*) >= 9) SELECT n.entity, n.window, round(mad(s.x), 6) AS mad FROM n JOIN sig s ON s.entity = n.entity AND s.idx >= n.window * 4 AND s.idx < n.window * 4 + 9 GROUP BY ALL"


@query
def roll_opaque_bounds(spark, folder):
    """A Python function over given bounds."""
    s = sig(spark, folder)
    return rounded(windows.over_bounds(s, _bounds(s), _MAD, min_window_len=2))


SQL["roll_opaque_bounds"] = f"WITH {V_SIG}, w AS (SELECT entity, unnest(range(0, count(*) // 10 + 1)) AS window FROM sig GROUP BY entity) SELECT w.entity, w.window, round(CASE WHEN count(s.x) >= 2 THEN mad(s.x) END, 6) AS mad FROM w LEFT JOIN sig s ON s.entity = w.entity AND s.idx >= w.window * 10 AND s.idx < w.window * 11 GROUP BY ALL"


_ENDS = {"ends": windows.opaque(lambda v: np.sort(v)[[0, -1]], "array<double>")}


@query
def roll_opaque_array(spark, folder):
    """A Python function with an array as its result: the two ends of each window."""
    r = windows.rolling(sig(spark, folder), _ENDS, 6, 3)
    return rounded(r.select("entity", "window", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")))


SQL["roll_opaque_array"] = f"WITH {V_SIG}, r AS (SELECT entity, idx, min(x) OVER f AS low, max(x) OVER f AS high, count(*) OVER f AS n FROM sig WINDOW f AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) SELECT entity, idx // 3 AS \"window\", round(low, 6) AS low, round(high, 6) AS high FROM r WHERE idx % 3 = 0 AND n = 6"

# ------------------------------------------------------------------ heart-rate variability

_D = f"d AS (SELECT entity, nni, nni - lag(nni) {W} AS d, nni + lag(nni) {W} AS s FROM nni)"


@query
def hrv_time_domain(spark, folder):
    return rounded(hrv.time_domain(nni(spark, folder)))


SQL["hrv_time_domain"] = f"WITH {V_NNI}, {_D} SELECT entity, round(stddev_pop(nni), 6) AS sdnn, round(sqrt(avg(d * d)), 6) AS rmssd, round(stddev_pop(d), 6) AS sdsd, round(sum(d), 6) AS ssd, round(avg(CASE WHEN d IS NOT NULL THEN CAST(abs(d) > 50 AS INTEGER) END), 6) AS pnnx FROM d GROUP BY entity"


@query
def hrv_pnnx_units(spark, folder):
    """pNN20 of intervals given in microseconds, and their sum in milliseconds."""
    us = nni(spark, folder).withColumn("nni", F.col("nni") * 1000)
    p = hrv.time_domain(us, unit="us", x=20).select("entity", "pnnx")
    return rounded(p.join(us.groupBy("entity").agg(F.sum(S.nni_to_ms("nni", "us")).alias("total_ms")), "entity"), 4)


SQL["hrv_pnnx_units"] = f"WITH {V_NNI}, {_D} SELECT entity, round(avg(CASE WHEN d IS NOT NULL THEN CAST(abs(d) > 20 AS INTEGER) END), 4) AS pnnx, round(sum(nni), 4) AS total_ms FROM d GROUP BY entity"


@query
def hrv_poincare(spark, folder):
    return rounded(hrv.poincare(nni(spark, folder)))


SQL["hrv_poincare"] = f"WITH {V_NNI}, {_D}, p AS (SELECT entity, stddev_pop(d) / sqrt(2) AS sd1, stddev_pop(s) / sqrt(2) AS sd2 FROM d GROUP BY entity) SELECT entity, round(sd1, 6) AS sd1, round(sd2, 6) AS sd2, round(sd1 / nullif(sd2, 0), 6) AS csi, round(CASE WHEN sd1 * sd2 > 0 THEN log10(sd1 * sd2) END, 6) AS cvi, round(sd1 * sd1 / nullif(sd2, 0), 6) AS mcsi FROM p"


@query
def hrv_cumulative(spark, folder):
    return rounded(hrv.cumulative(nni(spark, folder)).select("entity", "idx", "elapsed"), 4)


SQL["hrv_cumulative"] = f"WITH {V_NNI} SELECT entity, idx, round(sum(nni) {W}, 4) AS elapsed FROM nni"


@query
def hrv_sdann_sdnni(spark, folder):
    return rounded(hrv.windowed_deviation(nni(spark, folder), interval=10, unit="ms"))


SQL["hrv_sdann_sdnni"] = f"WITH {V_NNI}, t AS (SELECT entity, nni, CAST(round(sum(nni) {W} * 1000) AS BIGINT) AS us FROM nni), g AS (SELECT entity, min(us) AS t0, max(us) AS t1 FROM t GROUP BY entity), w AS (SELECT entity, t0, unnest(range(0, CAST(ceil((t1 - t0) / 1e7) AS BIGINT))) AS k FROM g), f AS (SELECT w.entity, w.k, avg(nni) AS m, stddev_pop(nni) AS s FROM w LEFT JOIN t ON t.entity = w.entity AND t.us >= t0 + k * 10000000 AND t.us < t0 + (k + 1) * 10000000 GROUP BY ALL) SELECT entity, round(CASE WHEN count(m) = count(*) THEN stddev_pop(m) END, 6) AS sdann, round(CASE WHEN count(m) = count(*) THEN avg(s) END, 6) AS sdnni FROM f GROUP BY entity"


@query
def hrv_sdann_default(spark, folder):
    """Windows of 300 s, the default, of the long series."""
    long = frames.series(load(spark, folder, "events"), "event_type", ["ts", "event_id"], F.lit(600.0) + F.col("value"), name="nni")
    return rounded(hrv.windowed_deviation(long, unit="ms"))


SQL["hrv_sdann_default"] = SQL["hrv_sdann_sdnni"].replace(V_NNI, V_NNI.replace("user_id", "event_type")).replace("1e7", "3e8").replace("10000000", "300000000")


@query
def hrv_windowed(spark, folder):
    """Features of windows of ten days, one every five: each is that of a series that is the window alone."""
    f = {"sdnn": A.sdnn("nni"), "rmssd": lambda w: A.rmssd(w.d), "pnn50": lambda w: A.pnn50(w.d), "mcsi": lambda w: A.lorenz_mcsi(w.d, w.s)}
    return rounded(windows.irregular(nni(spark, folder), f, 10 * DAY, 5 * DAY, min_window_len=2, x="nni"))


SQL["hrv_windowed"] = (
    f"WITH {V_NNI}, r AS (SELECT entity, idx, epoch_us(ts) AS us, nni FROM nni), g AS (SELECT entity, min(us) AS t0, max(us) AS t1 FROM r GROUP BY entity), "
    f"w AS (SELECT entity, t0, unnest(range(0, CAST(ceil((t1 - t0) / {5 * DAY}::DOUBLE) AS BIGINT))) AS window FROM g), "
    f"i AS (SELECT w.entity, w.window, t0 + w.window * {5 * DAY} AS start, nni, nni - lag(nni) OVER v AS d, nni + lag(nni) OVER v AS s "
    f"FROM w LEFT JOIN r ON r.entity = w.entity AND us >= t0 + w.window * {5 * DAY} AND us < t0 + w.window * {5 * DAY} + {10 * DAY} WINDOW v AS (PARTITION BY w.entity, w.window ORDER BY idx)), "
    "a AS (SELECT i.entity, i.window, i.start, count(nni) AS n, stddev_pop(nni) AS sdnn, sqrt(avg(d * d)) AS rmssd, avg(CASE WHEN d IS NOT NULL THEN CAST(abs(d) > 50 AS INTEGER) END) AS pnn50, stddev_pop(d) / sqrt(2) AS sd1, stddev_pop(s) / sqrt(2) AS sd2 FROM i GROUP BY ALL) "
    "SELECT a.entity, a.window, a.start, round(CASE WHEN n >= 2 THEN sdnn END, 6) AS sdnn, round(CASE WHEN n >= 2 THEN rmssd END, 6) AS rmssd, round(CASE WHEN n >= 2 THEN pnn50 END, 6) AS pnn50, round(CASE WHEN n >= 2 THEN sd1 * sd1 / nullif(sd2, 0) END, 6) AS mcsi FROM a"
)


@query
def hrv_recordings(spark, folder):
    """Time-domain variability of the beat recordings, in milliseconds, over their positive intervals in order. A row without
    a unit has that of its recording."""
    unit = F.coalesce(*[F.when(F.col("unit") == u, F.lit(n / 1e6)) for u, n in S.UNIT_NS.items()])
    rows = load(spark, folder, "intervals").select("rec_id", "idx", "nni", "unit")
    usual = rows.groupBy(F.col("rec_id").alias("entity")).agg(F.min("unit").alias("usual"))
    b = rows.withColumnRenamed("rec_id", "entity").where(F.col("nni") > 0).join(usual, "entity").withColumn("unit", F.coalesce("unit", "usual"))
    b = b.select("entity", "idx", (F.col("nni") * unit).alias("nni")).distinct().where(F.col("nni").between(200.0, 3000.0))
    return rounded(b.groupBy("entity").agg(A.std("nni").alias("sdnn"), A.mean("nni").alias("mean"), F.count("nni").alias("beats")), 4)


SQL["hrv_recordings"] = "WITH u AS (SELECT *, coalesce(unit, min(unit) OVER (PARTITION BY rec_id)) AS known FROM intervals), b AS (SELECT DISTINCT rec_id AS entity, idx, nni * CASE known WHEN 'ns' THEN 1e-6 WHEN 'us' THEN 1e-3 WHEN 'ms' THEN 1e0 WHEN 's' THEN 1e3 END AS nni FROM u WHERE nni > 0) SELECT entity, round(stddev_pop(nni), 4) AS sdnn, round(avg(nni), 4) AS mean, count(*) AS beats FROM b WHERE nni BETWEEN 200 AND 3000 GROUP BY entity"

# ------------------------------------------------------------------ information, recurrence


@query
def info_entropy(spark, folder):
    c = labels(spark, folder).groupBy("entity", "label").agg(F.count(F.lit(1)).alias("n"))
    return rounded(information.entropy(c))


_ENT = "SELECT entity, label, count(*) AS n FROM lab GROUP BY ALL"
SQL["info_entropy"] = f"WITH {V_LAB}, c AS ({_ENT}), p AS (SELECT entity, n / sum(n) OVER (PARTITION BY entity) + 1e-30 AS p FROM c) SELECT entity, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY entity"


@query
def info_sampen(spark, folder):
    return rounded(information.sampen(sig(spark, folder)))


SQL["info_sampen"] = f"WITH {V_SIG}, t AS (SELECT entity, 0.2 * stddev_pop(x) AS tol FROM sig GROUP BY entity), l AS (SELECT entity, idx, x AS x0, lead(x, 1) {W} AS x1, lead(x, 2) {W} AS x2 FROM sig), k AS (SELECT l.*, tol FROM l JOIN t USING (entity) WHERE x2 IS NOT NULL), p AS (SELECT a.entity, count(*) AS pairs, count(*) FILTER (abs(a.x2 - b.x2) < a.tol) AS matches FROM k a JOIN k b ON a.entity = b.entity AND a.idx < b.idx AND abs(a.x0 - b.x0) < a.tol AND abs(a.x1 - b.x1) < a.tol GROUP BY a.entity) SELECT t.entity, coalesce(pairs, 0) AS pairs, coalesce(matches, 0) AS matches, round(-ln(nullif(matches, 0) / nullif(pairs, 0)), 6) AS sampen FROM t LEFT JOIN p ON t.entity = p.entity"

RADIUS = 2.0


def _whole(spark, folder) -> DataFrame:
    """Series of whole numbers, so that both engines see the same distances."""
    return sig(spark, folder).withColumn("x", F.floor("x").cast("double"))


V_REC = V_SIG.replace("value AS x", "floor(value) AS x") + f", pairs AS (SELECT a.entity, a.idx AS i, b.idx AS j FROM sig a JOIN sig b ON a.entity = b.entity AND abs(a.x - b.x) <= {RADIUS})"


def _runs_sql(line: str, place: str) -> str:
    return f"SELECT entity, {line} AS line, count(*) AS length FROM (SELECT *, {place} - row_number() OVER (PARTITION BY entity, {line} ORDER BY {place}) AS island FROM pairs) GROUP BY entity, {line}, island"


@query
def rqa_pairs(spark, folder):
    """Exact recurrences (radius 0) of the whole-number series."""
    return rqa.recurrent_pairs(_whole(spark, folder))


SQL["rqa_pairs"] = V_REC.replace(f"abs(a.x - b.x) <= {RADIUS}", "a.x = b.x").join(["WITH ", " SELECT * FROM pairs"])


@query
def rqa_rates(spark, folder):
    s = _whole(spark, folder)
    return rounded(rqa.rates(s, rqa.recurrent_pairs(s, RADIUS)))


SQL["rqa_rates"] = f"WITH {V_REC}, n AS (SELECT entity, count(*) AS n FROM sig GROUP BY entity), r AS (SELECT entity, count(*) AS r FROM pairs GROUP BY entity), d AS (SELECT entity, sum(length) AS d FROM ({_runs_sql('i - j', 'i')}) WHERE length >= 2 GROUP BY entity), v AS (SELECT entity, sum(length) AS v FROM ({_runs_sql('i', 'j')}) WHERE length >= 2 GROUP BY entity) SELECT n.entity, round(coalesce(r, 0) / (n * n), 6) AS recurrence_rate, round(coalesce(d, 0) / (n * n), 6) AS determinism, round(coalesce(v, 0) / (n * n), 6) AS laminarity FROM n LEFT JOIN r USING (entity) LEFT JOIN d USING (entity) LEFT JOIN v USING (entity)"


@query
def rqa_diag_lengths(spark, folder):
    s = _whole(spark, folder)
    return rqa.diagonal_lengths(rqa.recurrent_pairs(s, RADIUS)).groupBy("entity", "length").agg(F.count(F.lit(1)).alias("n"))


SQL["rqa_diag_lengths"] = f"WITH {V_REC} SELECT entity, length, count(*) AS n FROM ({_runs_sql('i - j', 'i')}) WHERE length >= 2 GROUP BY ALL"


@query
def rqa_vert_lengths(spark, folder):
    s = _whole(spark, folder)
    return rqa.vertical_lengths(rqa.recurrent_pairs(s, RADIUS)).groupBy("entity", "length").agg(F.count(F.lit(1)).alias("n"))


SQL["rqa_vert_lengths"] = f"WITH {V_REC} SELECT entity, length, count(*) AS n FROM ({_runs_sql('j', 'i')}) WHERE length >= 2 GROUP BY ALL"


@query
def rqa_length_entropy(spark, folder):
    s = _whole(spark, folder)
    return rounded(rqa.length_entropy(s, rqa.recurrent_pairs(s, RADIUS)))


SQL["rqa_length_entropy"] = f"WITH {V_REC}, n AS (SELECT entity, count(*) AS n FROM sig GROUP BY entity), l AS (SELECT entity, length, count(*) AS c FROM ({_runs_sql('i - j', 'i')}) JOIN n USING (entity) WHERE length >= 2 AND length < n GROUP BY ALL), p AS (SELECT entity, c / sum(c) OVER (PARTITION BY entity) + 1e-30 AS p FROM l) SELECT entity, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY entity"


@query
def rqa_multivariate(spark, folder):
    """Recurrent pairs of embedding vectors of the same label."""
    e = load(spark, folder, "embeddings").select(F.col("label").alias("entity"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("v"))
    return rqa.recurrent_vector_pairs(e, 1.2)


SQL["rqa_multivariate"] = "WITH e AS (SELECT label AS entity, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.entity, a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON a.entity = b.entity AND sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) <= 1.2"

# ------------------------------------------------------------------ acceleration


@query
def accel_angles(spark, folder):
    a = acc(spark, folder).select("rec_id", "idx", S.roll("y", "z").alias("roll"), S.pitch("x", "y", "z").alias("pitch"))
    return rounded(a, 4)


SQL["accel_angles"] = f"WITH {V_ACC} SELECT rec_id, idx, round(degrees(atan2(y + 0.0, z + 0.0)), 4) AS roll, round(degrees(atan2(-x + 0.0, sqrt(y * y + z * z))), 4) AS pitch FROM acc"


@query
def accel_magnitude(spark, folder):
    return rounded(acc(spark, folder).select("rec_id", "idx", S.magnitude("x", "y", "z").alias("magnitude")), 4)


SQL["accel_magnitude"] = f"WITH {V_ACC} SELECT rec_id, idx, round(sqrt(x * x + y * y + z * z), 4) AS magnitude FROM acc"


@query
def accel_magnitude_dot(spark, folder):
    a = acc(spark, folder).groupBy("rec_id").agg(A.magnitude_dot("x", "y", "z").alias("m"))
    return a.select("rec_id", significant("m").alias("magnitude"))


SQL["accel_magnitude_dot"] = f"WITH {V_ACC}, m AS (SELECT rec_id, sqrt(sum(x * x + y * y + z * z)) AS m FROM acc GROUP BY rec_id) SELECT rec_id, {significant_sql('m')} AS magnitude FROM m"

# ------------------------------------------------------------------ location


@query
def geo_haversine(spark, folder):
    """Each point against the fixed point (51, 0), element by element."""
    return rounded(geo(spark, folder).select("entity", "idx", S.haversine("latitude", "longitude", F.lit(51.0), F.lit(0.0)).alias("km")))


SQL["geo_haversine"] = f"WITH {V_GEO} SELECT entity, idx, round({hav_sql('latitude', 'longitude', '51.0', '0.0')}, 6) AS km FROM geo"


@query
def geo_vector(spark, folder):
    """Each entity's first point against all its points."""
    g = geo(spark, folder)
    first = g.where(F.col("idx") == 0).select("entity", F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"))
    return rounded(g.join(first, "entity").select("entity", "idx", S.haversine("lat0", "lon0", "latitude", "longitude").alias("km")))


SQL["geo_vector"] = f"WITH {V_GEO} SELECT entity, idx, round({hav_sql('first_value(latitude) ' + W, 'first_value(longitude) ' + W, 'latitude', 'longitude')}, 6) AS km FROM geo"


@query
def geo_outer(spark, folder):
    """Distances from every zone's corners to the zone's corners."""
    z = load(spark, folder, "zones").select(F.col("zone_id").alias("entity"), F.col("seq").alias("i"), F.col("latitude"), F.col("longitude"))
    return rounded(location.outer_distances(z, z.withColumnRenamed("i", "j")), 4)


SQL["geo_outer"] = f"SELECT a.zone_id AS entity, a.seq AS i, b.seq AS j, round({hav_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 4) AS distance FROM zones a JOIN zones b USING (zone_id)"


@query
def geo_successive(spark, folder):
    return rounded(location.successive_distance(geo(spark, folder)).select("entity", "idx", "distance"))


SQL["geo_successive"] = f"WITH {V_GEO}, l AS (SELECT entity, idx, latitude, longitude, lag(latitude) {W} AS la, lag(longitude) {W} AS lo FROM geo) SELECT entity, idx, round(CASE WHEN la IS NULL THEN 0 ELSE {hav_sql('la', 'lo', 'latitude', 'longitude')} END, 6) AS distance FROM l"

_HOME = "home AS (SELECT entity, median(latitude) AS la, median(longitude) AS lo FROM geo WHERE CAST(ts AS TIME) >= TIME '23:00:00' OR CAST(ts AS TIME) <= TIME '06:00:00' GROUP BY entity)"


@query
def geo_home(spark, folder):
    return rounded(location.home(geo(spark, folder)))


SQL["geo_home"] = f"WITH {V_GEO}, {_HOME} SELECT entity, round(la, 6) AS home_lat, round(lo, 6) AS home_lon FROM home"


@query
def geo_home_distance(spark, folder):
    return rounded(location.distance_from_home(geo(spark, folder)).select("entity", "idx", "home_distance"))


SQL["geo_home_distance"] = f"WITH {V_GEO}, {_HOME} SELECT g.entity, g.idx, round({hav_sql('g.latitude', 'g.longitude', 'h.la', 'h.lo')}, 6) AS home_distance FROM geo g LEFT JOIN home h USING (entity)"


@query
def geo_home_stay(spark, folder):
    g = geo(spark, folder)
    a, b = location.proportion_home_stay(g), location.proportion_home_stay(g, limit=1.0).withColumnRenamed("home_stay", "home_stay_1km")
    return rounded(a.join(b, "entity"))


SQL["geo_home_stay"] = f"WITH {V_GEO}, {_HOME}, d AS (SELECT g.entity, {hav_sql('g.latitude', 'g.longitude', 'h.la', 'h.lo')} AS d FROM geo g LEFT JOIN home h USING (entity)) SELECT entity, round(count(*) FILTER (d < 0.1) / count(*), 6) AS home_stay, round(count(*) FILTER (d < 1) / count(*), 6) AS home_stay_1km FROM d GROUP BY entity"


@query
def geo_variance(spark, folder):
    g = geo(spark, folder).groupBy("entity").agg(A.location_variance("latitude", "longitude").alias("variance"), A.location_variance("latitude", "longitude", log=True).alias("log_variance"))
    return g.select("entity", F.round(F.col("variance") * 1e6, 4).alias("variance"), F.round("log_variance", 4).alias("log_variance"))


SQL["geo_variance"] = f"WITH {V_GEO} SELECT entity, round((var_pop(latitude) + var_pop(longitude)) * 1e6, 4) AS variance, round(ln(var_pop(latitude) + var_pop(longitude)), 4) AS log_variance FROM geo GROUP BY entity"


@query
def geo_clusters(spark, folder):
    """How many clusters the density clustering finds in each track, and the noise; coordinates in degrees as radians."""
    c = density.cluster_locations(geo(spark, folder), coords="radians")
    return c.groupBy("entity").agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"), F.count_if(F.col("label") < 0).alias("noise"), F.count(F.lit(1)).alias("points"))


@query
def cluster_count(spark, folder):
    l = labels(spark, folder)
    return location.num_clusters(l).join(location.num_clusters(l, include_noise=False).withColumnRenamed("clusters", "without_noise"), "entity")


SQL["cluster_count"] = f"WITH {V_LAB} SELECT entity, count(DISTINCT label) AS clusters, count(DISTINCT label) FILTER (label <> -1) AS without_noise FROM lab GROUP BY entity"


@query
def cluster_totals(spark, folder):
    return location.cluster_totals(labels(spark, folder))


SQL["cluster_totals"] = f"WITH {V_LAB} {_ENT}"


@query
def cluster_entropy(spark, folder):
    return rounded(location.cluster_entropy(labels(spark, folder)))


SQL["cluster_entropy"] = SQL["info_entropy"]


@query
def cluster_entropy_norm(spark, folder):
    return rounded(location.cluster_entropy(labels(spark, folder), normalized=True))


SQL["cluster_entropy_norm"] = f"WITH {V_LAB}, c AS ({_ENT}), p AS (SELECT entity, n / sum(n) OVER (PARTITION BY entity) + 1e-30 AS p FROM c) SELECT entity, round(-sum(p * ln(p)) / nullif(ln(count(*)), 0), 6) AS entropy FROM p GROUP BY entity"

# ------------------------------------------------------------------ spectra


@query
def spec_power_band(spark, folder):
    return rounded(spectrum(spark, folder).groupBy("entity").agg(A.power_band("psd", "freq", 0.04, 0.15).alias("lf"), A.power_band("psd", "freq").alias("all")))


SQL["spec_power_band"] = f"WITH {V_SPEC} SELECT entity, round(sum(psd) FILTER (freq BETWEEN 0.04 AND 0.15), 6) AS lf, round(sum(psd), 6) AS \"all\" FROM spec GROUP BY entity"


@query
def spec_relative_power(spark, folder):
    return rounded(spectrum(spark, folder).groupBy("entity").agg(A.relative_power_band("psd", "freq", 0.15, 0.4).alias("hf")))


SQL["spec_relative_power"] = f"WITH {V_SPEC} SELECT entity, round(sum(psd) FILTER (freq BETWEEN 0.15 AND 0.4) / nullif(sum(psd), 0), 6) AS hf FROM spec GROUP BY entity"


@query
def spec_peak(spark, folder):
    return rounded(spectrum(spark, folder).groupBy("entity").agg(A.peak_frequency("psd", "freq", 0.1, 0.5).alias("peak")))


SQL["spec_peak"] = f"WITH {V_SPEC} SELECT entity, round(freq, 6) AS peak FROM spec WHERE freq >= 0.1 AND freq < 0.5 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY psd DESC, freq) = 1"


@query
def spec_hrv_peak(spark, folder):
    s = spectrum(spark, folder)
    return rounded(hrv.peak_frequency(s, 0.15, 0.4).join(hrv.peak_frequency(s, 0.15, 0.4, aligned=True).withColumnRenamed("peak", "aligned"), "entity"))


SQL["spec_hrv_peak"] = f"WITH {V_SPEC}, m AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY freq) AS at FROM spec WHERE freq BETWEEN 0.15 AND 0.4), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY entity ORDER BY psd DESC, freq) = 1), a AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY freq) AS at FROM spec) SELECT b.entity, round(a.freq, 6) AS peak, round(b.freq, 6) AS aligned FROM b JOIN a ON a.entity = b.entity AND a.at = b.at"


@query
def spec_nufftfreqs(spark, folder):
    return rounded(spectral.nufftfreqs(sig(spark, folder), 9, 0.5))


SQL["spec_nufftfreqs"] = "SELECT DISTINCT user_id AS entity, k, k * 0.5 AS freq FROM events CROSS JOIN (SELECT unnest(range(-4, 5)) AS k)"


@query
def spec_nudft(spark, folder):
    """Non-uniform transform over times in days since the first row."""
    s = sig(spark, folder)
    t0 = s.groupBy("entity").agg(F.min("ts_us").alias("t0"))
    t = s.join(t0, "entity").select("entity", ((F.col("ts_us") - F.col("t0")) / DAY).alias("t"), F.col("x").alias("c"))
    return rounded(spectral.nudft(t, 8))


SQL["spec_nudft"] = f"WITH {V_SIG}, t AS (SELECT entity, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY entity)) / {DAY}::DOUBLE AS t, x FROM sig), k AS (SELECT unnest(range(-4, 4)) AS k) SELECT entity, k, round(avg(x * cos(k * t)), 6) AS re, round(avg(x * sin(k * t)), 6) AS im FROM t CROSS JOIN k GROUP BY ALL"


@query
def spec_fft(spark, folder):
    f = spectral.fft(sig(spark, folder))
    return f.select("entity", "k", F.round(F.col("re") + 0.0000001, 4).alias("re"), F.round(F.col("im") + 0.0000001, 4).alias("im"))


_TRIG = "WITH {v}, s AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM sig), k AS (SELECT DISTINCT entity, idx AS k FROM sig) SELECT s.entity, k.k, {re}, {im} FROM s JOIN k USING (entity) GROUP BY ALL"
SQL["spec_fft"] = _TRIG.format(v=V_SIG, re="round(sum(x * cos(2 * pi() * ((k * idx) % n) / n)) + 0.0000001, 4) AS re", im="round(-sum(x * sin(2 * pi() * ((k * idx) % n) / n)) + 0.0000001, 4) AS im")


@query
def spec_ifft(spark, folder):
    f = spectral.ifft(sig(spark, folder), "x", None)
    return f.select("entity", "k", F.round(F.col("re") + 0.0000001, 4).alias("re"), F.round(F.col("im") + 0.0000001, 4).alias("im"))


SQL["spec_ifft"] = _TRIG.format(v=V_SIG, re="round(avg(x * cos(2 * pi() * ((k * idx) % n) / n)) + 0.0000001, 4) AS re", im="round(avg(x * sin(2 * pi() * ((k * idx) % n) / n)) + 0.0000001, 4) AS im")

# ------------------------------------------------------------------ signal processing


@query
def dsp_moving_average(spark, folder):
    return rounded(timedom.moving_average(sig(spark, folder), 5).select("entity", "idx", "average"))


SQL["dsp_moving_average"] = f"WITH {V_SIG} SELECT entity, idx, round(sum(x) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS average FROM sig"


@query
def dsp_diff(spark, folder):
    s = sig(spark, folder)
    return rounded(timedom.pt_differentiate(timedom.pt_differentiate(s), into="five_point", five_point=True).select("entity", "idx", "derivative", "five_point"))


SQL["dsp_diff"] = f"WITH {V_SIG} SELECT entity, idx, round(x / 8, 6) AS derivative, round((x + 2 * lag(x, 1, 0) {W} - 2 * lag(x, 3, 0) {W} - lag(x, 4, 0) {W}) / 8, 6) AS five_point FROM sig"


@query
def dsp_slope_sum(spark, folder):
    return rounded(timedom.slope_sum(sig(spark, folder), 4).select("entity", "idx", "slope_sum"))


SQL["dsp_slope_sum"] = f"WITH {V_SIG}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM sig) SELECT entity, idx, round(CASE WHEN idx >= 4 AND idx <= n - 2 THEN x - lag(x, 4) {W} ELSE 0 END, 6) AS slope_sum FROM n"


@query
def dsp_find_peaks(spark, folder):
    return timedom.find_peaks(sig(spark, folder)).select("entity", "idx")


SQL["dsp_find_peaks"] = f"WITH {V_SIG}, p AS (SELECT entity, idx, x, lag(x) {W} AS a, lead(x) {W} AS b FROM sig) SELECT entity, idx FROM p WHERE x > a AND x > b"


@query
def dsp_slope_sum_rising(spark, folder):
    """The rectified variant: rising steps only."""
    return rounded(timedom.slope_sum(sig(spark, folder), 4, rectify=True).select("entity", "idx", "slope_sum"))


SQL["dsp_slope_sum_rising"] = f"WITH {V_SIG}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, greatest(x - lag(x) {W}, 0) AS up FROM sig), s AS (SELECT *, sum(up) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s FROM n) SELECT entity, idx, round(CASE WHEN idx >= 4 AND idx <= n - 2 THEN s ELSE 0 END, 6) AS slope_sum FROM s"


@query
def dsp_find_valleys(spark, folder):
    """Peaks by another comparison: rows that are no higher than both neighbours."""
    return timedom.find_peaks(sig(spark, folder), comp=lambda a, b: a <= b).select("entity", "idx")


SQL["dsp_find_valleys"] = f"WITH {V_SIG}, p AS (SELECT entity, idx, x, lag(x) {W} AS a, lead(x) {W} AS b FROM sig) SELECT entity, idx FROM p WHERE x <= a AND x <= b"


@query
def dsp_pairwise(spark, folder):
    """Consecutive pairs, with a counter from 10 in steps of 3."""
    return rounded(timedom.count(timedom.pairwise(sig(spark, folder)), 10, 3).select("entity", "count", "x", "next"))


SQL["dsp_pairwise"] = f"WITH {V_SIG}, p AS (SELECT entity, 10 + 3 * idx AS count, x, lead(x) {W} AS next FROM sig) SELECT entity, count, round(x, 6) AS x, round(next, 6) AS next FROM p WHERE next IS NOT NULL"


@query
def dsp_compose(spark, folder):
    """Two steps in both orders of composition: a gradient of doubled values, less one."""
    s = sig(spark, folder).select("entity", "idx", "x")
    double, less = (lambda d: d.withColumn("x", F.col("x") * 2)), (lambda d: d.withColumn("x", F.col("x") - 1))
    a, b = compose([double, less])(s), rcompose([double, less])(s).withColumnRenamed("x", "y")
    return rounded(a.join(b, ["entity", "idx"]))


SQL["dsp_compose"] = f"WITH {V_SIG} SELECT entity, idx, round((x - 1) * 2, 6) AS x, round(x * 2 - 1, 6) AS y FROM sig"


def filtfilt_sql(view: str, table: str, columns: str, f: dsp.Sections, name: str = "done") -> str:
    """CTEs that end in `name` (entity, idx, columns): zero-phase filtering of table (entity, idx, columns).

    Not the recursion of the operator but sums with the impulse response h: with the state of a constant input e_0, a pass
    over e is H(1) e_0 + sum_k h_k (e_(i-k) - e_0).
    """
    number = lambda v: f"({float(v)!r}::DOUBLE)"
    edge, count, gain = f.edge, len(f.rows), number(f.level[-1])
    step, held = ["CASE WHEN k = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS u0"], []
    for s, (b0, b1, b2, a1, a2) in enumerate(f.rows):
        step += [f"{number(b0)} * u{s} + p{s} AS u{s + 1}", f"{number(b1)} * u{s} - {number(a1)} * u{s + 1} + q{s} AS np{s}", f"{number(b2)} * u{s} - {number(a2)} * u{s + 1} AS nq{s}"]
        held += [f"p{s}", f"q{s}"]
    parts = [
        view,
        "h AS (SELECT -1 AS k, 0::DOUBLE AS h, " + ", ".join(f"0::DOUBLE AS {c}" for c in held) + f" UNION ALL SELECT k, u{count}, " + ", ".join(f"n{c}" for c in held) + f" FROM (SELECT k, {', '.join(step)} FROM (SELECT k + 1 AS k, {', '.join(held)} FROM h WHERE k < {dsp.settling(f, 1e-17)})))",
        "response AS (SELECT list(h ORDER BY k DESC) AS r, count(*) AS m FROM h WHERE k >= 0)",
        "long AS (" + " UNION ALL ".join(f"SELECT entity, idx, '{c}' AS axis, {c} AS x FROM {table}" for c in columns) + ")",
        f"s AS (SELECT entity, axis, list(x ORDER BY idx) AS v, count(*) AS n FROM long GROUP BY ALL HAVING count(*) > {edge})",
        f"e0 AS (SELECT entity, axis, n, list_concat(list_transform(range({edge}, 0, -1), lambda i: 2 * v[1] - v[i + 1]), v, list_transform(range(1, {edge + 1}), lambda i: 2 * v[n] - v[n - i])) AS e FROM s)",
    ]
    for k in (0, 1):
        parts.append(f"c{k} AS (SELECT entity, axis, n, e[1] AS first, list_transform(e, lambda q: q - e[1]) AS c, unnest(range(1, n + {2 * edge + 1})) AS j FROM e{k})")
        parts.append(f"e{k + 1} AS (SELECT entity, axis, n, list({gain} * first + list_dot_product(c[greatest(1, j - m + 1):j], r[m - least(j, m) + 1:m]) ORDER BY j DESC) AS e FROM c{k}, response GROUP BY ALL)")
    parts.append(f"f AS (SELECT entity, axis, unnest(range(0, n)) AS idx, unnest(e[{edge + 1}:n + {edge}]) AS y FROM e2)")
    parts.append(f"{name} AS (SELECT t.entity, t.idx, " + ", ".join(f"max(f.y) FILTER (f.axis = '{c}') AS {c}" for c in columns) + f" FROM {table} t LEFT JOIN f ON t.entity = f.entity AND t.idx = f.idx GROUP BY t.entity, t.idx)")
    return "WITH RECURSIVE " + ", ".join(parts)


@query
def dsp_butterworth(spark, folder):
    return rounded(dsp.butterworth(sig_long(spark, folder), 5.0, 50.0, kind="lowpass", columns=["x"]))


SQL["dsp_butterworth"] = filtfilt_sql(V_LONG, "sig", "x", dsp.Sections(5.0, 50.0, 5, "lowpass")) + " SELECT entity, idx, round(x, 6) AS x FROM done"


def _axes(spark, folder) -> DataFrame:
    """Readings of each recording in order, as series of three axes."""
    a = acc(spark, folder)
    return frames.series(a, "rec_id", ["ts", "idx"], "x", keep={"y": F.col("y"), "z": F.col("z")})


V_AXES = V_ACC + ", axes AS (SELECT rec_id AS entity, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY ts, idx, x) - 1 AS BIGINT) AS idx, x, y, z FROM acc WHERE ts IS NOT NULL AND rec_id IS NOT NULL)"


@query
def dsp_linear(spark, folder):
    return rounded(dsp.linear_filter(_axes(spark, folder), 50.0, columns=["x", "y", "z"]), 2)


SQL["dsp_linear"] = filtfilt_sql(V_AXES, "axes", "xyz", dsp.Sections(0.5, 50.0, 5, "highpass")) + " SELECT entity, idx, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z FROM done"


@query
def dsp_gravity(spark, folder):
    return rounded(dsp.gravity_filter(_axes(spark, folder), 50.0, columns=["x", "y", "z"]), 3)


SQL["dsp_gravity"] = filtfilt_sql(V_AXES, "axes", "xyz", dsp.Sections(0.5, 50.0, 5, "lowpass")) + " SELECT entity, idx, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM done"


@query
def dsp_bandpass(spark, folder):
    return rounded(dsp.bandpass(sig_long(spark, folder), 250.0))


SQL["dsp_bandpass"] = filtfilt_sql(V_LONG, "sig", "x", dsp.Sections((5, 15), 250.0, 5, "bandpass")) + " SELECT entity, idx, round(x, 6) AS x FROM done"


def _box(x: str, width: int) -> str:
    return f"sum({x}) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN {width // 2} PRECEDING AND {(width - 1) // 2} FOLLOWING) / {width}"


@query
def ecg_pan_tompkins(spark, folder):
    return rounded(detectors.filter_pan_tompkins(sig_long(spark, folder), 250.0))


SQL["ecg_pan_tompkins"] = filtfilt_sql(V_LONG, "sig", "x", dsp.Sections((5, 15), 250.0, 5, "bandpass")) + f" SELECT entity, idx, round({_box('pow(x / 8, 2)', 50)}, 6) AS y FROM done"


@query
def ecg_hamilton_filter(spark, folder):
    return rounded(detectors.filter_hamilton_tompkins(sig_long(spark, folder), 250.0))


SQL["ecg_hamilton_filter"] = filtfilt_sql(V_LONG, "sig", "x", dsp.Sections((3, 25), 250.0, 5, "bandpass")) + f" SELECT entity, idx, round({_box('abs(x / 8)', 20)}, 6) AS y FROM done"


@query
def ecg_rpeaks(spark, folder):
    return detectors.rpeaks_hamilton_tompkins(sig_long(spark, folder), 250.0, ts="ts_us")


def _over(before: int, after: int) -> str:
    return f"OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


# the rule walks the peaks; both rings start with the level of position 0
_RING = "[" + ", ".join(["first"] * 12) + "]"
SQL["ecg_rpeaks"] = (
    filtfilt_sql(V_LONG.replace("value AS x", "value AS x, epoch_us(ts) AS us"), "sig", "x", dsp.Sections((3, 25), 250.0, 5, "bandpass"))
    + f", y AS (SELECT entity, idx, {_box('abs(x / 8)', 20)} AS f FROM done), s AS (SELECT *, f - lag(f) {W} AS d, lag(f) {W} AS a, lead(f) {W} AS b FROM y)".replace(", s AS", ", slopes AS")
    + f", facts AS (SELECT entity, idx, f, a, b, f >= max(f) {_over(50, 49)} AS highest, max(d) {_over(11, 11)} > 0 AND min(d) {_over(11, 11)} < 0 AS turns, max(d) {_over(12, 11)} AS steep FROM slopes)"
    + f", peaks AS (SELECT *, row_number() {W} AS n FROM facts WHERE f > a AND f > b)"
    + f", walk AS (SELECT entity, 0 AS n, 0::BIGINT AS p, false AS ok, 0::BIGINT AS accepted, 0::BIGINT AS rejected, 0::BIGINT AS prior, 0::DOUBLE AS rise, 0::DOUBLE AS level, list_transform(range(0, 12), lambda i: 0::BIGINT) AS places, {_RING} AS high, {_RING} AS low FROM (SELECT entity, f AS first FROM y WHERE idx = 0)"
    + " UNION ALL SELECT entity, n, p, ok, accepted + ok::BIGINT, rejected + (NOT ok)::BIGINT, CASE WHEN ok THEN p ELSE prior END, CASE WHEN ok THEN steep ELSE rise END, list_avg(low2) + 0.3125 * (list_avg(high2) - list_avg(low2)), places2, high2, low2 FROM"
    + " (SELECT *, CASE WHEN ok THEN list_transform(places, lambda v, i: CASE WHEN i = accepted % 12 + 1 THEN p ELSE v END) ELSE places END AS places2, CASE WHEN ok THEN list_transform(high, lambda v, i: CASE WHEN i = accepted % 12 + 1 THEN f ELSE v END) ELSE high END AS high2, CASE WHEN NOT ok THEN list_transform(low, lambda v, i: CASE WHEN i = rejected % 12 + 1 THEN f ELSE v END) ELSE low END AS low2 FROM"
    + " (SELECT w.entity, k.n, k.idx AS p, k.f, k.steep, accepted, rejected, prior, rise, places, high, low, k.highest AND ((k.f > level AND k.turns AND NOT (prior <> 0 AND k.idx - prior < 90 AND k.steep < 0.5 * rise)) OR (accepted > 1 AND k.f > 0.5 * level AND k.idx - prior >= 1.5 * (list_max(places) - list_min(places)) / 11.0)) AS ok FROM walk w JOIN peaks k ON k.entity = w.entity AND k.n = w.n + 1)))"
    + " SELECT w.entity, w.p AS idx, s.us AS ts FROM walk w JOIN sig s ON s.entity = w.entity AND s.idx = w.p WHERE w.ok"
)


@query
def ppg_onsets(spark, folder):
    return detectors.pulse_onset_physionet(sig_long(spark, folder), 50)


# the rule goes from onset to onset: the next row above the threshold, the highest within 7 rows of it, 21 rows on
SQL["ppg_onsets"] = (
    filtfilt_sql(V_LONG, "sig", "x", dsp.Sections((0.5, 20), 50, 5, "bandpass"))
    + f", n AS (SELECT entity, idx, x, count(*) OVER (PARTITION BY entity) AS n, lag(x, 7) {W} AS back FROM done), y AS (SELECT entity, idx, n, CASE WHEN idx >= 7 AND idx <= n - 2 THEN x - back ELSE 0 END AS f FROM n)"
    + ", start AS (SELECT entity, avg(f) + 2 * stddev_pop(f) AS level, stddev_pop(f) AS sd FROM y WHERE idx < 500 GROUP BY entity)"
    + ", walk AS (SELECT entity, 7::BIGINT AS i, NULL::BIGINT AS onset, 0::BIGINT AS turn, list_transform(range(0, 10), lambda q: level) AS ring, level - sd AS cut FROM start"
    + " UNION ALL SELECT entity, i2 + 21, p, turn2, ring2, list_median(ring2) - 2 * list_stddev_pop(ring2) FROM"
    + " (SELECT *, list_transform(ring, lambda v, q: CASE WHEN q = turn2 + 1 THEN f ELSE v END) AS ring2 FROM"
    + " (SELECT w.entity, w.i2, (w.turn + 1) % 10 AS turn2, w.ring, arg_max(y.idx, (y.f, -y.idx)) AS p, max(y.f) AS f FROM"
    + " (SELECT w.entity, w.turn, w.ring, min(y.idx) AS i2 FROM walk w JOIN y ON y.entity = w.entity AND y.idx >= w.i AND y.idx < y.n - 500 AND y.f > w.cut GROUP BY ALL) w"
    + " JOIN y ON y.entity = w.entity AND y.idx >= w.i2 - 7 AND y.idx < w.i2 + 7 GROUP BY ALL)))"
    + " SELECT entity, onset AS idx FROM walk WHERE onset IS NOT NULL"
)
SQL["ppg_onsets"] = SQL["ppg_onsets"].replace("list_stddev_pop(ring2)", "list_aggregate(ring2, 'stddev_pop')")


def _beats(spark, folder, **more) -> DataFrame:
    """Scores of all interior maxima of the long series, taken for beats: the second around one has 20 rows."""
    s = sig_long(spark, folder)
    return rounded(detectors.beat_quality(s, timedom.find_peaks(s), 20, **more))


V_BEATS = (
    f"WITH {V_LONG}, e AS (SELECT entity, list_concat(list_transform(range(0, 10), lambda i: 0::DOUBLE), list(x ORDER BY idx), list_transform(range(0, 10), lambda i: 0::DOUBLE)) AS e, count(*) AS len FROM sig GROUP BY entity), "
    f"k AS (SELECT entity, idx, x, lag(x) {W} AS a, lead(x) {W} AS b FROM sig), "
    f"p AS (SELECT k.entity, k.idx, row_number() OVER (PARTITION BY k.entity ORDER BY k.idx) - 1 AS i, e.len, e.e[k.idx + 1:k.idx + 20] AS v FROM k JOIN e USING (entity) WHERE x > a AND x > b), "
    "c AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, list_transform(v, lambda q: q - list_avg(v)) AS d FROM p), "
    "beat AS (SELECT *, CASE WHEN list_dot_product(d, d) > 0 THEN list_transform(d, lambda q: q / sqrt(list_dot_product(d, d))) ELSE list_transform(d, lambda q: 0::DOUBLE) END AS z FROM c)"
)


@query
def beat_quality(spark, folder):
    return _beats(spark, folder)


# a ring of 24 that starts with beats 1 to 23 and takes beats from 1 on: those before, and at first beats 1 to 23
SQL["beat_quality"] = V_BEATS + " SELECT b.entity, b.idx, round(CASE WHEN b.n >= 24 THEN avg(list_dot_product(b.z, o.z)) END, 6) AS quality FROM beat b LEFT JOIN beat o ON o.entity = b.entity AND o.i BETWEEN CASE WHEN b.i <= 24 THEN 1 ELSE b.i - 24 END AND CASE WHEN b.i <= 24 THEN 23 ELSE b.i - 1 END GROUP BY b.entity, b.idx, b.n"


@query
def beat_quality_bi(spark, folder):
    return _beats(spark, folder, both_sides=True)


# row r of the ring of what follows holds beat r at first, and after beat q, q % 12 = r, beat q + 12, unless that lies in the
# last second (then the last one before it) or there is none (then nothing)
SQL["beat_quality_bi"] = (
    V_BEATS
    + ", whole AS (SELECT *, count(*) FILTER (idx < len - 20) OVER (PARTITION BY entity) AS good, count(*) FILTER (idx + 10 <= len) OVER (PARTITION BY entity) AS entered FROM beat), r AS (SELECT unnest(range(0, 12)) AS r)"
    + ", back AS (SELECT b.entity, b.i, sum(list_dot_product(b.z, o.z)) / 12 AS s FROM whole b JOIN whole o ON o.entity = b.entity AND o.i >= 11 AND o.i BETWEEN least(b.i, b.entered) - 12 AND least(b.i, b.entered) - 1 GROUP BY ALL)"
    + ", held AS (SELECT b.*, r, b.i - 1 - (b.i + 11 - r) % 12 AS q FROM whole b CROSS JOIN r WHERE b.i >= 11 AND b.idx + 10 <= b.len)"
    + ", places AS (SELECT *, CASE WHEN q < 11 THEN nullif(r, 0) WHEN q + 12 >= n THEN NULL WHEN q + 12 < good THEN q + 12 ELSE nullif(nullif(good - 1 - (good - 1 - r) % 12, 0), 12) END AS j FROM held)"
    + ", ahead AS (SELECT a.entity, a.i, sum(list_dot_product(a.z, o.z)) / 12 AS s FROM places a JOIN whole o ON o.entity = a.entity AND o.i = a.j GROUP BY ALL)"
    + " SELECT b.entity, b.idx, round(CASE WHEN b.n < 12 THEN NULL WHEN b.i < 11 THEN 0 WHEN b.idx + 10 > b.len THEN coalesce(back.s, 0) ELSE greatest(coalesce(back.s, 0), coalesce(ahead.s, 0)) END, 6) AS quality FROM whole b LEFT JOIN back ON back.entity = b.entity AND back.i = b.i LEFT JOIN ahead ON ahead.entity = b.entity AND ahead.i = b.i"
)


SQL = {name: sql.replace(", 6)", f" + {NUDGE}, 6)") for name, sql in SQL.items()}

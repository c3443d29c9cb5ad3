"""Registered queries that run the streaming operators to the end of a table, with the SQL of the same result.

A series is written to the shared folder in two slices; a stream reads what is new, stops, and goes on from its state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biosignal.operators import detectors, dsp, timedom
from biosignal.plans import signal_queries as S
from biosignal.session import ensure_checkpoint_dir
from biosignal.sources.tables import load
from biosignal.streaming import features

DAY = 86_400_000_000


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def _run(stream: DataFrame, at: str, complete: bool) -> None:
    """Take what is there, and stop."""
    out = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if complete:
        out = out.outputMode("complete").foreachBatch(lambda d, _: d.write.mode("overwrite").parquet(f"{at}/out"))
    else:
        out = out.outputMode("append").format("parquet").option("path", f"{at}/out")
    out.start().awaitTermination()


def _over_events(spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    at = _folder(spark)
    events = load(spark, folder, "events")
    source = spark.readStream.schema(events.schema)
    if any(f.endswith("/events.parquet") for f in events.inputFiles()):  # a file, not a folder of files
        source = source.option("pathGlobFilter", "events.parquet").parquet(folder)
    else:
        source = source.parquet(f"{folder}/events.parquet")
    stream = source.select(F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), "value")
    built = build(stream)
    _run(built, at, True)
    return spark.read.schema(built.schema).parquet(f"{at}/out")


def _over_series(spark: SparkSession, series: DataFrame, build: Callable[[DataFrame], DataFrame], cut: int = 500) -> DataFrame:
    at = _folder(spark)
    for slice_ in (F.col("idx") < cut, F.col("idx") >= cut):
        series.where(slice_).write.mode("append").parquet(f"{at}/in")
        built = build(spark.readStream.schema(series.schema).parquet(f"{at}/in"))
        _run(built, at, False)
    return spark.read.schema(built.schema).parquet(f"{at}/out")


def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Features of windows of two days, one a day."""
    d = _over_events(spark, folder, lambda s: features.sliding_features(s, {"mean": F.avg("value"), "n": F.count("value")}, "2 days", "1 day", "10 days"))
    return S.rounded(d.select("entity", F.unix_micros("start").alias("start"), "mean", "n"))


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of rows of a user without three days between them."""
    d = _over_events(spark, folder, lambda s: features.sessions(s, {"n": F.count("value"), "top": F.max("value")}, "3 days", "10 days"))
    return d.select("entity", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", "top")


def stream_peaks(spark: SparkSession, folder: str) -> DataFrame:
    return _over_series(spark, S.sig_long(spark, folder).select("entity", "idx", "x"), features.peaks).select("entity", "idx")


def stream_beats(spark: SparkSession, folder: str) -> DataFrame:
    """Beats, but for peaks in the last 0.2 s, which are not certain yet."""
    return _over_series(spark, detectors.filter_hamilton_tompkins(S.sig_long(spark, folder), 250.0).where(F.col("y").isNotNull()), lambda s: features.beats(s, 250.0))


def stream_onsets(spark: SparkSession, folder: str) -> DataFrame:
    band = dsp.butterworth(S.sig_long(spark, folder), (0.5, 20), 50, kind="bandpass", columns=["x"])
    slopes = timedom.slope_sum(band.where(F.col("x").isNotNull()), 7).select("entity", "idx", F.col("slope_sum").alias("x"))
    return _over_series(spark, slopes, lambda s: features.pulse_onsets(s, 50))


QUERIES = {"stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "stream_peaks": stream_peaks, "stream_beats": stream_beats, "stream_onsets": stream_onsets}

SQL = {
    "stream_sliding": f"WITH w AS (SELECT user_id AS entity, value, (epoch_us(ts) // {DAY} - unnest([0, 1])) * {DAY} AS start FROM events) SELECT entity, start, round(avg(value) + {S.NUDGE}, 6) AS mean, count(value) AS n FROM w GROUP BY entity, start",
    "stream_sessions": f"WITH e AS (SELECT user_id AS entity, epoch_us(ts) AS us, value FROM events), b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY entity ORDER BY us) < {3 * DAY} THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT entity, min(us) AS start, max(us) + {3 * DAY} AS \"end\", count(value) AS n, max(value) AS top FROM s GROUP BY entity, k",
    "stream_peaks": f"WITH {S.V_LONG}, p AS (SELECT entity, idx, x, lag(x) {S.W} AS a, lead(x) {S.W} AS b FROM sig) SELECT entity, idx FROM p WHERE x > a AND x > b",
    "stream_beats": f"SELECT r.entity, r.idx FROM ({S.SQL['ecg_rpeaks']}) r JOIN (SELECT event_type AS entity, count(*) AS n FROM events GROUP BY event_type) c ON c.entity = r.entity WHERE r.idx + 52 < c.n",
    "stream_onsets": S.SQL["ppg_onsets"],
}

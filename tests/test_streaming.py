import numpy as np
import pytest
from pyspark.sql import functions as F

from biosignal.operators import detectors
from biosignal.streaming.features import beats, peaks, pulse_onsets, sessions, sliding_features

SCHEMA = "entity bigint, idx bigint, ts timestamp, x double"


def run(spark, tmp_path, batches, build, mode="append"):
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    for k, rows in enumerate(batches):
        d = spark.createDataFrame([(e, i, s, x) for e, i, s, x in rows], "entity bigint, idx bigint, s string, x double").withColumn("ts", F.to_timestamp("s")).select("entity", "idx", "ts", "x")
        d.coalesce(1).write.mode("append").parquet(src)
        if k == 0:
            q = build(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    return spark.sql("select * from out").collect()


def test_sliding_features(spark, tmp_path):
    first = [(1, k, f"2024-01-01 00:0{k}:00", float(k)) for k in range(6)]
    late = [(1, 90, "2024-01-01 00:01:30", 50.0), (1, 91, "2024-01-01 02:00:00", 1.0)]
    out = run(spark, tmp_path, [first, late, [(1, 92, "2024-01-01 03:00:00", 1.0)], [(1, 93, "2024-01-01 04:00:00", 1.0)]], lambda s: sliding_features(s, {"m": F.max("x")}, "2 minutes", "2 minutes", "10 minutes"))
    by = {r.start.strftime("%H:%M"): r.m for r in out}
    assert by["00:00"] == 50.0 and by["00:02"] == 3.0 and by["00:04"] == 5.0


def test_sessions(spark, tmp_path):
    rows = [(1, 0, "2024-01-01 00:00:00", 1.0), (1, 1, "2024-01-01 00:10:00", 2.0), (1, 2, "2024-01-01 05:00:00", 3.0)]
    out = run(spark, tmp_path, [rows, [(1, 3, "2024-01-01 09:00:00", 1.0)], [(1, 4, "2024-01-01 15:00:00", 1.0)]], lambda s: sessions(s, {"n": F.count("x")}, "30 minutes"))
    assert sorted(r.n for r in out)[-1] == 2


def test_peaks_over_batches(spark, tmp_path):
    x = [0, 3, 1, 5, 4, 6, 2, 2, 9, 1]
    rows = [(1, k, "2024-01-01 00:00:00", float(v)) for k, v in enumerate(x)]
    out = run(spark, tmp_path, [rows[:3], rows[2:6], rows[6:]], peaks)
    assert sorted(r.idx for r in out) == [1, 3, 5, 8]


def batches_of(values, cuts, entity=1):
    rows = [(entity, k, "2024-01-01 00:00:00", float(v)) for k, v in enumerate(values)]
    return [rows[max(0, a - 3) : b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]  # a few rows come twice


def test_beats_over_batches(spark, tmp_path):
    t = np.arange(0, 30, 1 / 250)
    x = sum(np.exp(-((t - c) ** 2) / (2 * 0.01**2)) for c in np.arange(0.8, 29.5, 0.8)) + np.random.default_rng(2).normal(0, 0.05, len(t))
    y = detectors.hamilton_tompkins(x, 250.0)
    out = run(spark, tmp_path, batches_of(y, [7, 60, 1000, 1001, 4000]), lambda s: beats(s.withColumnRenamed("x", "y"), 250.0))
    want = detectors.r_peaks(x, 250.0)
    assert sorted(r.idx for r in out) == want[want + 52 < len(y)].tolist() and len(out) > 25


@pytest.mark.parametrize("backtracking", [0.0, 1.0])
def test_pulse_onsets_over_batches(spark, tmp_path, backtracking):
    sr = 20
    x = np.random.default_rng(3).uniform(0, 0.2, 90 * sr)
    for k in [*range(20, 600, 20), *range(1100, 1500, 20)]:
        x[k : k + 3] = [0.5, 1.0, 0.6] if k < 600 else [0.3, 0.55, 0.3]
    out = run(spark, tmp_path, batches_of(x, [90, 210, 700, 1250]), lambda s: pulse_onsets(s, sr, backtracking))
    assert sorted(r.idx for r in out) == sorted(detectors.pulse_onsets_of(x, sr, backtracking).tolist()) and len(out) >= 10

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from biosignal.functions import aggregates as A
from biosignal.functions import scalars as S
from biosignal.operators import density, detectors, dsp, frames, hrv, information, location, rqa, spectral, timedom, windows
from biosignal.plans.compose import compose, rcompose


def series(spark, *arrays, name="x"):
    rows = [(e, i, None if v is None else float(v)) for e, a in enumerate(arrays) for i, v in enumerate(a)]
    return spark.createDataFrame(rows, f"entity bigint, idx bigint, {name} double")


def column(df, name, entity=0):
    return [r[name] for r in df.where(F.col("entity") == entity).orderBy("idx").collect()]


POINTS = [(0.1532, 86.675), (33.123, 21.541), (41.507483, -99.436554), (38.504048, -98.315949), (51.5074, 0.1278), (41.3851, 2.1734)]


def test_haversine_goldens(spark):
    km = [7704.77729623, 9756.94118642, 347.32834804, 7275.82114826, 1136.28562666]
    rows = [(*a, *b) for a, b in zip(POINTS, POINTS[1:])]
    got = [r.d for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(S.haversine("a", "b", "c", "d").alias("d")).collect()]
    assert got == pytest.approx([k * 12742.018 / 12742 for k in km], rel=1e-8)


def test_outer_product_is_symmetric(spark):
    p = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(POINTS)], "entity int, i int, latitude double, longitude double")
    d = {(r.i, r.j): r.distance for r in location.outer_distances(p, p.withColumnRenamed("i", "j")).collect()}
    assert len(d) == 36 and all(math.isclose(d[i, j], d[j, i], abs_tol=1e-9) for i, j in d) and all(d[i, i] == 0 for i in range(6))


def track(spark, rows):
    return spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(rows)], "entity bigint, idx bigint, latitude double, longitude double")


def test_distance_examples(spark):
    scale = 12742.018 / 12742
    d = location.successive_distance(track(spark, [(0.123, 160.1), (-43.23, 99.12), (88.09, 1.12), (51.23, -20.1)]))
    assert column(d, "distance") == pytest.approx([0, *[k * scale for k in (7715.92891568, 14840.77608768, 4113.65086425)]], rel=1e-8)
    first = spark.createDataFrame([(0, 0.123, 160.1)], "entity bigint, home_lat double, home_lon double")
    d = location.distance_from_home(track(spark, [(-43.23, 99.12), (88.09, 1.12), (51.23, -20.1)]), first)
    assert column(d, "home_distance") == pytest.approx([k * scale for k in (7715.92891568, 10192.11206194, 14304.8626077)], rel=1e-8)


def test_home(spark):
    rows = [(0, 0, "2024-01-01 23:30:00", 10.0, 20.0), (0, 1, "2024-01-02 02:00:00", 10.0002, 20.0), (0, 2, "2024-01-02 12:00:00", 11.0, 20.0), (0, 3, "2024-01-02 13:00:00", None, 20.0), (1, 0, "2024-01-02 12:00:00", 1.0, 1.0)]
    d = spark.createDataFrame(rows, "entity bigint, idx bigint, s string, latitude double, longitude double").withColumn("ts", F.to_timestamp("s"))
    h = location.home(d).collect()
    assert len(h) == 1 and h[0].home_lat == pytest.approx(10.0001)
    stay = {r.entity: r.home_stay for r in location.proportion_home_stay(d).collect()}
    assert stay == {0: 0.5, 1: 0.0}
    assert d.groupBy("entity").agg(A.location_variance("latitude", "longitude").alias("v")).where("entity = 1").collect()[0].v == 0


def test_spectrum_bands(spark):
    rows = [(0, k, k / 10, float(v)) for k, v in enumerate([9, 1, -4, 4, 2])]
    d = spark.createDataFrame(rows, "entity bigint, k bigint, freq double, psd double")
    r = d.groupBy("entity").agg(A.power_band("psd", "freq", 0.1, 0.3).alias("p"), A.relative_power_band("psd", "freq", 0.1, 0.3).alias("r"), A.peak_frequency("psd", "freq", 0.1, 0.3).alias("f"), A.peak_frequency("psd", "freq", 9.0).alias("none")).collect()[0]
    assert (r.p, r.r, r.f, r.none) == (9.0, 0.45, 0.1, None)
    assert hrv.peak_frequency(d, 0.1, 0.4, aligned=True).collect()[0].peak == 0.3
    assert hrv.peak_frequency(d, 0.1, 0.4).collect()[0].peak == 0.2  # the place in the band, looked up in the whole
    assert hrv.peak_frequency(d).collect()[0].peak == 0.0


def test_daily_range(spark):
    t = ["22:59:59", "23:00:00", "00:00:00", "06:00:00", "06:00:01"]
    d = spark.createDataFrame([(f"2024-01-01 {x}",) for x in t], "s string").select(F.to_timestamp("s").alias("t"))
    assert [r[0] for r in d.select(S.in_daily_range("t")).collect()] == [False, True, True, True, False]
    assert [r[0] for r in d.select(S.in_daily_range("t", "06:00", "23:00")).collect()] == [True, True, False, True, True]


def test_units():
    assert S.td_factor("ms") == 1_000_000
    with pytest.raises(ValueError):
        S.td_factor("h")


def test_statistics_and_edges(spark):
    d = series(spark, [1, 2, 2, 1, 5], [3, 3, 3], [None, None])
    a = d.groupBy("entity").agg(A.mode("x").alias("mode"), A.skewness("x").alias("sk"), A.kurtosis("x").alias("ku"), A.kurtosis_excess("x").alias("ex"), A.coeff_var("x").alias("cv"), A.interquartile_range("x").alias("iqr"))
    r = {x.entity: x for x in a.collect()}
    assert r[0].mode == 1 and r[1].sk == 0 and r[1].ku == 0 and r[1].ex == -3 and r[1].cv == 0
    assert r[2].mode is None and r[2].sk is None and r[2].cv is None
    x = np.array([1, 2, 2, 1, 5.0])
    assert r[0].iqr == pytest.approx(np.percentile(x, 75) - np.percentile(x, 25)) and r[0].ku == pytest.approx(((x - x.mean()) ** 4).mean() / x.var() ** 2)


@pytest.mark.parametrize("chunk", [1, 3, 8192])
def test_chunks_change_nothing(spark, chunk):
    x = np.random.default_rng(1).normal(size=40)
    assert column(timedom.gradient(series(spark, x, [1.0]), chunk=chunk), "gradient") == pytest.approx(np.gradient(x))
    r = windows.rolling(series(spark, x), {"m": F.avg("x")}, 7, 3, chunk=chunk).orderBy("window").collect()
    assert [v.m for v in r] == pytest.approx([x[k : k + 7].mean() for k in range(0, 34, 3)])
    s = frames.running_sum(series(spark, x), "x", "s", chunk=chunk)
    assert column(s, "s") == pytest.approx(np.cumsum(x))


def test_series_orders_over_buckets(spark):
    rows = [(1, f"2024-01-0{d} 10:00:00", k, float(10 * d + k)) for d in (3, 1, 2) for k in (1, 0)] + [(None, "2024-01-01 00:00:00", 0, 1.0), (1, None, 0, 1.0)]
    d = spark.createDataFrame(rows, "e int, t string, k int, v double").withColumn("t", F.to_timestamp("t"))
    assert column(frames.series(d, "e", ["t", "k"], "v"), "x", 1) == [10.0, 11.0, 20.0, 21.0, 30.0, 31.0]


def test_windows_edges(spark):
    d = series(spark, [1, 2, 3])
    assert windows.rolling(d, {"m": F.avg("x")}, 4).count() == 0
    t = d.withColumn("ts_us", F.when(F.col("idx") == 2, 100).otherwise(F.col("idx") * 10).cast("bigint"))
    r = windows.irregular(t, {"m": F.avg("x")}, 20, 20).orderBy("window").collect()
    assert [(v.start, v.m) for v in r] == [(0, 1.5), (20, None), (40, None), (60, None), (80, None)]
    assert windows.irregular(series(spark, [1]).withColumn("ts_us", F.lit(5).cast("bigint")), {"m": F.avg("x")}, 20, 20).count() == 0
    b = spark.createDataFrame([(0, 0, 0, 2), (0, 1, 2, 2), (0, 2, 2, 9)], "entity bigint, window bigint, lo bigint, hi bigint")
    assert [v.m for v in windows.over_bounds(d, b, {"m": F.avg("x")}, block=2).orderBy("window").collect()] == [1.5, None, 3.0]


def test_time_domain(spark):
    x = np.array([1, -2, 3, 0, -1, 4.0])
    d = series(spark, x)
    assert column(timedom.zero_crossings(d), "crossing") == [True, True, True, False, True]
    assert timedom.zero_crossing_count(d).collect()[0].crossings == 4
    assert timedom.line_length(d).collect()[0].line_length == np.abs(np.diff(x)).sum()
    assert column(timedom.moving_average(d, 4), "average") == pytest.approx(np.convolve(x, np.ones(4), "same") / 4)
    h = timedom.hjorth_parameters(d).collect()[0]
    g = np.gradient(x)
    assert h.mobility == pytest.approx(np.sqrt(g.var() / x.var())) and h.complexity == pytest.approx(np.sqrt(np.gradient(g).var() / g.var()) / h.mobility)
    rect = column(timedom.slope_sum(series(spark, np.arange(8.0) % 3), 2, rectify=True), "slope_sum")
    s = np.maximum(np.diff(np.arange(8.0) % 3), 0)
    assert rect == [0, 0, *[s[i - 2 : i].sum() for i in range(2, 7)], 0]
    assert timedom.find_peaks(d).count() == 1 and timedom.find_peaks(d, comp=lambda a, b: a < b).count() == 2


def brute_dfa(x, sizes, order):
    y, f = np.cumsum(x - x.mean()), []
    for w in sizes:
        r = []
        for k in range(0, len(x) - w + 1, w):
            u = np.arange(w)
            r.append(np.sqrt(((y[k : k + w] - np.polyval(np.polyfit(u, y[k : k + w], order), u)) ** 2).sum() / w))
        f.append(np.mean(r))
    return np.polyfit(np.log(sizes), np.log(f), 1)[0]


def test_dfa_and_hurst(spark):
    x = np.random.default_rng(3).normal(size=130)
    d = series(spark, x, np.arange(20.0))
    for order in (1, 2):
        r = {v.entity: v.dfa for v in timedom.dfa(d, [8, 16, 32], order=order).collect()}
        assert r[0] == pytest.approx(brute_dfa(x, [8, 16, 32], order))
    r = {v.entity: v.hurst for v in timedom.hurst(d).collect()}
    tau = [np.sqrt(np.std(x[k:] - x[:-k])) for k in range(2, 64)]
    assert r[0] == pytest.approx(2 * np.polyfit(np.log(range(2, 64)), np.log(tau), 1)[0]) and r[1] is None


def test_hrv(spark):
    n = np.random.default_rng(2).normal(800, 60, 200)
    d = series(spark, n, name="nni")
    t = hrv.time_domain(d).collect()[0]
    s = np.diff(n)
    assert t.rmssd == pytest.approx(np.sqrt((s**2).mean())) and t.pnnx == pytest.approx((np.abs(s) > 50).mean()) and t.ssd == pytest.approx(n[-1] - n[0])
    p = hrv.poincare(d).collect()[0]
    assert p.sd1 == pytest.approx(t.sdsd / np.sqrt(2)) and p.csi == pytest.approx(p.sd1 / p.sd2)
    w = hrv.windowed_deviation(d, interval=20, unit="ms").collect()[0]
    us = np.round(np.cumsum(n) * 1000).astype(int)
    k = (us - us[0]) // 20_000_000
    nw = math.ceil((us[-1] - us[0]) / 2e7)
    m = [n[k == j] for j in range(nw)]
    assert w.sdann == pytest.approx(np.std([v.mean() for v in m])) and w.sdnni == pytest.approx(np.mean([v.std() for v in m]))
    with pytest.raises(ValueError):
        hrv.windowed_deviation(d)


def test_sampen_and_recurrence(spark):
    x = np.round(np.random.default_rng(5).normal(size=60), 1)
    r = information.sampen(series(spark, x, [2, 2, 2, 2])).orderBy("entity").collect()
    tol, b, a = 0.2 * x.std(), 0, 0
    for i in range(len(x) - 2):
        for j in range(i + 1, len(x) - 2):
            if abs(x[i] - x[j]) < tol and abs(x[i + 1] - x[j + 1]) < tol:
                b += 1
                a += abs(x[i + 2] - x[j + 2]) < tol
    assert (r[0].pairs, r[0].matches) == (b, a) and r[1].sampen is None
    d = series(spark, x)
    m = np.abs(x[:, None] - x) <= 0.3
    pairs = rqa.recurrent_pairs(d, 0.3)
    assert {(p.i, p.j) for p in pairs.collect()} == set(zip(*np.nonzero(m)))
    v = rqa.rates(d, pairs).collect()[0]
    assert v.recurrence_rate == pytest.approx(m.mean())
    pad = np.pad(m, 1)
    assert v.determinism == pytest.approx((m & (pad[2:, 2:] | pad[:-2, :-2])).mean()) and v.laminarity == pytest.approx((m & (pad[1:-1, 2:] | pad[1:-1, :-2])).mean())
    assert rqa.diagonal_lengths(pairs).where("line = 0").collect()[0].length == len(x)
    vec = spark.createDataFrame([(0, i, [float(x[i]), float(x[-i])]) for i in range(40)], "entity bigint, idx bigint, v array<double>")
    y = np.array([[x[i], x[-i]] for i in range(40)])
    assert rqa.recurrent_vector_pairs(vec, 0.4).count() == (np.sqrt(((y[:, None] - y) ** 2).sum(2)) <= 0.4).sum()


def test_spectra(spark):
    x = np.random.default_rng(6).normal(size=12)
    f = spectral.fft(series(spark, x)).orderBy("k").collect()
    assert [v.re + 1j * v.im for v in f] == pytest.approx(np.fft.fft(x))
    back = spectral.ifft(spark.createDataFrame([(0, v.k, v.re, v.im) for v in f], "entity bigint, idx bigint, re double, im double")).orderBy("k").collect()
    assert [v.re for v in back] == pytest.approx(x)
    t = spark.createDataFrame([(0, 2 * math.pi * i / 12, float(v)) for i, v in enumerate(x)], "entity bigint, t double, c double")
    g = {v.k: v.re - 1j * v.im for v in spectral.nudft(t, 12).collect()}
    assert [g[k] for k in range(6)] == pytest.approx(np.fft.fft(x)[:6] / 12)
    with pytest.raises(ValueError):
        spectral.nudft(t, 4, eps=1.0)


@pytest.mark.parametrize("kind,cutoff,edges", [("lowpass", 5.0, [5]), ("highpass", 5.0, [5]), ("bandpass", (3.0, 12.0), [3, 12])])
def test_butterworth(spark, kind, cutoff, edges):
    b, a = dsp.design(cutoff, 50.0, 5, kind)
    for f in edges:
        z = np.exp(-2j * np.pi * f / 50)
        assert abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) == pytest.approx(math.sqrt(0.5), rel=1e-6)
    t = np.arange(400) / 50
    y = column(dsp.butterworth(series(spark, np.full(400, 3.0), [1.0, 2.0]), cutoff, 50.0, kind=kind), "x")
    assert y == pytest.approx([3.0 if kind == "lowpass" else 0.0] * 400, abs=1e-4)
    if kind == "lowpass":
        slow, fast = np.sin(2 * np.pi * 1 * t), np.sin(2 * np.pi * 20 * t)
        assert dsp.filtfilt(dsp.Sections(cutoff, 50.0, 5, kind), (slow + fast)[:, None])[50:350, 0] == pytest.approx(slow[50:350], abs=1e-2)


def test_filters_together_are_as_alone():
    rng = np.random.default_rng(2)
    f = dsp.Sections((3.0, 12.0), 50.0, 5, "bandpass")
    x = [rng.normal(size=(n, 2)) for n in (40, 300, 41, 90, 150)]
    for one, y in zip(x, dsp.filtfilt_many(f, x)):
        assert y == pytest.approx(dsp.filtfilt(f, one), abs=1e-9)


def test_filters_of_acceleration(spark):
    t = np.arange(600) / 50
    rows = [(0, i, math.sin(2 * math.pi * 2 * s), 0.0, 9.81) for i, s in enumerate(t)] + [(1, i, 1.0, 1.0, 1.0) for i in range(10)]
    d = spark.createDataFrame(rows, "entity bigint, idx bigint, x double, y double, z double")
    g = dsp.gravity_filter(d, 50.0)
    assert column(g, "z")[100:500] == pytest.approx([9.81] * 400, abs=1e-3) and column(g, "z", 1) == [None] * 10
    assert column(dsp.linear_filter(d, 50.0), "x")[250:350] == pytest.approx(np.sin(2 * np.pi * 2 * t)[250:350], abs=2e-2)


def test_beats(spark):
    fs, t = 250, np.arange(0, 60, 1 / 250)
    centres = np.arange(0.8, 59.5, 0.8)
    ecg = sum(np.exp(-((t - c) ** 2) / (2 * 0.01**2)) for c in centres) + 0.2 * np.sin(2 * np.pi * 0.25 * t) + np.random.default_rng(0).normal(0, 0.01, len(t))
    d = series(spark, ecg, ecg[:20])
    at = np.array([r.idx for r in detectors.rpeaks_hamilton_tompkins(d, fs).orderBy("idx").collect()]) / fs
    assert sum(np.abs(at - c).min() < 0.06 for c in centres) >= 0.9 * len(centres) and len(at) <= len(centres) + 8
    peaks = spark.createDataFrame([(0, int(c * fs)) for c in centres], "entity bigint, idx bigint")
    for both in (False, True):
        q = [r.quality for r in detectors.beat_quality(d.where("entity = 0"), peaks, fs, both_sides=both).orderBy("idx").collect()]
        assert np.median(q) > 0.75
    assert detectors.beat_quality(d.where("entity = 0"), peaks.limit(5), fs).where("quality is null").count() == 5


def test_adapters(spark):
    from biosignal.sources.adapters import sampling_rate, signal

    d = spark.createDataFrame([(7, "a", f"2024-01-01 00:00:0{k}", float(k), 1) for k in range(4)] + [(8, "a", "2024-01-01 00:00:00", 5.0, 1)], "who int, note string, s string, first double, second int").withColumn("ts", F.to_timestamp("s"))
    x = signal(d, "who", ["ts"])
    assert column(x, "x", 7) == [0.0, 1.0, 2.0, 3.0]
    assert {r.entity: r.fs for r in sampling_rate(x).collect()} == {7: 1.0, 8: None}


def test_rate_from_times(spark):
    t = np.arange(0, 20, 1 / 200)
    ecg = sum(np.exp(-((t - c) ** 2) / (2 * 0.01**2)) for c in np.arange(0.8, 19.5, 0.8))
    d = series(spark, ecg).withColumn("ts_us", F.col("idx") * 5000)
    a = detectors.rpeaks_hamilton_tompkins(d, 200.0).select("idx").collect()
    assert a == detectors.rpeaks_hamilton_tompkins(d, ts="ts_us").select("idx").collect() and len(a) > 15


def test_pulse_onsets(spark):
    sr, t = 125, np.arange(0, 60, 1 / 125)
    phase = (t % 0.9) / 0.9
    ppg = np.where(phase < 0.4, 0.5 - 0.5 * np.cos(2 * np.pi * phase / 0.4), 0)
    at = np.array([r.idx for r in detectors.pulse_onset_physionet(series(spark, ppg), sr).orderBy("idx").collect()]) / sr
    assert len(at) > 45 and at.max() < 50.5 and np.median(np.diff(at)) == pytest.approx(0.9, abs=0.02)


def test_correlation():
    y = np.arange(6.0)
    assert detectors.correlations(np.array([y, -y, np.ones(6)]), y) == pytest.approx([1, -1, 0])


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(c, 0.001, (50, 2)) for c in ((10, 10), (10.5, 10), (10, 10.6))] + [rng.uniform(8, 13, (10, 2))])
    d = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(1, 0, 1.0, 1.0)], "entity bigint, idx bigint, latitude double, longitude double")
    label = column(density.cluster_locations(d, coords="radians"), "label")
    assert [len(set(label[k : k + 50])) for k in (0, 50, 100)] == [1, 1, 1] and len(set(label[:150])) == 3 and label[0] == 0
    assert column(density.cluster_locations(d), "label", 1) == [-1]


def test_labels(spark):
    d = spark.createDataFrame([(0, x) for x in (1, 1, 2, -1)] + [(1, 3)], "entity bigint, label int")
    assert [r.clusters for r in location.num_clusters(d).orderBy("entity").collect()] == [3, 1]
    e = [r.entropy for r in location.cluster_entropy(d, normalized=True).orderBy("entity").collect()]
    assert e[0] == pytest.approx(1.0397207708 / math.log(3)) and e[1] is None


def test_compose(spark):
    d = spark.range(3)
    double, less = (lambda x: x.select((F.col("id") * 2).alias("id"))), (lambda x: x.select((F.col("id") - 1).alias("id")))
    assert sorted(r.id for r in compose([double, less])(d).collect()) == [-2, 0, 2]
    assert sorted(r.id for r in rcompose([double, less])(d).collect()) == [-1, 1, 3]


def test_features_end_at_the_edges_of_windows(spark):
    x = [800.0, 810.0, 790.0, 805.0, 900.0, 700.0, 820.0, 815.0]
    f = {"rmssd": lambda w: A.rmssd(w.d), "activity": lambda w: A.hjorth_activity(w.x), "mobility": lambda w: A.hjorth_mobility(w.x, w.d1), "complexity": lambda w: A.hjorth_complexity(w.x, w.d1, w.d2)}
    d = series(spark, x).withColumn("ts_us", F.col("idx"))
    bounds = spark.createDataFrame([(0, 0, 0, 4), (0, 1, 4, 8)], "entity bigint, window bigint, lo bigint, hi bigint")

    def plain(v):
        d1 = np.gradient(v)
        mobility = np.sqrt(d1.var() / v.var())
        return [np.sqrt((np.diff(v) ** 2).mean()), v.var(), mobility, np.sqrt(np.gradient(d1).var() / d1.var()) / mobility]

    want = [plain(np.array(x[:4])), plain(np.array(x[4:]))]
    assert want[1][0] == pytest.approx(134.69, abs=0.01)
    for out in (windows.rolling(d, f, 4, 4), windows.over_bounds(d, bounds, f, block=3), windows.irregular(d, f, 4, 4)):
        got = [[r[n] for n in f] for r in out.orderBy("window").collect()]
        assert np.array(got) == pytest.approx(np.array(want))


def test_opaque_functions_in_all_windows(spark):
    x = np.random.default_rng(5).normal(size=23)
    d = series(spark, x).withColumn("ts_us", F.col("idx") * 10).repartition(4)
    f = {"last": windows.opaque(lambda v: float(v[-1] - v[0])), "m": F.avg("x")}
    bounds = spark.createDataFrame([(0, k, k, k + 7) for k in range(10)] + [(0, 10, 3, 3)], "entity bigint, window bigint, lo bigint, hi bigint")
    for out, step in ((windows.rolling(d, f, 7, 2), 2), (windows.over_bounds(d, bounds, f, block=4), 1), (windows.irregular(d, f, 70, 20), 2)):
        for r in out.where("window < 8").collect():
            v = x[r.window * step :][:7]
            assert (r.last, r.m) == pytest.approx((v[-1] - v[0], v.mean()))
    assert windows.over_bounds(d, bounds, f).where("window = 10").collect()[0].last is None
    udaf = F.pandas_udf(lambda v: float(v.max()), "double", F.PandasUDFType.GROUPED_AGG)
    assert [r.top for r in windows.irregular(d, {"top": udaf("x")}, 70, 70).orderBy("window").collect()][0] == pytest.approx(x[:7].max())


def test_filters_and_beats_in_chunks_are_those_of_the_series(spark):
    rng = np.random.default_rng(9)
    t = np.arange(12000) / 250
    x = sum(np.exp(-((t - c) ** 2) / (2 * 0.01**2)) for c in np.arange(0.8, 47.5, 0.8)) + rng.normal(0, 0.05, len(t))
    d = series(spark, x, x[:3000], x[:20])
    for k, v in enumerate((x, x[:3000])):
        assert column(dsp.butterworth(d, (5, 15), 250.0, kind="bandpass", columns=["x"], chunk=1000), "x", k) == pytest.approx(dsp.filtfilt(dsp.Sections((5, 15), 250.0, 5, "bandpass"), v[:, None])[:, 0], abs=1e-12)
        got = column(detectors.rpeaks_hamilton_tompkins(d, 250.0, chunk=1000), "idx", k)
        assert got == detectors.r_peaks(v, 250.0).tolist() and len(got) > 10
    assert column(dsp.butterworth(d, (5, 15), 250.0, kind="bandpass", columns=["x"], chunk=1000), "x", 2) == [None] * 20


def test_sections_are_the_polynomials():
    for cutoff, kind in ((5.0, "lowpass"), (0.5, "highpass"), ((3.0, 12.0), "bandpass"), ((0.5, 20.0), "bandpass")):
        for order in (2, 5):
            f, (b, a) = dsp.Sections(cutoff, 50.0, order, kind), dsp.design(cutoff, 50.0, order, kind)
            z = np.exp(-2j * np.pi * np.linspace(0.01, 0.49, 50))
            whole = np.prod([(r[0] + r[1] * z + r[2] * z**2) / (1 + r[3] * z + r[4] * z**2) for r in f.rows], axis=0)
            assert whole == pytest.approx(np.polyval(b[::-1], z) / np.polyval(a[::-1], z), rel=1e-4, abs=1e-9)


def test_pulse_backtracking_by_the_plain_rule():
    """After ten quiet seconds the ring takes the level of what follows the last onset; the threshold moves with an onset."""
    sr = 20
    x = np.random.default_rng(3).uniform(0, 0.2, 90 * sr)
    for k in [*range(20, 600, 20), *range(1100, 1500, 20)]:
        x[k : k + 3] = [0.5, 1.0, 0.6] if k < 600 else [0.3, 0.55, 0.3]
    for backtracking in (0.0, 1.0):
        level = x[: 10 * sr].mean() + 2 * x[: 10 * sr].std()
        cut, w, ring, turn, onsets = level - x[: 10 * sr].std(), int(sr / (1000 / 150)), [level] * 10, 0, []
        i, j, back = w, 0, 0
        while i < len(x) - 10 * sr:
            if x[i] > cut:
                j = max(range(i - w, i + w), key=lambda q: (x[q], -q))
                onsets.append(j)
                turn = (turn + 1) % 10
                ring[turn] = x[j]
                cut = np.median(ring) - 2 * np.std(ring)
                i, back = i + 3 * w - 1, j
            i += 1
            if backtracking and j < i - 10 * sr:
                ring = [3 * x[j + sr : j + 11 * sr].mean()] * 10
                i, back = back + w, back + 5 * sr
        assert detectors.pulse_onsets_of(x, sr, backtracking).tolist() == onsets and len(onsets) >= 10


def test_density_by_rows_is_that_of_the_matrix(monkeypatch):
    rng = np.random.default_rng(4)
    p = density.on_sphere(*(rng.normal(0.7, 0.001, (2, 60))))
    d = 2 * np.arcsin(np.sqrt(((p[:, :, None] - p[:, None]) ** 2).sum(axis=0)) / 2)
    monkeypatch.setattr(density, "ROWS", 130)
    core = density.core_distances(p, 4)
    assert core == pytest.approx(np.sort(d, axis=1)[:, 3])
    reach = np.maximum(np.maximum(core[:, None], core), d)
    edges = density.spanning_tree(p, core)
    # Kruskal's tree has the same weights
    group, weights = list(range(60)), []
    for a, b in sorted(((a, b) for a in range(60) for b in range(a)), key=lambda e: reach[e]):
        if group[a] != group[b]:
            weights.append(reach[a, b])
            group = [group[a] if g == group[b] else g for g in group]
    assert edges[:, 2] == pytest.approx(weights) and all(reach[int(a), int(b)] == pytest.approx(w) for a, b, w in edges)


def test_long_transforms_are_those_of_one_task(spark):
    rng = np.random.default_rng(12)
    x = [rng.normal(size=n) for n in (997, 1024, 1, 2, 40)]
    for f in (spectral.fft, spectral.ifft):
        d = series(spark, *x).withColumn("im", F.col("x") * 0.5 + F.col("idx") % 3)
        got = f(d, "x", "im", longest=30)
        for e, v in enumerate(x):
            z = v + 1j * (v * 0.5 + np.arange(len(v)) % 3)
            want = np.fft.fft(z) if f is spectral.fft else np.fft.ifft(z)
            rows = got.where(F.col("entity") == e).orderBy("k").collect()
            assert [r.k for r in rows] == list(range(len(v)))
            assert np.array([r.re + 1j * r.im for r in rows]) == pytest.approx(want, abs=1e-9)

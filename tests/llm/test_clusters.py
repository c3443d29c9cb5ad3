import numpy as np
import pytest
from pyspark.sql import functions as F

from biosignal.llm.clusters import BallTree, CellTree, describe_clusters, nearest, place_clusters, vector_clusters, ward

SCHEMA = "ping_id bigint, latitude double, longitude double, x string, cluster_id string, n string"
M = 1 / 111194.9


def blob(lat, lon, n, first, spread, seed):
    rng = np.random.default_rng(seed)
    y, x = rng.normal(0, spread, n) * M, rng.normal(0, spread, n) * M / np.cos(np.radians(lat))
    return [(first + k, float(lat + a), float((lon + b + 180) % 360 - 180)) for k, (a, b) in enumerate(zip(y, x))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def data():
    big = blob(10.0, 20.0, 400, 0, 30, 1)
    other = blob(10.0 + 600 * M, 20.0, 60, 1000, 25, 2)
    over = blob(-17.5, 180.0, 80, 2000, 30, 3)
    north = blob(78.0, -0.0001, 40, 3000, 20, 4)
    few = blob(30.0, 30.0, 29, 4000, 10, 5)
    way = [(5000 + k, 10.0 + (700 + 80 * k) * M, 20.01) for k in range(60)]
    return big, other, over, north, few, way


def test_blobs_and_lone_records(spark):
    *blobs, few, way = data()
    junk = [(None, 10.0, 20.0), (9001, None, 20.0), (9002, 999.0, 20.0), (9003, float("nan"), 20.0)]
    repeated = few[:5] * 3  # 29 records, whatever the rows
    rows = [r for b in blobs for r in b] + few + way + junk + repeated + blobs[0][:200]
    out = place_clusters(frame(spark, rows)).collect()
    of = {r.id: r.cluster_id for r in out}
    assert len(of) == len(out)
    for b in blobs:
        ids = {of.get(r[0]) for r in b}
        assert len(ids) == 1 and None not in ids
    assert len({of[b[0][0]] for b in blobs}) == 4
    assert not {r[0] for r in few + way + junk} & of.keys()


def test_same_result_for_any_partitioning(spark):
    rows = [r for b in data() for r in b]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({(r.id, r.cluster_id) for r in place_clusters(frame(spark, rows[::-1] if n == "7" else rows).repartition(int(n))).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = [{frozenset(i for i, c in g if c == k) for k in {c for _, c in g}} for g in got]
    assert groups[0] == groups[1]


def test_description(spark):
    big = data()[0]
    d = describe_clusters(place_clusters(frame(spark, big)), typical=3).collect()
    assert len(d) == 1 and d[0]["size"] == 400 and len(d[0].typical) == 3
    centre = np.mean([r[1:] for r in big], axis=0)
    far = {r[0]: np.hypot(r[1] - centre[0], (r[2] - centre[1]) * np.cos(np.radians(10))) for r in big}
    assert set(d[0].typical) <= set(sorted(far, key=far.get)[:12])


def test_ward_merges_by_increase_and_respects_the_width():
    mean = np.array([[0.0, 0, 0], [20, 0, 0], [100, 0, 0], [800, 0, 0], [830, 0, 0]])
    label = ward(np.array([10, 10, 5, 8, 8]), mean, np.zeros(5), 250, 2)
    assert label[0] == label[1] == label[2] and label[3] == label[4] != label[0]


def test_empty(spark):
    assert place_clusters(frame(spark, [])).count() == 0
    assert place_clusters(frame(spark, [(1, 2.0, 3.0)])).where(F.col("id") > 0).count() == 0


@pytest.mark.parametrize("gap,spread", [(100, 10), (180, 15), (220, 15), (220, 25), (260, 20)])
def test_two_places_near_each_other_keep_all_their_records(spark, gap, spread):
    rows = blob(10.0, 20.0, 100, 0, spread, 1) + blob(10.0 + gap * M, 20.0, 100, 1000, spread, 2)
    of = {r.id: r.cluster_id for r in place_clusters(frame(spark, rows)).collect()}
    assert len(of) == 200
    if gap > 100:
        assert len({of[r[0]] for r in rows[:100]}) == len({of[r[0]] for r in rows[100:]}) == 1
    assert len(set(of.values())) == 2


def test_cell_trees_merge_in_any_order():
    x = np.random.default_rng(8).normal(0, 80, (5000, 3)) + [6.3e6, 10, -20]
    whole, parts = CellTree(30.0), CellTree(30.0)
    whole.add(x)
    for k in (2, 0, 1):
        t = CellTree(30.0)
        t.add(x[k::3])
        parts.take(t.leaves())
    assert parts.leaves() == pytest.approx(whole.leaves(), rel=1e-9) and whole.leaves()[:, 3].sum() == 5000


def test_ball_tree_is_bounded_and_keeps_every_record():
    x = np.random.default_rng(8).normal(size=(3000, 6))
    tree = BallTree(0.01, 200)
    tree.take(np.ones(3000), x, (x**2).sum(axis=1))
    assert len(tree.n) <= 200 and tree.n.sum() == 3000
    assert tree.total.sum(axis=0) == pytest.approx(x.sum(axis=0)) and tree.ss.sum() == pytest.approx((x**2).sum())


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    rows = [(int(100 * k + i), [float(v) for v in c + rng.normal(0, 0.02, 24)], "a") for k, c in enumerate(centres) for i in range(4 + 6 * k)]
    alone = [(9000 + k, [float(v) for v in rng.normal(size=24) * 3], "a") for k in range(20)]
    junk = [(None, [0.0] * 24, "a"), (9900, None, "a"), (9901, [], "a"), (9902, [float("nan")] * 24, "a"), (9903, [None] * 24, "a")]
    d = spark.createDataFrame(rows + alone + junk, "k bigint, vec array<double>, cluster_id string").repartition(5)
    out = vector_clusters(d, "k", "vec", across=1.0, min_size=10)
    of = {r.id: r.cluster_id for r in out.collect()}
    large = [k for k in range(12) if 4 + 6 * k >= 10]
    assert set(of) == {r[0] for r in rows if r[0] // 100 in large}
    groups = [{of[r[0]] for r in rows if r[0] // 100 == k} for k in large]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == len(large)
    about = describe_clusters(out).collect()
    assert sorted(r["size"] for r in about) == [4 + 6 * k for k in large] and all(len(r.typical) == 3 and r.radius < 0.2 for r in about)
    assert vector_clusters(d.where(F.lit(False)), "k", "vec", across=1.0).count() == 0


def test_nearest():
    of, d2 = nearest(np.array([[0.0, 0], [5, 5]]), np.array([[4.0, 5], [1, 0]]))
    assert of.tolist() == [1, 0] and d2 == pytest.approx([1, 1])

import numpy as np
import pandas as pd

from biosignal.operators.blocks import changes, map_segments, segmented


def frame(sizes):
    return pd.DataFrame({"a": np.repeat(np.arange(len(sizes)), sizes), "v": np.arange(sum(sizes))})


def test_blocks_hold_whole_segments():
    rng = np.random.default_rng(0)
    for rows in (1, 5, 40, 10_000):
        whole = frame(rng.integers(1, 30, 50))
        cuts = np.sort(rng.integers(0, len(whole), 20))
        frames = [whole.iloc[a:b] for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(whole)])]
        blocks = list(segmented(frames, ["a"], rows))
        assert pd.concat(blocks).v.tolist() == whole.v.tolist()
        owner = {}
        for k, b in enumerate(blocks):
            for a in b.a.unique():
                assert owner.setdefault(a, k) == k


def test_changes_of_several_keys():
    f = pd.DataFrame({"a": [1, 1, 1, 2], "b": ["x", "x", "y", "y"]})
    assert changes(f, ["a", "b"]).tolist() == [True, False, True, True]
    assert changes(f.iloc[:0], ["a"]).tolist() == []


def test_kernel_sees_segments_in_order(spark):
    rows = [(k % 5, v) for v in range(200) for k in [v * 7]]
    d = spark.createDataFrame(rows, "a int, v int").repartition(6)

    def kernel(block):
        assert all(g.v.is_monotonic_increasing for _, g in block.groupby("a"))
        return block.groupby("a", as_index=False).agg(n=("v", "size"))

    out = map_segments(d, ["a"], ["v"], kernel, "a int, n bigint", rows=10).collect()
    assert sorted((r.a, r.n) for r in out) == [(k, 40) for k in range(5)]

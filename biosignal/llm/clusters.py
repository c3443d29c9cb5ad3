"""Similarity clusters: mergeable trees of cluster features, Ward agglomeration of their leaves, one assignment pass.

A cluster feature is (n, sum, sum of squares) of a group of records; features add up. Every partition grows a tree of
features over its records and hands on the leaves only; leaves of several trees meet and become one tree again; Ward's
criterion joins the leaves of the last tree to clusters; a pass over all records assigns each to the nearest centroid.

Two kinds of trees serve two kinds of data.

* Places (`place_clusters`) are many, and small beside the globe. Their tree has a fixed fan-out over unit-sphere coordinates
  in metres: leaves are cells of `leaf_m`, nodes cells of `NODE` leaves, roots tiles of `TILE` leaves. The trees of all
  partitions have the same cells, so that merging them is exact and does not depend on the order, and a tile, with a margin,
  is agglomerated for itself: it holds a number of leaves bounded by its area, however many records pile up in it.
* Vectors of any length (`vector_clusters`) have no cells to speak of. Their tree takes a record into the nearest leaf within
  a radius, which grows when there are more than `max_leaves` leaves; trees are merged by taking in each other's leaves, a
  few at a time, until one is left. Its size is bounded, whatever the data.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biosignal.operators.blocks import changes, map_segments
from biosignal.session import materialise
from biosignal.sources.tables import valid_fixes

RADIUS_M = 6371009.0
NODE, TILE = 8, 256
#: Leaves that a partition's tree of places holds before it hands them on and starts again.
HELD = 200_000


def ward(n: np.ndarray, mean: np.ndarray, ss: np.ndarray, across: float, dims: int, apart=None) -> np.ndarray:
    """Label of each cluster feature: pairs merge in order of Ward's increase, n_a n_b / (n_a + n_b) d^2, as long as the
    centroids are at most `across` apart and the root mean square radius stays that of a ball of that width in `dims`
    dimensions (and a tenth). Features meet within half the width; a union meets what either of its parts met.

    apart(a, b): whether two groups of features, given by their members, are places of their own and stay so.
    """
    m = len(n)
    label = np.arange(m)
    n, spread = n.astype(float).tolist(), np.maximum(ss, 0.0).tolist()  # spread: sum of squared distances from the centroid
    at = [tuple(p) for p in mean.tolist()]
    alive, near = [True] * m, [set() for _ in range(m)]
    limit = (across / 2) ** 2 * dims / (dims + 2) * 1.1
    heap: list[tuple[float, int, int]] = []

    def offer(a: int, b: int) -> None:
        d = math.dist(at[a], at[b])
        if d > across:
            return
        both = n[a] + n[b]
        cost = n[a] * n[b] / both * d * d
        if spread[a] + spread[b] + cost <= limit * both:
            heapq.heappush(heap, (cost, a, b))
            near[a].add(b)
            near[b].add(a)

    order = np.argsort(mean[:, 0], kind="stable")
    x = mean[order, 0]
    hi = np.searchsorted(x, x + across / 2, side="right")
    for k in range(m):
        other = order[k + 1 : hi[k]]
        first = int(order[k])
        for b in other[((mean[other] - mean[first]) ** 2).sum(axis=1) <= across**2 / 4].tolist():
            offer(first, b)
    members = {k: [k] for k in range(m)}
    while heap:
        cost, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or (apart is not None and apart(members[a], members[b])):
            continue
        c, both = len(n), n[a] + n[b]
        at.append(tuple([(p * n[a] + q * n[b]) / both for p, q in zip(at[a], at[b])]))
        n.append(both)
        spread.append(spread[a] + spread[b] + cost)
        alive[a] = alive[b] = False
        alive.append(True)
        near.append(set())
        members[c] = members.pop(a) + members.pop(b)
        for o in (near[a] | near[b]) - {a, b}:
            if alive[o]:
                offer(o, c)
    for k, own in members.items():
        label[own] = k
    return label


# ------------------------------------------------------------------ places


def _xyz(lat: Column, lon: Column) -> list[Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return [F.lit(RADIUS_M) * F.cos(la) * F.cos(lo), F.lit(RADIUS_M) * F.cos(la) * F.sin(lo), F.lit(RADIUS_M) * F.sin(la)]


LEAF = ["kx", "ky", "kz", "n", "sx", "sy", "sz", "ss"]


class CellTree:
    """Features of the cells that records fall into. Sums are of distances from a cell's corner, so that no digit is lost."""

    def __init__(self, leaf: float):
        self.leaf, self.held, self.size = leaf, [], 0

    def add(self, points: np.ndarray) -> None:
        cell = np.floor(points / self.leaf).astype(np.int64)
        inside = points - cell * self.leaf
        self.take(np.c_[cell, np.ones(len(points)), inside, (inside**2).sum(axis=1)])

    def take(self, leaves: np.ndarray) -> None:
        """Take in leaves, rows in the order of LEAF: equal cells become one."""
        if self.held:
            leaves = np.concatenate([self.held[0], leaves])
        code = ((leaves[:, 0].astype(np.int64) + 2**20) << 42) + ((leaves[:, 1].astype(np.int64) + 2**20) << 21) + leaves[:, 2].astype(np.int64) + 2**20
        _, first, of = np.unique(code, return_index=True, return_inverse=True)
        summed = np.stack([np.bincount(of, leaves[:, c], len(first)) for c in range(3, 8)], axis=1)
        self.held, self.size = [np.c_[leaves[first, :3], summed]], len(first)

    def leaves(self) -> np.ndarray:
        return self.held[0] if self.held else np.zeros((0, len(LEAF)))


def _grow(frames: Iterable[pd.DataFrame], leaf: float) -> Iterator[pd.DataFrame]:
    tree, waiting, count = CellTree(leaf), [], 0
    for f in frames:
        waiting.append(f[["x", "y", "z"]].to_numpy(float))
        count += len(f)
        if count >= 100_000:
            tree.add(np.concatenate(waiting))
            waiting, count = [], 0
            if tree.size > HELD:
                yield _as_leaves(tree)
                tree = CellTree(leaf)
    if waiting:
        tree.add(np.concatenate(waiting))
    if tree.size:
        yield _as_leaves(tree)


def _as_leaves(tree: CellTree) -> pd.DataFrame:
    f = pd.DataFrame(tree.leaves(), columns=LEAF)
    return f.astype({c: "int64" for c in LEAF[:4]})


def _merged(block: pd.DataFrame) -> pd.DataFrame:
    """The leaves of a block of tiles, those of the same cell of a tile together: the trees of the partitions as one."""
    keys = ["tx", "ty", "tz", "kx", "ky", "kz"]  # the order of the rows
    of = np.cumsum(changes(block, keys)) - 1
    out = block[changes(block, keys)].reset_index(drop=True)
    for c in LEAF[3:]:
        out[c] = np.bincount(of, block[c].to_numpy(float), len(out))
    return out


def _around(block: pd.DataFrame, seg: np.ndarray, tile: np.ndarray, size: int, reach: int) -> np.ndarray:
    """Of each leaf the mass of its node, a cell of `size` leaves, and of the nodes up to `reach` cells away, in its tile."""
    local = (block[["kx", "ky", "kz"]].to_numpy() - tile * TILE) // size + 32
    code = (seg * 256 + local[:, 0]) * 65536 + local[:, 1] * 256 + local[:, 2]
    node, of = np.unique(code, return_inverse=True)
    mass, out = np.bincount(of, block.n.to_numpy()), np.zeros(len(node))
    steps = range(-reach, reach + 1)
    for step in (a * 65536 + b * 256 + c for a in steps for b in steps for c in steps):
        there = np.minimum(np.searchsorted(node, node + step), len(node) - 1)
        out += np.where(node[there] == node + step, mass[there], 0)
    return out[of]


class Places:
    """The leaves of a tile and the clusters they make."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, ss: np.ndarray, leaf: float, least: int, across: float):
        self.n, self.mean, self.leaf, self.least, self.across = n, mean, leaf, least, across
        order = np.argsort(mean[:, 0], kind="stable")
        self.order, self.x = order, mean[order, 0]
        self.label = ward(n, mean, ss, across, 2, self.apart)

    def mass(self, at: np.ndarray) -> float:
        """Records of the leaves within a leaf's width of a point."""
        a, b = np.searchsorted(self.x, (at[0] - self.leaf, at[0] + self.leaf))
        near = self.order[a:b]
        return float(self.n[near][((self.mean[near] - at) ** 2).sum(axis=1) <= self.leaf**2].sum())

    def valley(self, p: np.ndarray, q: np.ndarray) -> bool:
        """Whether two centroids are peaks with next to nothing half-way."""
        if ((p - q) ** 2).sum() < (3 * self.leaf) ** 2:
            return False
        top = min(self.mass(p), self.mass(q))
        return top >= self.least / 2 and 4 * self.mass((p + q) / 2) < top

    def apart(self, a: list[int], b: list[int]) -> bool:
        """Two places of their own: each with enough records, and a valley between."""
        na, nb = self.n[a], self.n[b]
        if na.sum() < self.least or nb.sum() < self.least:
            return False
        return self.valley(np.average(self.mean[a], axis=0, weights=na), np.average(self.mean[b], axis=0, weights=nb))

    def centroids(self) -> list[tuple[np.ndarray, int]]:
        """The centroid of every cluster with enough records, and how many lie within its width, largest first.

        A cluster within the width of a larger one is what is left around it, unless a valley lies between.
        """
        _, group = np.unique(self.label, return_inverse=True)
        mass = np.bincount(group, self.n)
        sums = np.stack([np.bincount(group, self.mean[:, c] * self.n) for c in range(3)], axis=1)
        tops: list[np.ndarray] = []
        first = sums / mass[:, None]
        for k in np.lexsort((first[:, 0], -mass)):
            if mass[k] < max(2, self.least / 8):
                break  # remainders around the clusters, and single ways
            close = [t for t in tops if ((t - first[k]) ** 2).sum() <= self.across**2]
            if not close or (mass[k] >= self.least and all(self.valley(t, first[k]) for t in close)):
                tops.append(first[k])
        out = []
        if not tops:
            return out
        at = np.array(tops)
        for _ in range(2):  # the centroid of all leaves that the assignment will reach
            nearest, d2 = self._nearest(at)
            held = d2 <= (self.across / 2) ** 2
            weight = np.bincount(nearest[held], self.n[held], len(at))
            moved = np.stack([np.bincount(nearest[held], self.n[held] * self.mean[held, c], len(at)) for c in range(3)], axis=1)
            at = np.where(weight[:, None] > 0, moved / np.maximum(weight, 1)[:, None], at)
        nearest, d2 = self._nearest(at)
        held = d2 <= (self.across / 2) ** 2
        size = np.bincount(nearest[held], self.n[held], len(at))
        for c, s in zip(at, size):
            if s >= self.least and all(((c - o) ** 2).sum() > self.across**2 or self.valley(c, o) for o, _ in out):
                out.append((c, int(s)))
        return out

    def _nearest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, of = np.full(len(self.n), np.inf), np.zeros(len(self.n), int)
        for k, c in enumerate(at):
            a, b = np.searchsorted(self.x, (c[0] - self.across, c[0] + self.across))
            rows = self.order[a:b]
            d2 = ((self.mean[rows] - c) ** 2).sum(axis=1)
            closer = d2 < best[rows]
            best[rows[closer]], of[rows[closer]] = d2[closer], k
        return of, best


def _tile_clusters(block: pd.DataFrame, leaf_m: float, least: int, across_m: float) -> pd.DataFrame:
    out = []
    block = _merged(block)
    tile = block[["tx", "ty", "tz"]].to_numpy()
    # inner nodes, coarse ones first: what lies in a leaf's node and around it is too little for a cluster
    for size, reach in ((NODE, 1), (NODE // 2, 2)):
        keep = _around(block, np.cumsum(changes(block, ["tx", "ty", "tz"])) - 1, tile, size, reach) >= least if len(block) else np.zeros(0, bool)
        block, tile = block[keep].reset_index(drop=True), tile[keep]
    start = np.flatnonzero(changes(block, ["tx", "ty", "tz"])) if len(block) else []
    count = block.n.to_numpy()
    inside = block[["sx", "sy", "sz"]].to_numpy() / np.maximum(count, 1)[:, None]
    mean = block[["kx", "ky", "kz"]].to_numpy() * leaf_m + inside
    spread = block.ss.to_numpy() - count * (inside**2).sum(axis=1)
    for a, b in zip(start, np.r_[start[1:], len(block)]):
        for centre, size in Places(count[a:b], mean[a:b], spread[a:b], leaf_m, least, across_m).centroids():
            if (np.floor(centre / (leaf_m * TILE)).astype(np.int64) == tile[a]).all():
                out.append((*centre, size))
    return pd.DataFrame(out, columns=["cx", "cy", "cz", "size"])


def find_places(points: DataFrame, leaf_m: float, least: int, across_m: float) -> DataFrame:
    """(cluster_id, cx, cy, cz): the centroids of the clusters, of points with x, y, z in metres."""
    types = "kx bigint, ky bigint, kz bigint, n bigint, sx double, sy double, sz double, ss double"
    leaves = points.select("x", "y", "z").mapInPandas(lambda frames: _grow(frames, leaf_m), types)
    margin = int(np.ceil(2 * across_m / leaf_m))
    for c in "xyz":
        low, high = F.floor((F.col(f"k{c}") - margin) / TILE).cast("bigint"), F.floor((F.col(f"k{c}") + margin) / TILE).cast("bigint")
        leaves = leaves.withColumn(f"t{c}", F.explode(F.sequence(low, high)))
    found = map_segments(leaves, ["tx", "ty", "tz"], ["kx", "ky", "kz"], lambda b: _tile_clusters(b, leaf_m, least, across_m), "cx double, cy double, cz double, size bigint")
    # a cluster's id follows from its place, so that a task that runs again gives the same one
    return found.select(F.xxhash64(*[F.round(c, 1) for c in ("cx", "cy", "cz")]).alias("cluster_id"), "cx", "cy", "cz")


def place_clusters(df: DataFrame, id: str = "ping_id", lat: str = "latitude", lon: str = "longitude", *, across_m: float = 250.0, min_size: int = 30, reach_m: float = 150.0, leaf_m: float = 30.0) -> DataFrame:
    """(id, cluster_id, distance_m, latitude, longitude): the cluster of each record that belongs to one.

    A cluster is a place about `across_m` across at most with at least `min_size` records; nearer to each other than that,
    two places are two clusters where next to nothing lies between them. A record belongs to the nearest cluster whose
    centroid is at most `reach_m` away. Records without an id or a valid place, and lone ones, are in no cluster; a repeated
    id counts once, at the place nearest to a centroid. Empty in, empty out; other columns are ignored.
    """
    p = valid_fixes(df.where(F.col(id).isNotNull()), F.col(id).alias("id"), lat=lat, lon=lon)
    x, y, z = _xyz(F.col("latitude"), F.col("longitude"))
    p = p.select("id", "latitude", "longitude", x.alias("x"), y.alias("y"), z.alias("z"))
    cells = materialise(find_places(p, leaf_m, max(1, int(min_size * 0.8)), across_m))
    for c in "xyz":
        low, high = F.floor((F.col(f"c{c}") - reach_m) / reach_m).cast("bigint"), F.floor((F.col(f"c{c}") + reach_m) / reach_m).cast("bigint")
        cells = cells.withColumn(f"g{c}", F.explode(F.sequence(low, high)))
    p = p.withColumns({f"g{c}": F.floor(F.col(c) / reach_m).cast("bigint") for c in "xyz"})
    d2 = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0))
    near = p.join(cells, ["gx", "gy", "gz"]).withColumn("distance_m", F.sqrt(d2)).where(F.col("distance_m") <= reach_m)
    nearest = near.groupBy("id").agg(F.min(F.struct("distance_m", "cluster_id", "latitude", "longitude")).alias("best"))
    own = materialise(nearest.select("id", "best.cluster_id", "best.distance_m", "best.latitude", "best.longitude"))
    large = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("cluster_id")
    return own.join(large, "cluster_id").select("id", "cluster_id", "distance_m", "latitude", "longitude")


def describe_clusters(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, radius, typical): each cluster's size, root mean square radius and the ids nearest to its centroid,
    of members with a cluster_id and a distance, in metres for places."""
    by = "distance_m" if "distance_m" in members.columns else "distance"
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.sqrt(F.avg(F.col(by) * F.col(by))).alias("radius_m" if by == "distance_m" else "radius"))
    w = Window.partitionBy("cluster_id").orderBy(by, "id")
    top = members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)  # limited before the shuffle, too
    top = top.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best"))
    return size.join(top, "cluster_id").drop("rank").withColumn("typical", F.col("best.id")).drop("best")


# ------------------------------------------------------------------ vectors


class BallTree:
    """Features of balls: a feature joins the nearest leaf whose centroid is within the radius, or begins one. With more than
    `most` leaves the radius grows by a quarter and the leaves take each other in."""

    def __init__(self, radius: float, most: int):
        self.radius, self.most = radius, most
        self.n, self.total, self.ss = np.zeros(0), None, np.zeros(0)

    def take(self, n: np.ndarray, total: np.ndarray, ss: np.ndarray, step: int = 1024) -> None:
        """Take in features: counts, sums [feature, dimension] and sums of squares."""
        for a in range(0, len(n), step):
            self._take(n[a : a + step], total[a : a + step], ss[a : a + step])
            while len(self.n) > self.most:
                own = self.n, self.total, self.ss
                self.radius *= 1.25
                self.n, self.total, self.ss = np.zeros(0), None, np.zeros(0)
                for b in range(0, len(own[0]), step):
                    self._take(*(v[b : b + step] for v in own))

    def _join(self, of: np.ndarray, n: np.ndarray, total: np.ndarray, ss: np.ndarray) -> None:
        np.add.at(self.n, of, n)
        np.add.at(self.total, of, total)
        np.add.at(self.ss, of, ss)

    def _take(self, n: np.ndarray, total: np.ndarray, ss: np.ndarray) -> None:
        if self.total is None:
            self.total = np.zeros((0, total.shape[1]))
        mean = total / n[:, None]
        left = np.arange(len(n))
        if len(self.n):
            of, d2 = nearest(mean, self.total / self.n[:, None])
            near = d2 <= self.radius**2
            self._join(of[near], n[near], total[near], ss[near])
            left = left[~near]
        while len(left):  # the first one that is left begins a leaf, and those around it join
            near = ((mean[left] - mean[left[0]]) ** 2).sum(axis=1) <= self.radius**2
            own = left[near]
            self.n = np.r_[self.n, n[own].sum()]
            self.total = np.r_[self.total, total[own].sum(axis=0)[None]]
            self.ss = np.r_[self.ss, ss[own].sum()]
            left = left[~near]


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the nearest centre and the squared distance to it."""
    d2 = (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)
    of = d2.argmin(axis=1)
    return of, ((points - centres[of]) ** 2).sum(axis=1)


def _rows_of(tree: BallTree) -> pd.DataFrame:
    return pd.DataFrame({"n": tree.n, "total": list(tree.total) if tree.total is not None else [], "ss": tree.ss, "radius": tree.radius})


BALL = "n double, total array<double>, ss double, radius double"


def _ball_tree(frames: Iterable[pd.DataFrame], radius: float, most: int) -> Iterator[pd.DataFrame]:
    tree = BallTree(radius, most)
    for f in frames:
        if len(f):
            x = np.stack(f.v.to_numpy()).astype(float)
            tree.take(np.ones(len(x)), x, (x**2).sum(axis=1))
    if len(tree.n):
        yield _rows_of(tree)


def _merged_trees(block: pd.DataFrame, most: int) -> pd.DataFrame:
    out = []
    for group, g in block.groupby("into", sort=False):
        tree = BallTree(float(g.radius.max()), most)
        tree.take(g.n.to_numpy(), np.stack(g.total.to_numpy()), g.ss.to_numpy())
        out.append(_rows_of(tree).assign(part=group))
    return pd.concat(out, ignore_index=True)[["part", "n", "total", "ss", "radius"]]


def _vector_centres(block: pd.DataFrame, across: float, least: int) -> pd.DataFrame:
    n, total = block.n.to_numpy(), np.stack(block.total.to_numpy())
    mean = total / n[:, None]
    label = ward(n, mean, block.ss.to_numpy() - n * (mean**2).sum(axis=1), across, mean.shape[1])
    _, group = np.unique(label, return_inverse=True)
    size = np.bincount(group, n)
    sums = np.zeros((len(size), mean.shape[1]))
    np.add.at(sums, group, total)
    keep = size >= least
    return pd.DataFrame({"centre": list((sums / size[:, None])[keep])})


def vector_clusters(df: DataFrame, id: str, vector: str, *, across: float, min_size: int = 5, reach: float | None = None, max_leaves: int = 2000) -> DataFrame:
    """(id, cluster_id, distance): the cluster of each record that belongs to one, by the distance of its vectors.

    A cluster is about `across` wide at most and has at least `min_size` records; a record belongs to the nearest cluster
    whose centroid is at most `reach` away (by default 0.6 across). There are no more clusters than `max_leaves`, which bounds
    the summary that every worker holds; with more places than that, leaves grow, and clusters with them. Records without an
    id, without a vector or with NULL or NaN in it take no part; all vectors must have one length; a repeated id counts once
    for each of its vectors. Empty in, empty out; other columns are ignored.
    """
    v = df.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double"))))
    v = v.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    trees = v.select("v").mapInPandas(lambda frames: _ball_tree(frames, across / 8, max_leaves), BALL).withColumn("part", F.spark_partition_id())
    for groups in (256, 16, 1):
        into = trees.withColumn("into", F.pmod(F.col("part"), F.lit(groups)))
        trees = map_segments(into, ["into"], ["part", "n"], lambda b: _merged_trees(b, max_leaves), f"part int, {BALL}")
    centres = map_segments(trees, ["part"], ["n"], lambda b: _vector_centres(b, across, max(1, int(min_size * 0.8))), "centre array<double>")
    # max_leaves rows at most, whatever the data
    at = np.array([r.centre for r in materialise(centres).orderBy("centre").collect()], float)
    kind, limit = dict(df.dtypes)[id], reach or 0.6 * across
    shared = df.sparkSession.sparkContext.broadcast(at)

    def assign(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f) and len(shared.value):
                of, d2 = nearest(np.stack(f.v.to_numpy()).astype(float), shared.value)
                near = d2 <= limit**2
                yield pd.DataFrame({"id": f.id[near], "cluster_id": of[near].astype(np.int64), "distance": np.sqrt(d2[near])})

    own = materialise(v.mapInPandas(assign, f"id {kind}, cluster_id bigint, distance double"))
    large = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("cluster_id")
    return own.join(large, "cluster_id").select("id", "cluster_id", "distance")

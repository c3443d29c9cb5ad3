"""Hierarchical density clustering of the points of each entity (HDBSCAN with a haversine metric)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosignal.operators.blocks import changes, map_segments


ROWS = 2_000_000


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the unit sphere, of coordinates in radians."""
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Haversine distances of the points a[3, m] from b[3, n], by their chords."""
    square = sum((a[k][:, None] - b[k]) ** 2 for k in range(3))
    return 2 * np.arcsin(np.minimum(np.sqrt(square) / 2, 1))


def core_distances(points: np.ndarray, k: int) -> np.ndarray:
    """Distance of each point to its k-th neighbour, itself the first; ROWS distances are held at once."""
    n = points.shape[1]
    out, step = np.empty(n), max(1, ROWS // max(n, 1))
    for a in range(0, n, step):
        out[a : a + step] = np.partition(_angles(points[:, a : a + step], points), min(k, n) - 1, axis=1)[:, min(k, n) - 1]
    return out


def spanning_tree(points: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight) of a minimum spanning tree by mutual reachability, in order of weight. A row of distances is made
    when its point joins the tree, and forgotten."""
    n = points.shape[1]
    left, best, parent = np.arange(1, n), np.full(n - 1, np.inf), np.zeros(n - 1, int)
    edges, at = np.empty((n - 1, 3)), 0
    for k in range(n - 1):
        reach = np.maximum(np.maximum(_angles(points[:, at : at + 1], points[:, left])[0], core[left]), core[at])
        closer = reach < best
        best[closer], parent[closer] = reach[closer], at
        j = int(np.argmin(best))
        edges[k] = parent[j], left[j], best[j]
        at = left[j]
        # the last one takes the place of the one that joined
        left[j], best[j], parent[j] = left[-1], best[-1], parent[-1]
        left, best, parent = left[:-1], best[:-1], parent[:-1]
    return edges[np.argsort(edges[:, 2], kind="stable")]


def labels_of(points: np.ndarray, min_samples: int, min_cluster_size: int = 5) -> np.ndarray:
    """Cluster numbers of points[3, n] of the sphere, -1 for noise: excess of mass over the condensed tree, the root never."""
    n = points.shape[1]
    out = np.full(n, -1)
    if n < 2 * min_cluster_size:
        return out
    core = core_distances(points, min_samples)
    # single linkage: node n + k joins two nodes at a height
    group, size, child, height = list(range(n)), [1] * n, {}, {}
    top = np.arange(n)

    def find(a: int) -> int:
        while group[a] != a:
            group[a] = group[group[a]]
            a = group[a]
        return a

    node = {k: k for k in range(n)}
    for k, (a, b, w) in enumerate(spanning_tree(points, core)):
        ra, rb = find(int(a)), find(int(b))
        left, right, new = node[ra], node[rb], n + k
        child[new], height[new] = (left, right), w
        size.append(size[left] + size[right])
        group[rb] = ra
        node[ra] = new
    # condensed tree: a cluster lives from its birth until it splits into two that are large enough
    root = 2 * n - 2
    birth, stability, parent = {root: 0.0}, {}, {root: None}
    point_cluster = top * 0 + root
    stack = [(root, root)]

    def under(a: int) -> list[int]:
        todo, found = [a], []
        while todo:
            x = todo.pop()
            if x < n:
                found.append(x)
            else:
                todo += child[x]
        return found

    while stack:
        at, owner = stack.pop()
        if at < n:
            stability[owner] = stability.get(owner, 0.0)
            continue
        strength = 1 / height[at] if height[at] > 0 else 1e18
        left, right = child[at]
        large = [c for c in (left, right) if size[c] >= min_cluster_size]
        leaving = sum(size[c] for c in (left, right) if c not in large or len(large) == 2)
        stability[owner] = stability.get(owner, 0.0) + leaving * (strength - birth[owner])
        if len(large) == 2:
            for c in large:
                birth[c], parent[c] = strength, owner
                point_cluster[under(c)] = c
                stack.append((c, c))
        else:
            stack += [(c, owner) for c in large]
    children: dict[int, list[int]] = {}
    for c, p in parent.items():
        if p is not None:
            children.setdefault(p, []).append(c)
    best, chosen = {}, {}
    for c in sorted(parent):  # a child's number is smaller than its parent's
        below = sum(best[x] for x in children.get(c, []))
        chosen[c] = c != root and (not children.get(c) or stability.get(c, 0.0) >= below)
        best[c] = max(stability.get(c, 0.0), below) if c != root else below
    keep, walk = [], [root]
    while walk:
        c = walk.pop()
        if chosen[c]:
            keep.append(c)
        else:
            walk += children.get(c, [])
    for k, c in enumerate(sorted(keep, key=lambda c: min(under(c)))):
        out[under(c)] = k
    return out


def cluster_locations(df: DataFrame, min_samples: int | None = None, min_cluster_size: int = 5, coords: str = "as_is") -> DataFrame:
    """(entity, idx, label) of rows (entity, idx, latitude, longitude); -1 is noise, numbers follow the first row.

    min_samples: by default 1 + a twentieth of the entity's rows. coords: 'as_is' gives the values to the metric as they
    are, 'radians' converts degrees first. An entity is one task: its time grows with the square of its rows (some 10 s for
    20,000), its memory with the rows. Points of all entities together are better clustered by place, in cells.
    """
    if coords not in ("as_is", "radians"):
        raise ValueError("coords must be 'as_is' or 'radians'")

    def kernel(block: pd.DataFrame) -> pd.DataFrame:
        start = np.flatnonzero(changes(block, ["entity"]))
        out = np.empty(len(block), np.int32)
        for a, b in zip(start, np.r_[start[1:], len(block)]):
            lat, lon = block.latitude.to_numpy()[a:b], block.longitude.to_numpy()[a:b]
            if coords == "radians":
                lat, lon = np.radians(lat), np.radians(lon)
            out[a:b] = labels_of(on_sphere(lat, lon), min_samples or 1 + (b - a) // 20, min_cluster_size)
        return pd.DataFrame({"entity": block.entity, "idx": block.idx, "label": out})

    rows = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("entity").isNotNull()).select("entity", "idx", "latitude", "longitude")
    return map_segments(rows, ["entity"], ["idx"], kernel, f"entity {dict(df.dtypes)['entity']}, idx bigint, label int")

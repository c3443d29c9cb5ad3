"""Implausible readings per source: spikes, stuck values and impossible values, by a Kalman filter.

Each source's values follow a local-level model. The filter forecasts a reading from those before it, flags it where the
innovation divided by its standard deviation exceeds a threshold, and withholds flagged readings from the update; after
more than `max_run` flagged readings in a row it takes the new level for sound and starts again from it. An innovation
variance that vanishes, that is a run of steps of exactly zero, marks stuck readings.

Sources are cut into chunks of `chunk` readings with a margin on both sides, and a worker runs the recursion over all
chunks and values of a block at once, one vector operation a step: a source with a third of all rows is spread over
many tasks. What a chunk cannot decide alone is decided from summaries: runs that touch its edges (two a chunk), which join
inside groups of `GROUP` chunks and then over groups (two a group), and, for values judged against the whole source, a
histogram of distances from the source's median by powers of two. No window or task holds a source's readings.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biosignal.operators.blocks import changes, map_segments
from biosignal.session import materialise

SCHEMA = "source {source}, signal int, kind string, chunk bigint, pos int, value double, n bigint, idx array<bigint>, bin int, low double, high double, flagged bigint, long bigint"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Chunks of a group: two million readings.
GROUP = 4096
#: Ranks of the sketch of a source's quantiles: exact for sources of fewer readings, else within one in so many.
RANKS = 10_000


def kalman_flags(z: np.ndarray, level: np.ndarray, sigma: np.ndarray, drift: float, threshold: float, max_run: int, adapt: bool) -> np.ndarray:
    """Flags of readings z[step, series] (NaN: none) whose standardised innovation exceeds the threshold.

    level and sigma: the first level and the standard deviation of sound innovations of each series; drift: standard
    deviation of the level's step, in sigmas; adapt: follow the innovation variance where it is larger than sigma's.
    """
    steps, series = z.shape
    flags = np.zeros(z.shape, bool)
    level, r = level.copy(), sigma**2
    p, q, wide, run = r.copy(), (drift * sigma) ** 2, r.copy(), np.zeros(series, int)
    for k in range(steps):
        v = z[k]
        there = v == v
        e = np.where(there, v - level, 0.0)
        s = p + np.maximum(r, wide)
        flag = there & (e * e > threshold**2 * s)
        run = np.where(flag, run + 1, np.where(there, 0, run))
        restart = run > max_run
        use = there & ~flag
        gain = p / s
        level = np.where(use, level + gain * e, np.where(restart, v, level))
        p = np.where(use, (1 - gain) * p, np.where(restart, r, p)) + q
        if adapt:
            # flagged readings enter by a bounded amount: a few wrong ones hide nothing, livelier movement is learnt
            wide = np.where(there, 0.9 * wide + 0.1 * np.minimum(e * e, 25 * s), wide)
            wide = np.where(restart, np.maximum(wide, np.minimum(e * e, 100 * s)), wide)
        run = np.where(restart, 0, run)
        flags[k] = flag
    return flags


def _short_runs(flags: np.ndarray, there: np.ndarray, max_run: int) -> np.ndarray:
    """Of flags[step, series], those in runs of at most max_run over the readings that are there."""
    out = np.zeros_like(flags)
    col, row = np.nonzero(there.T)
    f = flags[row, col]
    new = np.r_[True, (f[1:] != f[:-1]) | (col[1:] != col[:-1])]
    length = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(f) else np.zeros(0, int)
    ok = f & (length <= max_run)
    out[row[ok], col[ok]] = True
    return out


def _beside(flags: np.ndarray, there: np.ndarray, each: int) -> np.ndarray:
    """Flags and the `each` readings before and after one, over the readings that are there."""
    out = np.zeros_like(flags)
    col, row = np.nonzero(there.T)
    f = flags[row, col]
    wide = f.copy()
    for k in range(1, each + 1):
        same = col[k:] == col[:-k]
        wide[k:] |= f[:-k] & same
        wide[:-k] |= f[k:] & same
    out[row[wide], col[wide]] = True
    return out


def _around(v: np.ndarray, sound: np.ndarray, at: np.ndarray, each: int) -> np.ndarray:
    """Median of up to `each` sound values before and after each position of one series."""
    where = np.flatnonzero(sound)
    out = np.full(len(at), np.nan)
    for k, i in enumerate(at):
        m = np.searchsorted(where, i)
        near = np.r_[where[max(0, m - each) : m], where[m : m + each]]
        near = near[near != i]
        if len(near):
            out[k] = np.median(v[near])
    return out


def _rows(kind: str, count: int, **columns) -> pd.DataFrame:
    """Rows of SCHEMA: columns that are not given are empty."""
    usual = {"chunk": 0, "pos": 0, "value": 0.0, "n": 0, "bin": None, "low": np.nan, "high": np.nan, "flagged": 0, "long": 0}
    f = pd.DataFrame({"kind": [kind] * count, **usual, **columns}, index=range(count))
    f["idx"] = columns.get("idx") if "idx" in columns else pd.Series([[] for _ in range(count)], index=f.index, dtype=object)
    return f[COLUMNS].astype({"bin": "Int32"})


def _long_level(far: np.ndarray, seg: np.ndarray, length: int) -> np.ndarray:
    """Of each reading the largest distance of which a run of `length` readings around it all have at least as much."""
    n, k = len(far), length - 1
    out = np.full(n, -np.inf)
    if n < length:
        return out
    least = np.min([far[j : n - k + j] for j in range(length)], axis=0)
    least = np.where(seg[k:] == seg[: n - k], least, -np.inf)
    for j in range(length):
        out[j : n - k + j] = np.maximum(out[j : n - k + j], least)
    return out


def _scan(block: pd.DataFrame, values: int, ratio: bool, threshold: float, max_run: int, stuck: int, off: float) -> pd.DataFrame:
    block = block[changes(block, ["source", "chunk", "ord"])].reset_index(drop=True)
    seg = np.cumsum(changes(block, ["source", "chunk"])) - 1
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    place = np.arange(len(block)) - first[seg]
    shape = (int(place.max()) + 1, len(first))
    own, order = block.own.to_numpy(bool), block.ord.to_numpy()
    source, chunk = block.source.to_numpy()[first], block.chunk.to_numpy()[first]
    parts: list[pd.DataFrame] = []

    def single(kind: str, k: int, at: np.ndarray, value: np.ndarray) -> None:
        if len(at):
            parts.append(_rows(kind, len(at), source=source[seg[at]], signal=k, chunk=chunk[seg[at]], value=value[at], n=1, idx=order[at][:, None].tolist()))

    for k in range(values):
        raw = block[f"v{k}"].to_numpy(float)
        low, high = block[f"low{k}"].to_numpy(float), block[f"high{k}"].to_numpy(float)
        with np.errstate(invalid="ignore"):
            bad = ~np.isnan(raw) & ((raw < low) | (raw > high) | np.isinf(raw))
            if ratio:
                bad |= raw <= 0
        single("impossible", k, np.flatnonzero(bad & own), raw)
        mid, sigma = block[f"mid{k}"].to_numpy(float)[first], block[f"sig{k}"].to_numpy(float)[first]
        good = ~np.isnan(raw) & ~bad
        use = good
        if not ratio:  # a level that is stuck is none to follow
            rows = np.flatnonzero(~np.isnan(raw))
            new = np.r_[True, (raw[rows][1:] != raw[rows][:-1]) | (seg[rows][1:] != seg[rows][:-1])][: len(rows)]
            run = np.cumsum(new) - 1
            use = good.copy()
            use[rows] &= np.bincount(run)[run] < stuck if len(rows) else True
        z = np.full(shape, np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            z[place[use], seg[use]] = np.log(raw[use]) if ratio else raw[use]
        there = ~np.isnan(z)
        if ratio:
            # the level where the chunk starts: the median of its first readings
            head = np.where(there & (np.cumsum(there, axis=0) <= 15), z, np.nan)
            with np.errstate(all="ignore"):
                some = there.any(axis=0)
                level = np.where(some, np.nanmedian(np.where(some, head, 0), axis=0), 0.0)
            sigma = _step_sigma(z)
        else:
            level = np.where(np.isnan(mid), 0.0, mid)
            sigma = np.maximum(np.where(np.isnan(sigma), 0.0, sigma), 1e-12 + 1e-9 * np.abs(level))
        # next to a spike, lively sound readings may be flagged too, and the later readings of a spike may be taken for
        # livelier movement: all of these are candidates, and the exact check below tells them apart
        longest = max_run if ratio else 2 * max_run
        flags = kalman_flags(z, level, sigma, 0.35 if ratio else 0.05, threshold, longest, not ratio)
        flags = _short_runs(flags, there, longest)
        if not ratio:
            flags = _beside(flags, there, max_run - 1)
        flat = np.zeros(len(block), bool)
        flat[good] = flags[place[good], seg[good]]
        far = np.abs(raw - mid[seg])
        # what the filter has got used to may still be a spike: half of the width of nine readings in ten is surely sound
        wide = np.full(len(first), np.inf) if ratio else block[f"wide{k}"].to_numpy(float)[first]
        with np.errstate(invalid="ignore"):
            likely = flat | good & (far > 0) & (far >= wide[seg] * (1 - 1e-9))
        level_long = np.full(len(block), -np.inf)
        level_long[good] = _long_level(far[good], seg[good], max_run + 1)
        # runs of the same value, over the readings that are there
        rows = np.flatnonzero(own & ~np.isnan(raw))
        if not len(rows):
            continue
        new = np.r_[True, (raw[rows][1:] != raw[rows][:-1]) | (seg[rows][1:] != seg[rows][:-1])]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(rows)]
        owner = seg[rows][start]
        head, tail = np.r_[True, owner[1:] != owner[:-1]], np.r_[owner[1:] != owner[:-1], True]
        long, edge = end - start >= stuck, head | tail
        of = np.repeat(np.arange(len(start)), end - start)  # the run of each row
        fixed = np.zeros(len(block), bool)
        fixed[rows[long[of]]] = True
        loose = np.zeros(len(block), bool)  # in a run that the chunk cannot judge
        loose[rows[edge[of]]] = True
        s = np.flatnonzero(long)
        if len(s):
            parts.append(_rows("stuck", len(s), source=source[owner[s]], signal=k, chunk=chunk[owner[s]], value=raw[rows[start[s]]], n=end[s] - start[s], idx=[order[rows[start[i] : end[i]]].tolist() for i in s]))
        s = np.flatnonzero(edge)
        at = rows[start[s]]
        counted = (not ratio) & good[at] & (far[at] > 0) & ~long[s]  # it has a distance, for the case that it is not stuck as a whole
        parts.append(_rows(
            "edge", len(s), source=source[owner[s]], signal=k, chunk=chunk[owner[s]], pos=np.where(head[s] & tail[s], 2, np.where(head[s], 0, 1)), value=raw[at], n=end[s] - start[s],
            idx=[[] if long[i] else order[rows[start[i] : end[i]]].tolist() for i in s], bin=pd.array(np.frexp(far[at])[1], "Int32").astype("Int32"), low=np.where(counted, far[at], np.nan), high=level_long[at],
            flagged=np.add.reduceat(flat[rows].astype(int), start)[s], long=np.add.reduceat(likely[rows].astype(int), start)[s],
        ))
        if ratio:
            flagged = flat & own
            for c in np.unique(seg[flagged]):
                rows = np.arange(first[c], first[c] + int((seg == c).sum()))
                at = np.flatnonzero(flagged[rows])
                base = _around(raw[rows], good[rows] & ~flat[rows], at, 4)
                with np.errstate(invalid="ignore"):
                    at = at[np.abs(raw[rows[at]] / base - 1) > off]
                single("spike", k, rows[at], raw)
            continue
        single("candidate", k, np.flatnonzero(likely & own & good & ~fixed & ~loose), far)
        use = good & own & ~fixed & ~loose & (far > 0)
        exponent = np.frexp(far[use])[1]
        bins = pd.DataFrame({"seg": seg[use], "bin": exponent, "far": far[use], "flag": flat[use].astype(int)}).groupby(["seg", "bin"]).agg(n=("far", "size"), low=("far", "min"), high=("far", "max"), flagged=("flag", "sum")).reset_index()
        if len(bins):
            parts.append(_rows("bin", len(bins), source=source[bins.seg], signal=k, bin=bins.bin, n=bins.n, low=bins.low, high=bins.high, flagged=bins.flagged))
        some = use & (level_long > 0)
        if some.any():
            bins = pd.DataFrame({"seg": seg[some], "bin": np.frexp(level_long[some])[1]}).groupby(["seg", "bin"]).size().reset_index(name="long")
            parts.append(_rows("bin", len(bins), source=source[bins.seg], signal=k, bin=bins.bin, long=bins.long))
    return pd.concat(parts, ignore_index=True) if parts else _rows("bin", 0, source=source[:0], signal=0)


def _step_sigma(z: np.ndarray) -> np.ndarray:
    """Standard deviation of each column's sound steps, from their median size: beats differ, and so do hearts. Bounded, so
    that neither a stretch of equal intervals nor one full of wrong ones is taken for what is normal."""
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        size = np.nanmedian(np.abs(np.diff(z, axis=0)), axis=0) if len(z) > 1 else np.full(z.shape[1], np.nan)
    return np.clip(np.where(np.isnan(size), 0.06, 1.4826 * size / math.sqrt(2)), 0.05, 0.1)


def _joined(g: pd.DataFrame, keys: list[str], stuck: int, last: bool) -> list[pd.DataFrame]:
    """Edge runs in order, equal values that follow each other with nothing between as one: those that are stuck, those that
    are not, as bins and candidates, and, but for the last time, those at the ends of a segment as edges again."""
    value, pos, n = g.value.to_numpy(), g.pos.to_numpy(), g.n.to_numpy()
    begins = changes(g, keys)
    new = begins.copy()
    # the head of a chunk that goes on with other values is over when its tail comes
    new[1:] |= (value[1:] != value[:-1]) | ((pos[:-1] == 0) & (pos[1:] == 1))
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(g)]
    total = np.bincount(run, n).astype(np.int64)
    opens = begins[start] & np.isin(pos[start], (0, 2))
    closes = np.r_[begins[1:], True][end - 1] & np.isin(pos[end - 1], (1, 2))
    lists = g.idx.tolist()
    idx = [[i for x in lists[a:b] for i in x] for a, b in zip(start, end)]
    low, high, flagged, likely = g.low.to_numpy()[start], np.maximum.reduceat(g.high.to_numpy(), start), np.add.reduceat(g.flagged.to_numpy(), start), np.add.reduceat(g.long.to_numpy(), start)
    low = np.where(np.logical_or.reduceat(np.isnan(g.low.to_numpy()), start), np.nan, low)
    facts = {"source": g.source.to_numpy()[start], "signal": g.signal.to_numpy()[start], "chunk": g.chunk.to_numpy()[start]}
    pick = lambda m: {c: v[m] for c, v in facts.items()}
    own = lambda m: pd.Series([idx[i] for i in np.flatnonzero(m)], dtype=object)
    out = []
    still = (opens | closes) & (not last)
    if still.any():
        out.append(_rows("edge", int(still.sum()), **pick(still), pos=np.where(opens & closes, 2, np.where(opens, 0, 1))[still], value=value[start][still], n=total[still], idx=own(still), bin=g.bin.array[start][still], low=low[still], high=high[still], flagged=flagged[still], long=likely[still]))
    fixed = ~still & (total >= stuck)
    if fixed.any():
        out.append(_rows("stuck", int(fixed.sum()), **pick(fixed), n=total[fixed], idx=own(fixed)))
    loose = ~still & (total < stuck) & ~np.isnan(low)
    if loose.any():
        out.append(_rows("bin", int(loose.sum()), **pick(loose), bin=g.bin.array[start][loose], n=total[loose], low=low[loose], high=low[loose], flagged=flagged[loose]))
        long = loose & (high > 0)
        out.append(_rows("bin", int(long.sum()), **pick(long), bin=pd.array(np.frexp(high[long])[1], "Int32"), long=total[long]))
        hit = loose & (likely > 0)
        out.append(_rows("candidate", int(hit.sum()), **pick(hit), value=low[hit], n=total[hit], idx=own(hit)))
    return out


def _gaps(b: pd.DataFrame) -> list[pd.DataFrame]:
    """Of the bins of whole (source, signal) segments the lowest gap of a factor of two above which lie spikes: readings that
    the filter flagged (seven of ten), and that come in short runs (eight of ten). Inside a power of two there is none."""
    b = b.groupby(["source", "signal", "bin"], sort=True, dropna=False).agg(n=("n", "sum"), low=("low", "min"), high=("high", "max"), flagged=("flagged", "sum"), long=("long", "sum")).reset_index()
    if not len(b):
        return []
    by = b.groupby(["source", "signal"], sort=False)
    above = by[["n", "flagged", "long"]].transform(lambda x: x[::-1].cumsum()[::-1])
    below = by["high"].transform(lambda x: x.cummax().shift())
    ok = (b.n > 0) & (b.low >= 2 * below) & (above.flagged >= 0.7 * above.n) & (above.long <= 0.2 * above.n)
    g = b[ok].groupby(["source", "signal"], sort=False).low.min().reset_index()
    return [_rows("gap", len(g), source=g.source, signal=g.signal, low=g.low)] if len(g) else []


def _settled(block: pd.DataFrame, stuck: int, ratio: bool) -> pd.DataFrame:
    """What is decided over whole (source, signal) segments, from edges of groups and bins."""
    edges = block[block.kind == "edge"].reset_index(drop=True)
    parts = _joined(edges, ["source", "signal"], stuck, True) if len(edges) else []
    if not ratio:
        parts += _gaps(pd.concat([block[block.kind == "bin"], *[p[p.kind == "bin"] for p in parts]], ignore_index=True))
    parts = [p[p.kind != "bin"] for p in parts] + [block[block.kind.isin(["stuck", "candidate"])]]
    return pd.concat(parts, ignore_index=True)[COLUMNS]


def implausible_readings(df: DataFrame, values: list[str], source: str = "rec_id", order: str = "idx", *, limits: dict[str, tuple[Column | float | None, Column | float | None]] | None = None, ratio: bool = False, stuck: int = 15, max_run: int = 3, threshold: float = 2.0, off: float = 0.4, chunk: int = 512, margin: int = 32) -> DataFrame:
    """(source, signal, order, kind): the readings that are stuck, spikes or impossible; a reading may have several kinds.

    limits: the smallest and largest value a reading can have (columns or numbers; None or NULL: no limit).
    ratio=False: a spike lies at least twice as far from the source's median as any sound reading of the source.
    ratio=True: values are positive intervals; a spike is more than `off` away from the sound ones around it.

    Rows without a source or an order take no part; repeated (source, order) count once; NULL and NaN are missing and
    passed over; infinite values are impossible. `order` is an integer. Empty in, empty out; other columns are ignored.
    """
    limits = limits or {}
    types = dict(df.dtypes)
    column = lambda c: c if isinstance(c, Column) else F.lit(c)
    x = df.where(F.col(source).isNotNull() & F.col(order).isNotNull()).select(
        F.col(source).alias("source"), F.col(order).cast("bigint").alias("ord"), *[F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)],
        *[column(limits.get(v, (None, None))[s]).cast("double").alias(f"{n}{k}") for k, v in enumerate(values) for s, n in ((0, "low"), (1, "high"))],
    )
    if ratio:
        x = x.withColumns({f"{n}{k}": F.lit(None).cast("double") for k in range(len(values)) for n in ("mid", "sig")})
    else:
        # what is normal in the source: mergeable quantile sketches of bounded size
        inside = {k: F.when(~F.isnan(f"v{k}") & (F.col(f"v{k}") >= F.coalesce(F.col(f"low{k}"), F.lit(-math.inf))) & (F.col(f"v{k}") <= F.coalesce(F.col(f"high{k}"), F.lit(math.inf))), F.col(f"v{k}")) for k in range(len(values))}
        q = x.groupBy("source").agg(*[F.percentile_approx(inside[k], F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]), RANKS).alias(f"q{k}") for k in range(len(values))])
        sig = lambda k: F.greatest((F.col(f"q{k}")[3] - F.col(f"q{k}")[1]) / 1.349, (F.col(f"q{k}")[4] - F.col(f"q{k}")[0]) / 3.29)
        q = q.select("source", *[F.col(f"q{k}")[2].alias(f"mid{k}") for k in range(len(values))], *[sig(k).alias(f"sig{k}") for k in range(len(values))], *[(F.col(f"q{k}")[4] - F.col(f"q{k}")[0]).alias(f"wide{k}") for k in range(len(values))])
        x = x.join(q, "source")
    at = F.floor(F.col("ord") / chunk).cast("bigint")
    reach = F.sequence(F.floor((F.col("ord") - margin) / chunk).cast("bigint"), F.floor((F.col("ord") + margin) / chunk).cast("bigint"))
    x = x.withColumn("home", at).withColumn("chunk", F.explode(reach)).withColumn("own", F.col("home") == F.col("chunk")).drop("home")
    schema = SCHEMA.format(source=types[source])
    found = materialise(map_segments(x, ["source", "chunk"], ["ord"], lambda b: _scan(b, len(values), ratio, threshold, max_run, stuck, off), schema))
    flat = lambda d, *kinds: d.where(F.col("kind").isin(*kinds)).select("source", "signal", F.explode("idx").alias("ord"), "kind")
    # edges join inside groups of chunks, then over groups; bins add up on the map side
    keys = ["source", "signal", "group"]

    def joined(block: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_rows("bin", 0, source=block.source[:0], signal=0), *_joined(block, keys, stuck, False)], ignore_index=True)[COLUMNS]

    edges = found.where(F.col("kind") == "edge").withColumn("group", F.floor(F.col("chunk") / GROUP).cast("bigint"))
    rest = map_segments(edges, keys, ["chunk", "pos"], joined, schema)
    if not ratio:
        bins = found.where(F.col("kind") == "bin").groupBy("source", "signal", "kind", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "flagged", "long")], F.min("low").alias("low"), F.max("high").alias("high"))
        rest = rest.unionByName(bins, allowMissingColumns=True)
    settled = map_segments(rest, ["source", "signal"], ["chunk", "pos"], lambda b: _settled(b, stuck, ratio), schema)
    if not ratio:
        settled = materialise(settled)  # read for what is stuck, for gaps and for candidates
    out = flat(found, "impossible", "stuck", "spike").unionByName(flat(settled, "stuck"))
    if not ratio:
        gap = settled.where(F.col("kind") == "gap").select("source", "signal", F.col("low").alias("least"))
        c = found.where(F.col("kind") == "candidate").unionByName(settled.where(F.col("kind") == "candidate")).join(gap, ["source", "signal"]).where(F.col("value") >= F.col("least"))
        out = out.unionByName(flat(c.withColumn("kind", F.lit("spike")), "spike"))
    name = F.element_at(F.array(*[F.lit(v) for v in values]), F.col("signal") + 1)
    return out.select(F.col("source").alias(source), name.alias("signal"), F.col("ord").alias(order), "kind")

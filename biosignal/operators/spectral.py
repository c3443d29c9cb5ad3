"""Fourier transforms of series, uniform and not."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosignal.operators.blocks import changes, map_segments


def nufftfreqs(df: DataFrame, m: int, spacing: float = 1.0) -> DataFrame:
    """(entity, k, freq): spacing times -(m // 2) ... m - m // 2 - 1 for each entity."""
    k = F.explode(F.sequence(F.lit(-(m // 2)).cast("bigint"), F.lit(m - m // 2 - 1).cast("bigint")))
    return df.select("entity").distinct().select("entity", k.alias("k")).withColumn("freq", F.col("k") * F.lit(float(spacing)))


def nudft(df: DataFrame, m: int, df_: float = 1.0, eps: float = 1e-15, iflag: int = 1, x: str = "t", c: str = "c") -> DataFrame:
    """(entity, k, re, im): mean of c exp(+-i k df x) over irregular samples, exact; eps is only checked."""
    if not 1e-33 < eps < 1e-1:
        raise ValueError("eps must be between 1e-33 and 1e-1")
    k = F.explode(F.sequence(F.lit(-(m // 2)).cast("bigint"), F.lit(m - m // 2 - 1).cast("bigint")))
    angle = F.col("k") * F.lit(float(df_)) * F.col(x)
    rows = df.select("entity", x, c).select("entity", x, c, k.alias("k"))
    return rows.groupBy("entity", "k").agg(F.avg(F.col(c) * F.cos(angle)).alias("re"), F.avg((1 if iflag >= 0 else -1) * F.col(c) * F.sin(angle)).alias("im"))


def _transform(df: DataFrame, re: str, im: str | None, inverse: bool) -> DataFrame:
    def kernel(block: pd.DataFrame) -> pd.DataFrame:
        start = np.flatnonzero(changes(block, ["entity"]))
        parts, sizes = [], np.diff(np.r_[start, len(block)])
        z = block.re.to_numpy(float) + 1j * block.im.to_numpy(float)
        for a, n in zip(start, sizes):
            parts.append((np.fft.ifft if inverse else np.fft.fft)(z[a : a + n]))
        out = np.concatenate(parts)
        return pd.DataFrame({"entity": block.entity, "k": np.concatenate([np.arange(n) for n in sizes]), "re": out.real, "im": out.imag})

    kind = dict(df.dtypes)["entity"]
    rows = df.select("entity", "idx", F.col(re).cast("double").alias("re"), (F.col(im) if im else F.lit(0.0)).cast("double").alias("im"))
    return map_segments(rows, ["entity"], ["idx"], kernel, f"entity {kind}, k bigint, re double, im double")


def _segments(block: pd.DataFrame, key: str) -> list[slice]:
    start = np.flatnonzero(changes(block, ["entity", key]))
    return [slice(a, b) for a, b in zip(start, np.r_[start[1:], len(block)])]


def _turn(i: np.ndarray, n: int) -> np.ndarray:
    """exp(-2 pi i / n), of whole numbers however large."""
    return np.exp(-2j * np.pi * (i % n) / n)


def _long_transform(rows: DataFrame, inverse: bool) -> DataFrame:
    """Transforms of series (entity, idx, n, re, im) of any length n, of which no task sees more than about its root.

    By the chirp c_j = exp(-pi i j^2 / n) a transform is a convolution, of the length of the next power of two, and each of its
    transforms is one of R rows of Q after one of Q rows of R: x_(r + R q) meet by r, what comes of them by t = k mod Q, and the
    way back is the same. The chirp's own side is made where it is needed.
    """
    kind = dict(rows.dtypes)["entity"]
    sign = -1.0 if inverse else 1.0  # the inverse transform is the conjugate of the transform of the conjugate

    def sizes(n: int) -> tuple[int, int]:
        m = (2 * n - 2).bit_length()
        return 1 << (m // 2), 1 << (m - m // 2)

    def chirp(j: np.ndarray, n: int) -> np.ndarray:
        return _turn(j * j, 2 * n)

    def first(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in _segments(block, "r"):
            n, r, j = int(block.n.iloc[s.start]), int(block.r.iloc[s.start]), block.idx.to_numpy()[s]
            height, width = sizes(n)
            a, q = np.zeros(width, complex), np.arange(width)
            a[j // height] = (block.re.to_numpy()[s] + sign * 1j * block.im.to_numpy()[s]) * chirp(j, n)
            back = np.minimum(r + height * q, height * width - r - height * q)
            b = np.where(back < n, np.conj(chirp(np.minimum(back, n), n)), 0)
            turn = _turn(r * q, height * width)
            a, b = np.fft.fft(a) * turn, np.fft.fft(b) * turn
            out.append(pd.DataFrame({"entity": block.entity.iloc[s.start], "n": n, "r": r, "t": q, "ar": a.real, "ai": a.imag, "br": b.real, "bi": b.imag}))
        return pd.concat(out, ignore_index=True)

    def second(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in _segments(block, "t"):
            n, t = int(block.n.iloc[s.start]), int(block.t.iloc[s.start])
            height, width = sizes(n)
            a, b = (block[f"{c}r"].to_numpy()[s] + 1j * block[f"{c}i"].to_numpy()[s] for c in "ab")
            u = np.arange(height)
            y = np.fft.ifft(np.fft.fft(a) * np.fft.fft(b)) * np.conj(_turn(t * u, height * width))
            out.append(pd.DataFrame({"entity": block.entity.iloc[s.start], "n": n, "u": u, "t": t, "re": y.real, "im": y.imag}))
        return pd.concat(out, ignore_index=True)

    def third(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in _segments(block, "u"):
            n, u = int(block.n.iloc[s.start]), int(block.u.iloc[s.start])
            height, width = sizes(n)
            k = u + height * np.arange(width)
            keep = k < n
            z = np.fft.ifft(block.re.to_numpy()[s] + 1j * block.im.to_numpy()[s])[keep] * chirp(k[keep], n)
            z = np.conj(z) / n if inverse else z
            out.append(pd.DataFrame({"entity": block.entity.iloc[s.start], "k": k[keep], "re": z.real, "im": z.imag}))
        return pd.concat(out, ignore_index=True)

    # sizes(n)[0]
    x = rows.withColumn("r", F.pmod("idx", F.expr("shiftleft(CAST(1 AS BIGINT), CAST(floor(length(bin(2 * n - 2)) / 2) AS INT))")))
    y = map_segments(x, ["entity", "r"], ["idx"], first, f"entity {kind}, n bigint, r bigint, t bigint, ar double, ai double, br double, bi double")
    y = map_segments(y, ["entity", "t"], ["r"], second, f"entity {kind}, n bigint, u bigint, t bigint, re double, im double")
    return map_segments(y, ["entity", "u"], ["t"], third, f"entity {kind}, k bigint, re double, im double")


def _any_length(df: DataFrame, re: str, im: str | None, inverse: bool, longest: int | None) -> DataFrame:
    if longest is None:
        return _transform(df, re, im, inverse)
    rows = df.select("entity", "idx", F.col(re).cast("double").alias("re"), (F.col(im) if im else F.lit(0.0)).cast("double").alias("im"))
    rows = rows.join(df.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity")
    longest = max(longest, 2)
    return _transform(rows.where(F.col("n") <= longest), "re", "im", inverse).unionByName(_long_transform(rows.where(F.col("n") > longest), inverse))


def fft(df: DataFrame, re: str = "x", im: str | None = None, longest: int | None = None) -> DataFrame:
    """(entity, k, re, im): discrete Fourier transform of each series. A series is one task; with `longest`, those of more rows
    than that are spread over tasks of about the root of their length."""
    return _any_length(df, re, im, False, longest)


def ifft(df: DataFrame, re: str = "re", im: str | None = "im", longest: int | None = None) -> DataFrame:
    """(entity, k, re, im): inverse transform, scaled by 1 / n, of (entity, idx, re, im); longest as in fft."""
    return _any_length(df, re, im, True, longest)

"""Entropies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biosignal.operators.frames import framed, near, owned
from biosignal.session import materialise


def entropy(df: DataFrame, counts: str = "n", by: str = "entity") -> DataFrame:
    """(by, entropy): -sum p ln p of each group's counts, p = count / sum + 1e-30."""
    s = df.groupBy(by).agg(F.sum(counts).alias("__s"))
    p = df.join(s, by).select(by, (F.try_divide(F.col(counts), F.col("__s")) + 1e-30).alias("p"))
    return p.groupBy(by).agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))


def label_entropy(df: DataFrame, label: str = "label", by: str = "entity", include_noise: bool = True) -> DataFrame:
    """(by, entropy, clusters) of the labels of each group; the noise label -1 counts as a cluster unless left out."""
    c = df if include_noise else df.where(F.col(label) != -1)
    c = c.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return entropy(c, by=by).join(c.groupBy(by).agg(F.count(F.lit(1)).alias("clusters")), by)


def sampen(df: DataFrame, mm: int = 2, r: float = 0.2, sd: float | None = None) -> DataFrame:
    """(entity, pairs, matches, sampen): -ln(matches / pairs) over templates i < j of mm and mm + 1 values within r sd.

    sd: the deviation to scale with, by default each entity's own. Templates meet only where their first values lie in
    neighbouring cells as wide as the tolerance (a band join in up to two values), so that a series is not joined with
    itself as a whole. No match of either length gives NULL.
    """
    tol = df.groupBy("entity").agg((F.lit(r) * (F.lit(sd) if sd is not None else F.stddev_pop("x"))).alias("tol"))
    t = owned(framed(df, 0, mm).withColumns({f"x{k}": F.lead("x", k).over(near()) for k in range(1, mm + 1)}))
    t = t.withColumnRenamed("x", "x0").where(F.col(f"x{mm}").isNotNull()).join(tol, "entity").where(F.col("tol") > 0)
    t = materialise(t.select("entity", "tol", "idx", *[f"x{k}" for k in range(mm + 1)]))  # both sides of the join
    dims = range(min(mm, 2))
    cell = lambda k: F.floor(F.col(f"x{k}") / F.col("tol")).cast("bigint")
    a = t.select("entity", "tol", F.col("idx").alias("i"), *[F.col(f"x{k}").alias(f"a{k}") for k in range(mm + 1)], *[cell(k).alias(f"c{k}") for k in dims])
    b = t.select("entity", F.col("idx").alias("j"), *[F.col(f"x{k}").alias(f"b{k}") for k in range(mm + 1)], *[F.explode(F.sequence(cell(0) - 1, cell(0) + 1)).alias("c0")], *[cell(k).alias(f"c{k}") for k in dims if k])
    if len(dims) > 1:
        b = b.withColumn("c1", F.explode(F.sequence(F.col("c1") - 1, F.col("c1") + 1)))
    close = lambda k: F.abs(F.col(f"a{k}") - F.col(f"b{k}")) < F.col("tol")
    p = a.join(b, ["entity", *[f"c{k}" for k in dims]]).where(F.col("i") < F.col("j"))
    for k in range(mm):
        p = p.where(close(k))
    n = p.groupBy("entity").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(close(mm)).alias("matches"))
    out = tol.select("entity").join(n, "entity", "left")
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select("entity", n0("pairs").alias("pairs"), n0("matches").alias("matches"), (-F.ln(F.try_divide(F.nullif(n0("matches"), F.lit(0)), n0("pairs")))).alias("sampen"))


def length_histogram_entropy(lengths: DataFrame, length: Column | str = "length") -> DataFrame:
    """(entity, entropy) of how often each length occurs."""
    c = lengths.groupBy("entity", F.col(length) if isinstance(length, str) else length).agg(F.count(F.lit(1)).alias("n"))
    return entropy(c)

"""Recurrence quantification on a sparse relation (entity, i, j) of recurrent pairs; never a dense matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biosignal.operators.information import length_histogram_entropy


def recurrent_pairs(df: DataFrame, radius: float = 0.0) -> DataFrame:
    """(entity, i, j) with |x_i - x_j| <= radius, i and j in any order: a band join over cells as wide as the radius."""
    a, b = df.select("entity", F.col("idx").alias("i"), F.col("x").alias("a")), df.select("entity", F.col("idx").alias("j"), F.col("x").alias("b"))
    if radius <= 0:
        return a.withColumn("v", F.col("a")).join(b.withColumn("v", F.col("b")), ["entity", "v"]).select("entity", "i", "j")
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    a = a.withColumn("c", cell("a"))
    b = b.withColumn("c", F.explode(F.sequence(cell("b") - 1, cell("b") + 1)))
    return a.join(b, ["entity", "c"]).where(F.abs(F.col("a") - F.col("b")) <= radius).select("entity", "i", "j")


def recurrent_vector_pairs(df: DataFrame, radius: float = 0.0, vector: str = "v") -> DataFrame:
    """(entity, i, j) with a Euclidean distance of at most the radius of rows (entity, idx, v ARRAY<DOUBLE>).

    By the triangle inequality the norms of two such vectors differ by at most the radius: norms are the band of the join.
    """
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x * x))
    n = df.select("entity", "idx", F.col(vector).alias("v"), norm.alias("norm"))
    width = radius if radius > 0 else 1e-9
    cell = F.floor(F.col("norm") / width).cast("bigint")
    a = n.select("entity", F.col("idx").alias("i"), F.col("v").alias("a"), cell.alias("c"))
    b = n.select("entity", F.col("idx").alias("j"), F.col("v").alias("b"), F.explode(F.sequence(cell - 1, cell + 1)).alias("c"))
    d = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))
    return a.join(b, ["entity", "c"]).where(d <= radius).select("entity", "i", "j")


def _runs(pairs: DataFrame, line, place: str) -> DataFrame:
    """(entity, line, length): runs of consecutive places along each line."""
    p = pairs.select("entity", line.alias("line"), F.col(place).alias("p"))
    w = Window.partitionBy("entity", "line").orderBy("p")
    p = p.withColumn("island", F.col("p") - F.row_number().over(w))
    return p.groupBy("entity", "line", "island").agg(F.count(F.lit(1)).alias("length")).drop("island")


def diagonal_lengths(pairs: DataFrame, minlen: int = 2) -> DataFrame:
    """(entity, line, length): runs along the diagonals, of both triangles and the main one, of at least minlen."""
    return _runs(pairs, F.col("i") - F.col("j"), "i").where(F.col("length") >= minlen)


def vertical_lengths(pairs: DataFrame, minlen: int = 2) -> DataFrame:
    """(entity, line, length): runs along i in each column j, of at least minlen."""
    return _runs(pairs, F.col("j"), "i").where(F.col("length") >= minlen)


def rates(df: DataFrame, pairs: DataFrame, normalize: str = "all") -> DataFrame:
    """(entity, recurrence_rate, determinism, laminarity): shares of N^2 cells, or of the recurrent ones."""
    n = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    lines = F.sum(F.when(F.col("length") >= 2, F.col("length")))
    # every recurrent pair lies in one run of each direction
    det = _runs(pairs, F.col("i") - F.col("j"), "i").groupBy("entity").agg(F.sum("length").alias("recurrent"), lines.alias("diagonal"))
    lam = _runs(pairs, F.col("i"), "j").groupBy("entity").agg(lines.alias("vertical"))
    j = n.join(det, "entity", "left").join(lam, "entity", "left").fillna(0, ["recurrent", "diagonal", "vertical"])
    cells = F.col("n") * F.col("n")
    of = F.col("recurrent") if normalize == "recurrent" else cells
    return j.select("entity", (F.col("recurrent") / cells).alias("recurrence_rate"), F.try_divide("diagonal", of).alias("determinism"), F.try_divide("vertical", of).alias("laminarity"))


def length_entropy(df: DataFrame, pairs: DataFrame, minlen: int = 2) -> DataFrame:
    """(entity, entropy) of the histogram of diagonal lengths from minlen to N - 1."""
    n = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    lengths = diagonal_lengths(pairs, minlen).join(n, "entity").where(F.col("length") < F.col("n"))
    return length_histogram_entropy(lengths)

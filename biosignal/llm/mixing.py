"""Mixing sources to target shares of the total size, by thresholds on a hash.

Each document has a hash. One pass sums tokens by (source, hash bucket), with map-side combining; from this histogram follow
what each source has, which shares can be had and at what total, and the bucket in which each source's budget ends. Only
the documents of that bucket are counted again, finer, until single ones are told apart. A source's budget is filled by
whole passes over its documents and by the documents below its threshold, so that a larger budget takes a superset of a
smaller one's documents. Then all documents are filtered by their source's threshold: nothing is sorted, and a source with a
third of all documents is no task of its own.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biosignal.session import materialise

#: Where the public vocabulary lies (ranks, one a line).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Hashes have 60 bits; a histogram tells buckets of so many of them apart.
BITS, FINE = 15, 30


def source_key(source: Column) -> Column:
    """A source's name with case and surrounding white space made equal."""
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, into: str = "tokens") -> DataFrame:
    """The documents' columns but the text, with the number of its tokens; NULL and empty texts have none. The file of the
    vocabulary is read where the job is started and sent to the workers."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    keep = [f for f in docs.schema.fields if f.name != text]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for f in frames:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in f[text]]
            yield f.drop(columns=text).assign(**{into: n})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return docs.select(*[F.col(f"`{f.name}`") for f in keep], text).mapInPandas(run, f"{schema}, {into} bigint")


def histogram(sized: DataFrame) -> DataFrame:
    """(key, bucket, tokens) of (key, tokens, hash): sums by source and the first bits of the hash."""
    return sized.groupBy("key", F.shiftright("hash", FINE + BITS).alias("bucket")).agg(F.sum("tokens").alias("tokens"))


def plan_shares(buckets: DataFrame, targets: DataFrame, total: int | None = None, fit: str = "shares") -> DataFrame:
    """(key, source, share, repeats, own, total, budget, passes, rest, reached): what each source of the targets has to give.

    buckets: (key, tokens), histograms or single documents. total: tokens that the mixture should have; by default those of
    all documents of listed sources. reached: whether the source can make up its share of that. fit="shares" lowers the total
    to the largest at which every source that has tokens makes up its share; fit="total" keeps it, and sources that cannot
    reach their share give all they can.
    """
    if fit not in ("shares", "total"):
        raise ValueError("fit must be 'shares' or 'total'")
    own = buckets.groupBy("key").agg(F.sum("tokens").alias("own"))
    t = targets.join(own, "key", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("bigint")))
    all_ = Window.partitionBy(F.lit(0))  # one row for each source of the targets
    t = t.withColumn("total", F.sum("own").over(all_) if total is None else F.lit(total).cast("bigint"))
    most = F.col("repeats") * F.col("own")
    t = t.withColumn("reached", F.col("share") * F.col("total") <= most)
    if fit == "shares":
        limit = F.min(F.when((most > 0) & (F.col("share") > 0), most / F.col("share"))).over(all_)
        t = t.withColumn("total", F.least("total", F.floor(limit + 1e-6)).cast("bigint"))
    t = t.withColumn("budget", F.least(F.floor(F.col("share") * F.col("total") + 1e-6), most).cast("bigint"))
    t = t.withColumn("passes", F.coalesce(F.least(F.floor(F.try_divide("budget", "own")), F.col("repeats")), F.lit(0)).cast("int"))
    return t.withColumn("rest", F.greatest(F.col("budget") - F.col("passes") * F.col("own"), F.lit(0)).cast("bigint"))


def _boundary(buckets: DataFrame) -> DataFrame:
    """(key, bucket, left) of (key, rest, bucket, tokens): the first bucket that does not fit whole, and what is left of the
    budget when it begins; no row for a source all of whose buckets fit."""
    upto = F.sum("tokens").over(Window.partitionBy("key").orderBy("bucket"))
    b = buckets.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    f = b.groupBy("key").agg(F.min(F.struct("bucket", "upto", "tokens", "rest")).alias("f"))
    return f.select("key", F.col("f.bucket").alias("bucket"), (F.col("f.rest") - (F.col("f.upto") - F.col("f.tokens"))).alias("left"))


def thresholds(sized: DataFrame, plan: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """(key, below): of each source the hash below which documents are taken once more.

    sized: (key, tokens, hash) with 60-bit hashes; plan: (key, rest). The boundary bucket of the histogram holds one document
    in 32,768; its documents alone are read again, and counted by the next bits, and those of the boundary bucket there, a
    handful, one by one.
    """
    budget = plan.select("key", "rest")
    first = materialise(_boundary((histogram(sized) if buckets is None else buckets).join(budget, "key")).withColumnRenamed("bucket", "top"))
    inside = sized.select("key", "tokens", "hash").join(first, "key").where(F.shiftright("hash", FINE + BITS) == F.col("top"))
    inside = materialise(inside.select("key", "top", F.col("left").alias("rest"), "tokens", "hash"))
    fine = F.shiftright("hash", FINE)
    second = _boundary(inside.groupBy("key", "rest", fine.alias("bucket")).agg(F.sum("tokens").alias("tokens")))
    last = inside.select("key", "tokens", "hash").join(second.withColumnRenamed("left", "rest"), "key").where(fine == F.col("bucket"))
    last = _boundary(last.groupBy("key", "rest", F.col("hash").alias("bucket")).agg(F.sum("tokens").alias("tokens")))
    return budget.join(last, "key", "left").select("key", F.coalesce("bucket", F.lit(1 << 60)).alias("below"))


def mixture(docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", *, share: str = "target_share", repeats: str = "max_repeats", vocabulary: str = VOCABULARY, total: int | None = None, fit: str = "shares", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(uses, report).

    uses: (id, source, tokens, uses) of every document of a listed source that is used at all.
    report: (source, target_share, actual_share, own_tokens, target_tokens, used_tokens, documents, reached) of each source
    as spelled in the targets; reached is false where even max_repeats uses of every document fall short of the share of
    `total`, by default the tokens of all documents of listed sources.

    The mixture has the largest size up to `total` at which every source that has tokens makes up its target share, to a
    document; with fit="total" it has that size, as far as sources reach their share, and the shares of the others are
    larger for what is missing. Documents without an id, of no or an unknown source take no part; NULL and empty texts have
    no tokens; rows with the same id are used alike. A source without documents reaches nothing. Of targets whose names
    differ in case or white space only, the first in order counts. Other columns of either input are ignored.
    """
    t, sized = _sized(docs, targets, id, text, source, share, repeats, vocabulary, seed)
    sized = materialise(sized)
    buckets = materialise(histogram(sized))
    plan = plan_shares(buckets, t, total, fit)
    p = plan.join(thresholds(sized, plan, buckets), "key")
    uses = sized.join(p, "key").withColumn("uses", F.col("passes") + (F.col("hash") < F.col("below")).cast("int"))
    uses = uses.withColumn("uses", F.least("uses", "repeats")).select("id", "source", "tokens", "uses")
    used = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.sum((F.col("uses") > 0).cast("bigint")).alias("documents"))
    report = plan.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0).cast("bigint")))
    actual = F.try_divide("used_tokens", F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))
    report = report.select(
        "source", F.col("share").alias("target_share"), F.coalesce(actual, F.lit(0.0)).alias("actual_share"), F.col("own").alias("own_tokens"),
        F.floor(F.col("share") * F.col("total") + 1e-6).cast("bigint").alias("target_tokens"), "used_tokens", F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"), "reached",
    )
    return uses.where(F.col("uses") > 0), report


def _sized(docs: DataFrame, targets: DataFrame, id: str, text: str, source: str, share: str, repeats: str, vocabulary: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """The targets by key, and (id, key, tokens, hash) of every document of a listed source."""
    t = targets.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), source_key(F.col(source)).alias("key"), F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.col(repeats).cast("int"), F.lit(1)), F.lit(0)).alias("repeats"))
    t = t.groupBy("key").agg(F.min_by(F.struct("source", "share", "repeats"), "source").alias("t")).select("key", "t.*")
    d = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), source_key(F.col(source)).alias("key"), F.col(text).alias("text"))
    d = d.join(t.select("key"), "key", "left_semi")
    return t, count_tokens(d, vocabulary=vocabulary).withColumn("hash", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 4))


def plan_of(docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", *, share: str = "target_share", repeats: str = "max_repeats", vocabulary: str = VOCABULARY, total: int | None = None, fit: str = "shares", seed: int = 7) -> DataFrame:
    """The plan of a mixture alone: (source, share, repeats, own, total, budget, reached), from the histogram of one pass."""
    t, sized = _sized(docs, targets, id, text, source, share, repeats, vocabulary, seed)
    return plan_shares(histogram(sized), t, total, fit).select("source", "share", "repeats", "own", "total", "budget", "reached")

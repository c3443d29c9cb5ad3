"""The pN_ queries of the problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biosignal.llm.clusters import describe_clusters, place_clusters
from biosignal.llm.leaks import find_leaks, remove_leaks
from biosignal.llm.mixing import mixture, plan_of
from biosignal.llm.stuffing import stuffed_pages
from biosignal.sources.tables import load


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of probe fixes that belong to the same cluster."""
    member = place_clusters(load(spark, folder, "android_phone_location")).select("id", "cluster_id")
    probes = load(spark, folder, "probe_fixes").select(F.col("ping_id").alias("id")).distinct()
    own = member.join(probes, "id")
    a, b = own.select(F.col("id").alias("ping_a"), "cluster_id"), own.select(F.col("id").alias("ping_b"), "cluster_id")
    return a.join(b, "cluster_id").where(F.col("ping_a") < F.col("ping_b")).select("ping_a", "ping_b")


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size and most typical fixes of every cluster of places."""
    return describe_clusters(place_clusters(load(spark, folder, "android_phone_location")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold the wording of an evaluation item, with the item."""
    return find_leaks(load(spark, folder, "documents"), load(spark, folder, "eval_items")).select(F.col("id").alias("doc_id"), "item_id").distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each leaked item stands in, and the longest match."""
    found = find_leaks(load(spark, folder, "documents"), load(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("id").alias("documents"), F.max("words").alias("longest"))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without what leaked, as they are written, with the number of words cut out; wholly leaked ones are gone."""
    docs = load(spark, folder, "documents").select("doc_id", "text")
    clean = remove_leaks(docs, load(spark, folder, "eval_items"))
    return clean.select("doc_id", "removed_words", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that cannot reach their target share of the tokens."""
    return plan_of(load(spark, folder, "documents"), load(spark, folder, "mix_targets")).where(~F.col("reached")).select("source")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source of the mixture."""
    return mixture(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))[1]


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used."""
    return mixture(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))[0].select(F.col("id").alias("doc_id"), "source", "uses")


def p8_measures(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document is stuffing, repeated phrases and clauses."""
    m = stuffed_pages(load(spark, folder, "documents"))
    return m.select(F.col("id").alias("doc_id"), "chars", *[F.round(c, 4).alias(c) for c in ("stuffing", "repeated", "clauses")])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are keywords, links or product tags for the most part."""
    return stuffed_pages(load(spark, folder, "documents")).where("is_stuffed").select(F.col("id").alias("doc_id"))


QUERIES = {"p4_found": p4_found, "p4_clusters": p4_clusters, "p6_found": p6_found, "p6_report": p6_report, "p6_clean": p6_clean, "p7_found": p7_found, "p7_shares": p7_shares, "p7_uses": p7_uses, "p8_found": p8_found, "p8_measures": p8_measures}

def _shifted(k: int, reach: int) -> str:
    """The mean of the fixes around a probe's place moved k - 1 times."""
    cell = " AND ".join(f"s.c{c} = CAST(floor(p.{c} / 250) AS BIGINT)" for c in "xyz")
    apart = " + ".join(f"(s.{c} - p.{c}) * (s.{c} - p.{c})" for c in "xyz")
    return f"p{k} AS (SELECT p.probe, p.px, p.py, p.pz, avg(s.x) AS x, avg(s.y) AS y, avg(s.z) AS z, count(DISTINCT s.ping_id) AS n FROM p{k - 1} p JOIN spread s ON {cell} WHERE {apart} <= {reach * reach} GROUP BY ALL)"


#: Another definition of the same clusters: each probe climbs to the middle of the fixes around it; it belongs to a cluster if
#: 30 fixes lie around that, itself among them.
_CLIMB = """
WITH fix AS (SELECT DISTINCT ping_id, 6371009 * cos(radians(latitude)) * cos(radians(longitude)) AS x, 6371009 * cos(radians(latitude)) * sin(radians(longitude)) AS y, 6371009 * sin(radians(latitude)) AS z
        FROM android_phone_location WHERE abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)),
step AS (SELECT unnest([-1, 0, 1]) AS d),
spread AS (SELECT f.*, CAST(floor(x / 250) AS BIGINT) + a.d AS cx, CAST(floor(y / 250) AS BIGINT) + b.d AS cy, CAST(floor(z / 250) AS BIGINT) + e.d AS cz FROM fix f, step a, step b, step e),
p0 AS (SELECT DISTINCT f.ping_id AS probe, f.x AS px, f.y AS py, f.z AS pz, f.x, f.y, f.z FROM fix f JOIN probe_fixes USING (ping_id)),
""" + ",\n".join(_shifted(k, 150) for k in range(1, 6)) + """,
own AS (SELECT * FROM p5 WHERE n >= 30 AND (px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z) <= 22500)
SELECT a.probe AS ping_a, b.probe AS ping_b FROM own a JOIN own b ON a.probe < b.probe
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 62500"""

SQL = {
    "p4_found": _CLIMB,
    # words and single signs stand for tokens: any tokenizer gives the same sources
    "p7_found": """
WITH d AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS key, len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS n FROM documents),
t AS (SELECT source, lower(source) AS key, target_share, max_repeats FROM mix_targets),
own AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(d.n), 0) AS own FROM t LEFT JOIN d USING (key) GROUP BY ALL)
SELECT source FROM own WHERE target_share * (SELECT sum(own) FROM own) > max_repeats * own""",
}

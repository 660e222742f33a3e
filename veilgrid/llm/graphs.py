"""Connected components of a table of links, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veilgrid.session import cut_lineage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id`` and ``component`` (its smallest member) of every id of ``links`` (two bigint columns).

    Large-star and small-star rounds in turn: each id hands its larger, then its smaller neighbours to the smallest
    one it knows. A round gives at most as many links as it got, so nothing grows, and the number of rounds goes
    with the logarithm of the longest path. Sums of 64-bit hashes tell when nothing changes any more. Each round is
    written to the shared folder, and its sums are taken by the same job.
    """
    edges, now = _written(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while now["n"] and now != before:
        before = now
        edges, now = _written(_small_star(_large_star(edges)))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """``edges`` cut from their lineage, their number and the sum of their hashes."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")
    return cut_lineage(edges.observe(seen, *sums), "links"), seen.get


def _large_star(edges: DataFrame) -> DataFrame:
    """Links from each id's larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u")
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links from each id and its smaller neighbours to the smallest of these. Links go from larger to smaller ids."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

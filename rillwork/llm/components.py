"""Connected components of a table of links, by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.shared import HOT_ROWS, forget, with_answers, written


def _stars(links: DataFrame, both_ways: bool, n: int, hubs: bool) -> DataFrame:
    """One round: every neighbour of a node is tied to the least of them.

    Large-star looks both ways and ties the larger neighbours; small-star looks from a node to smaller ones.
    The least neighbour is a minimum with map-side combine. It comes back to the links of a hub by broadcast, of which
    there are few, and to the others by a shuffle, so a hub's links lie in many tasks.
    """
    seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else links
    least = seen.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n__"))
    tied = with_answers(seen, least, ["u"], total=2 * n) if hubs else seen.join(least.drop("n__"), "u")
    if both_ways:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _shape(links: DataFrame) -> tuple[int, bool, int]:
    """Links, whether they are stars (no node has two centres or is a centre and a leaf), and the most that a node has."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    nodes = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.sum("centre").alias("centre"))
    wrong = (F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("centre") > 0))
    n, bad, most = nodes.agg(F.coalesce(F.sum("leaf"), F.lit(0)), F.count_if(wrong), F.max(F.col("leaf") + F.col("centre"))).first()
    return n, bad == 0, most or 0


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for the nodes of `links` (u, v: long), the component being its least node.

    Links to oneself and repeated links do no harm; an empty table gives an empty one. Each round is written to
    the shared folder; the rounds end when the links are stars, which takes a few for groups of copies.
    """
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        n, stars, most = _shape(now)
        if stars:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        large = written(_stars(now, True, n, most > HOT_ROWS), "large-star")
        after = written(_stars(large, False, n, most > HOT_ROWS), "small-star")
        forget(links.sparkSession, now, large)
        now = after
    raise RuntimeError(f"links didn't become stars in {rounds} rounds")

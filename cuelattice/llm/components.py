"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links(u, v); component is the smallest id reachable.

    Alternating star contraction: the large star hooks a node's larger neighbours to the
    smallest id around it, the small star does so with the smaller ones. Every step is a
    grouped minimum and a join, so a hub is summed up before it is shuffled and no
    neighbour list is gathered. Ends when the links no longer change: then each node but
    the smallest of its component has one link, to that smallest. Rows with a null and
    links of a node to itself are ignored; no links give an empty result.
    """
    a, b = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    links = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(a, b).distinct().checkpoint()
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )

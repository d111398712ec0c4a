"""Connected components by alternating large-star and small-star (Kiveris et al., 2014), as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm.common import Scratch, salted_join


def _minima(rows: DataFrame, small: bool) -> DataFrame:
    """Each row (u, v) with m, the smallest of u and its v. A node with very many neighbours is dealt over several partitions."""
    m = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return rows.join(F.broadcast(m), "u") if small else salted_join(rows, m, ["u"], F.col("v"))


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _minima(both, small).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    out = _minima(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), small)
    own = out.select("u", F.col("m").alias("v"))
    return own.union(out.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of links (u, v), as a table of scratch: component is the smallest node reachable.

    Self-links, repeated links and links with a null end are ignored. It stops when a round changes no edge: then every edge leads
    from a node to its component's smallest one. Of small edge lists (by their written size) the minima are broadcast.
    """
    edges = scratch.table(links.select("u", "v").where("u != v").distinct())
    small = scratch.is_small(edges)
    seen = None
    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
            return scratch.table(found.coalesce(4) if small else found)
        seen, last = now, edges
        after = _small_star(_large_star(edges, small), small)
        edges = scratch.table(after.coalesce(4) if small else after)
        scratch.drop(last)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

"""Connected components of a link table, by alternating large and small stars.

Every step joins the links with the least neighbour of each node. The links of a hot centre never
meet in one task: its least neighbour is broadcast, and its links stay where they are. A centre is
hot if it has more links than a quarter of an even share of a partition, so there are at most
eight hot centres for each partition, whatever the links are; the others are joined by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import dropped, written


def _with_least(links: DataFrame, n_links: int) -> tuple[DataFrame, DataFrame]:
    """links (u, v) with m, the least v of each u; and the table (u, m, n) that it comes from."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col("n") > max(1, n_links // (4 * parts))
    centres = F.broadcast(least.where(hot).select("u", "m"))
    rest = links.join(F.broadcast(least.where(hot).select("u")), "u", "left_anti")
    return links.join(centres, "u").unionByName(rest.join(least.where(~hot).select("u", "m").hint("shuffle_merge"), "u")), least


def _star_step(edges: DataFrame, n_edges: int) -> DataFrame:
    """A large star (every neighbour above a node is linked to the least of the node and its neighbours), then a small one (a node and its lesser neighbours are linked to the least of them). edges: u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, least = _with_least(both, 2 * n_edges)
    large = written(joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "stars")
    dropped(least)
    joined, least = _with_least(large, n_edges)
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    dropped(least)
    dropped(large)
    return small


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Null ends and self-links are ignored, repeated links count once, no links give no rows.
    """
    edges = written(
        links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .where(F.col(u).isNotNull() & F.col(v).isNotNull() if (u, v) == ("u", "v") else F.lit(True))
        .where("u <> v")
        .distinct(),
        "links",
    )

    def mark(df: DataFrame):
        return tuple(
            df.agg(
                F.count("*"),
                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
            ).first()
        )

    before = mark(edges)
    while before[0]:
        after_edges = _star_step(edges, before[0])
        dropped(edges)
        edges, after = after_edges, mark(after_edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: A node of more edges than this and than a SHARE-th of all is a hub. There are 2 * SHARE hubs at most.
HUB, SHARE = 100_000, 1_000


def _joined(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges (a, b) with the ``_m`` of least (_k, _m, _n: edges of _k) where a = _k.

    Hubs are few by their definition, so they are broadcast: no hub's edges meet in one task.
    """
    small = least.select("_k", "_m")
    if n <= HUB:
        return edges.join(small, F.col("a") == F.col("_k"))
    hub = F.col("_n") > max(HUB, n // SHARE)
    hubs = F.broadcast(least.where(hub).select("_k", "_m"))
    rest = edges.join(hubs, F.col("a") == F.col("_k"), "left_anti")
    return edges.join(hubs, F.col("a") == F.col("_k")).unionByName(rest.join(least.where(~hub).select("_k", "_m"), F.col("a") == F.col("_k")))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node's larger neighbours join the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("_k")).agg(F.least(F.min("b"), F.first("a")).alias("_m"), F.count("*").alias("_n"))
    return _joined(both.where("b > a"), least, n).select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours join the least of these."""
    least = edges.groupBy(F.col("a").alias("_k")).agg(F.min("b").alias("_m"), F.count("*").alias("_n"))
    return (
        _joined(edges, least, n)
        .where("b != _m")
        .select(F.col("b").alias("a"), F.col("_m").alias("b"))
        .union(least.select(F.col("_k").alias("a"), F.col("_m").alias("b")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node long, root long): the least node of its component.

    Nodes without a link to another node are absent. Nulls, self links and repeated links
    are ignored; an empty table gives an empty table. Rounds grow with the logarithm of a
    component's diameter; each is written to the shared folder and the one before removed,
    and only two counts reach the driver.
    """
    edges = cut(
        links.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark, before = seen, edges
        edges = cut(_small_star(_large_star(edges, 2 * seen[0]), 2 * seen[0]))
        release(before)

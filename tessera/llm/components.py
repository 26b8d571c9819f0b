"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 100, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(id, component) for every id that occurs in ``links``; component is the smallest id reachable.

    Each round replaces the edges by stars around the smallest neighbour: minima
    are pre-aggregated map-side and joined back on the node, so a hub with a
    third of all edges is a skewed join that AQE splits, never one task. The
    edge table is written (by ``write``) to the shared folder after each round.
    The rounds grow with the logarithm of the longest path; one that isn't done
    after ``max_rounds`` raises an error. Self links and
    repeated links are harmless; rows with a null end are ignored; an empty
    table gives an empty table.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .select("u", "v").distinct()
    )
    nodes = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    edges = write(edges.where("u > v"), "cc")
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or seen == tuple(state):
            break
        seen = tuple(state)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct()
        )
        edges = write(small, "cc")
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    # the edges are now stars: every node but the centre has one edge to it
    return nodes.join(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )

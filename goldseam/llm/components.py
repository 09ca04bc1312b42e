"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """From edges (a, b), longs: one row (node, root) for every node with a neighbour; roots are the least nodes.

    Each round links all neighbours of a node to the least of them, first the larger
    ones, then the smaller; the number of rounds grows with the logarithm of the
    longest chain. It ends when neither step has changed a link, which is written with
    the links. Minima are written before they are joined, so that AQE can split the join
    of a node with very many neighbours. The tables of a round are dropped once the next
    round's links are there; the links returned stay.
    """
    links = tables.put(
        edges.filter("a != b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    )
    changed = True
    while changed:
        both = links.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            links.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = tables.put(both.groupBy(F.col("u").alias("low")).agg(F.least(F.col("u"), F.min("v")).alias("root")))
        # A link is reached from its smaller end; it stays if that is the least of its own neighbours.
        large = tables.put(
            links.join(least, "low").select("high", F.col("root").alias("low"), (F.col("root") != F.col("low")).alias("changed"))
        )
        lowest = tables.put(large.groupBy("high").agg(F.min("low").alias("root")))
        small = (
            large.join(lowest, "high")
            .filter("low != root")
            .select(F.col("low").alias("high"), F.col("root").alias("low"), F.lit(True).alias("changed"))
            .unionByName(lowest.select("high", F.col("root").alias("low"), F.lit(False).alias("changed")))
        )
        before, links = links, tables.put(small.groupBy("high", "low").agg(F.bool_or("changed").alias("changed")))
        changed = not (large.filter("changed").isEmpty() and links.filter("changed").isEmpty())
        tables.drop(before, least, large, lowest)
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )

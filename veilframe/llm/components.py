"""Connected components of a table of links, by contraction.

Each round every vertex joins its smallest neighbour, links are renamed to the joined vertices, and links within one
vertex vanish.  Vertex ids are hashes, so a round removes a good part of the vertices whatever the graph's shape and
the number of rounds grows with its logarithm.  Rounds end in tables in the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b); nodes have equal labels exactly if links connect them.

    Repeated, reversed and self links are harmless; an empty table gives an empty table.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = written(links.distinct(), "links")
    nodes: DataFrame | None = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("node"), "to"), "joined")
        if nodes is None:
            nodes = joined.withColumnRenamed("to", "label")
        else:
            moved = nodes.join(joined.withColumnRenamed("node", "label"), "label", "left")
            nodes = moved.select("node", F.coalesce("to", "label").alias("label"))
        left = joined.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = joined.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        links = links.join(left, "a").join(right, "b").where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        links = written(links.distinct(), "links")
        nodes = written(nodes, "nodes")
        if links.isEmpty():
            return nodes

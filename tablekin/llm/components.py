"""Connected components of an edge table, by repeated contraction of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b); the root is one node of the component.

    Each round maps every node to its smallest neighbour, and edges to edges between those. What is
    left of a star is nothing, of a path less than half, so rounds grow with the logarithm of
    its length. Nothing but the number of edges reaches the driver.
    """
    edges = stage(edges.select("a", "b").filter("a <> b").distinct())
    roots = stage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stage(both.groupBy(F.col("a").alias("of")).agg(F.least(F.col("of"), F.min("b")).alias("parent")))
        of = lambda name: parents.select(F.col("of").alias(name), F.col("parent").alias(f"{name}_to"))
        roots = stage(roots.join(of("root"), "root", "left").select(
            "node", F.coalesce("root_to", "root").alias("root")))
        edges = stage(edges.join(of("a"), "a").join(of("b"), "b").filter("a_to <> b_to").select(
            F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    return roots

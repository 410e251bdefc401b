"""Connected components of an edge table, by contraction: joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.llm.common import save


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (v, root) for every vertex of an edge; root is one vertex of its component.

    A round points every vertex to the smallest of itself and its neighbours, in the order of a hash that each round
    takes anew, and replaces it by that in all edges; edges within a point vanish. A path whose ids rise along it so
    shrinks like any other. Each round writes the shrunken edges and the pointers as tables. Composing the
    pointers from the last round back gives the roots. Self-loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    edges = save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        salt = F.lit(len(rounds))
        least = F.least(F.struct(F.xxhash64(salt, "a").alias("h"), F.col("a").alias("v")), F.min(F.struct(F.xxhash64(salt, "b").alias("h"), F.col("b").alias("v"))))
        to = save(both.groupBy("a").agg(least["v"].alias("to")).withColumnRenamed("a", "v"), "pointers")
        rounds.append(to)
        moved = edges.join(to.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        edges = save(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if not rounds:
        return spark.createDataFrame([], "v long, root long")
    roots = rounds[-1].select("v", F.col("to").alias("root"))
    for to in reversed(rounds[:-1]):
        later = roots.select(F.col("v").alias("to"), "root")
        roots = to.join(later, "to", "left").select("v", F.coalesce("root", "to").alias("root"))
    return save(roots, "roots")

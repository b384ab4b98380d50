"""Connected components by alternating stars: two joins per round, no node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import intermediates, materialise


def _stars(edges: DataFrame) -> DataFrame:
    """Link each node to the least node next to it; edges point from the greater to the lesser end."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.where(F.col("v") > F.col("u")).join(least, "u")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    return (large.join(down, "u").where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(down.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge list; root is the least node of its component.

    Every round is written to the shared folder, so a lost executor costs its tasks only; the rounds' tables go when
    the result is written. Stars at least halve the longest path, so the number of rounds is logarithmic.
    """
    with intermediates(edges.sparkSession):
        now = materialise(edges.where(F.col(a) != F.col(b))
                          .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
        while True:
            # Done when every node hangs on one root and no root hangs on another node: one shuffle of the ends tells.
            ends = (now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
                    .union(now.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")))
            if not ends.where("up > 1 or (up > 0 and down > 0)").count():
                break
            now = materialise(_stars(now), "stars")
        star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return materialise(star.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components", outer=True)

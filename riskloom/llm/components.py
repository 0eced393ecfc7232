"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Every step is two grouped minima and two joins on edges kept as rows; nothing
reaches the driver but one checksum a round. High-degree nodes are shared out
by Spark's split of skewed joins, and minima combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import kept


#: Edges up to which a step is not cut into as many tasks as the corpus, and its tasks then.
FEW = 40_000
TASKS = 8


def _star(edges: DataFrame, few: bool = False) -> DataFrame:
    def fit(df: DataFrame) -> DataFrame:
        return df.coalesce(TASKS) if few else df

    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = fit(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = fit(fit(large.filter("u <> v")).distinct())
    lower = fit(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"))
    joined = large.join(lower, F.col("u") == F.col("k"))
    small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
    return fit(fit(small.union(lower.select(F.col("k").alias("u"), F.col("m").alias("v")))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of ``edges`` (u, v) but the roots themselves."""
    edges = kept(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if found["n"] == 0 or (found["n"], found["s"]) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (found["n"], found["s"])
        edges = kept(_star(edges, found["n"] <= FEW))

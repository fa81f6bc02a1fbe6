"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """vertex, comp: every vertex of an edge (u, v) with the smallest vertex that it reaches.

    Alternating large and small stars (Kiveris et al. 2014), one written table per
    round.  Minima are pre-aggregated, so a hub costs one row per task; the joins
    with the minima are plain, so a hub's rows can be split.
    """

    def written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        table = cut_lineage(pairs.where("u <> v").distinct())
        return table, tuple(table.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    pairs, mark = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
        pairs, after = written(small)
        if after == mark:
            break
        mark = after
    roots = pairs.select(F.col("v").alias("vertex")).distinct()
    return pairs.select(F.col("u").alias("vertex"), F.col("v").alias("comp")).unionByName(roots.select("vertex", F.col("vertex").alias("comp")))

"""New rows in an existing density clustering, by its stored tree (approximate prediction of HDBSCAN)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.cluster import MERGE_EDGES, TINY, _labels, density_tree
from topicloom.operators.spanning import core_distance
from topicloom.operators.vectorjoin import BLOCK_ROWS, knn_between, knn_join
from topicloom.session import cut_lineage

#: The tables of a fitted clustering, as ``save_model`` and ``load_model`` name them.
TABLES = ("points", "clusters", "settings")


def fit_density(
    df: DataFrame,
    min_cluster_size: int = 5,
    min_samples: int | None = None,
    key: str = "seg_key",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    merge_edges: int = MERGE_EDGES,
) -> dict[str, DataFrame]:
    """points, clusters and settings of a density clustering: tables that can be saved as a model.

    points: key, vec, core, head (the deepest cluster of the tree that the row was in),
    lam (where it left that cluster), topic and prob.  clusters: head, above (the cluster
    that it split off from), birth, topic (of the chosen cluster at or above it, else -1)
    and peak (the largest lam in that one); the root, which is never chosen, has no row.
    settings: min_samples.
    """
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    min_samples = min_samples or min_cluster_size
    rows = cut_lineage(df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec")))
    # the tree and the cores need the same neighbours
    knn = cut_lineage(knn_join(rows, min_samples, "key", "vec", "euclidean", block_rows))
    tree, leaves, n = density_tree(rows, min_cluster_size, min_samples, "key", "vec", block_rows, merge_edges, knn)
    labels, fallen, clusters = _labels(tree, leaves, n)
    cores = core_distance(knn, "key")
    placed = fallen.join(leaves, "leaf").join(labels, "key")
    points = rows.join(cores, "key", "left").fillna(0.0, ["core"]).join(placed, "key")
    return {
        "points": cut_lineage(points.select("key", "vec", "core", "head", "lam", "topic", "prob")),
        "clusters": cut_lineage(clusters),
        "settings": df.sparkSession.range(1).select(F.lit(int(min_samples)).alias("min_samples")),
    }


def predict_density(
    model: dict[str, DataFrame], new: DataFrame, key: str = "seg_key", vector: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """key, topic, prob of new rows; the clustering itself does not change.

    Of its 2 x min_samples nearest points, a row hangs on the one with the smallest
    mutual reachability, at lam = 1 / that distance.  Its cluster is the deepest one that
    holds this point and was there at lam; its topic is that of the chosen cluster at or
    above it, its strength lam over the peak of that, at most 1.  A row at the place of a
    point gets that point's topic and strength (of several the one with the smallest key),
    so the points themselves keep theirs.  Rows without a vector are in no cluster, as are
    all rows if there are no points.
    """
    min_samples = model["settings"].first().min_samples
    rows = cut_lineage(new.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec")))
    points = model["points"]
    near = cut_lineage(knn_between(rows.where(F.col("vec").isNotNull()), points.select("key", "vec"), 2 * min_samples, block_rows))
    # the distance to the min_samples-th point, or to the last where there are fewer
    cores = near.where(F.col("rank") <= min_samples).groupBy("key").agg(F.max("distance").alias("own"))
    met = near.join(cores, "key").join(points.drop("vec").withColumnRenamed("key", "neighbor"), "neighbor")
    reach = F.greatest("distance", "own", "core")
    there = F.col("distance") == 0
    best = met.groupBy("key").agg(
        F.min(F.struct(F.when(there, 0.0).otherwise(reach).alias("reach"), "distance", "neighbor", "head", "topic", "prob", there.alias("there"))).alias("b")
    )
    best = cut_lineage(best.select("key", "b.head", "b.topic", "b.prob", "b.there", (1 / F.greatest("b.reach", F.lit(TINY))).alias("lam")))
    hung = cluster_at(model["clusters"], best.where("not there").select("key", "head", "lam"))
    chosen = model["clusters"].select("head", "topic", "peak")
    joined = hung.join(chosen, "head", "left").select(
        "key", F.coalesce("topic", F.lit(-1)).alias("topic"), F.when(F.col("topic") >= 0, F.least(F.lit(1.0), F.col("lam") / F.col("peak"))).otherwise(0.0).alias("prob")
    )
    found = joined.unionByName(best.where("there").select("key", "topic", "prob"))
    return rows.select("key").join(found, "key", "left").select(
        F.col("key").alias(key), F.coalesce("topic", F.lit(-1)).cast("int").alias("topic"), F.coalesce("prob", F.lit(0.0)).alias("prob")
    )


def cluster_at(clusters: DataFrame, rows: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """key, head, lam: each head moved up the tree to the first cluster that was born at or before lam.

    ``clusters`` (head, above, birth); births do not fall on the way down.  Jumps of
    1, 2, 4, ... clusters are tabled and taken from the longest down, so a chain of
    clusters takes a number of rounds that grows with its logarithm; ``rounds``, if
    given, gets it.
    """
    jumps = [cut_lineage(clusters.select("head", F.col("above").alias("to"), "birth"))]
    born = jumps[0].select(F.col("head").alias("to"), F.col("birth").alias("to_birth"))
    # only jumps that end in a cluster with a row; the root is the last resort
    level = cut_lineage(jumps[0].join(born, "to").select("head", "to", "to_birth"))
    levels = []
    while level.take(1):
        levels.append(level)
        step = level.select(F.col("head").alias("to"), F.col("to").alias("far"), F.col("to_birth").alias("far_birth"))
        level = cut_lineage(level.join(step, "to").select("head", F.col("far").alias("to"), F.col("far_birth").alias("to_birth")))
    state = rows.select("key", "head", "lam")
    for level in reversed(levels):
        # a jump is taken if even its end was born too late
        state = cut_lineage(
            state.join(level, "head", "left").select("key", F.when(F.col("to_birth") > F.col("lam"), F.col("to")).otherwise(F.col("head")).alias("head"), "lam")
        )
    if rounds is not None:
        rounds.append(len(levels))
    last = state.join(jumps[0], "head", "left")
    return last.select("key", F.when(F.col("birth") > F.col("lam"), F.col("to")).otherwise(F.col("head")).alias("head"), "lam")

"""Joins between sets of vectors: nearest neighbours and all scores against a few targets.

The exact nearest-neighbour join follows the Voronoi-cell join of Lu et al.
("Efficient processing of k nearest neighbor joins using MapReduce", 2012):

1.  copies of a vector are merged, so a large group of copies is one vector;
2.  pivots cut space into cells, and a cell that is large, into blocks of bounded size;
3.  each block finds the best k inside itself, which bounds the k-th distance;
4.  a vector visits another cell only if the triangle inequality allows a closer
    vector there; visits are joined on (home block, visited block), so both sides
    of every task are bounded, and only the k best per vector leave the task;
5.  where nearly every cell could hold a neighbour, as in many dimensions without
    structure, a vector is sent to a few large blocks of all points instead of to many
    small ones, so it is shuffled once per ``WIDE_ROWS`` points.

Nothing is capped: a vector meets every cell that could matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.vectors import normalise
from topicloom.session import cut_lineage

BLOCK_ROWS = 1024
# Pivots are shipped to the executors, so their number is bounded.
MAX_PIVOTS = 4096
# Points of a block for vectors that have to see most cells.
WIDE_ROWS = 32_768
# What the visits of a vector may ship, by its own row and by rows of the visited blocks; beyond that it is compared with large blocks.
VISIT_BYTES = 1 << 14
# Large blocks seen after a round for each one seen before it; the bounds shrink in between.
WIDER = 4
# Queries compared with a block at a time.
QUERY_ROWS = 128
# Bounds are compared with this relative slack, so rounding never prunes a neighbour.
SLACK = 1e-6


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared Euclidean distances by matrix product, and a bound of their rounding error."""
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    scale = float(a2.max(initial=0.0) + b2.max(initial=0.0))
    return np.maximum(a2[:, None] + b2[None, :] - 2.0 * (a @ b.T), 0.0), 1e-13 * scale


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by matrix product; good for pruning, not for output."""
    return np.sqrt(squares(a, b)[0])


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of paired rows, the same in both directions."""
    gap = a - b
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def nearest(queries, q_keys, points, p_keys, k, bounds=None):
    """The k nearest points per query, ordered by (distance, key); the query's own key is skipped.

    Points beyond a query's bound, if given, may be left out.
    Returns flat arrays: query position, point position, distance.
    """
    limits = np.full(len(queries), np.inf) if bounds is None else bounds * bounds * (1 + SLACK) ** 2
    # |q - p|^2 = |q|^2 - 2 (q.p - |p|^2 / 2): one product and one comparison per pair
    p2 = (points * points).sum(1)
    tall = np.hstack([points, -0.5 * p2[:, None]]).T
    parts = [
        _nearest(queries[i : i + QUERY_ROWS], q_keys[i : i + QUERY_ROWS], points, p_keys, k, i, tall, p2.max(initial=0.0), limits[i : i + QUERY_ROWS])
        for i in range(0, len(queries), QUERY_ROWS)
    ]
    if not parts:
        return np.array([], int), np.array([], int), np.array([])
    return tuple(np.concatenate(p) for p in zip(*parts))


def _nearest(queries, q_keys, points, p_keys, k, offset, tall, longest, limits):
    q2 = (queries * queries).sum(1)
    score = np.hstack([queries, np.ones((len(queries), 1))]) @ tall
    error = 1e-13 * float(q2.max(initial=0.0) + longest)
    # keep everything that rounding could put among the k best, the query itself included
    least = (q2 - limits - error) / 2
    near = score >= least[:, None]
    if np.count_nonzero(near) > 4 * (k + 1) * len(queries):
        place = points.shape[0] - min(k + 1, points.shape[0])
        kth = np.partition(score, place, axis=1)[:, place]
        near = score >= np.maximum(least, kth - error)[:, None]
    qi, pi = np.divmod(np.flatnonzero(near), points.shape[0])
    keep = q_keys[qi] != p_keys[pi]
    qi, pi = qi[keep], pi[keep]
    d = exact_distance(queries[qi], points[pi])
    order = np.lexsort((p_keys[pi], d, qi))
    qi, pi, d = qi[order], pi[order], d[order]
    first = np.searchsorted(qi, np.arange(queries.shape[0]))
    best = np.arange(len(qi)) - first[qi] < k
    return qi[best] + offset, pi[best], d[best]


@dataclass
class Cells:
    """Vectors by cell and block: key, vec, cell, block, home; and the cells' pivots and radii."""

    points: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    key_type: str


def build_cells(points: DataFrame, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS) -> Cells:
    """Index ``points`` (key, vec).  Hash-chosen pivots make the result repeatable."""
    n = points.count()
    wanted = max(1, min(max_pivots, -(-n // block_rows)))
    chosen = points.orderBy(F.xxhash64("key"), "key").limit(wanted).select("vec").collect()
    pivots = np.array([r.vec for r in chosen], dtype=np.float64)
    key_type = points.schema["key"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            if len(b) == 0:
                continue
            d = distances(matrix(b["vec"]), pivots)
            cell = d.argmin(1)
            yield pd.DataFrame(
                {"key": b["key"], "vec": b["vec"], "cell": cell, "to_pivot": d[np.arange(len(b)), cell]}
            )

    assigned = cut_lineage(
        points.select("key", "vec").mapInPandas(
            assign, f"key {key_type}, vec array<double>, cell int, to_pivot double"
        )
    )
    stats = assigned.groupBy("cell").agg(F.max("to_pivot").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radii, counts = np.full(len(pivots), -1.0), np.zeros(len(pivots), dtype=np.int64)
    for r in stats:
        radii[r.cell], counts[r.cell] = r.radius, r.n
    blocks = F.element_at(
        F.array(*[F.lit(int(max(1, -(-c // block_rows)))) for c in counts]), F.col("cell") + 1
    )
    split = assigned.withColumn("block", F.pmod(F.xxhash64("key"), blocks.cast("long")).cast("int"))
    home = (F.col("cell").cast("long") * F.lit(1 << 32)) + F.col("block")
    return Cells(split.select("key", "vec", "cell", "block", home.alias("home")), pivots, radii, counts, key_type)


def visits(
    cells: Cells,
    queries: DataFrame,
    block_rows: int = BLOCK_ROWS,
    n_probe: int | None = None,
    include_home: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """``queries`` (key, vec, home, bound, ...) x the blocks they have to visit, and the queries with too many visits.

    A cell is visited if its nearest possible vector is within ``bound``.
    ``n_probe`` visits only that many nearest cells instead (approximate).
    The second table, None if it is empty, has the queries that have to meet all points.
    """
    few = max(1, VISIT_BYTES // (8 * cells.pivots.shape[1] + 48)) if n_probe is None else 1 << 62
    pivots, radii, counts = cells.pivots, cells.radii, cells.counts
    n_blocks = np.maximum(1, -(-counts // block_rows))

    def find(batches):
        for b in batches:
            if len(b) == 0:
                continue
            d = distances(matrix(b["vec"]), pivots)
            low = np.maximum(d - radii[None, :], 0.0)
            if n_probe is None:
                open_ = low <= b["bound"].to_numpy()[:, None] + SLACK * (1 + d)
            else:
                order = d.argsort(1, kind="stable")[:, :n_probe]
                open_ = np.zeros_like(d, dtype=bool)
                np.put_along_axis(open_, order, True, axis=1)
            open_ &= (radii >= 0)[None, :]
            row, cell = np.nonzero(open_)
            times = n_blocks[cell]
            crowded = np.bincount(row, times, minlength=len(b)) > few
            row, cell, times = row[~crowded[row]], cell[~crowded[row]], times[~crowded[row]]
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, target = np.repeat(row, times), (np.repeat(cell, times) << 32) + block
            if not include_home:
                away = target != b["home"].to_numpy()[row]
                row, target = row[away], target[away]
            targets = np.split(target, np.searchsorted(row, np.arange(1, len(b))))
            yield b.assign(targets=[None if c else t for c, t in zip(crowded, targets)])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    found = cut_lineage(queries.mapInPandas(find, schema + ", targets array<bigint>"))
    # a home whose vectors visit too many blocks between them would have all of these shipped to it
    pairs = found.select("home", F.explode("targets").alias("target")).distinct()
    crowded = cut_lineage(pairs.groupBy("home").count().where(F.col("count") > few).select("home", F.lit(True).alias("_crowded")))
    marked = found.join(crowded, "home", "left")
    open_ = F.isnull("targets") | F.col("_crowded").isNotNull()
    wide = marked.where(open_).select(*queries.columns)
    return marked.where(~open_).select(*queries.columns, F.explode("targets").alias("target")), wide if wide.take(1) else None


def meet_all(queries: DataFrame, points: DataFrame, reducer, schema: str, blocks: int, first: int = 0, last: int | None = None) -> DataFrame:
    """Run ``reducer(queries, points)`` for large blocks of ``queries`` and the blocks ``first`` to ``last`` of ``points``.

    Both are dealt by a hash of their key, points to ``blocks`` blocks.
    """
    last, n = blocks if last is None else last, queries.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    # enough blocks to keep all cores busy, if that leaves them rows
    parts = max(-(-n // WIDE_ROWS), min(-(-n // BLOCK_ROWS), -(-2 * cores // (last - first))), 1)
    left = queries.withColumn("_q", F.pmod(F.xxhash64("key"), F.lit(parts)))
    left = left.withColumn("_p", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last - 1).cast("long"))))
    right = points.withColumn("_p", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks))).where(F.col("_p").between(first, last - 1))
    right = right.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return left.groupBy("_q", "_p").cogroup(right.groupBy("_q", "_p")).applyInPandas(reducer, schema)


def visit_blocks(cells: Cells, asked: DataFrame, points: DataFrame, reducer, schema: str) -> DataFrame:
    """Run ``reducer(queries, points)`` for every pair (home block, visited block)."""
    pairs = asked.select(F.col("home").alias("from_block"), F.col("target").alias("to_block")).distinct()
    shipped = points.withColumnRenamed("home", "to_block").join(pairs, "to_block")
    return (
        asked.groupBy("home", "target")
        .cogroup(shipped.groupBy("from_block", "to_block"))
        .applyInPandas(reducer, schema)
    )


def _group_copies(df: DataFrame) -> DataFrame:
    return cut_lineage(df.groupBy("vec").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")))


def knn_join(
    df: DataFrame,
    k: int,
    key: str = "seg_key",
    vector: str = "embedding",
    metric: str = "euclidean",
    block_rows: int = BLOCK_ROWS,
    n_probe: int | None = None,
) -> DataFrame:
    """key, rank (1..k), neighbor, distance: the k nearest other rows, equal distances by key.

    Exact unless ``n_probe`` is given.  ``distance`` is Euclidean, or 1 - cosine.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"Unknown metric: {metric!r}")
    if k < 1:
        raise ValueError("k must be positive")
    vec = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("key"), vec.alias("vec"))
    if metric == "cosine":
        rows = rows.select("key", "vec", unit_with_flag("vec").alias("unit")).select("key", F.col("unit").alias("vec"))
    key_type = rows.schema["key"].dataType.simpleString()
    rows = cut_lineage(rows)
    groups = _group_copies(rows)
    found = _knn_distinct(groups.select(F.col("rep").alias("key"), "vec"), k, block_rows, n_probe, key_type)
    if groups.where("copies > 1").take(1):
        found = _expand_copies(rows, groups, found, k)
    if metric == "cosine":
        found = found.withColumn("distance", F.col("distance") * F.col("distance") / 2)
    return found.select(F.col("key").alias(key), "rank", "neighbor", "distance")


def unit_with_flag(vec: str):
    """Unit vector with one more coordinate, 1 for a zero vector: it is at right angles to all others."""
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
    lengths = F.array_repeat(length, F.size(vec))
    unit = F.zip_with(vec, lengths, lambda x, n: F.when(n > 0, x / n).otherwise(x))
    return F.concat(unit, F.array(F.when(length > 0, F.lit(0.0)).otherwise(F.lit(1.0))))


def _best_k(candidates: DataFrame, k: int) -> DataFrame:
    # the filter on row_number lets Spark keep k rows per key and task before the shuffle
    order = Window.partitionBy("key").orderBy("distance", "neighbor")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _inside(k: int, key_type: str):
    """A task function for the k nearest inside one block, and its schema."""

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        v, keys = matrix(pdf["vec"]), pdf["key"].to_numpy()
        qi, pi, d = nearest(v, keys, v, keys, k)
        return pd.DataFrame({"key": keys[qi], "neighbor": keys[pi], "distance": d})

    return inside, f"key {key_type}, neighbor {key_type}, distance double"


def _knn_distinct(distinct: DataFrame, k: int, block_rows: int, n_probe: int | None, key_type: str) -> DataFrame:
    cells = build_cells(distinct, block_rows)
    inside, hit = _inside(k, key_type)
    local = cells.points.groupBy("home").applyInPandas(inside, hit)
    local = cut_lineage(local)

    # the k-th distance so far; fewer than k vectors in the block give no bound
    bounds = local.groupBy("key").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound")
    )
    queries = cells.points.join(bounds, "key", "left").select(
        "key", "vec", "home", F.coalesce("bound", F.lit(float("inf"))).alias("bound")
    )
    asked, wide = visits(cells, queries, block_rows, n_probe)
    across = _across(k)
    other = visit_blocks(cells, asked, cells.points.select("key", "vec", "home"), across, hit)
    if wide is None:
        return _best_k(local.unionByName(other), k)
    far = _wide_lists(wide, cells, k, across, hit)
    near = local.unionByName(other).join(wide.select("key"), "key", "left_anti")
    return _best_k(near, k).unionByName(far)


def _across(k: int, same: bool = True):
    """A task function for the k nearest points within the bounds of the queries, as ``visit_blocks`` and ``meet_all`` run it.

    With ``same`` a point with the key of a query is the query itself.
    """

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"key": [], "neighbor": [], "distance": []})
        q_keys, p_keys, bounds = left["key"].to_numpy(), right["key"].to_numpy(), left["bound"].to_numpy()
        mine = q_keys if same else np.full(len(left), None)
        qi, pi, d = nearest(matrix(left["vec"]), mine, matrix(right["vec"]), p_keys, k, bounds)
        useful = d <= bounds[qi] * (1 + SLACK)
        return pd.DataFrame({"key": q_keys[qi], "neighbor": p_keys[pi], "distance": d})[useful]

    return across


def _wide_lists(wide: DataFrame, cells: Cells, k: int, across, hit: str) -> DataFrame:
    """key, neighbor, distance, rank: the k nearest of all points for queries (key, vec, bound, ...).

    Blocks are met in rounds, each with the bounds that the rounds before have reached, so
    a query gathers few more than k neighbours in a round.
    """
    queries, points = cut_lineage(wide.select("key", "vec", "bound")), cells.points.select("key", "vec")
    blocks = max(1, -(-int(cells.counts.sum()) // WIDE_ROWS))
    lists, first, last = None, 0, 1
    while True:
        found = meet_all(queries, points, across, hit, blocks, first, last)
        if lists is not None:
            found = found.unionByName(lists.drop("rank"))
        lists = cut_lineage(_best_k(found, k))
        if last >= blocks:
            return lists
        bounds = lists.groupBy("key").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_b"))
        queries = cut_lineage(queries.join(bounds, "key", "left").select("key", "vec", F.least("bound", F.coalesce("_b", "bound")).alias("bound")))
        first, last = last, min(last * WIDER, blocks)


def knn_between(queries: DataFrame, points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, rank (1..k), neighbor, distance: the k nearest rows of ``points`` for each row of ``queries`` (both key, vec).

    Exact, Euclidean, equal distances by the point's key; a query may stand on a point.
    Copies on either side are compared once.  A query first sees the cell of the nearest
    pivot, then all blocks that could hold something nearer than the k-th found there.
    """
    if k < 1:
        raise ValueError("k must be positive")
    query_type, key_type = (t.schema["key"].dataType.simpleString() for t in (queries, points))
    hit = f"key {query_type}, neighbor {key_type}, distance double"
    asking, there = _group_copies(queries), _group_copies(points)
    if not asking.take(1) or not there.take(1):
        return queries.sparkSession.createDataFrame([], f"key {query_type}, rank int, neighbor {key_type}, distance double")
    cells = build_cells(there.select(F.col("rep").alias("key"), "vec"), block_rows)
    homes = build_cells(asking.select(F.col("rep").alias("key"), "vec"), block_rows).points.select("key", "vec", "home")

    search = _across(k, same=False)

    def visited(asked: DataFrame, n_probe: int | None) -> DataFrame:
        asked, wide = visits(cells, asked, block_rows, n_probe, include_home=True)
        found = cut_lineage(_best_k(visit_blocks(cells, asked, cells.points.select("key", "vec", "home"), search, hit), k))
        return found if wide is None else found.unionByName(_wide_lists(wide, cells, k, search, hit))

    nearby = visited(homes.withColumn("bound", F.lit(float("inf"))), 1)
    bounds = nearby.groupBy("key").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    bounded = homes.join(bounds, "key", "left").select("key", "vec", "home", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = visited(bounded, None)

    # a group of equal points offers its k smallest keys; every copy of a query gets the same list
    order = Window.partitionBy("vec").orderBy("key")
    members = points.select("key", "vec").withColumn("m", F.row_number().over(order)).where(F.col("m") <= k)
    members = members.join(there.select("vec", "rep"), "vec").select(F.col("rep").alias("neighbor"), F.col("key").alias("member"))
    offers = found.join(members, "neighbor").select("key", F.col("member").alias("neighbor"), "distance")
    lists = cut_lineage(_best_k(offers, k).withColumnRenamed("key", "rep"))
    owners = queries.select("key", "vec").join(asking.select("vec", "rep"), "vec").select("key", "rep")
    return owners.join(lists, "rep").select("key", "rank", "neighbor", "distance")


def _expand_copies(rows: DataFrame, groups: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """From neighbours of distinct vectors to neighbours of rows.

    A group of copies offers its k + 1 smallest keys, which is all that a row can
    use; the filter on row_number keeps only those before the shuffle.
    """
    order = Window.partitionBy("vec").orderBy("key")
    members = rows.withColumn("m", F.row_number().over(order)).where(F.col("m") <= k + 1)
    members = cut_lineage(members.join(groups.select("vec", "rep"), "vec").select("rep", F.col("key").alias("member")))
    reached = found.select(F.col("key").alias("owner"), F.col("neighbor").alias("rep"), "distance").unionByName(
        groups.select(F.col("rep").alias("owner"), "rep", F.lit(0.0).alias("distance"))
    )
    offers = reached.join(members, "rep").select(
        F.col("owner").alias("key"), F.col("member").alias("neighbor"), "distance"
    )
    # k + 1 so that k remain after a row has skipped itself
    lists = (
        _best_k(offers, k + 1)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))).alias("offers"))
        .withColumnRenamed("key", "rep")
    )
    # a large group of copies is the big side of both joins; adaptive execution splits it
    own = rows.join(groups.select("vec", "rep"), "vec").select("key", "rep").join(lists, "rep")
    kept = own.select("key", F.filter("offers", lambda o: o["neighbor"] != F.col("key")).alias("offers"))
    return kept.select("key", F.posexplode(F.slice("offers", 1, k)).alias("pos", "o")).select(
        "key", F.col("o.neighbor").alias("neighbor"), F.col("o.distance").alias("distance"), (F.col("pos") + 1).alias("rank")
    )


def score_all(
    df: DataFrame,
    targets: DataFrame,
    key: str,
    vector: str,
    target_key: str,
    target_vector: str,
    block_rows: int = BLOCK_ROWS,
    shares: bool = False,
) -> DataFrame:
    """key, target key, similarity: cosine of every row with every target.

    With ``shares`` the result is (1 + cosine), divided by its sum over all targets.

    The whole table of scores is the result.  Targets that fit one block are
    shipped with the task and nothing is shuffled; more targets are packed in
    blocks of bounded size, and rows meet each block in a join on (row block, target block).
    """
    left = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    right = targets.select(F.col(target_key).alias("target"), F.col(target_vector).cast("array<double>").alias("tvec"))
    key_type = left.schema["key"].dataType.simpleString()
    target_type = right.schema["target"].dataType.simpleString()
    schema = f"key {key_type}, target {target_type}, similarity double"

    n = right.count()
    if shares:
        # the sum over targets is one product with the sum of the unit targets
        unit = right.select(array_to_vector(normalise(F.col("tvec"))).alias("u"))
        total = unit.agg(Summarizer.sum(F.col("u"))).first()[0].toArray()

    def scores(keys, vecs, t_keys, t_vecs):
        a, b = matrix(vecs), t_vecs
        lengths = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.where(lengths > 0, (a @ b.T) / lengths, 0.0)
        if shares:
            own = np.linalg.norm(a, axis=1)
            s = (1.0 + s) / (n + (a @ total) / np.where(own > 0, own, 1.0))[:, None]
        return pd.DataFrame(
            {"key": np.repeat(keys.to_numpy(), len(t_keys)), "target": np.tile(t_keys, len(a)), "similarity": s.ravel()}
        )

    if n <= block_rows:
        rows = right.orderBy("target").collect()
        t_keys = np.array([r.target for r in rows])
        t_vecs = np.array([r.tvec for r in rows], dtype=np.float64).reshape(len(rows), -1)

        def score_batches(batches):
            for b in batches:
                # small pieces keep the output batches small
                for i in range(0, len(b), 1024):
                    piece = b.iloc[i : i + 1024]
                    if len(piece) and len(t_keys):
                        yield scores(piece["key"], piece["vec"], t_keys, t_vecs)

        out = left.mapInPandas(score_batches, schema)
    else:
        n_left = left.count()
        left_blocks, right_blocks = -(-n_left // block_rows), -(-n // block_rows)
        lefts = left.select(
            "*",
            F.pmod(F.xxhash64("key"), F.lit(left_blocks)).alias("lb"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(right_blocks - 1).cast("long"))).alias("rb"),
        )
        rights = right.select(
            "*",
            F.pmod(F.xxhash64("target"), F.lit(right_blocks)).alias("rb"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(left_blocks - 1).cast("long"))).alias("lb"),
        )

        def score_blocks(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if len(a) == 0 or len(b) == 0:
                return pd.DataFrame({"key": [], "target": [], "similarity": []})
            return scores(a["key"], a["vec"], b["target"].to_numpy(), matrix(b["tvec"]))

        out = lefts.groupBy("lb", "rb").cogroup(rights.groupBy("lb", "rb")).applyInPandas(score_blocks, schema)
    out_key = key if key != target_key else f"{key}_a"
    out_target = target_key if key != target_key else f"{key}_b"
    return out.select(F.col("key").alias(out_key), F.col("target").alias(out_target), "similarity")

"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has its own codebook; the product of the two is a
grid of cells.  A vector visits the cells around its own in the order of how far
it is from them (multi-sequence traversal) and stops at the first one that lies
beyond the distance of a link, so the target recall is 1; what it meets is verified in
double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.components import components
from topicloom.session import cut_lineage

#: Vectors, drawn by hash, on which the codebooks are fitted.  All vectors are indexed.
FIT_ROWS = 20_000

#: Residents of a block and visitors of a block per task.
BLOCK_ROWS, VISITOR_ROWS = 1024, 4096

#: Codes per half: sqrt(vectors / CELL_ROWS), at most MAX_CODES.
CELL_ROWS, MAX_CODES = 256, 256

#: The traversal goes this much farther than a link, against rounding.
SLACK = 1e-9


def units(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_codes(points: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    """Centres by Lloyd's iterations from evenly spaced starting points."""
    start = points[np.lexsort(points.T[::-1])]
    centres = start[np.linspace(0, len(start) - 1, min(codes, len(start))).astype(int)].copy()
    for _ in range(rounds):
        nearest = (-2 * points @ centres.T + (centres**2).sum(1)).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(centres, axis=0)


def offsets(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each point, and the squared distance to the border of every code's region."""
    d = np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)
    own = d.argmin(1)
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    np.fill_diagonal(apart, 1.0)
    border = np.maximum(d - d[np.arange(len(d)), own][:, None], 0) / (2 * apart[own])
    return own, border**2


def traverse(points: np.ndarray, books: tuple[np.ndarray, np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell of each point, then (point, cell) for all cells within ``reach`` that come after the own one, nearest first.

    The codes of each half are walked from near to far.  The distance to a cell is at
    least that to the borders of both its codes, so the walk over the first half ends
    where its code alone is too far, and for each of its codes the walk over the second
    half ends where both together are; no other cell is looked at.
    """
    half = len(books[0][0])
    (a, da), (b, db) = offsets(points[:, :half], books[0]), offsets(points[:, half:], books[1])
    own, limit = a * len(books[1]) + b, reach * reach
    near_a, near_b = np.argsort(da, axis=1, kind="stable"), np.argsort(db, axis=1, kind="stable")
    da, db = np.take_along_axis(da, near_a, 1), np.take_along_axis(db, near_b, 1)
    at, cells = [], []
    for step in range(da.shape[1]):
        rows = np.flatnonzero(da[:, step] <= limit)
        if not len(rows):
            break
        left = limit - da[rows, step]
        many = (db[rows] <= left[:, None]).sum(axis=1)
        row = np.repeat(rows, many)
        second = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        cell = near_a[row, step] * len(books[1]) + near_b[row, second]
        after = cell > own[row]
        at.append(np.stack([row[after], cell[after]]))
        cells.append((da[row, step] + db[row, second])[after])
    (row, cell), far = np.concatenate(at, axis=1), np.concatenate(cells)
    order = np.lexsort((far, row))
    return own, row[order], cell[order]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (indices) after joining a[i] with b[i]: each component has its smallest index."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        new = new[labels]
        if (new == labels).all():
            break
        labels = new
    return labels


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    table: DataFrame, threshold: float = 0.98, key: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """key, n_links, component_id, kept: one row per row of ``table``.

    Vectors are compared if their labels are equal and not null and their lengths
    are equal; links are pairs with cosine >= threshold.  Null keys, null labels
    and vectors that are null, empty, zero or not finite link with nothing, and are
    their own component.  Equal vectors of one label are one representative with a
    number of copies, so copies are counted, never paired.  Repeated rows are
    copies.  Links of a group are counted block by block; only the joins between
    its rows that connect it are written, never all its pairs.
    """
    k, lab, vec = (F.col(f"`{c}`") for c in (key, label, vector))
    rows = table.select(k.alias("k"), lab.alias("lab"), vec.alias("vec"))
    good = usable(F.col("vec")) & F.col("k").isNotNull() & F.col("lab").isNotNull()
    rows = rows.withColumn("good", good)
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "vec")).withColumn("h2", F.xxhash64(F.lit(2), "vec"))
    copies = rows.where("good").groupBy("lab", "h1", "h2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec"))
    copies = cut_lineage(copies.withColumn("dims", F.size("vec")).withColumn("gid", F.monotonically_increasing_id()))

    total, dims = copies.agg(F.count(F.lit(1)), F.max("dims")).first()
    linked = _links(copies, total, dims or 1, threshold)
    linked = cut_lineage(linked)
    counts = linked.groupBy("gid").agg(F.sum("links").alias("links"))
    comps = components(linked.select(F.col("gid").alias("u"), F.col("root").alias("v")))
    reps = copies.select("gid", "lab", "h1", "h2", "rep", "n")
    comps = comps.withColumnRenamed("vertex", "gid").join(reps.select("gid", "rep"), "gid")
    lowest = comps.groupBy("comp").agg(F.min("rep").alias("low"))
    found = counts.join(comps, "gid", "left").join(lowest, "comp", "left").select("gid", "links", "low")
    groups = reps.join(found, "gid", "left").select(
        "lab", "h1", "h2",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("low", "rep").alias("component_id"),
    )
    apart = rows.where("not good").select(F.col("k"), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    joined = rows.where("good").select("k", "lab", "h1", "h2").join(groups, ["lab", "h1", "h2"]).select("k", "n_links", "component_id")
    return joined.unionByName(apart).select(
        F.col("k").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _links(copies: DataFrame, total: int, dims: int, threshold: float) -> DataFrame:
    """gid, links, root: for each block that a vector is in, its links there and the vector that connects it."""
    spark = copies.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    share = FIT_ROWS / max(total, FIT_ROWS)
    picked = copies.where(F.pmod("h1", F.lit(1 << 20)) < int(share * (1 << 20))).select("vec").toPandas()["vec"]
    width = max(2, dims)
    sample = np.zeros((max(1, len(picked)), width))
    for i, v in enumerate(picked):
        sample[i, : len(v)] = units(np.asarray(v, dtype=np.float64)[None])[0]
    codes = int(min(MAX_CODES, max(1, round(math.sqrt(total / CELL_ROWS)))))
    half = width // 2
    books = (fit_codes(sample[:, :half], codes), fit_codes(sample[:, half:], codes))
    cell_kind = copies.schema["lab"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("dims"))
            own, visits = np.zeros(len(n), np.int32), [None] * len(n)
            for d in np.unique(n):
                at = np.flatnonzero(n == d)
                points = np.zeros((len(at), width))
                points[:, :d] = units(_matrix(batch.column("vec").take(pa.array(at))))
                home, row, cell = traverse(points, books, radius * (1 + SLACK) + SLACK)
                own[at] = home
                cuts = np.searchsorted(row, np.arange(len(at) + 1))
                for i, j in enumerate(at):
                    visits[j] = cell[cuts[i] : cuts[i + 1]].astype(np.int32)
            arrays = [batch.column(c) for c in ("gid", "lab", "dims", "n", "vec")]
            arrays += [pa.array(own), pa.array(visits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["gid", "lab", "dims", "n", "vec", "cell", "visits"])

    indexed = copies.select("gid", "lab", "dims", "n", "vec").mapInArrow(
        index, f"gid long, lab {cell_kind}, dims int, n long, vec {copies.schema['vec'].dataType.simpleString()}, cell int, visits array<int>"
    )
    indexed = cut_lineage(indexed)
    where = ["lab", "dims", "cell"]
    sizes = indexed.groupBy(*where).agg(F.count(F.lit(1)).alias("size"))
    guests = indexed.select("lab", "dims", F.explode("visits").alias("cell")).groupBy(*where).agg(F.count(F.lit(1)).alias("guests"))
    parts = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    # in a cell of several blocks, residents also visit the later blocks of their own cell
    salts = F.ceil((F.coalesce("guests", F.lit(0)) + F.when(F.col("size") > BLOCK_ROWS, F.col("size")).otherwise(0)) / VISITOR_ROWS)
    cells = cut_lineage(
        sizes.join(guests, where, "left").select(*where, parts.alias("parts"), F.greatest(F.lit(1), salts).cast("int").alias("salts"))
    )
    body = ["gid", "n", "vec"]
    home = indexed.select(*where, *body).join(cells, where).withColumn("part", F.pmod(F.xxhash64("gid"), "parts").cast("int"))
    residents = home.select(
        *where, "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *body, F.lit(True).alias("home")
    )
    salt = F.pmod(F.xxhash64(F.lit(7), "gid"), "salts").cast("int")
    within = home.where("parts > part + 1").select(
        *where, F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), salt.alias("salt"), *body, F.lit(False).alias("home")
    )
    visiting = indexed.select("lab", "dims", F.explode("visits").alias("cell"), *body).join(cells, where)
    visiting = visiting.select(
        *where, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), salt.alias("salt"), *body, F.lit(False).alias("home")
    )

    def verify(group: pa.Table) -> pa.Table:
        home = group.column("home").to_numpy()
        gid, n = group.column("gid").to_numpy(), group.column("n").to_numpy()
        order = np.argsort(~home, kind="stable")
        gid, n, here = gid[order], n[order], int(home.sum())
        points = units(_matrix(group.column("vec"))[order])
        first = group.column("salt")[0].as_py() == 0
        links, labels = np.zeros(len(gid), np.int64), np.arange(len(gid))
        for i in range(0 if first else here, len(gid), 512):
            near = points[i : i + 512] @ points[:here].T >= threshold
            # residents meet each other once, in the first task of their block
            if i < here:
                near &= (np.arange(i, min(i + 512, len(gid)))[:, None] > np.arange(here)[None])
            a, b = np.nonzero(near)
            a += i
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            labels = join_labels(labels, a, b)
        hit = np.flatnonzero(links)
        return pa.table({"gid": gid[hit], "links": links[hit], "root": gid[labels[hit]]})

    all_rows = residents.unionByName(within).unionByName(visiting)
    return all_rows.groupBy(*where, "part", "salt").applyInArrow(verify, "gid long, links long, root long")

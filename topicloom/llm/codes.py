"""Compression of vectors to short codes: one small codebook for each part, by Ball k-means.

Components become integers, so all distances and means are exact.  An entry's ball
is as wide as its farthest part; only entries nearer than twice that radius are its
neighbours.  A part nearer to its entry than half the way to the entry's first
neighbour is in the stable core and stays.  The others lie in rings between half the
ways to one neighbour and the next, and a part in the i-th ring is compared with the
i nearest neighbours and no others.  Entries that, like all their neighbours, did not
move keep their parts unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.session import cut_lineage

#: Parts of a vector, entries of a codebook, rounds of assigning and averaging.
PARTS, ENTRIES, ROUNDS = 16, 64, 2

#: One component unit is cut into this many steps.
STEPS = 256

#: Rows of a batch compared at a time.
BATCH_ROWS = 16_384


@dataclass
class Codebook:
    """Entries of one part, with what their balls say about the next assignment."""

    entries: np.ndarray  # integers, one row per entry
    order: np.ndarray  # for each entry, all entries from near to far, itself first
    gaps: np.ndarray  # and four times the squared half ways to them
    neighbours: np.ndarray  # how many of these are neighbours, itself included
    settled: np.ndarray  # neither the entry nor a neighbour of it moved


def codebook(entries: np.ndarray, before: np.ndarray | None = None, radii: np.ndarray | None = None) -> Codebook:
    """Neighbours of all entries.  ``radii`` are squared, around the entries ``before``; without them balls have no bound."""
    apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
    apart[np.arange(len(entries)), np.arange(len(entries))] = -1  # an entry comes before its copies
    order = np.argsort(apart, axis=1, kind="stable")
    gaps = np.maximum(np.take_along_axis(apart, order, axis=1), 0)
    settled = np.zeros(len(entries), dtype=bool)
    neighbours = np.full(len(entries), len(entries))
    if before is not None:
        moved = ((entries - before) ** 2).sum(axis=1)
        # the ball around the new entry reaches no farther than the old one and the move; slack for rounding
        reach = (np.sqrt(radii.astype(np.float64)) + np.sqrt(moved.astype(np.float64))) ** 2 * (1 + 1e-9) + 1
        neighbours = (gaps <= 4 * reach[:, None]).sum(axis=1)
        near = np.arange(len(entries))[None, :] < neighbours[:, None]
        settled = ~(near & (moved[order] > 0)).any(axis=1)
    return Codebook(entries, order, gaps, neighbours, settled)


def assign(points: np.ndarray, own: np.ndarray, book: Codebook) -> np.ndarray:
    """The nearest entry of each part, the lower one of equally near ones, from the entry ``own`` that it had."""
    own = own.astype(np.int64)
    out = own.copy()
    # balls without neighbours and settled balls need no look at all
    rows = np.flatnonzero(~book.settled[own] & (book.neighbours[own] > 1))
    if not len(rows):
        return out
    home = own[rows]
    distance = ((points[rows] - book.entries[home]) ** 2).sum(axis=1)
    core = 4 * distance < book.gaps[home, 1]
    rows, home, distance = rows[~core], home[~core], distance[~core]
    if not len(rows):
        return out
    # the ring: neighbours half the way to which is not beyond the part
    ring = np.minimum((book.gaps[home] <= 4 * distance[:, None]).sum(axis=1), book.neighbours[home])
    ends = np.cumsum(ring)
    row = np.repeat(np.arange(len(rows)), ring)
    entry = book.order[home[row], np.arange(ends[-1]) - np.repeat(ends - ring, ring)]
    far = ((points[rows[row]] - book.entries[entry]) ** 2).sum(axis=1)
    best = np.minimum.reduceat(far, ends - ring)
    entry[far != best[row]] = len(book.entries)
    out[rows] = np.minimum.reduceat(entry, ends - ring)
    return out


def whole_vector(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _pass(rows: DataFrame, books: list[Codebook], width: int) -> DataFrame:
    """``rows`` with their codes renewed, and the squared distance of every part."""
    parts = len(books)
    size = width // parts

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        flat = pa.array(values.reshape(-1), kind)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * parts), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                points = _matrix(batch.column("point"), width)
                codes = _matrix(batch.column("codes"), parts).astype(np.int64)
                far = np.empty_like(codes)
                for p, book in enumerate(books):
                    part = points[:, p * size : (p + 1) * size]
                    codes[:, p] = assign(part, codes[:, p], book)
                    far[:, p] = ((part - book.entries[codes[:, p]]) ** 2).sum(axis=1)
                others = [batch.column(c) for c in ("k", "lab", "point")]
                made = [lists(codes, pa.int32()), lists(far, pa.int64())]
                yield pa.RecordBatch.from_arrays([*others, *made], names=["k", "lab", "point", "codes", "far"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("k", "lab")]
    return rows.mapInArrow(run, ", ".join(kinds) + ", point array<bigint>, codes array<int>, far array<bigint>")


def _sums(rows: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """part, entry, n, radius (squared), total: what the parts of each entry add up to, one row per task and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width // parts
        n = np.zeros(parts * entries, dtype=np.int64)
        radius = np.zeros(parts * entries, dtype=np.int64)
        total = np.zeros((parts * entries, size), dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            place = (_matrix(batch.column("codes"), parts) + np.arange(parts) * entries).reshape(-1)
            points = _matrix(batch.column("point"), width).reshape(-1, size)
            n += np.bincount(place, minlength=len(n))
            np.maximum.at(radius, place, _matrix(batch.column("far"), parts).reshape(-1))
            np.add.at(total, place, points)
        used = np.flatnonzero(n)
        bounds = pa.array(np.arange(len(used) + 1, dtype=np.int32) * size)
        lists = pa.ListArray.from_arrays(bounds, pa.array(total[used].reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(n[used]), pa.array(radius[used]), lists],
            names=["part", "entry", "n", "radius", "total"],
        )

    found = rows.select("codes", "far", "point").mapInArrow(run, "part int, entry int, n bigint, radius bigint, total array<bigint>")
    size = width // parts
    sums = [F.sum(F.element_at("total", i + 1)).alias(f"t{i}") for i in range(size)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), *sums)


def compress(
    table: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """The codes of all usable vectors (key, label, codes, error), and the codebooks (part, entry, component).

    Vectors that are null, empty or hold null or non-finite components are left out, and
    so are vectors whose width is no multiple of ``parts`` or not that of the smallest
    key.  Component x is the integer floor(256 x); results are exact while components
    stay below 2 ** 21.  Codebooks start with the parts of the ``entries`` smallest keys
    (null keys come last, equal keys by vector); fewer rows make smaller codebooks.  Each
    round assigns all parts to the nearest entry, ties to the lower one, and moves each
    entry to the componentwise floor of its parts' mean; unused entries stay.  ``codes``
    are the entries of a last assignment, ``error`` the sum of its squared distances.
    Repeated rows count as often as they stand there; an empty table gives an empty one
    and no entries; other columns are left out.

    The driver holds the codebooks only: parts x entries rows of sums a round.
    """
    if not 2 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("2 to 256 entries, one part or more and no negative number of rounds are needed")
    k, lab, vec = (F.col(f"`{c}`") for c in (key, label, vector))
    rows = table.select(k.alias("k"), lab.alias("lab"), vec.cast("array<double>").alias("v")).where(whole_vector(F.col("v")))
    point = F.transform("v", lambda x: F.floor(x * STEPS).cast("bigint"))
    rows = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)).select("k", "lab", point.alias("point"))

    def smallest() -> list:
        return [r.point for r in rows.orderBy(F.col("k").asc_nulls_last(), "point").limit(entries).collect()]

    start = smallest()
    width = len(start[0]) if start else parts
    rows = rows.where(F.size("point") == width)
    if any(len(p) != width for p in start):
        start = smallest()
    values = np.array(start, dtype=np.int64).reshape(len(start), parts, width // parts)
    if not start:
        values = np.zeros((1, parts, 1), dtype=np.int64)  # for no rows
    books = [codebook(values[:, p]) for p in range(parts)]

    state = rows.withColumn("codes", F.array_repeat(F.lit(0), parts))
    for _ in range(rounds):
        state = cut_lineage(_pass(state, books, width))
        books = _moved(books, _sums(state, parts, len(values), width).collect())
    error = F.aggregate("far", F.lit(0).cast("bigint"), lambda a, x: a + x)
    made = _pass(state, books, width).select(F.col("k").alias(key), F.col("lab").alias(label), "codes", error.alias("error"))
    return made, np.stack([b.entries for b in books])[:, : len(start)]


def _moved(books: list[Codebook], found: list) -> list[Codebook]:
    """New codebooks: entries at the floor of the mean of their parts."""
    entries = [b.entries.copy() for b in books]
    radii = [np.zeros(len(b.entries), dtype=np.int64) for b in books]
    for r in found:
        size = books[r.part].entries.shape[1]
        entries[r.part][r.entry] = [r[f"t{i}"] // r.n for i in range(size)]
        radii[r.part][r.entry] = r.radius
    return [codebook(new, old.entries, radius) for new, old, radius in zip(entries, books, radii)]

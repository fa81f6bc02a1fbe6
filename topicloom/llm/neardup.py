"""Near-duplicate texts by Order MinHash and banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence
number, so every labelled shingle is unique within its text.  A sketch is the
few labelled shingles with the smallest hashes, *in text order*; texts that share
a sketch are candidates.  Candidates are verified by aligning their sequences:
similarity = aligned / (a + b - aligned), which is 1 minus a metric.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.components import components
from topicloom.llm.names import free_name
from topicloom.llm.words import Hasher, find_words, mix, seeds, signed, text_pieces, windows
from topicloom.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8

#: A sketch holds this many shingles; at similarity 0.8 two texts share one with probability 0.51, and none of SKETCHES with 5e-5.
ORDER, SKETCHES = 3, 14

#: Texts of a bucket per task: residents of a block, and visitors.
BLOCK_ROWS, VISITOR_ROWS = 256, 1024

#: Rows per task of small groups taken together.
BATCH_ROWS = 1024

#: Hashes per text that tell, before anything exact, which pairs cannot be similar.  A similarity of 0.8 agrees in
#: 0.8 of them, with a standard deviation of 0.035; AGREE is five of these below.
SIGNATURE, AGREE = 128, 80


def labelled_shingles(words, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every occurrence-labelled shingle, in order.  A text of 1 to size - 1 words is one shingle."""
    at, grams = windows(words, hashes, size)
    doc = words.doc[at]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = []
        for i in short:
            h = hashes[words.first[i] : words.first[i + 1]]
            own.append((h * seeds(size, 11)[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h)))
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, mix(np.array(own, dtype=np.uint64))])
        order = np.argsort(doc, kind="stable")
        doc, grams = doc[order], grams[order]
    if not len(doc):
        return doc, grams
    # number equal shingles of a text from 0 on, in text order
    key = grams ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    run = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    starts = np.flatnonzero(run)
    number = np.empty(len(doc), dtype=np.uint64)
    number[order] = np.arange(len(doc)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(doc)]])))
    return doc, np.where(number > 0, mix(grams + number * np.uint64(0xA24BAED4963EE407)), grams)


def order_sketches(doc: np.ndarray, shingles: np.ndarray, first: np.ndarray, sketches: int, order: int) -> np.ndarray:
    """(texts, sketches) hashes of the ``order`` smallest shingles in text order; ``first`` are the texts' starts, none empty."""
    out = np.empty((len(first), sketches), dtype=np.uint64)
    position = np.arange(len(shingles))
    far = np.uint64((1 << 64) - 1)
    for s, odd in enumerate(seeds(sketches, 23)):
        values = mix(shingles * odd)
        places = np.empty((order, len(first)), dtype=np.int64)
        for k in range(order):
            low = np.minimum.reduceat(values, first)
            hit = np.flatnonzero(values == low[doc])
            # texts with fewer shingles than the order repeat their last ones
            places[k, doc[hit[::-1]]] = position[hit[::-1]]
            values[hit] = far
        chosen = shingles[np.sort(places, axis=0)]
        total = np.zeros(len(first), dtype=np.uint64)
        for k, weight in enumerate(seeds(order, 31)):
            total += mix(chosen[k] * weight)
        out[:, s] = mix(total + np.uint64(s))
    return out


def alignment(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """aligned / (a + b - aligned) of two sequences of unique labelled shingles.

    Only matches within the band in which a similarity of ``least`` is possible
    count, so below ``least`` the value may be too small, never too large.
    """
    if not len(a) or not len(b):
        return 0.0
    band = int((len(a) + len(b)) * (1 - least) / (1 + least) + 1e-9)
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    match = b[order][at] == a
    i, j = np.flatnonzero(match), order[at[match]]
    near = np.abs(i - j) <= band
    j = j[near]
    if len(j) / (len(a) + len(b) - len(j)) < least:
        return len(j) / (len(a) + len(b) - len(j)) * 0.999 if len(j) else 0.0
    aligned = len(j) if (np.diff(j) > 0).all() else _longest_rise(j)
    return aligned / (len(a) + len(b) - aligned)


def _longest_rise(values: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    from bisect import bisect_left

    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return len(tails)


def _sketched(texts: DataFrame) -> DataFrame:
    """k, h1, h2 (a fingerprint of all words), size, sketches of the rows (k, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for piece in text_pieces(batches, "text"):
            w = find_words(piece.column(1))
            doc, shingles = labelled_shingles(w, hasher.spans(w.raw, w.start, w.stop))
            first = np.searchsorted(doc, np.arange(w.texts + 1))
            filled = np.flatnonzero(np.diff(first) > 0)
            if not len(filled):
                continue
            small = np.searchsorted(filled, doc)
            sketches = order_sketches(small, shingles, first[filled], SKETCHES, ORDER)
            starts = first[filled]
            # a fingerprint of the whole sequence: equal for texts with equal words
            place = np.arange(len(doc)) - starts[small]
            prints = [np.add.reduceat(mix(shingles + mix(place.astype(np.uint64) * odd)), starts) for odd in seeds(2, 41)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, SKETCHES * len(filled) + 1, SKETCHES), pa.int32()), pa.array(signed(sketches.reshape(-1)))
            )
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(filled)), *[pa.array(signed(p)) for p in prints], pa.array(np.diff(first)[filled]), lists],
                names=["k", "h1", "h2", "size", "sketches"],
            )

    kind = texts.schema["k"].dataType.simpleString()
    return texts.mapInArrow(run, f"k {kind}, h1 long, h2 long, size long, sketches array<long>")


def _shingled(texts: DataFrame) -> DataFrame:
    """gid, sketches, shingles of the rows (gid, sketches, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for piece in text_pieces(batches, "text"):
            w = find_words(piece.column(2))
            doc, shingles = labelled_shingles(w, hasher.spans(w.raw, w.start, w.stop))
            first = np.searchsorted(doc, np.arange(w.texts + 1))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(signed(shingles)))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), lists], names=["gid", "sketches", "shingles"])

    return texts.mapInArrow(run, "gid long, sketches array<long>, shingles array<long>")


class _Texts:
    """The shingles of the rows of a verification task, in text order and sorted, with signatures and sketches."""

    def __init__(self, table: pa.Table):
        column = table.column("shingles").combine_chunks()
        self.values = column.flatten().to_numpy(zero_copy_only=False)
        self.first = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
        self.size = np.diff(self.first)
        self.ordered = self.values[np.lexsort((self.values, np.repeat(np.arange(len(self.size)), self.size)))]
        self.sketches = table.column("sketches").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCHES)
        self.signature = np.empty((len(self.size), SIGNATURE), dtype=np.uint32)
        values = self.values.view(np.uint64)
        for s, odd in enumerate(seeds(SIGNATURE, 61)):
            self.signature[:, s] = np.minimum.reduceat(mix(values * odd), self.first[:-1]) >> np.uint64(32)

    def sequence(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i + 1]]

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles text ``i`` shares with each of the others."""
        mine, sizes = self.ordered[self.first[i] : self.first[i + 1]], self.size[others]
        starts = np.cumsum(sizes) - sizes
        theirs = self.values[np.repeat(self.first[others] - starts, sizes) + np.arange(sizes.sum())]
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        return np.add.reduceat(hit.astype(np.int64), starts)


def _verify(table: pa.Table) -> pa.Table:
    """Edges (u, v) that connect what is similar within each group.

    Pairs already connected are passed over, and so are pairs that also meet in the
    group of an earlier band.
    """
    home = table.column("home").to_numpy(zero_copy_only=False)
    groups = [table.column(c).to_numpy() for c in ("group", "part", "salt")]
    order = np.lexsort((~home, *groups[::-1]))
    table, home = table.take(pa.array(order)), home[order]
    changed = [g[order][1:] != g[order][:-1] for g in groups]
    cuts = np.concatenate([[0], np.flatnonzero(changed[0] | changed[1] | changed[2]) + 1, [len(home)]])
    gid, label, band = (table.column(c).to_numpy() for c in ("gid", "label", "band"))
    texts = _Texts(table)
    parent = {x: x for x in label.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    u, v = [], []
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        here = first + int(home[first:last].sum())
        size, signature, sketches = texts.size[first:here], texts.signature[first:here], texts.sketches[first:here, : band[first]]
        roots = np.array([root(x) for x in label[first:here].tolist()])
        for i in range(here, last):
            mine = root(int(label[i]))
            small, large = np.minimum(size, texts.size[i]), np.maximum(size, texts.size[i])
            ready = np.flatnonzero((small >= SIMILARITY * large) & (roots != mine) & (gid[first:here] != gid[i]))
            ready = ready[(signature[ready] == texts.signature[i]).sum(axis=1) >= AGREE]
            ready = ready[~(sketches[ready] == texts.sketches[i, : band[first]]).any(axis=1)]
            if not len(ready):
                continue
            shared = texts.shared(i, first + ready)
            near = shared >= SIMILARITY * (size[ready] + texts.size[i] - shared) - 1e-9
            for j in ready[near][np.argsort(-shared[near], kind="stable")].tolist():
                if roots[j] != mine and alignment(texts.sequence(i), texts.sequence(first + j)) >= SIMILARITY:
                    other = int(roots[j])
                    parent[mine] = other
                    roots[roots == mine] = other
                    mine = other
                    u.append(int(gid[i]))
                    v.append(int(gid[first + j]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _meetings(residents: DataFrame, visitors: DataFrame, bodies: DataFrame) -> DataFrame:
    """Edges between the visitors and the residents (group, band, gid, label) of each group.

    Residents of a group are cut into blocks and visitors into shares, so a group of
    any size is many small meetings; small meetings are verified some hundred at a
    time.
    """
    blocks = residents.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    guests = visitors.groupBy("group").agg(F.count(F.lit(1)).alias("_m"))
    plan = blocks.join(guests, "group").select(
        "group", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("parts"), F.ceil(F.col("_m") / VISITOR_ROWS).cast("int").alias("salts"),
        "_n", "_m",
    )
    plan = cut_lineage(plan)
    rows = plan.agg(F.sum(F.col("_n") * F.col("salts") + F.col("_m") * F.col("parts"))).first()[0] or 0
    batches = max(1, -(-int(rows) // BATCH_ROWS))
    part, salt = F.pmod(F.xxhash64("gid"), "parts").cast("int"), F.pmod(F.xxhash64(F.lit(7), "gid"), "salts").cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    plan = plan.drop("_n", "_m")
    at_home = residents.join(plan, "group").select("group", part.alias("part"), span("salts").alias("salt"), "gid", "label", "band", F.lit(True).alias("home"))
    away = visitors.join(plan, "group").select("group", span("parts").alias("part"), salt.alias("salt"), "gid", "label", "band", F.lit(False).alias("home"))
    rows = at_home.unionByName(away).join(bodies, "gid")
    batch = F.pmod(F.xxhash64("group", "part", "salt"), F.lit(batches))
    return rows.groupBy(batch.alias("batch")).applyInArrow(_verify, "u long, v long")


def near_texts(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, kept: one row per row of ``table``.

    Texts whose similarity is at least 0.8 are in one class, and so is what is
    connected by such pairs; ``class_id`` is the class's smallest key.  Case of A to Z
    and white space make no difference.  Null texts and texts without words are
    classes of their own, and so are rows with a null key.  ``kept`` marks the rows
    whose key is their class: one per class, unless a key repeats.  Rows with one key
    and different texts are compared each with its own text.

    Texts with equal words are one representative.  Representatives that share a
    sketch meet the smallest of their bucket first.  What that leaves in a bucket
    beside its largest class meets all of the bucket, in blocks; buckets in one
    class are done.  So a large group of copies costs its size, not its square,
    and no pair of a bucket is left out.
    """
    k, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = table.select(k.alias("k"), body.alias("text"), F.xxhash64(body).alias("t"))
    has_word = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)) & F.col("k").isNotNull()
    worded = rows.where(has_word)
    # a key may stand on rows with different texts, so a row is known by both
    sketched = cut_lineage(_sketched(worded.select(F.struct("k", "t").alias("k"), "text")))
    copies = sketched.groupBy("h1", "h2", "size").agg(F.min("k").alias("rep"), F.any_value("sketches").alias("sketches"))
    copies = cut_lineage(copies.withColumn("gid", F.monotonically_increasing_id()))

    buckets = copies.select("gid", F.posexplode("sketches").alias("band", "print")).select(
        "gid", F.col("band").cast("int").alias("band"), F.xxhash64("band", "print").alias("group")
    )
    shared = buckets.groupBy("group").agg(F.min("gid").alias("pivot"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    members = cut_lineage(buckets.join(shared, "group"))

    # the texts that share a sketch with another one, with their shingles
    wanted = members.select("gid").distinct().join(copies.select("gid", "rep", "sketches"), "gid")
    wanted = wanted.select("gid", "sketches", "rep.k", "rep.t")
    again = worded.join(wanted, ["k", "t"]).dropDuplicates(["gid"]).select("gid", "sketches", "text")
    bodies = cut_lineage(_shingled(again))

    first_band = F.lit(0).alias("band")
    stars = members.where("gid <> pivot").select(F.col("pivot").alias("group"), "gid").distinct()
    stars = stars.select("group", first_band, "gid", F.col("gid").alias("label"))
    pivots = stars.select("group").distinct().select("group", first_band, F.col("group").alias("gid"), F.col("group").alias("label"))
    edges = cut_lineage(_meetings(pivots, stars, bodies))

    comps = components(edges).withColumnRenamed("vertex", "gid")
    labelled = members.join(comps, "gid", "left").select("group", "band", "gid", F.coalesce("comp", "gid").alias("label"))
    parts = labelled.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
    open_groups = cut_lineage(labelled.join(largest.where("parts > 1").select("group", "main"), "group"))
    more = cut_lineage(_meetings(open_groups.drop("main"), open_groups.where("label <> main").drop("main"), bodies))
    known = comps.select(F.col("gid").alias("u"), F.col("comp").alias("v"))
    comps = components(known.unionByName(more)).withColumnRenamed("vertex", "gid")

    named = comps.join(copies.select("gid", "rep"), "gid")
    lowest = named.groupBy("comp").agg(F.min("rep.k").alias("low"))
    classes = copies.select("gid", F.col("rep.k").alias("rep"), "h1", "h2", "size").join(
        comps.join(lowest, "comp").select("gid", "low"), "gid", "left"
    ).select("h1", "h2", "size", F.coalesce("low", "rep").alias("class_id"))
    found = sketched.select("k.k", "h1", "h2", "size").join(classes, ["h1", "h2", "size"]).select("k", "class_id")
    bare = rows.where(~has_word).select("k", F.col("k").alias("class_id"))
    return found.unionByName(bare).select(
        F.col("k").alias(key), "class_id", F.coalesce(F.col("k") == F.col("class_id"), F.lit(True)).alias("kept")
    )


def drop_near_copies(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``table`` with one of each class: the one with the smallest key, once if it repeats.  Null keys stay."""
    chosen = near_texts(table, key, text).where(F.col("kept") & F.col(key).isNotNull()).select(key).distinct()
    nth = free_name(table, "nth")
    rows = table.join(chosen, key, "left_semi").select(*[F.col(f"`{c}`") for c in table.columns])
    same = Window.partitionBy(f"`{key}`", F.md5(f"`{text}`")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in table.columns]))
    once = rows.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(table.where(F.col(f"`{key}`").isNull()))

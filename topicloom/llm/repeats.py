"""Removing passages that repeat within and across documents, by hashing windows of words.

A passage counts if it has more than ``MIN_WORDS`` words; line breaks do not matter.
Every window of that many words and one has an anchor, the half-window with the
smallest hash in it.  Neighbouring windows with the same anchor form a context, and
equal windows lie in contexts of equal anchors.  A context all of whose words
occurred before is found by its digest; the windows of the others are compared one
by one where an anchor has several contexts.  So exactly the words of repeated
passages are found, up to equal 64-bit hashes, and the earliest occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.names import free_name
from topicloom.llm.words import Hasher, Words, chars_before, find_words, mix, seeds, signed, text_pieces
from topicloom.session import cut_lineage

#: Every passage of more words than this that occurred before is found.
MIN_WORDS = 50

_PLACE = ["k", "t", "s"]


def first_smallest(rank: np.ndarray, size: int) -> np.ndarray:
    """For every row of ``size`` numbers, the place of its first smallest one."""
    at, span = np.arange(len(rank)), 1
    while span < size:
        step = min(span, size - span)
        left, right = at[:-step], at[step:]
        at = np.where(rank[right] < rank[left], right, left)
        span += step
    return at


class _Spans:
    """Digests and code points of spans of words of a piece."""

    def __init__(self, texts: pa.Array, hasher: Hasher):
        self.words: Words = find_words(texts)
        self.hashes = hasher.spans(self.words.raw, self.words.start, self.words.stop)
        odd, n = int(seeds(1, 83)[0]), len(self.hashes)
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, odd, np.uint64))])
        self._back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, pow(odd, -1, 1 << 64), np.uint64))])
        self._sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * power[:-1])])
        self._chars = chars_before(self.words.raw)

    def digest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self._sums[last] - self._sums[first]) * self._back[first] + (last - first).astype(np.uint64))

    def columns(self, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
        """s, e (words of the text), start, stop (its code points)."""
        w, doc = self.words, self.words.doc[first]
        origin = self._chars[w.offsets[doc]]
        start, stop = self._chars[w.start[first]] - origin, self._chars[w.stop[last - 1]] - origin
        return [pa.array(x.astype(np.int32)) for x in (first - w.first[doc], last - w.first[doc], start, stop)]

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows that lie in one text."""
        doc = self.words.doc
        return np.flatnonzero(doc[: max(0, len(doc) - size + 1)] == doc[size - 1 :])


def _contexts(rows: DataFrame, size: int) -> DataFrame:
    """k, t, s, e, start, stop, anchor, digest: the contexts of all windows of ``size`` words."""
    half = (size + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for piece in text_pieces(batches, "text"):
            spans = _Spans(piece.column(2), hasher)
            s = spans.windows(size)
            if not len(s):
                continue
            grams = np.arange(len(spans.hashes) - half + 1)
            rank = spans.digest(grams, grams + half)
            at = first_smallest(rank, size - half + 1)[s]
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            first, last = s[begins], s[np.concatenate([begins[1:], [len(s)]]) - 1] + size
            doc = pa.array(spans.words.doc[first])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(doc), piece.column(1).take(doc), *spans.columns(first, last),
                 pa.array(signed(rank[at[begins]])), pa.array(signed(spans.digest(first, last)))],
                names=["k", "t", "s", "e", "start", "stop", "anchor", "digest"],
            )

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, t long, s int, e int, start int, stop int, anchor long, digest long")


def _windows(rows: DataFrame, size: int) -> DataFrame:
    """k, t, s, e, start, stop, digest of the windows within the contexts that are listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for piece in text_pieces(batches, "text"):
            spans = _Spans(piece.column(2), hasher)
            lists = piece.column(3)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            begin = lists.flatten().field(0).to_numpy(zero_copy_only=False) + np.repeat(spans.words.first[:-1], n)
            count = lists.flatten().field(1).to_numpy(zero_copy_only=False) + np.repeat(spans.words.first[:-1], n) - begin - size + 1
            first = np.unique(np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum()))
            doc = pa.array(spans.words.doc[first])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(doc), piece.column(1).take(doc), *spans.columns(first, first + size), pa.array(signed(spans.digest(first, first + size)))],
                names=["k", "t", "s", "e", "start", "stop", "digest"],
            )

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, t long, s int, e int, start int, stop int, digest long")


def _apart(size: int) -> Column:
    """Is the place in another text than ``first``, or so far on that windows do not overlap?"""
    first = F.col("first")
    return (F.col("k") != first["k"]) | (F.col("t") != first["t"]) | (F.col("s") - first["s"] >= size)


def _repeated(rows: DataFrame, size: int) -> DataFrame:
    """k, t, s, e, start, stop, first: spans, overlapping ones among them, that cover all windows that occurred before."""
    contexts = cut_lineage(_contexts(rows, size))
    # pre-aggregated, so a passage of millions of documents is one row per task
    distinct = contexts.groupBy("digest").agg(
        F.min(F.struct(*_PLACE)).alias("first"), F.min_by("e", F.struct(*_PLACE)).alias("e"), F.first("anchor").alias("anchor"), F.count(F.lit(1)).alias("times")
    )
    distinct = cut_lineage(distinct)
    again = contexts.join(distinct.where("times > 1").select("digest", "first"), "digest").where(F.struct(*_PLACE) != F.col("first"))
    again = cut_lineage(again.drop("digest"))
    # anchors with several contexts, or with one that overlaps its own copy
    close = again.where(~_apart(size))
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    anchors = several.union(close.select("anchor")).distinct()
    open_ones = distinct.join(anchors, "anchor").select("first.*", "e").union(close.select(*_PLACE, "e"))
    lists = open_ones.groupBy("k", "t").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    windows = cut_lineage(_windows(rows.join(lists, ["k", "t"]).select("k", "t", "text", "spans"), size))
    first = windows.groupBy("digest").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    single = windows.join(first.select("digest", "first"), "digest").where(_apart(size))
    return again.where(_apart(size)).drop("anchor").unionByName(single.drop("digest"))


def repeated_spans(table: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, length, n_words, first_key, text_hash: the spans that repeat something earlier.

    Offsets are code points of the original text.  Earlier means a smaller key, or
    an earlier place in the same text that does not overlap.  A span is made of all words of
    passages of more than ``min_words`` words that occurred before, each in one place;
    where such passages overlap or touch they are one span, and ``first_key`` is an
    earlier place of the first of them.  Null texts, texts
    without words and null keys yield nothing and hide nothing.  Rows with one
    key and different texts have their own spans, told apart by ``text_hash``, the
    xxhash64 of the text; rows equal in both are one text.
    """
    rows = table.select(F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    found = _repeated(rows.where("k is not null and text is not null"), min_words + 1)
    order = Window.partitionBy("k", "t").orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("s") <= reached, 0).otherwise(1)
    runs = found.withColumn("run", begins).withColumn("run", F.sum("run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a key may stand on several texts, so spans name the text too
    merged = runs.groupBy("k", "t", "run").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        (F.max("e") - F.min("s")).alias("n_words"),
        F.min_by("first.k", F.struct("s", "first.k")).alias("first_key"),
    )
    return merged.select(
        F.col("k").alias(key), F.col("start").cast("long"), (F.col("stop") - F.col("start")).cast("long").alias("length"),
        F.col("n_words").cast("long"), F.col("first_key").alias(f"first_{key}"), F.col("t").alias("text_hash"),
    )


def remove_spans(table: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``table`` with the spans (key, text_hash, start, length) taken out of its texts.

    All rows and columns stay, whatever their names.  A span is taken out of rows
    with its key and its text only; null keys and null texts stay as they are.
    """
    k, t, lists = (free_name(table, c) for c in ("span_key", "span_text", "spans"))
    listed = spans.groupBy(F.col(f"`{key}`").alias(k), F.col("text_hash").alias(t)).agg(
        F.array_sort(F.collect_list(F.struct("start", "length"))).alias(lists)
    )
    body, taken = F.col(f"`{text}`"), F.col(lists)
    joined = table.join(listed, (F.col(f"`{key}`") == F.col(k)) & (F.xxhash64(body) == F.col(t)), "left")

    def kept(i):
        stop = F.when(i == 0, F.lit(0)).otherwise(F.get(taken, i - 1)["start"] + F.get(taken, i - 1)["length"])
        start = F.coalesce(F.get(taken, i)["start"], F.length(body).cast("long"))
        return F.substr(body, (stop + 1).cast("int"), F.greatest(F.lit(0), start - stop).cast("int"))

    parts = F.array_join(F.transform(F.sequence(F.lit(0), F.size(taken)), kept), "")
    return joined.withColumn(text, F.when(taken.isNull(), body).otherwise(parts)).drop(k, t, lists)

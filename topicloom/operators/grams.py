"""Counts of words and n-grams by topic, without a row per occurrence.

Frequent words are numbered, so that an n-gram of them is one long; the n-grams of a batch of
texts are counted there as numbers, and Spark adds up the counts.  An n-gram with a word
that has no number is counted as a string.  Both ways together miss nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Numbered words, which every task holds; the others are counted as strings.
MAX_WORDS = (1 << 18) - 1
# Bits of a number, and rows of a batch that leaves a task.
CODE_BITS, OUT_ROWS = 63, 65_536


@dataclass
class Numbered:
    """Words by number, from 1; 0 is none.  An n-gram is the numbers of its words, ``bits`` each, last word lowest."""

    words: list[str]
    shared: Broadcast

    @property
    def bits(self) -> int:
        return len(self.words).bit_length()

    def table(self, spark: SparkSession) -> DataFrame:
        """_id, word"""
        return spark.createDataFrame(pd.DataFrame({"_id": np.arange(1, len(self.words) + 1), "word": self.words}))

    def codes(self, terms: list[str]) -> np.ndarray:
        """The numbers of n-grams of numbered words, in ascending order."""
        place = {w: i + 1 for i, w in enumerate(self.words)}
        found = np.zeros(len(terms), np.int64)
        for i, term in enumerate(terms):
            for w in term.split(" "):
                found[i] = found[i] << self.bits | place[w]
        return np.sort(found)


def number_words(totals: DataFrame) -> Numbered:
    """Numbers for the most frequent words of ``totals`` (term, total)."""
    top = totals.select("term", "total").orderBy(F.desc("total"), "term").limit(MAX_WORDS)
    words = [r.term for r in top.select("term").collect()]
    return Numbered(words, totals.sparkSession.sparkContext.broadcast(words))


def _flat(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """All words of a batch (topic, words), the row of each, the topics of the batch, and the place of each row's topic there."""
    topics = pc.dictionary_encode(batch.column(0), null_encoding="encode")
    return (
        pc.list_flatten(batch.column(1)), pc.list_parent_indices(batch.column(1)).to_numpy(),
        topics.dictionary, topics.indices.to_numpy().astype(np.int64),
    )


def _batches(schema: pa.Schema, *columns: pa.Array) -> Iterator[pa.RecordBatch]:
    table = pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
    yield from table.to_batches(max_chunksize=OUT_ROWS)


def _counted(topic: np.ndarray, code: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """topic, code, n of the different pairs; codes have ``width`` bits, topics go in groups that the other bits can hold."""
    spare = CODE_BITS - width
    for group in range((int(topic.max(initial=-1)) >> spare) + 1):
        mine = topic >> spare == group
        here = (topic[mine] & ((1 << spare) - 1)) << width | code[mine]
        pair, n = np.unique(here, return_counts=True)
        yield (pair >> width) + (group << spare), pair & ((1 << width) - 1), n


def word_counts(words: DataFrame) -> DataFrame:
    """topic, term, tf of the single words in ``words`` (topic, _words)."""
    topic_type = words.schema["topic"].dataType.simpleString()

    def count(batches):
        for b in batches:
            flat, row, topics, place = _flat(b)
            schema = pa.schema([("topic", topics.type), ("term", pa.string()), ("n", pa.int64())])
            coded = flat.dictionary_encode()
            for t, c, n in _counted(place[row], coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary).bit_length())):
                yield from _batches(schema, topics.take(pa.array(t)), coded.dictionary.take(pa.array(c)), pa.array(n))

    counted = words.select("topic", "_words").mapInArrow(count, f"topic {topic_type}, term string, n long")
    return counted.groupBy("topic", "term").agg(F.sum("n").alias("tf"))


def gram_counts(words: DataFrame, low: int, high: int, numbered: Numbered, only: bool = False, shorter: np.ndarray | None = None) -> DataFrame:
    """topic, term, tf of the n-grams, n = low..high, in ``words`` (topic, _words).

    With ``only``, n-grams with a word that has no number are left out; with ``shorter``
    (low = high), those of which one of the two n-grams one word shorter is not in it.
    """
    bits, shared = numbered.bits, numbered.shared
    topic_type = words.schema["topic"].dataType.simpleString()
    allowed = None if shorter is None else words.sparkSession.sparkContext.broadcast(shorter)

    def count(batches):
        vocabulary = pa.array(shared.value, pa.string())
        for b in batches:
            flat, row, topics, place = _flat(b)
            schema = pa.schema([("topic", topics.type), ("code", pa.int64()), ("term", pa.string()), ("n", pa.int64())])
            flat = flat.cast(pa.string())
            ids = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy().astype(np.int64) + 1
            topic = place[row]
            for n in range(low, high + 1):
                size = max(0, len(ids) - n + 1)
                at = row[len(row) - size :] == row[:size]
                known = np.logical_and.reduce([ids[j : j + size] > 0 for j in range(n)])
                if only:
                    at &= known
                if allowed is not None:
                    part = np.zeros(size + 1, np.int64)
                    for j in range(n - 1):
                        part = part << bits | ids[j : j + size + 1]
                    part = np.isin(part, allowed.value)
                    at &= part[:-1] & part[1:] if size else False
                coded = at & known if n * bits <= CODE_BITS else np.zeros(size, bool)
                code, where = np.zeros(np.count_nonzero(coded), np.int64), np.flatnonzero(coded)
                for j in range(n):
                    code = code << bits | ids[where + j]
                for t, c, k in _counted(topic[where], code, min(CODE_BITS, n * bits)):
                    yield from _batches(schema, topics.take(pa.array(t)), pa.array(c), pa.nulls(len(c), pa.string()), pa.array(k))
                where = np.flatnonzero(at & ~coded)
                for i in range(0, len(where), OUT_ROWS):
                    here = where[i : i + OUT_ROWS]
                    term = pc.binary_join_element_wise(*[flat.take(pa.array(here + j)) for j in range(n)], " ")
                    yield from _batches(schema, topics.take(pa.array(topic[here])), pa.nulls(len(here), pa.int64()), term, pa.array(np.ones(len(here), np.int64)))

    counted = words.select("topic", "_words").mapInArrow(count, f"topic {topic_type}, code long, term string, n long")
    # dealt as they are: most have one topic and come once, so sums before the shuffle would only fill the memory
    summed = counted.repartition("code", "term").groupBy("topic", "code", "term").agg(F.sum("n").alias("tf"))
    if not numbered.words:
        return summed.select("topic", "term", "tf")
    # the words of a number, first to last; leading ones may be none
    listed = F.broadcast(numbered.table(words.sparkSession))
    spelled, names = summed, []
    for j in reversed(range(min(high, CODE_BITS // bits))):
        names.append(f"_w{j}")
        number = F.shiftright("code", bits * j).bitwiseAND(F.lit((1 << bits) - 1))
        spelled = spelled.withColumn("_id", number).join(listed.withColumnRenamed("word", names[-1]), "_id", "left")
    return spelled.select("topic", F.coalesce("term", F.concat_ws(" ", *names)).alias("term"), "tf")

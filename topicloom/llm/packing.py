"""Packing documents into training sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``capacity`` tokens.  The histogram of
piece lengths has at most ``capacity`` entries whatever the corpus size, so the
packing plan (patterns of lengths with the number of sequences that follow each)
is computed on the driver; pieces join their place in the plan by their rank
among the pieces of equal length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.bpe import as_bytes_text, byte_letters, load
from topicloom.llm.words import text_pieces
from topicloom.session import cut_lineage

#: Pieces of one length are ranked in this many parts, so that a frequent length spreads over tasks;
#: those that fill a sequence, the most frequent ones in long documents, in more.
RANK_PARTS, FULL_PARTS = 64, 4096

#: Words remembered per task; the memory is emptied when full, which changes no result.
REMEMBERED = 300_000


class _Memory(dict):
    """Remembers what ``make`` gave for a key."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Token ids of whole texts as little-endian 32-bit numbers.

    ``by_word``: the tokenizer folds case and never joins text across white space,
    so words are encoded one by one and remembered.  Special strings contain no
    white space, so they are found inside words as they are inside texts.  Plain
    words, Latin letters and then punctuation, are cut here and given to the
    library's model; all others go through the whole library.
    """

    def __init__(self, path: str, by_word: bool = True):
        self.tokenizer = load(path)
        self.by_word = by_word
        self.letters = byte_letters()
        self.plain = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([-.,:;!?#*$%&|]*)")
        self.known = _Memory(self._word)
        self.parts = _Memory(self._part)

    def _part(self, part: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(as_bytes_text(part, self.letters))
        return array("I", [t.id for t in tokens]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        found = self.plain.fullmatch(text) if len(text) < 100 else None
        if not found:
            return self._library(text)
        head, tail = found.groups()
        return self.parts[head.lower()] + self.parts[tail] if tail else self.parts[head.lower()]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._library(text.decode())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        return b"".join(map(self.known.__getitem__, text.split()))


def cut_documents(
    table: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, by_word: bool = True, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens: the pieces of every document.

    A document's ids are those of the tokenizer, then ``end_id``; a null text is
    an empty one, so every row has at least one piece.  All pieces but a
    document's last have ``capacity`` ids.
    """
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, by_word)
        end = np.array([end_id], dtype="<u4").tobytes()
        for piece in text_pieces(batches, "_text"):
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(piece.column(1).cast(pa.large_binary()).to_pylist()):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    row.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(row, pa.int64())), *longs], names=[key, "start", "length", "ids_crc32", "doc_tokens"]
            )

    picked = table.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text"))
    return picked.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def plan_packs(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """length, first_rank, first_sequence, offset, n: shortest-pack-first.

    Lengths are placed from the longest down.  The pieces of a length go to the
    shortest open pattern, the one with the most free room, as many pieces as
    there are sequences of that pattern; if none has room, new sequences open.  A
    pattern that is only partly used splits.  Each row of the plan says that the
    pieces of ``length`` with ranks from ``first_rank`` on go to ``n`` successive
    sequences from ``first_sequence`` on, at ``offset``.
    """
    open_packs: dict[int, list[tuple[int, int]]] = {}  # free room -> runs (first sequence, number)
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids does not fit {capacity}")
        left, rank = histogram[length], 0
        while left:
            room = max(open_packs, default=0)
            if room < length:
                fits = max(1, capacity // length)
                # whole sequences filled with this one length, then one for the rest
                full, rest = divmod(left, fits)
                for k, n in ((fits, full), (rest, 1)):
                    if not n or not k:
                        continue
                    for j in range(k):
                        rows.append((length, rank, sequences, j * length, n))
                        rank += n
                    if capacity - k * length:
                        open_packs.setdefault(capacity - k * length, []).append((sequences, n))
                    sequences += n
                left = 0
                break
            first, n = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
            used = min(n, left)
            rows.append((length, rank, first, capacity - room, used))
            if used < n:
                open_packs.setdefault(room, []).append((first + used, n - used))
            if room > length:
                open_packs.setdefault(room - length, []).append((first, used))
            rank, left = rank + used, left - used
    return pd.DataFrame(rows, columns=["length", "first_rank", "first_sequence", "offset", "n"]).astype("int64")


def pack(pieces: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Pieces of one length are ranked by (key, start) within ``RANK_PARTS`` parts;
    the parts' sizes, at most capacity * RANK_PARTS + FULL_PARTS numbers, give each
    part its first rank.  The result depends on the pieces only, not on their partitions.
    """
    spark = pieces.sparkSession
    parts = F.when(F.col("length") == capacity, FULL_PARTS).otherwise(RANK_PARTS)
    part = F.pmod(F.xxhash64(F.col(key), "start"), parts).cast("int")
    pieces = cut_lineage(pieces.withColumn("_part", part))
    sizes = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["length", "_part"])
    plan = plan_packs(sizes.groupby("length")["n"].sum().to_dict(), capacity)
    sizes["_before"] = sizes.groupby("length")["n"].cumsum() - sizes["n"]
    # rows of the plan cut at the borders of the parts, so that a piece finds its row by equality and a range of few rows
    steps = []
    for length, rows in plan.groupby("length"):
        parts = sizes[sizes["length"] == length]
        low = np.unique(np.concatenate([rows["first_rank"], parts["_before"]]))
        low = low[low < int(parts["n"].sum())]
        at = np.searchsorted(rows["first_rank"].to_numpy(), low, side="right") - 1
        inside = np.searchsorted(parts["_before"].to_numpy(), low, side="right") - 1
        chosen = rows.iloc[at]
        shift = low - chosen["first_rank"].to_numpy()
        steps.append(pd.DataFrame({
            "length": length,
            "_part": parts["_part"].to_numpy()[inside],
            "low": low - parts["_before"].to_numpy()[inside],
            "sequence": chosen["first_sequence"].to_numpy() + shift,
            "place": chosen["offset"].to_numpy(),
        }))
    columns = ["length", "_part", "low", "sequence", "place"]
    table = (pd.concat(steps)[columns] if steps else pd.DataFrame(columns=columns)).astype("int64")
    flat = spark.createDataFrame(table, "length long, _part long, low long, sequence long, place long")
    step = F.struct("low", "sequence", "place")
    places = flat.groupBy("length", F.col("_part").cast("int").alias("_part")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    ranked = pieces.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(key, "start", "ids_crc32")).cast("long") - 1
    )
    step = F.element_at(F.filter("steps", lambda s: s["low"] <= F.col("_rank")), -1)
    placed = ranked.join(places, ["length", "_part"]).withColumn("_step", step)
    return placed.select(
        *[c for c in pieces.columns if c != "_part"],
        (F.col("_step.sequence") + F.col("_rank") - F.col("_step.low")).alias("sequence_id"),
        F.col("_step.place").alias("offset"),
    )

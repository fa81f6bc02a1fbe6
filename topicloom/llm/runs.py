"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run is a longest stretch of words that repeats with a smallest period q, at least
twice and over at least ``MIN_WORDS`` words.  So every word of a run occurs twice or
more in it, and a word that occurs once in a segment is in no run there: it splits the
segment.  The parts are counted anew until nothing splits.  In what survives, every
lag q is tried at places so far apart that a run of period q covers one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from topicloom.llm.words import Hasher, Words, find_words, text_pieces

#: The shortest run.
MIN_WORDS = 12

#: Words a word may be counted over, on average, before its segment goes to the lag scan unsplit.  Changes no result.
COUNTED = 64

#: Numbers in flight at a time.
BLOCK = 1 << 20


def spread_out(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), start[1], ... in one flat array."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def word_numbers(words: Words, hasher: Hasher) -> np.ndarray:
    """Equal numbers for equal words, and only for these."""
    length = words.stop - words.start
    _, first, number = np.unique(hasher.spans(words.raw, words.start, words.stop), return_index=True, return_inverse=True)
    twin = first[number]
    same = (length[twin] == length).all()
    for i in range(0, len(length) if same else 0, BLOCK // 8):
        part = slice(i, i + BLOCK // 8)
        here, there = spread_out(words.start[part], length[part]), spread_out(words.start[twin[part]], length[part])
        same = same and (words.raw[here] == words.raw[there]).all()
    if same:
        return number
    known: dict[bytes, int] = {}  # equal hashes of different words
    raw = words.raw.tobytes()
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(words.start.tolist(), words.stop.tolist())])


def split_segments(x: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The segments of words ``x`` that survive recursive splitting at words that occur once in their segment."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    kinds, budget = int(x.max(initial=0)) + 1, COUNTED * max(1, len(x))
    while True:
        long_enough = end - begin >= least
        begin, end = begin[long_enough], end[long_enough]
        size = end - begin
        budget -= int(size.sum())
        if budget < 0 or not len(begin):
            kept.append((begin, end))
            break
        at, segment = spread_out(begin, size), np.repeat(np.arange(len(size)), size)
        _, which, counts = np.unique(segment * kinds + x[at], return_inverse=True, return_counts=True)
        frequent = counts[which] > 1
        rare = np.bincount(segment, weights=~frequent, minlength=len(size)) > 0
        kept.append((begin[~rare], end[~rare]))
        # neighbouring frequent words of a split segment are the next segments
        at, segment = at[frequent & rare[segment]], segment[frequent & rare[segment]]
        if not len(at):
            break
        fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])])
        starts = np.flatnonzero(fresh)
        begin, end = at[starts], at[np.append(starts[1:], len(at)) - 1] + 1
    return np.concatenate([b for b, _ in kept]), np.concatenate([e for _, e in kept])


class Stretches:
    """How far words of ``x`` and words some places on stay equal, exactly.

    Level k numbers the windows of 2 ** k words, equal ones alike, so a longest common
    stretch takes one comparison a level however much the text repeats.
    """

    def __init__(self, x: np.ndarray, longest: int):
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= min(longest, len(x)):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def on(self, at: np.ndarray, lag: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from ``at`` on, at most ``limit``."""
        n = np.zeros(len(at), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            open_ = np.flatnonzero(n + (1 << k) <= limit)
            here = (at + n)[open_]
            n[open_[self.levels[k][here] == self.levels[k][here + lag[open_]]]] += 1 << k
        return n

    def back(self, at: np.ndarray, lag: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words before ``at``, at most ``limit``."""
        n = np.zeros(len(at), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            open_ = np.flatnonzero(n + (1 << k) <= limit)
            here = (at - n)[open_] - (1 << k)
            n[open_[self.levels[k][here] == self.levels[k][here + lag[open_]]]] += 1 << k
        return n


def scan_lags(x: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, stop, period of the runs within the segments, by start and period."""
    found = [np.zeros((3, 0), dtype=np.int64)]
    total = np.cumsum(end - begin)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, BLOCK)), len(begin)))
    for first, last in zip(cuts[:-1], cuts[1:]):
        size = (end - begin)[first:last]
        at = np.cumsum(size) - size
        stretches = Stretches(x[spread_out(begin[first:last], size)], int(size.max()))
        owner = np.repeat(np.arange(len(size)), size // 2)
        lag = spread_out(np.ones(len(size), dtype=np.int64), size // 2)
        need = np.maximum(least - lag, lag)  # words that a run of this period has in common with the words a lag on
        places = (size[owner] - lag - 1) // need + 1
        bounds = np.cumsum(places)
        stops = np.unique(np.append(np.searchsorted(bounds, np.arange(BLOCK, bounds[-1], BLOCK)), len(lag)))
        for a, b in zip(np.concatenate([[0], stops[:-1]]), stops):
            own = owner[a:b]
            runs = _stretches(stretches, at[own], at[own] + size[own], lag[a:b], need[a:b], places[a:b])
            # back from the words of the block to those of the text
            shift = begin[first + np.searchsorted(at, runs[0], side="right") - 1] - at[np.searchsorted(at, runs[0], side="right") - 1]
            found.append(_smallest(np.stack([runs[0] + shift, runs[1] + shift, runs[2]])))
    start, stop, lag = _smallest(np.concatenate(found, axis=1))
    order = np.lexsort((lag, start))
    return start[order], stop[order], lag[order]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """A stretch that has several periods is a run of the smallest."""
    start, stop, lag = runs
    order = np.lexsort((lag, stop, start))
    start, stop = start[order], stop[order]
    once = np.concatenate([[True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])])[: len(start)]
    return runs[:, order[once]]


def _stretches(words: Stretches, begin, end, lag, need, places) -> np.ndarray:
    """start, stop, lag of longest stretches in which all words equal the word a lag on, over ``need`` words or more."""
    x = words.levels[0]
    at = np.repeat(begin, places) + spread_out(np.zeros(len(places), np.int64), places) * np.repeat(need, places)
    begin, end, lag, need = (np.repeat(v, places) for v in (begin, end, lag, need))
    hit = np.flatnonzero(x[at] == x[at + lag])
    at, begin, end, lag, need = at[hit], begin[hit], end[hit], lag[hit], need[hit]
    back = words.back(at, lag, np.minimum(at - begin, need))
    new = back < need  # else the place before lies in the same stretch
    at, end, lag, need, back = at[new], end[new], lag[new], need[new], back[new]
    on = words.on(at, lag, end - lag - at)
    runs = back + on >= need
    return np.stack([(at - back)[runs], (at + on + lag)[runs], lag[runs]])


def find_runs(x: np.ndarray, first: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, length, period of all runs; text i has the words ``x[first[i] : first[i + 1]]``."""
    begin, end = split_segments(x, first[:-1], first[1:], least)
    start, stop, period = scan_lags(x, begin, end, least)
    text = np.searchsorted(first, start, side="right") - 1
    return text, start - first[text], stop - start, period


def _collapse(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    length, doc = (words.stop - words.start)[kept], words.doc[kept]
    per_text = np.bincount(doc, weights=length + 1, minlength=words.texts).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.maximum(per_text - 1, 0))])
    filled = np.cumsum(per_text > 0) - 1
    out = np.full(bounds[-1], 32, dtype=np.uint8)
    begin = np.cumsum(length + 1) - (length + 1) - filled[doc]
    source = words.start[kept]
    for i in range(0, len(kept), BLOCK // 8):
        part = slice(i, i + BLOCK // 8)
        out[spread_out(begin[part], length[part])] = words.raw[spread_out(source[part], length[part])]
    buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]
    return pa.Array.from_buffers(pa.large_string(), words.texts, buffers)


def periodic_runs(table: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``table`` without its text, with ``runs``, ``collapsed`` and ``n_words``.

    ``runs`` holds (start, length, period) of every run of at least ``min_words``
    words, by start, then period; words are longest stretches without space and 0x09
    to 0x0D, numbered from 0, and compared byte by byte.  ``collapsed`` is the text
    without the words that any run repeats after its first period, joined by one
    space.  Null texts count as empty: no runs, an empty ``collapsed``.  Texts are
    taken whole; a text of n words costs n log n steps whatever it repeats.  Rows stay
    one to one, repeated ones and null keys too; an empty table gives an empty one.
    Columns of ``table`` named like a result are replaced, all others stay.  One pass,
    no shuffle.
    """
    made = ["runs", "collapsed", "n_words"]
    others = [c for c in table.columns if c not in (text, *made)]
    run_type = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])
    schema = StructType(
        [StructField(c, table.schema[c].dataType, True) for c in others]
        + [StructField("runs", ArrayType(run_type, False)), StructField("collapsed", StringType()), StructField("n_words", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=False)
        for piece in text_pieces(batches, text):
            words = find_words(piece.column(len(others)))
            owner, start, length, period = find_runs(word_numbers(words, hasher), words.first, min_words)
            # words in a run after its first period
            change = np.zeros(len(words.start) + 1, dtype=np.int64)
            np.add.at(change, words.first[owner] + start + period, 1)
            np.add.at(change, words.first[owner] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
            fields = [pa.field(c, pa.int64(), nullable=False) for c in ("start", "length", "period")]
            structs = pa.StructArray.from_arrays([pa.array(v) for v in (start, length, period)], fields=fields)
            bounds = np.searchsorted(owner, np.arange(words.texts + 1)).astype(np.int32)
            kind = pa.list_(pa.field("element", structs.type, nullable=False))
            lists = pa.ListArray.from_arrays(pa.array(bounds), structs, type=kind)
            columns = [piece.column(i) for i in range(len(others))]
            collapsed = _collapse(words, kept).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, lists, collapsed, pa.array(np.diff(words.first))], names=[*others, *made])

    picked = table.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias(text))
    return picked.mapInArrow(run, schema)

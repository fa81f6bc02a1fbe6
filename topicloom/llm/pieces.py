"""SentencePiece encoding and decoding of whole texts by vectorised merge rounds.

The model is a BPE file of the sentencepiece library with identity normaliser and
byte fallback.  A text becomes a flat array of symbols.  Between two characters that
stand next to each other in no piece nothing can ever merge, so texts are cut there
into words, and equal words are merged once.  In a round every word looks up the
smallest rank among its pairs and merges the places that have it, from the left;
words without a pair leave, and the rest is compacted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from topicloom.llm.words import mix, seeds, text_pieces

#: Characters handled at a time; a longer text is handled in parts that end at a cut.
BLOCK_CHARS = 1 << 20

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_SHIFT = 21


class Lookup:
    """Positions of 64-bit keys in a fixed set of distinct keys; ``len(keys)`` for others."""

    def __init__(self, keys: np.ndarray):
        self.none = len(keys)
        bits = max(4, int(len(keys)).bit_length() + 3)
        self.odd, self.down = seeds(1, 91)[0], np.uint64(64 - bits)
        order = np.argsort(keys)
        slot = self._slot(keys)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.at = np.full(1 << bits, self.none, dtype=np.int32)
        self.keys[slot[order]], self.at[slot[order]] = keys[order], order
        # keys that lost their slot to another one are searched in a sorted list
        lost = order[self.keys[slot[order]] != keys[order]]
        self.more, self.more_at = keys[lost], lost.astype(np.int32)
        self.crowded = np.zeros(1 << bits, dtype=bool)
        self.crowded[slot[lost]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.odd) >> self.down).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        own = self.keys[slot] == keys
        found = np.where(own, self.at[slot], self.none)
        left = np.flatnonzero(~own & self.crowded[slot])
        if len(left):
            at = np.minimum(np.searchsorted(self.more, keys[left]), len(self.more) - 1)
            found[left] = np.where(self.more[at] == keys[left], self.more_at[at], self.none)
        return found


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << _SHIFT) | right.astype(np.int64)


def spread_out(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), start[1], ... in one flat array."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Pieces:
    """What encoding and decoding need of a model; bounded by its vocabulary, so it may be broadcast."""

    size: int
    unknown: int
    end: int
    letters: np.ndarray  # code points that have symbols of their own, ascending
    symbols: np.ndarray  # and these symbols
    keys: np.ndarray  # pairs that merge
    ranks: np.ndarray  # their ranks, the smallest first
    merged: np.ndarray  # and what they merge to
    neighbours: np.ndarray  # pairs of symbols of characters that stand side by side in a piece
    bytes_from: int  # the piece of byte 0
    surface: np.ndarray  # bytes that the pieces decode to, one after the other
    bounds: np.ndarray  # where each piece's bytes begin
    kind: np.ndarray
    spaced: np.ndarray  # normal pieces that begin with a space


def load(path: str) -> Pieces:
    """Read a model file.  Models that this module does not cover raise ValueError."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(path, "rb") as f:
        raw = f.read()
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(raw)
    rule, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
    plain = not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
    if not plain or spec.trainer_spec.model_type != 2 or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{os.path.basename(path)}: only BPE models with identity normaliser are covered")
    if not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or _BYTE not in kinds or spec.denormalizer_spec.precompiled_charsmap:
        raise ValueError(f"{os.path.basename(path)}: only models with byte fallback and without user-defined pieces are covered")
    processor = SentencePieceProcessor(model_proto=raw)
    kind = np.array([p.type for p in spec.pieces], dtype=np.int8)
    size = len(kind)
    ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
    names = dict(ids)
    for c in sorted({c for p in ids for c in p} - set(ids)):
        names[c] = size + len(names) - len(ids)  # a character that occurs in pieces but is none
    letters = sorted(c for c in names if len(c) == 1)

    scores = sorted({-spec.pieces[i].score for i in ids.values()})
    rank_of = {s: r for r, s in enumerate(scores)}
    pairs = {}
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = names.get(piece[:cut]), names.get(piece[cut:])
            if left is not None and right is not None:
                pairs[left << _SHIFT | right] = (rank_of[-spec.pieces[i].score], i)
    beside = {names[a] << _SHIFT | names[b] for piece in ids for a, b in zip(piece, piece[1:])}

    byte_ids = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if byte_ids != list(range(byte_ids[0], byte_ids[0] + 256)):
        raise ValueError(f"{os.path.basename(path)}: byte pieces are not in order")
    surfaces = []
    for i, p in enumerate(spec.pieces):
        if p.type == _BYTE:
            surfaces.append(bytes([i - byte_ids[0]]))
        elif p.type == _UNKNOWN:
            surfaces.append(spec.trainer_spec.unk_surface.encode())
        else:
            surfaces.append(b"" if p.type == _CONTROL else p.piece.replace(SPACE, " ").encode())
    return Pieces(
        size, processor.unk_id(), processor.eos_id(),
        np.array([ord(c) for c in letters]), np.array([names[c] for c in letters], dtype=np.int32),
        np.array(list(pairs), dtype=np.int64), np.array([r for r, _ in pairs.values()], dtype=np.int32),
        np.array([i for _, i in pairs.values()], dtype=np.int32), np.array(sorted(beside), dtype=np.int64), byte_ids[0],
        np.frombuffer(b"".join(surfaces), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in surfaces])]),
        kind, np.array([p.type == _NORMAL and p.piece.startswith(SPACE) for p in spec.pieces]),
    )


class Encoder:
    """Token ids of texts; equal to the library's for every text."""

    def __init__(self, pieces: Pieces):
        self.pieces = p = pieces
        # other characters are symbols that merge with nothing
        self.others = p.size + len(p.letters)
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.others
        self.symbol[p.letters] = p.symbols
        self.pairs, self.beside = Lookup(p.keys), Lookup(p.neighbours)
        self.far = np.int32(np.iinfo(np.int32).max)
        self.rank = np.append(p.ranks, self.far)
        self.power = self.back = np.ones(0, dtype=np.uint64)

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has.  ``end`` adds the end id to each text."""
        parts, counts = [], np.zeros(len(texts), dtype=np.int64)
        first, held = 0, 0
        for i, text in enumerate(texts):
            if len(text) > BLOCK_CHARS or held + len(text) > BLOCK_CHARS:
                parts.append(self._whole(texts[first:i], counts[first:i], end))
                first, held = i, 0
            if len(text) > BLOCK_CHARS:
                parts.append(self._long(text, counts[i : i + 1], end))
                first = i + 1
            else:
                held += len(text) + 1
        parts.append(self._whole(texts[first:], counts[first:], end))
        return np.concatenate(parts), counts

    def _symbols(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]

    def _whole(self, texts: list[str], counts: np.ndarray, end: bool) -> np.ndarray:
        """Ids of texts that are handled together; their numbers are put into ``counts``."""
        if not texts:
            return np.zeros(0, dtype=np.int32)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts])
        symbols = self._symbols("".join(SPACE + t for t in texts if t).replace(" ", SPACE))
        begins = np.cumsum(sizes) - sizes
        cut = self._cuts(symbols)
        cut[begins[sizes > 0]] = True
        ids, per_word = self._encode_words(symbols, cut)
        if len(symbols):
            owner = np.searchsorted(begins[sizes > 0], np.flatnonzero(cut), side="right") - 1
            counts[sizes > 0] = np.bincount(owner, weights=per_word, minlength=(sizes > 0).sum()).astype(np.int64)
        if not end:
            return ids
        out = np.full(len(ids) + len(texts), self.pieces.end, dtype=np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), counts)] = ids
        counts += 1
        return out

    def _long(self, text: str, count: np.ndarray, end: bool) -> np.ndarray:
        """Ids of one long text, part by part; a part ends where nothing can merge."""
        parts, held, at = [], SPACE, 0
        while at < len(text):
            held += text[at : at + BLOCK_CHARS].replace(" ", SPACE)
            at += BLOCK_CHARS
            symbols = self._symbols(held)
            cut = self._cuts(symbols)
            stop = len(symbols) if at >= len(text) else int(np.flatnonzero(cut)[-1])
            if stop:
                parts.append(self._encode_words(symbols[:stop], cut[:stop])[0])
                held = held[stop:]
        if end:
            parts.append(np.array([self.pieces.end], dtype=np.int32))
        count[0] = sum(map(len, parts))
        return np.concatenate(parts)

    def _cuts(self, symbols: np.ndarray) -> np.ndarray:
        """Marks the symbols that begin a word: nothing merges across from the symbol before."""
        cut = np.ones(len(symbols), dtype=bool)
        cut[1:] = self.beside.find(_pair_keys(symbols[:-1], symbols[1:])) == self.beside.none
        return cut

    def _encode_words(self, symbols: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each word has."""
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(symbols)))
        first, word = self._distinct(symbols, start, length)
        flat, count = self._merge(symbols[spread_out(start[first], length[first])], length[first])
        flat, count = self._bytes(flat, count)
        begin = np.cumsum(count) - count
        return flat[spread_out(begin[word], count[word])], count[word]

    def _distinct(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of each group of equal words, and the group of each word."""
        if len(self.power) < len(symbols):
            base = int(seeds(1, 93)[0])
            self.power = np.cumprod(np.full(len(symbols), base, np.uint64))
            self.back = np.cumprod(np.full(len(symbols), pow(base, -1, 1 << 64), np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(1)) * self.power[: len(symbols)])])
        digest = mix((sums[start + length] - sums[start]) * self.back[start] + length.astype(np.uint64))
        _, first, word = np.unique(digest, return_index=True, return_inverse=True)
        same = (length[first[word]] == length).all()
        if same and (symbols[spread_out(start[first[word]], length)] == symbols).all():
            return first, word
        return np.arange(len(start)), np.arange(len(start))  # equal digests of different words

    def _merge(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words laid end to end; the symbols left, and how many each word has."""
        word = np.repeat(np.arange(len(length)), length)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(begin, len(word)))
            pair = np.full(len(symbols), self.pairs.none, dtype=np.int32)
            pair[:-1] = np.where(word[1:] == word[:-1], self.pairs.find(_pair_keys(symbols[:-1], symbols[1:])), self.pairs.none)
            rank = self.rank[pair]
            least = np.minimum.reduceat(rank, begin)
            over = least == self.far
            if over.any():
                finished = np.repeat(over, size)
                done.append((word[finished], symbols[finished]))
                open_ = ~finished
                symbols, word, pair, rank = symbols[open_], word[open_], pair[open_], rank[open_]
                size, least = size[~over], least[~over]
                begin = np.cumsum(size) - size
                if not len(symbols):
                    break
            at = self._places(symbols, word, rank, pair, np.repeat(least, size), begin, size)
            symbols[at] = self.pieces.merged[pair[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return symbols, np.zeros(len(length), dtype=np.int64)
        owner = np.concatenate([w for w, _ in done])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([s for _, s in done])[order], np.bincount(owner, minlength=len(length))

    def _places(self, symbols, word, rank, pair, least, begin, size) -> np.ndarray:
        """Left symbols of the pairs to merge in this round.

        They have the least rank of their word and do not overlap.  Where a merge
        makes a pair that would have to come before the word's next place, the word
        merges its first place only, as one merge at a time would.
        """
        chosen = np.flatnonzero(rank == least)
        # in a row of overlapping pairs, every second one from the left
        row = np.concatenate([[True], chosen[1:] != chosen[:-1] + 1])
        starts = np.flatnonzero(row)
        nth = np.arange(len(chosen)) - np.repeat(starts, np.diff(np.append(starts, len(chosen))))
        at = chosen[nth % 2 == 0]
        new = self.pieces.merged[pair[at]]
        owner = word[at]
        early = np.zeros(len(at), dtype=bool)
        right = at + 2
        has = (right < len(symbols)) & (word[np.minimum(right, len(word) - 1)] == owner)
        early[has] |= self.rank[self.pairs.find(_pair_keys(new[has], symbols[right[has]]))] <= least[at[has]]
        has = (at > 0) & (word[at - 1] == owner)
        left = symbols[at - 1].copy()
        close = np.concatenate([[False], at[1:] == at[:-1] + 2])
        left[close] = new[:-1][close[1:]]
        early[has] |= self.rank[self.pairs.find(_pair_keys(left[has], new[has]))] <= least[at[has]]
        if not early.any():
            return at
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        group = np.cumsum(first) - 1
        unsafe = np.bincount(group, weights=early) > 0
        return at[first | ~unsafe[group]]

    def _bytes(self, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with the UTF-8 bytes of characters that are no piece."""
        p = self.pieces
        odd = symbols >= p.size
        if not odd.any():
            return symbols, count
        code = symbols.astype(np.int64) - self.others
        spare = odd & (code < 0)  # characters that occur in pieces but are none
        if spare.any():
            order = np.argsort(p.symbols)
            code[spare] = p.letters[order][np.searchsorted(p.symbols[order], symbols[spare])]
        width = np.where(odd, 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000), 1)
        word = np.repeat(np.arange(len(count)), count)
        flat, k = np.repeat(symbols, width), spread_out(np.zeros(len(width), np.int64), width)
        hit = np.repeat(odd, width)
        code, width_at, k = np.repeat(code, width)[hit], np.repeat(width, width)[hit], k[hit]
        bits = code >> (6 * (width_at - 1 - k))
        lead = np.array([0, 0xC0, 0xE0, 0xF0])[width_at - 1]
        flat[hit] = p.bytes_from + np.where(k == 0, lead | bits, 0x80 | (bits & 0x3F))
        return flat, np.bincount(word, weights=width, minlength=len(count)).astype(np.int64)


class Decoder:
    """Texts of token ids; equal to the library's decode."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """One text for each of ``counts`` consecutive runs of ids.  Ids outside the vocabulary raise ValueError."""
        p = self.pieces
        if len(ids) and (ids.min() < 0 or ids.max() >= p.size):
            raise ValueError("token id outside the vocabulary")
        ends = np.cumsum(counts)
        begins = ends - counts
        owner = np.repeat(np.arange(len(counts)), counts)
        start, width = p.bounds[ids], p.bounds[ids + 1] - p.bounds[ids]
        # the space that encoding put before a text goes
        said = np.flatnonzero(p.kind[ids] != _CONTROL)
        lead = said[np.concatenate([[True], owner[said][1:] != owner[said][:-1]])] if len(said) else said
        lead = lead[p.spaced[ids[lead]]]
        start[lead] += 1
        width[lead] -= 1
        data = p.surface[spread_out(start, width)]
        totals = np.concatenate([[0], np.cumsum(width)])
        bounds = np.append(totals[begins], len(data)).astype(np.int64) if len(counts) else np.zeros(1, np.int64)
        raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        if not (p.kind[ids] == _BYTE).any():
            return raw.cast(pa.large_string())
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([_valid(raw[i].as_py()) for i in range(len(counts))], pa.large_string())


def _valid(raw: bytes) -> str:
    """The text with every byte that begins no valid character replaced by U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(raw[at : at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


def _others(table: DataFrame, replaced: list[str]) -> tuple[list[str], list[StructField]]:
    names = [c for c in table.columns if c not in replaced]
    return names, [StructField(c, table.schema[c].dataType, True) for c in names]


def encode_texts(table: DataFrame, path: str, text: str = "text", end: bool = True) -> DataFrame:
    """``table`` without its text, with ``ids`` (array of int) and ``n_tokens`` (long).

    The ids are those of the sentencepiece library with the model at ``path``, no
    sampling, no begin id; ``end`` adds the end id.  A null text counts as an empty
    one, which has no ids but the end id.  Texts are encoded whole, long ones part by
    part.  Rows stay one to one, repeated ones and null keys too; an empty table
    gives an empty one.  Columns of ``table`` named like a result are replaced, all
    others stay.  One pass, no shuffle.
    """
    others, fields = _others(table, [text, "ids", "n_tokens"])
    model = table.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for piece in text_pieces(batches, text):
            ids, counts = encoder.encode(piece.column(piece.num_columns - 1).to_pylist(), end)
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
            columns = [piece.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(counts)], names=[*others, "ids", "n_tokens"])

    picked = table.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias(text))
    schema = StructType([*fields, StructField("ids", ArrayType(IntegerType()), True), StructField("n_tokens", LongType(), True)])
    return picked.mapInArrow(run, schema)


def decode_ids(table: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``table`` with the texts of its ``ids`` in column ``text``, as the library's decode gives them.

    Null ids give an empty text, null elements count as the unknown piece.  Bytes that
    form no character become U+FFFD.  Rows stay one to one; a column of ``table``
    named ``text`` is replaced, all others stay.  One pass, no shuffle.
    """
    others, fields = _others(table, [text])
    place = others.index(ids)
    model = table.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(place).fill_null([]) if batch.column(place).null_count else batch.column(place)
            counts = np.asarray(lists.value_lengths(), dtype=np.int64)
            values = lists.flatten().fill_null(decoder.pieces.unknown).to_numpy(zero_copy_only=False).astype(np.int64)
            done, row = np.concatenate([[0], np.cumsum(counts)]), 0
            while row < len(counts):
                # a bounded number of ids at a time, or one longer text
                stop = max(row + 1, int(np.searchsorted(done, done[row] + BLOCK_CHARS, side="right")) - 1)
                texts = decoder.decode(values[done[row] : done[stop]], counts[row:stop])
                columns = [c.slice(row, stop - row) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, texts.cast(pa.string())], names=[*others, text])
                row = stop

    picked = table.select(*[F.col(f"`{c}`") for c in others])
    return picked.mapInArrow(run, StructType([*fields, StructField(text, StringType(), True)]))

"""Token counts with a shortcut for words that are a single token.

The tokenizer is a byte-level BPE file of the tokenizers library.  A vocabulary
string is *whole* if the library, given that string alone, returns one token;
this is proved once for the whole vocabulary.  A text is cut into pre-tokens;
whole ones count as one token without any merge, and only the rest is merged by
the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.bpe import as_bytes_text, byte_letters, load, special_strings
from topicloom.llm.words import text_pieces

# fixed value: the pattern that byte-level BPE cuts pre-tokens with
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Up to here all versions of Unicode agree on letters and digits; pieces with later characters go to the library uncut.
LAST_SURE = "\u052f"

#: Pieces remembered per task; the memory is emptied when it is full, which changes no result.
REMEMBERED = 400_000


def whole_strings(path: str) -> frozenset[str]:
    """Vocabulary strings that encode, alone, as one pre-token and one token.

    Bounded by the vocabulary (about 50,000 strings), so it may be broadcast.
    """
    tokenizer = load(path)
    special = set(special_strings(tokenizer))
    ids = range(tokenizer.get_vocab_size(with_added_tokens=False))
    strings = sorted({tokenizer.decode([i], skip_special_tokens=False) for i in ids} - special - {""})
    strings = [s for s in strings if "\ufffd" not in s and max(s) <= LAST_SURE]
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    cut = regex.compile(PRE_TOKENS)
    return frozenset(s for s, e in zip(strings, encoded) if len(e.ids) == 1 and cut.findall(s) == [s])


class Counter:
    """Counts tokens of whole texts; equal to the library's count for every text."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer = load(path)
        self.special = special_strings(self.tokenizer)
        self.whole = whole
        self.cut = regex.compile(PRE_TOKENS)
        self.letters = byte_letters()
        self.known: dict[str, int] = dict.fromkeys(whole, 1)

    def _remember(self, piece: str, n: int) -> None:
        if len(piece) < 100:
            if len(self.known) >= REMEMBERED + len(self.whole):
                self.known = dict.fromkeys(self.whole, 1)
            self.known[piece] = n

    def _merge(self, piece: str) -> int:
        """Tokens of a piece that starts and ends at pre-token boundaries."""
        if piece and max(piece) > LAST_SURE:
            return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        total = 0
        for part in self.cut.findall(piece):
            n = self.known.get(part)
            if n is None:
                n = len(self.tokenizer.model.tokenize(as_bytes_text(part, self.letters)))
                self._remember(part, n)
            total += n
        return total

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            # special strings cut the text before anything else does
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        # a space before anything but white space begins a pre-token
        pieces = text.split(" ")
        if any(not p or p[0].isspace() for p in pieces[1:]):
            joined = [pieces[0]]
            for p in pieces[1:]:
                if not p or p[0].isspace():
                    joined[-1] += " " + p
                else:
                    joined.append(" " + p)
        else:
            joined = [pieces[0]] + [" " + p for p in pieces[1:]]
        known, total = self.known, 0
        for piece in joined:
            n = known.get(piece)
            if n is None:
                n = self._merge(piece)
                self._remember(piece, n)
                known = self.known
            total += n
        return total


def count_tokens(table: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """``table`` without its text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as an empty one: 0 bytes, 0 tokens.  Rows stay one to one,
    repeated ones too; an empty table gives an empty one.  One pass, no shuffle.
    Columns of ``table`` named like a result are replaced.
    """
    keep = table.drop("n_bytes", "n_tokens", "over_limit")
    others = [c for c in keep.columns if c != text]
    fields = [f"`{c}` {keep.schema[c].dataType.simpleString()}" for c in others] + ["n_bytes long", "n_tokens long"]
    whole = table.sparkSession.sparkContext.broadcast(whole_strings(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value)
        for piece in text_pieces(batches, "_text"):
            texts = piece.column(len(others))
            counts = pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())
            sizes = pc.binary_length(texts).cast(pa.int64())
            columns = [piece.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*columns, sizes, counts], names=[*others, "n_bytes", "n_tokens"])

    picked = keep.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("_text"))
    return picked.mapInArrow(run, ", ".join(fields)).withColumn("over_limit", F.col("n_tokens") > limit)

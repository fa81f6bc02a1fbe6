"""Quality rules as a ledger of bits.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; policies are versions of a bit mask, so a new
policy or an ablation needs the ledger only, not the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from topicloom.llm.names import free_name
from topicloom.llm.words import Hasher, find_words, text_pieces, windows

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"

# fixed values: the characters that count as symbols
SYMBOLS = "#*$%&|<>"


def _rules() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "capitals": 2 * F.col("n_upper") > F.col("n_letters"),
    }


#: Rule names in the order of their bits.  New rules go to the end; bits are never used again.
RULES = ("few_words", "repeated_windows", "word_length", "symbols", "repeated_lines", "capitals")

#: Named versions of the policy: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "word_length", "symbols", "repeated_lines", "capitals"),
}


def measure(table: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``table`` with one column per measurement of the whole text, which itself goes unless ``keep_text``.

    A null text is measured as an empty one.  Columns of ``table`` named like a
    measurement are replaced.
    """
    names = [part.split()[0] for part in MEASURES.split(", ")]
    keep = table.drop(*names)
    others = [c for c in keep.columns if c != text or keep_text]
    fields = [keep.schema[c] for c in others]
    schema = StructType([StructField(f.name, f.dataType) for f in fields] + [StructField(name, LongType()) for name in names])
    body = free_name(keep, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=False)
        is_symbol = np.zeros(256, dtype=np.int64)
        is_symbol[list(SYMBOLS.encode())] = 1
        upper = np.zeros(256, dtype=bool)
        upper[65:91] = True
        letter = upper.copy()
        letter[97:123] = True
        for piece in text_pieces(batches, body):
            texts = piece.column(piece.num_columns - 1)
            w = find_words(texts)
            solid = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)])
            at, gram = windows(w, hasher.spans(w.raw, w.start, w.stop), 3)
            key = gram + w.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            marked = np.zeros(len(w.start), dtype=bool)
            for k in range(3):
                marked[at[twice] + k] = True

            def total(flags: np.ndarray, w=w) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(flags)])
                return sums[w.offsets[1:]] - sums[w.offsets[:-1]]

            lines, repeated = _lines(texts)
            columns = [
                np.diff(w.first),
                w.per_text(solid[w.stop] - solid[w.start]),
                total(is_symbol[w.raw]),
                repeated,
                w.per_text(marked),
                lines,
                total(upper[w.raw]),
                total(letter[w.raw]),
            ]
            kept = [piece.column(i) for i in range(piece.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c.astype(np.int64)) for c in columns], names=others + names)

    picked = keep.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias(body))
    return picked.mapInArrow(run, schema)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those equal to an earlier line."""
    lines, repeated = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.cast(pa.large_binary())):
        seen = set()
        for line in text.as_py().split(b"\n"):
            if not line.strip(b" \t\r\x0b\x0c"):
                continue
            lines[i] += 1
            if line in seen:
                repeated[i] += 1
            seen.add(line)
    return lines, repeated


def rule_ledger(table: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Measurements and ``failed``, a long with one bit per failed rule in the order of ``RULES``.

    Null and empty texts have no words.  Rows stay one to one, repeated ones too; an
    empty table gives an empty ledger.  Other columns stay, unless they are named
    like a measurement.  No shuffle.
    """
    rules = _rules()
    bits = [F.when(rules[name], F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(table, text, keep_text).withColumn("failed", total.cast("long"))


def policy_mask(policy: str | Mapping[str, bool] | tuple[str, ...]) -> int:
    """The bit mask of a named policy or of a list of rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else tuple(policy)
    unknown = set(names) - set(RULES)
    if unknown:
        raise ValueError(f"no such rules: {sorted(unknown)}; there are {list(RULES)}")
    return sum(1 << RULES.index(name) for name in names)


def apply_policy(ledger: DataFrame, policy: str | tuple[str, ...] = "v1", name: str = "kept") -> DataFrame:
    """The ledger with a boolean: no rule of the policy failed."""
    return ledger.withColumn(name, F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(ledger: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """rule, n_failed, n_only, n_kept, n_kept_without: what each rule of the policy does, and what leaving it out would do.

    The ledger is first counted by bit pattern, of which there are at most
    2 ** rules, so the data shuffled do not grow with the documents.  An empty
    ledger gives zeros for every rule.
    """
    mask = policy_mask(policy)
    chosen = [(name, 1 << i) for i, name in enumerate(RULES) if mask >> i & 1]
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in chosen]))
    none = ledger.sparkSession.createDataFrame([(name, bit, 0, 0) for name, bit in chosen], "rule string, bit long, bits long, n long")
    pairs = patterns.select(rules.alias("r"), "bits", "n").select("r.rule", "r.bit", "bits", "n").unionByName(none)
    bits, bit, n = F.col("bits"), F.col("bit"), F.col("n")

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    return pairs.groupBy("rule").agg(
        count(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        count(bits == bit).alias("n_only"),
        count(bits == 0).alias("n_kept"),
        count((bits == 0) | (bits == bit)).alias("n_kept_without"),
    )


def drop_failed(table: DataFrame, policy: str | tuple[str, ...] = "v1", text: str = "text") -> DataFrame:
    """The rows of ``table`` that fail no rule of the policy, with all their columns as they are, whatever their names."""
    # measured beside the whole row, so that no column of it can be taken for a measurement
    rows = table.select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return apply_policy(rule_ledger(rows), policy).where("kept").select("row.*")

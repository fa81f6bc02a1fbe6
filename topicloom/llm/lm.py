"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

A word's class is itself for the most frequent words, else its last letters.  The
model predicts the next class from the two before it: the prediction vector is the
sum of the context classes' vectors, each scaled by its position, and a class's
score is its product with that vector plus a bias.  Within a class, words are
predicted by smoothed counts, so probabilities over all words, with one unknown
word per class, add up to 1.

Counts and training examples are taken from all training texts.  Training passes over
the counts of all class triples in parts, whose number grows with the counts and
whose parameters are averaged after each round.  The number of classes is fixed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.words import Hasher, Words, find_words, signed, text_pieces
from topicloom.session import cut_lineage

#: Classes: the end of a text, frequent words, frequent endings, and the rest of the endings by their code.
WORD_CLASSES, ENDING_CLASSES, OTHER_CLASSES = 127, 120, 8
CLASSES = 1 + WORD_CLASSES + ENDING_CLASSES + OTHER_CLASSES

#: Words whose counts are sent to every task, 12 bytes each; the rest are joined.
BROADCAST_WORDS = 1 << 18

#: Tokens that one training example stands for, and examples of one part, both at most about.
EXAMPLE_TOKENS, PART_EXAMPLES = 64, 1_000_000

#: Length of the vectors, and the training: least number of parts, rounds, examples and noise classes per step.
DIMENSIONS, PARTS, ROUNDS, BATCH, NOISE = 24, 8, 3, 2048, 64

#: Parameters are averaged as integers of this fraction; those of 4,096 and more would not fit.
MEAN_UNIT = float(1 << 50)

_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def endings(words: Words) -> np.ndarray:
    """The last one to three bytes of each word as a number, A to Z folded."""
    low = _LOWER[words.raw]
    code = low[words.stop - 1].copy() if len(words.stop) else np.zeros(0, np.int64)
    for k in (1, 2):
        longer = words.stop - words.start > k
        code[longer] |= low[words.stop[longer] - 1 - k] << (8 * k)
    return code


@dataclass
class Classes:
    """Which words and endings are classes; arrays are sorted for look-up."""

    words: np.ndarray
    word_class: np.ndarray
    ends: np.ndarray
    end_class: np.ndarray

    def of(self, hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        found = 1 + WORD_CLASSES + ENDING_CLASSES + codes % OTHER_CLASSES
        for keys, table, values in ((self.ends, self.end_class, codes), (self.words, self.word_class, hashes)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                found = np.where(keys[at] == values, table[at], found)
        return found


def class_sequence(words: Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class triples (two before, one before, own) of all tokens, ends included, and each word's place among them."""
    place = np.arange(len(classes)) + words.doc
    sequence = np.zeros(len(classes) + words.texts, dtype=np.int64)
    sequence[place] = classes
    before = np.concatenate([[0], sequence[:-1]])
    earlier = np.where(before == 0, 0, np.concatenate([[0], before[:-1]]))
    return (earlier * CLASSES + before) * CLASSES + sequence, sequence, place


class Model:
    """Parameters, and log10 probabilities of the next class."""

    def __init__(self, noise: np.ndarray):
        draw = np.random.default_rng(7)
        self.context = draw.normal(0, 0.1, (CLASSES, DIMENSIONS))
        self.target = draw.normal(0, 0.1, (CLASSES, DIMENSIONS))
        self.position = np.ones((2, DIMENSIONS))
        self.bias = np.log(noise)
        self.noise = noise

    NAMES = ("context", "target", "position", "bias")

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for name in self.NAMES:
            shape = getattr(self, name).shape
            n = math.prod(shape)
            setattr(self, name, np.asarray(flat[at : at + n]).reshape(shape))
            at += n
        return self

    def predictions(self, earlier: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.position[0] * self.context.take(earlier, 0) + self.position[1] * self.context.take(before, 0)

    def log10_table(self) -> np.ndarray:
        """log10 probabilities for every triple, by one matrix product per earlier class; 64 MB."""
        table = np.empty((CLASSES, CLASSES, CLASSES), dtype=np.float32)
        everything = np.arange(CLASSES)
        for c in range(CLASSES):
            scores = self.predictions(np.full(CLASSES, c), everything) @ self.target.T + self.bias
            scores -= scores.max(axis=1, keepdims=True)
            table[c] = (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / math.log(10)
        return table.reshape(-1)

    def train(self, triples: np.ndarray, counts: np.ndarray, seed: int) -> None:
        """Noise-contrastive estimation with AdaGrad: about four passes over all examples, weighted by their counts, or more if they are few."""
        draw = np.random.default_rng(seed)
        weights = counts / counts.mean()
        order, at = draw.permutation(len(triples)), 0
        log_noise = np.log(NOISE * self.noise)
        noise_share = np.cumsum(self.noise)
        size = {n: np.full(getattr(self, n).shape, 1e-3) for n in self.NAMES}
        places = {n: np.arange(size[n].size).reshape(size[n].shape) for n in self.NAMES}

        def move(name: str, index, gradient: np.ndarray) -> None:
            now = getattr(self, name)
            # bincount adds in the order of the rows, as add.at does, but in one pass over flat arrays
            whole = np.bincount(places[name].take(index, 0).ravel(), gradient.ravel(), minlength=now.size).reshape(now.shape)
            size[name] += whole**2
            getattr(self, name)[...] += 0.1 * whole / np.sqrt(size[name])

        def sigmoid(x: np.ndarray) -> np.ndarray:
            """In place: new arrays of this size would cost more than the sums."""
            np.negative(np.clip(x, -30, 30, out=x), out=x)
            np.exp(x, out=x)
            return np.divide(1, np.add(x, 1, out=x), out=x)

        down = np.empty((BATCH, NOISE))
        for _ in range(60 + len(triples) // 500):
            taken = order[np.arange(at, at + BATCH) % len(order)]
            at += BATCH
            chosen, weight = triples[taken], weights[taken]
            own, before, earlier = chosen % CLASSES, chosen // CLASSES % CLASSES, chosen // CLASSES**2
            false = np.minimum(np.searchsorted(noise_share, draw.random(NOISE)), CLASSES - 1)
            q = self.predictions(earlier, before)
            true, noise = self.target.take(own, 0), self.target.take(false, 0)
            up = weight * (1 - sigmoid((q * true).sum(1) + self.bias[own] - log_noise[own]))
            np.matmul(q, noise.T, out=down)
            down += self.bias[false]
            down -= log_noise[false]
            sigmoid(down)
            down *= -weight[:, None]
            dq = (up[:, None] * true + down @ noise) / BATCH
            grow, shrink = up[:, None] * q / BATCH, down.T @ q / BATCH
            bias = np.concatenate([up, down.sum(0)]) / BATCH
            position = np.stack([(dq * self.context.take(c, 0)).sum(0) for c in (earlier, before)])
            first, second = dq * self.position[0], dq * self.position[1]
            move("target", np.concatenate([own, false]), np.concatenate([grow, shrink]))
            move("context", np.concatenate([earlier, before]), np.concatenate([first, second]))
            move("bias", np.concatenate([own, false]), bias)
            move("position", np.arange(2), position)


def _count_words(texts: DataFrame) -> DataFrame:
    """h, code, c of the words of the rows (k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for piece in text_pieces(batches, "text"):
            w = find_words(piece.column(0))
            found, at, n = np.unique(hasher.spans(w.raw, w.start, w.stop), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(found)), pa.array(endings(w)[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "code", "n"]
            )

    made = texts.select("text").mapInArrow(run, "h long, code int, n long")
    return made.groupBy("h", "code").agg(F.sum("n").alias("c"))


def _count_triples(texts: DataFrame, classes: Classes) -> DataFrame:
    """triple, n over all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        counts = np.zeros(CLASSES**3, dtype=np.int32)
        for piece in text_pieces(batches, "text"):
            w = find_words(piece.column(0))
            triples, _, _ = class_sequence(w, classes.of(hasher.spans(w.raw, w.start, w.stop), endings(w)))
            found, n = np.unique(triples, return_counts=True)
            counts[found] += n.astype(np.int32)
        found = np.flatnonzero(counts)
        for i in range(0, len(found), 100_000):
            part = found[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int64))], names=["triple", "n"])

    made = texts.select("text").mapInArrow(run, "triple int, n long")
    return made.groupBy("triple").agg(F.sum("n").alias("n"))


def examples(triples: DataFrame) -> DataFrame:
    """triple, copy, n: every triple as often as EXAMPLE_TOKENS goes into its count, the count dealt out evenly."""
    times = F.ceil(F.col("n") / EXAMPLE_TOKENS)
    return triples.select("triple", F.explode(F.sequence(F.lit(1), times)).alias("copy"), (F.col("n") / times).alias("n"))


def train(triples: DataFrame, noise: np.ndarray) -> Model:
    """The model after some rounds of training in parts and averaging.

    Parts and steps grow with the number of examples, so with the tokens.  The mean
    of the parts, weighted by their tokens, is taken in Spark, one parameter to a
    row, so the driver gets one vector however many parts there are.  Sums are of
    integers, so their order does not matter.
    """
    model = Model(noise)
    number, tokens = triples.agg(
        F.coalesce(F.sum(F.ceil(F.col("n") / EXAMPLE_TOKENS)), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    parts = examples(triples).repartition(max(PARTS, math.ceil(number / PART_EXAMPLES)), "triple", "copy")
    for number in range(ROUNDS):
        start = model.vector()

        def run(batches: Iterator[pa.RecordBatch], start=start, number=number) -> Iterator[pa.RecordBatch]:
            rows = list(batches)
            triple = np.concatenate([b.column("triple").to_numpy() for b in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
            if not len(triple):
                return
            n = np.concatenate([b.column("n").to_numpy() for b in rows]).astype(np.float64)
            copy = np.concatenate([b.column("copy").to_numpy() for b in rows])
            order = np.lexsort([copy, triple])
            own = Model(noise).load(start.copy())
            own.train(triple[order], n[order], seed=number)
            share = n[order].sum() / tokens
            whole = np.rint(own.vector() * (share * MEAN_UNIT)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([whole])], names=["theta"])

        sent = parts.mapInArrow(run, "theta array<long>").select(F.posexplode("theta").alias("at", "x"))
        made = sent.groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        if not len(made):
            break
        model.load(made.sort_values("at")["x"].to_numpy() / MEAN_UNIT)
    return model


def held_out(key: Column) -> Column:
    """Texts that training leaves out: CRC-32 of the key as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def _frequent(vocabulary: DataFrame) -> tuple[pd.DataFrame, Column]:
    """At most BROADCAST_WORDS of the most frequent words, and the condition that tells them."""
    step = F.floor(F.log2("c") * 16)
    bins = vocabulary.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin", ascending=False)
    inside = bins[bins["n"].cumsum() <= BROADCAST_WORDS]["bin"]
    condition = step >= int(inside.min()) if len(inside) else F.lit(False)
    return vocabulary.where(condition).toPandas(), condition


def score_texts(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row.

    Training texts are those not held out; null keys train.  Null texts are empty:
    they have the end token only.  Repeated rows count each time.  Scores are log10
    probabilities of whole texts: ``base_score`` by smoothed word counts, ``score``
    by the model.  Without training texts all counts are 0.
    """
    spark = table.sparkSession
    k, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = table.select(k.alias("k"), held_out(k).alias("held_out"), body.alias("text"))
    training = rows.where(~F.col("held_out"))
    vocabulary = cut_lineage(_count_words(training))
    texts = training.count()
    words, types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, types = words + texts, types + (texts > 0)

    frequent, is_frequent = _frequent(vocabulary)
    frequent = frequent.sort_values(["c", "h"], ascending=[False, True], kind="stable")
    top = frequent.head(WORD_CLASSES)
    by_code = vocabulary.groupBy("code").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    by_code = cut_lineage(by_code)
    # enough endings that the frequent words cannot have displaced any of the chosen ones
    best = by_code.orderBy(F.desc("c"), "code").limit(ENDING_CLASSES + WORD_CLASSES).toPandas().set_index("code")
    taken = top.groupby("code")["c"].sum().reindex(best.index).fillna(0)
    chosen = (best["c"] - taken).sort_values(ascending=False, kind="stable").head(ENDING_CLASSES).index.to_numpy()
    order, ends = np.argsort(top["h"].to_numpy().view(np.uint64)), np.sort(chosen).astype(np.int64)
    classes = Classes(
        top["h"].to_numpy().view(np.uint64)[order], 1 + order, ends, 1 + WORD_CLASSES + np.arange(len(ends))
    )
    # tokens and types of each class
    named = spark.createDataFrame(pd.DataFrame({"code": ends.astype(np.int32), "class": classes.end_class}), "code int, class long")
    rest = F.lit(1 + WORD_CLASSES + ENDING_CLASSES) + F.col("code") % OTHER_CLASSES
    sums = by_code.join(F.broadcast(named), "code", "left").groupBy(F.coalesce("class", rest).alias("class")).agg(F.sum("c"), F.sum("v")).toPandas()
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    tokens[sums["class"]], kinds[sums["class"]] = sums.iloc[:, 1], sums.iloc[:, 2]
    home = Classes(np.zeros(0, np.uint64), np.zeros(0, np.int64), ends, classes.end_class).of(np.zeros(len(top), np.uint64), top["code"].to_numpy().astype(np.int64))
    np.subtract.at(tokens, home, top["c"].to_numpy())
    np.subtract.at(kinds, home, 1)
    tokens[0], tokens[1 : 1 + len(top)] = texts, top["c"]
    room = np.log10(tokens + kinds + 1)  # of a class of several words
    room[: 1 + WORD_CLASSES] = 0

    noise = (tokens + 1) / (tokens + 1).sum()
    model = train(cut_lineage(_count_triples(training, classes)), noise)

    order = np.argsort(frequent["h"].to_numpy().view(np.uint64))
    known = spark.sparkContext.broadcast((frequent["h"].to_numpy().view(np.uint64)[order], frequent["c"].to_numpy()[order].astype(np.float64)))
    theta = model.vector()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        hashes, counts = known.value
        log_counts = np.log10(counts + 1)
        table = Model(noise).load(theta).log10_table()
        for piece in text_pieces(batches, "text"):
            w = find_words(piece.column(2))
            h = hasher.spans(w.raw, w.start, w.stop)
            kind = classes.of(h, endings(w))
            triples, sequence, place = class_sequence(w, kind)
            steps = table[triples].astype(np.float64) - room[sequence]
            owner = np.repeat(np.arange(w.texts), np.diff(w.first) + 1)
            chain = np.bincount(owner, weights=steps, minlength=w.texts)
            at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
            hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
            logs = np.zeros(len(h))
            logs[hit] = log_counts[at[hit]]
            shared = kind > WORD_CLASSES
            base = np.bincount(w.doc, weights=logs, minlength=w.texts) + math.log10(texts + 1)
            chain += np.bincount(w.doc[shared], weights=logs[shared], minlength=w.texts)
            sure = np.bincount(w.doc[hit], minlength=w.texts) + (texts > 0)
            missing = np.flatnonzero(~hit)
            cuts = np.searchsorted(w.doc[missing], np.arange(w.texts + 1))
            rare = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(signed(h[missing])))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(np.diff(w.first) + 1), pa.array(sure.astype(np.int64)), pa.array(base), pa.array(chain), rare],
                names=["k", "held_out", "n_tokens", "sure", "base", "chain", "rare"],
            )

    kind = rows.schema["k"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"k {kind}, held_out boolean, n_tokens long, sure long, base double, chain double, rare array<long>")
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("h")).join(vocabulary.where(~is_frequent).select("h", "c"), "h")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        F.col("k").alias(key),
        "held_out",
        "n_tokens",
        (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * math.log10(total + types + 1)).alias("base_score"),
        (F.col("chain") + logs).alias("score"),
    )

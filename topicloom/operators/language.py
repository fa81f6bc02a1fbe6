"""Language detection: multinomial naive Bayes over character n-grams.

Training is a distributed count per language, over all labelled texts.  Detection is a row map: the
profiles are an ML model that Spark ships to the executors, so a text never moves.
There the n-grams are a tree of states, and no n-gram of a text is ever built as a string.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.fixed_values import ISO_639_3, UNKNOWN_LANGUAGE
from topicloom.session import cut_lineage

# Characters whose n-grams are counted at a time; a longer text is counted alone.
COUNT_CHARS = 1 << 21
# Scores closer than this count as a tie.
TIE = 1e-6
# Entries of a table by key while n-grams are counted; more keys than this, or than characters, are sorted.
DENSE_KEYS = 1 << 21
# Entries of a step's table of (state, character); a larger step is searched in sorted keys.
DENSE_STEPS = 1 << 23
# Characters scored at a time; a longer text is scored alone.
SCORE_CHARS = 1 << 19


@dataclass
class LanguageProfiles:
    vectorizer: CountVectorizerModel
    bayes: NaiveBayesModel
    languages: list[str]
    longest: int


def letters_only(text: Column) -> Column:
    """Lower-case letters; anything else becomes one blank."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def with_char_grams(df: DataFrame, text: Column, longest: int = 3) -> DataFrame:
    """Add ``grams``: all character n-grams of the whole text, for n = 1..longest.

    Every step is a column of its own, so Spark computes it once per row.
    """
    df = df.withColumn("_g1", F.split(letters_only(text), ""))
    for n in range(2, longest + 1):
        # the shorter array is filled up with nulls, and so are the grams past the end
        shifted = F.slice("_g1", n, F.size("_g1"))
        df = df.withColumn(f"_g{n}", F.zip_with(f"_g{n - 1}", shifted, lambda g, c: F.concat(g, c)))
    steps = [f"_g{n}" for n in range(1, longest + 1)]
    return df.withColumn("grams", F.filter(F.concat(*steps), lambda g: g.isNotNull())).drop(*steps)


def count_char_grams(df: DataFrame, longest: int = 3) -> DataFrame:
    """lang, gram, n: the n-grams of ``with_char_grams`` in all texts of ``df`` (lang, letters), counted by batch."""
    lang_type = df.schema["lang"].dataType.simpleString()

    def count(batches):
        for b in batches:
            place, names = pd.factorize(b["lang"])
            texts = b["letters"].tolist()
            ends = np.cumsum([len(t) + 1 for t in texts])
            first = 0
            while first < len(texts):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + COUNT_CHARS, "right")))
                lang, grams, n = grams_of(texts[first:last], place[first:last], longest)
                yield pd.DataFrame({"lang": names.take(lang), "gram": grams, "n": n})
                first = last

    counted = df.select("lang", "letters").mapInPandas(count, f"lang {lang_type}, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def grams_of(texts: list[str], lang: np.ndarray, longest: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Language, n-gram and count of all n-grams of ``texts``; one that is in two languages comes twice.

    An n-gram is the number of what comes before its last character, with its language, and that
    character, so no n-gram is built as a string but the different ones.
    """
    length = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), dtype=np.uint32)
    chars = np.flatnonzero(np.bincount(points))
    codes = np.zeros(int(chars[-1]) + 1, dtype=np.int64)
    codes[chars] = np.arange(len(chars))
    codes, names = codes[points], [chr(c) for c in chars]
    # places are those of last characters; character 0, which has code 0, parts texts
    at = np.flatnonzero(codes)
    state = np.repeat(lang.astype(np.int64), length + 1)[at]
    owner, grams = np.arange(int(lang.max(initial=0)) + 1), [""] * (int(lang.max(initial=0)) + 1)
    empty, times = np.unique(lang[length == 0], return_counts=True)
    langs, found, n = [empty], [""] * len(empty), [times]
    for _ in range(longest):
        key = state * len(chars) + codes[at]
        if len(grams) * len(chars) <= min(DENSE_KEYS, max(len(key), 1)):
            count = np.bincount(key, minlength=1)
            kept = np.flatnonzero(count)
            number = np.zeros(len(count), dtype=np.int64)
            number[kept] = np.arange(len(kept))
            state, count = number[key], count[kept]
        else:
            kept, state, count = np.unique(key, return_inverse=True, return_counts=True)
        before, last = np.divmod(kept, len(chars))
        owner, grams = owner[before], [grams[i] + names[c] for i, c in zip(before.tolist(), last.tolist())]
        langs.append(owner)
        found.extend(grams)
        n.append(count)
        more = codes[at + 1] > 0
        at, state = at[more] + 1, state[more]
    return np.concatenate(langs), found, np.concatenate(n)


def train_language_profiles(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3) -> LanguageProfiles:
    """Count n-grams per language in all labelled texts; add-one smoothed log-probabilities.

    What comes to the driver is the model, one number per language and different n-gram, whatever the number of texts.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = cut_lineage(count_char_grams(known.select(F.col(lang).alias("lang"), letters_only(F.col(text)).alias("letters")), longest))
    # the model itself
    kept = counts.toPandas()
    if kept.empty:
        raise ValueError("no labelled text to learn languages from")
    languages, grams = sorted(kept["lang"].unique()), sorted(kept["gram"].unique())
    place = {g: i for i, g in enumerate(grams)}
    kept["at"] = kept["gram"].map(place)
    # naive Bayes needs only the sums per language, so one row each is enough
    rows = []
    for label, name in enumerate(languages):
        part = kept[kept["lang"] == name].sort_values("at")
        rows.append((float(label), Vectors.sparse(len(grams), part["at"].tolist(), part["n"].astype(float).tolist())))
    table = df.sparkSession.createDataFrame(rows, ["label", "features"])
    bayes = NaiveBayes(modelType="multinomial", smoothing=1.0).fit(table)
    vectorizer = CountVectorizerModel.from_vocabulary(grams, inputCol="grams", outputCol="features")
    return LanguageProfiles(vectorizer, bayes, languages, longest)


class GramTree:
    """Log-probabilities of n-grams, read along a text without building its n-grams.

    A state is an n-gram that is known or begins a known one; 0 is none.  ``scores`` of a state, one row
    per language, are those of its n-gram and all that begin it, so the longest state at a
    character stands for all n-grams that start there.
    """

    def __init__(self, grams: list[str], theta: np.ndarray):
        # character 0 parts texts, so no state has it
        states = {g[:n] for g in grams if "\0" not in g for n in range(1, len(g) + 1)}
        order = sorted(states, key=lambda g: (len(g), g))
        number = {g: i + 1 for i, g in enumerate(order)}
        self.chars = np.array(sorted({ord(c) for g in states for c in g}), dtype=np.int64)
        place = {chr(c): i + 1 for i, c in enumerate(self.chars)}
        own = np.zeros((theta.shape[0], len(order) + 1))
        self.empty = np.zeros(theta.shape[0])
        for g, column in zip(grams, theta.T):
            if g in number:
                own[:, number[g]] = column
            elif not g:
                self.empty = column
        width = len(self.chars) + 1
        self.codes = np.zeros(int(self.chars.max(initial=0)) + 2, dtype=np.int32)
        self.codes[self.chars] = np.arange(1, width)
        self.steps = []
        # states of one length are numbered in a row
        first, rows = 0, 1
        for n in range(1, max(map(len, order), default=0) + 1):
            here = [g for g in order if len(g) == n]
            before = np.array([number.get(g[:-1], 0) for g in here], dtype=np.int64)
            there = np.array([number[g] for g in here], dtype=np.int64)
            own[:, there] += own[:, before]
            keys = (before - first) * width + np.array([place[g[-1]] for g in here])
            if rows * width <= DENSE_STEPS:
                table = np.zeros((rows + 1) * width, dtype=np.int32)
                table[keys + width] = there
                self.steps.append((first, width, table, None))
            else:
                by_key = np.argsort(keys)
                self.steps.append((first, width, there[by_key].astype(np.int32), keys[by_key]))
            first, rows = int(there[0]), len(there)
        self.scores = own

    def _next(self, n: int, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        first, width, table, keys = self.steps[n]
        row = state.astype(np.int64) - first
        if keys is None:
            # states without a step share a row of zeros
            return table.take(np.maximum(row + 1, 0) * width + code)
        wanted = row * width + code
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (row >= 0) & (code > 0), table[at], 0)

    def score(self, texts: list[str]) -> np.ndarray:
        """One row per text, one column per language."""
        length = np.array([len(t) for t in texts], dtype=np.int64)
        out, first = np.zeros((len(texts), len(self.empty))), 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(np.cumsum(length[first:]), SCORE_CHARS, "right")) + first)
            out[first:last] = self._score(texts[first:last], length[first:last])
            first = last
        out[length == 0] += self.empty
        return out

    def _score(self, texts: list[str], length: np.ndarray) -> np.ndarray:
        points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), dtype=np.uint32)
        codes = self.codes[np.minimum(points, len(self.codes) - 1)]
        state = longest = np.zeros(len(codes), dtype=np.int32)
        for n in range(len(self.steps)):
            state = self._next(n, state, np.concatenate([codes[n:], np.zeros(min(n, len(codes)), np.int32)]))
            longest = np.where(state > 0, state, longest)
        starts = np.cumsum(length + 1) - length - 1
        return np.stack([np.add.reduceat(s.take(longest), starts) for s in self.scores], axis=1)


def detect_language(
    df: DataFrame, profiles: LanguageProfiles, text: str = "text", iso3: bool = True
) -> DataFrame:
    """Add ``language``; ``unknown`` if no n-gram is known or the best two tie."""
    names = np.array([ISO_639_3.get(x, x.upper()) if iso3 else x for x in profiles.languages], dtype=object)
    kept = [F.col(c) for c in df.columns if c != "language"]
    # every language is equally likely beforehand, so the class shares of the model are left out
    made = GramTree(profiles.vectorizer.vocabulary, profiles.bayes.theta.toArray())
    tree = df.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("string")
    def named(texts: pd.Series) -> pd.Series:
        scores = tree.value.score(texts.tolist())
        rivals = (scores >= scores.max(axis=1, keepdims=True) - TIE).sum(axis=1)
        return pd.Series(np.where(rivals == 1, names[scores.argmax(axis=1)], UNKNOWN_LANGUAGE))

    language = named(letters_only(F.coalesce(F.col(text), F.lit(""))))
    # explode() of one value keeps a filter on the result from being moved below the
    # model, where it would score every text a second time
    return df.select(*kept, F.explode(F.array(language)).alias("language"))

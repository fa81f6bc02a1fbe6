"""Texts to vectors.

``embed_static``  sparse random projection of the tokens (Achlioptas 2003): every
token has fixed +1/-1 signs taken from its hash, a text is the normalised sum.
``embed_texts``   a caller's batch encoder, run on Arrow batches.
``embed_loaded``  a model that every Python worker loads once.
``embed_token_table``  mean of stored token vectors; ``learn_token_vectors`` makes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions import text as tx
from topicloom.functions.vectors import normalise
from topicloom.operators.ordering import running_number

BITS_PER_WORD = 32
MAX_DIMS = 128  # bits of an MD5 hash


def _hash_words(token: Column, dims: int) -> list[Column]:
    """The MD5 of the token as 32-bit whole numbers, first hex digits first."""
    digest = F.md5(token)
    return [
        F.conv(F.substring(digest, 1 + 8 * w, 8), 16, 10).cast("long")
        for w in range(-(-dims // BITS_PER_WORD))
    ]


def embed_static(
    df: DataFrame,
    key: str | Sequence[str] = "seg_key",
    text: str = "text",
    dims: int = 64,
    weights: DataFrame | None = None,
    default_weight: float = 1.0,
    stopwords: Iterable[str] = (),
    unit: bool = True,
) -> DataFrame:
    """key, embedding: weighted sum of token signs, made a unit vector.

    Sign ``d`` of a token is +1 if bit ``d`` of its MD5 is 0, else -1.
    ``weights`` (token, weight) is joined if given; tokens without an entry get
    ``default_weight``.  All tokens of a text are in one task, so they are added
    up there and only one row per text is shuffled.  A text without tokens gets
    the zero vector.
    """
    if not 1 <= dims <= MAX_DIMS:
        raise ValueError(f"dims must be between 1 and {MAX_DIMS}")
    keys = [key] if isinstance(key, str) else list(key)
    words = tx.remove_stopwords(tx.tokens(F.col(text)), stopwords)
    exploded = df.select(*keys, F.explode_outer(words).alias("token"))
    if weights is None:
        exploded = exploded.withColumn("weight", F.lit(1))
    else:
        exploded = exploded.join(weights.select("token", "weight"), "token", "left").withColumn(
            "weight", F.coalesce("weight", F.lit(float(default_weight)))
        )
    hashed = exploded.select(
        *keys,
        F.when(F.col("token").isNull(), F.lit(0)).otherwise(F.col("weight")).alias("weight"),
        *[
            F.coalesce(h, F.lit(0)).alias(f"h{w}")
            for w, h in enumerate(_hash_words(F.col("token"), dims))
        ],
    )

    def bit(d: int) -> Column:
        return F.shiftright(F.col(f"h{d // BITS_PER_WORD}"), d % BITS_PER_WORD).bitwiseAND(F.lit(1))

    sums = hashed.groupBy(*keys).agg(
        F.sum("weight").alias("total"), *[F.sum(bit(d) * F.col("weight")).alias(f"s{d}") for d in range(dims)]
    )
    vector = F.array(*[(F.col("total") - 2 * F.col(f"s{d}")).cast("double") for d in range(dims)])
    summed = sums.select(*keys, vector.alias("embedding"))
    return summed.withColumn("embedding", normalise(F.col("embedding"))) if unit else summed


def rank_weights(df: DataFrame, text: str = "text", scheme: str = "idf") -> DataFrame:
    """token, weight: ``idf`` = ln(texts / texts with the token); ``zipf`` = ln(1 + frequency rank)."""
    if scheme == "idf":
        distinct = df.select(F.explode_outer(F.array_distinct(tx.tokens(F.col(text)))).alias("token"))
        seen = distinct.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        n = df.agg(F.count(F.lit(1))).scalar()
        return seen.withColumn("n", n).select("token", F.log(F.col("n") / F.col("df")).alias("weight"))
    if scheme == "zipf":
        words = df.select(F.explode_outer(tx.tokens(F.col(text))).alias("token"))
        counts = words.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        ranked = running_number(counts, [-F.col("n"), F.col("token")], "rank")
        return ranked.select("token", F.log(1.0 + F.col("rank")).alias("weight"))
    raise ValueError(f"Unknown weighting: {scheme!r}")


def embed_texts(
    df: DataFrame,
    encoder: Callable[[list[str]], np.ndarray],
    key: str = "seg_key",
    text: str = "text",
    batch_size: int = 256,
) -> DataFrame:
    """key, embedding from a caller's batch encoder.

    ``encoder`` takes a list of texts and returns one row per text.  It is pickled
    once per task, so an encoder object can load its model on first use.
    """
    key_type = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [
                np.asarray(encoder(batch["text"].iloc[i : i + batch_size].tolist()), dtype=np.float64)
                for i in range(0, len(batch), batch_size)
            ]
            if parts:
                yield pd.DataFrame({key: batch[key], "embedding": list(np.vstack(parts))})

    rows = df.select(F.col(key), F.col(text).alias("text"))
    return rows.mapInPandas(encode, f"{key} {key_type}, embedding array<double>")


def embed_loaded(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    key: str = "seg_key",
    text: str = "text",
    batch_size: int = 256,
) -> DataFrame:
    """key, embedding from an encoder that ``load`` returns.

    ``load`` runs once in every Python worker, however many tasks the worker gets, so
    a model is read where it is used and never sent with a task.  Null texts are
    empty texts.
    """

    def make():
        encoder = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(encoder(texts.tolist()), dtype=np.float64)

        return predict

    encode = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return df.select(F.col(key), encode(F.coalesce(F.col(text), F.lit(""))).alias("embedding"))


def learn_token_vectors(
    df: DataFrame, text: str = "text", dims: int = 64, min_count: int = 5, seed: int = 42, parts: int = 8
) -> DataFrame:
    """token, vector learned from the corpus."""
    words = df.select(tx.tokens(F.col(text)).alias("words"))
    model = Word2Vec(
        vectorSize=dims, minCount=min_count, seed=seed, numPartitions=parts, inputCol="words", outputCol="v"
    ).fit(words)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


def embed_token_table(
    df: DataFrame, table: DataFrame, key: str = "seg_key", text: str = "text", dims: int = 64
) -> DataFrame:
    """key, embedding: mean vector of the tokens found in ``table`` (token, vector).

    Repeated tokens of a text are counted before the join, so a frequent token
    costs one row per text; the mean is pre-aggregated before the shuffle.
    """
    words = df.select(key, F.explode_outer(tx.tokens(F.col(text))).alias("token"))
    counted = words.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    found = counted.join(table.select("token", F.col("vector")), "token", "left")
    known = found.where(F.col("vector").isNotNull())
    mean = Summarizer.mean(array_to_vector("vector"), F.col("n").cast("double"))
    means = known.groupBy(key).agg(vector_to_array(mean).alias("m"))
    zero = F.array_repeat(F.lit(0.0), dims)
    return (
        df.select(key)
        .join(means, key, "left")
        .select(key, F.coalesce("m", zero).alias("embedding"))
    )

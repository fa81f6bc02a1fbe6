"""Topics: sizes, centres, words, representative texts, similarity and seeds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.vectors import cosine
from topicloom.operators import terms as tm
from topicloom.operators.encode import embed_static
from topicloom.operators.ordering import running_number
from topicloom.operators.vectorjoin import matrix, score_all
from topicloom.session import cut_lineage


def align(texts: DataFrame, other: DataFrame, key: str = "seg_key", check: bool = True) -> DataFrame:
    """Join texts with their vectors or topics by key; with ``check`` none may be missing on either side."""
    joined = texts.join(other, key)
    if check:
        counts = texts.count(), other.count(), joined.count()
        if len(set(counts)) != 1:
            raise ValueError(f"{counts[0]} texts and {counts[1]} partners give {counts[2]} rows")
    return joined


# --- sizes and centres -------------------------------------------------------------------


def topic_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))


def topic_count(assigned: DataFrame) -> DataFrame:
    """One row: number of topics, the topic -1 included if there is one."""
    return assigned.agg(F.countDistinct("topic").alias("n_topics"))


def topic_centroids(assigned: DataFrame, vector: str = "embedding") -> DataFrame:
    """topic, centroid: mean vector, pre-aggregated in every task."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return assigned.groupBy("topic").agg(vector_to_array(mean).alias("centroid"))


def renumber_topics(assigned: DataFrame) -> DataFrame:
    """Number topics 0, 1, ... from the largest down (equal sizes by old number); -1 stays."""
    sizes = topic_sizes(assigned).where(F.col("topic") != -1)
    numbers = running_number(sizes, [-F.col("count"), F.col("topic")], "_n")
    mapping = numbers.select("topic", (F.col("_n") - 1).cast("int").alias("_new"))
    renamed = assigned.join(mapping, "topic", "left").withColumn(
        "topic", F.coalesce("_new", F.col("topic").cast("int"))
    )
    return renamed.select(*assigned.columns)


# --- similarity --------------------------------------------------------------------------


def topic_similarity_matrix(centroids: DataFrame) -> DataFrame:
    """topic_a, topic_b, similarity for every pair of topics; the table of all pairs is the result."""
    return score_all(centroids, centroids, "topic", "centroid", "topic", "centroid")


def find_topics(phrase: DataFrame, centroids: DataFrame, top_n: int = 8) -> DataFrame:
    """topic, similarity, rank: the topics nearest to the one vector in ``phrase`` (embedding)."""
    vector = phrase.select("embedding").scalar()
    scored = centroids.withColumn("_p", vector).select("topic", cosine(F.col("centroid"), F.col("_p")).alias("similarity"))
    best = scored.orderBy(F.desc("similarity"), "topic").limit(top_n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "topic")))


def embed_phrase(df: DataFrame, phrase: str, dims: int = 64) -> DataFrame:
    """One row: the phrase as a vector of the static encoder."""
    one = df.sparkSession.createDataFrame([(phrase, phrase)], "phrase string, text string")
    return embed_static(one, "phrase", "text", dims)


def restrict_topics(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose topic is in ``wanted``."""
    return df.join(wanted.select("topic"), "topic", "left_semi")


def topic_barchart_data(scored: DataFrame, wanted: DataFrame, n_words: int = 5) -> DataFrame:
    """topic, rank, term, score of the best words of the wanted topics."""
    return tm.rank_terms(restrict_topics(scored, wanted), n_words)


def topic_probabilities(df: DataFrame, centroids: DataFrame, key: str = "seg_key", vector: str = "embedding") -> DataFrame:
    """key, topic, probability: 1 + cosine to every centroid, scaled to sum 1 per row."""
    scored = score_all(df, centroids, key, vector, "topic", "centroid", shares=True)
    return scored.withColumnRenamed("similarity", "probability")


# --- seeds -------------------------------------------------------------------------------


def seed_phrases(seeds: Sequence[Sequence[str]]) -> list[str]:
    """One text per seed: its phrases joined.  A seed is a non-empty sequence of strings, and not itself a string."""
    texts = []
    for number, seed in enumerate(seeds):
        phrases = [seed] if isinstance(seed, str) else list(seed)
        if isinstance(seed, str) or not phrases or any(not isinstance(p, str) for p in phrases):
            raise ValueError(f"seed {number} is {seed!r}; give each seed as a sequence of phrases")
        texts.append(" ".join(phrases))
    return texts


def seed_embeddings(df: DataFrame, seeds: Sequence[Sequence[str]], dims: int = 64) -> DataFrame:
    """seed, embedding: each list of phrases joined to one text and encoded."""
    rows = list(enumerate(seed_phrases(seeds)))
    made = df.sparkSession.createDataFrame(rows, "seed int, text string")
    return embed_static(made, "seed", "text", dims)


def guide_with_seeds(
    df: DataFrame, seeds: DataFrame, key: str = "seg_key", vector: str = "embedding", pull: float = 0.25
) -> DataFrame:
    """key, seed, embedding.

    A row belongs to the seed with the highest cosine, or to none (-1) if the mean
    vector of all rows is nearer.  Vectors of matched rows move towards their seed.
    ``seeds`` (seed, embedding) is a parameter-sized table.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    mean = rows.agg(Summarizer.mean(array_to_vector("vec"))).first()[0].toArray()
    listed = seeds.orderBy("seed").collect()
    numbers = np.array([r.seed for r in listed] + [-1], dtype=np.int32)
    targets = np.array([list(r.embedding) for r in listed] + [list(mean)], dtype=np.float64)
    key_type = rows.schema["key"].dataType.simpleString()

    def guide(batches):
        lengths = np.linalg.norm(targets, axis=1)
        unit = targets / np.where(lengths > 0, lengths, 1.0)[:, None]
        for b in batches:
            if len(b) == 0:
                continue
            v = matrix(b["vec"])
            # the length of a row does not change which target is best
            best = (v @ unit.T).argmax(1)
            hit = numbers[best] != -1
            v[hit] = (1 - pull) * v[hit] + pull * targets[best[hit]]
            yield pd.DataFrame({"key": b["key"], "seed": numbers[best], "embedding": list(v)})

    out = rows.mapInPandas(guide, f"key {key_type}, seed int, embedding array<double>")
    return out.withColumnRenamed("key", key)


# --- representation ----------------------------------------------------------------------


def representative_docs(
    df: DataFrame,
    scored: DataFrame,
    key: str = "seg_key",
    text: str = "text",
    n: int = 3,
    stopwords: Sequence[str] = (),
    ngram_range: tuple[int, int] = (1, 1),
    reduce_frequent_words: bool = False,
) -> DataFrame:
    """topic, rank, key, similarity: the texts whose weighted terms are nearest to their topic's.

    ``df`` has key, text and topic; ``scored`` comes from ``class_tfidf``.  All texts
    are scored.  Texts without a known term have similarity 0.
    """
    found = tm.explode_terms(df, [key, "topic"], text, stopwords, ngram_range)
    counted = found.groupBy(key, "topic", "term").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(scored.select("topic", "term", "weight", "score"), ["topic", "term"])
    amount = F.sqrt(F.col("n")) if reduce_frequent_words else F.col("n").cast("double")
    own = amount * F.col("weight")
    sums = joined.groupBy(key, "topic").agg(
        F.sum(own * F.col("score")).alias("dot"), F.sum(own * own).alias("own2")
    )
    lengths = scored.groupBy("topic").agg(F.sum(F.col("score") * F.col("score")).alias("topic2"))
    base = F.sqrt("own2") * F.sqrt("topic2")
    similarity = F.when(base > 0, F.col("dot") / base).otherwise(F.lit(0.0))
    # rounded, so that copies of a text are equal and ordered by key
    every = df.select(key, "topic").join(sums, [key, "topic"], "left").join(lengths, "topic", "left")
    compared = every.select("topic", key, F.round(similarity, 10).alias("similarity"))
    order = Window.partitionBy("topic").orderBy(F.desc("similarity"), key)
    return (
        compared.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("topic", "rank", key, "similarity")
    )


def _term_vectors(ranked: DataFrame, dims: int) -> DataFrame:
    """term, word_vec for the distinct terms of ``ranked``."""
    return embed_static(ranked.select("term").distinct().withColumn("text", F.col("term")), "term", "text", dims).select(
        "term", F.col("embedding").alias("word_vec")
    )


def rerank_mmr(ranked: DataFrame, diversity: float = 0.2, n: int = 10, dims: int = 64) -> DataFrame:
    """topic, rank, term, score: ``n`` words per topic that fit the topic but differ among themselves.

    Greedy maximal marginal relevance (Carbonell & Goldstein 1998).  ``ranked`` holds
    at most a few tens of candidates per topic, so a topic is one small group.  The
    chosen words keep the order of their scores.
    """
    topic_text = (
        ranked.groupBy("topic")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("w"))
        .select("topic", F.array_join(F.transform("w", lambda p: p["term"]), " ").alias("text"))
    )
    topic_vecs = embed_static(topic_text, "topic", "text", dims).select("topic", F.col("embedding").alias("topic_vec"))
    candidates = ranked.join(_term_vectors(ranked, dims), "term").join(topic_vecs, "topic")
    topic_type = ranked.schema["topic"].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        words, topic = matrix(pdf["word_vec"]), np.array(pdf["topic_vec"].iloc[0])
        fit, alike = words @ topic, words @ words.T
        chosen = [int(fit.argmax())]
        while len(chosen) < min(n, len(pdf)):
            value = (1 - diversity) * fit - diversity * alike[:, chosen].max(axis=1)
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        out = pdf.iloc[sorted(chosen)]
        return pd.DataFrame(
            {"topic": out["topic"], "rank": np.arange(1, len(out) + 1, dtype=np.int32), "term": out["term"], "score": out["score"]}
        )

    return candidates.groupBy("topic").applyInPandas(choose, f"topic {topic_type}, rank int, term string, score double")


def rerank_keybert(
    ranked: DataFrame, representatives: DataFrame, embeddings: DataFrame, key: str = "seg_key", n: int = 10, dims: int = 64
) -> DataFrame:
    """topic, rank, term, score: words by cosine to the mean vector of the topic's representative texts.

    ``ranked`` holds the candidate words, ``representatives`` (topic, key), ``embeddings`` (key, embedding).
    """
    picked = representatives.select("topic", key).join(embeddings.select(key, "embedding"), key)
    centres = topic_centroids(picked)
    scored = (
        ranked.select("topic", "term")
        .join(_term_vectors(ranked, dims), "term")
        .join(centres, "topic")
        .select("topic", "term", cosine(F.col("word_vec"), F.col("centroid")).alias("score"))
    )
    return tm.rank_terms(scored, n)


def topic_info(assigned: DataFrame, words: DataFrame, representatives: DataFrame) -> DataFrame:
    """topic, count, name, representation, representative_docs.

    ``words`` (topic, words) and ``representatives`` (topic, rank, text) are already cut to a few per topic.
    """
    docs = representatives.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("d"))
    docs = docs.select("topic", F.transform("d", lambda p: p["text"]).alias("representative_docs"))
    empty = F.array().cast("array<string>")
    joined = topic_sizes(assigned).join(words, "topic", "left").join(docs, "topic", "left")
    representation = F.coalesce("words", empty)
    return joined.select(
        "topic",
        "count",
        F.concat_ws("_", F.col("topic").cast("string"), F.slice(representation, 1, 4)).alias("name"),
        representation.alias("representation"),
        F.coalesce("representative_docs", empty).alias("representative_docs"),
    )


# --- hierarchy ---------------------------------------------------------------------------


def topic_hierarchy(centroids: DataFrame) -> DataFrame:
    """step, topic_a, topic_b, distance, size: Ward merges over 1 - cosine, nearest first.

    A cluster is named by its smallest topic.  Ward linkage is reducible, so all
    pairs that are each other's nearest neighbour are merged in the same round; the
    merges are those of the one-at-a-time method.
    """
    spark = centroids.sparkSession
    start = topic_similarity_matrix(centroids).where(F.col("topic_a") != F.col("topic_b"))
    pairs = cut_lineage(
        start.select(
            F.col("topic_a").alias("a"),
            F.col("topic_b").alias("b"),
            (1 - F.col("similarity")).alias("d"),
            F.lit(1).cast("long").alias("na"),
            F.lit(1).cast("long").alias("nb"),
        )
    )
    done: DataFrame | None = None
    while pairs.take(1):
        nearest = pairs.groupBy("a").agg(F.min(F.struct("d", "b", "na", "nb")).alias("x")).select("a", "x.*")
        back = nearest.select(F.col("a").alias("b"), F.col("b").alias("a"))
        # mutual nearest pairs, each once
        merges = cut_lineage(nearest.where(F.col("a") < F.col("b")).join(back, ["a", "b"]))
        done = merges if done is None else done.unionByName(merges)
        parts = merges.select(F.col("a").alias("old"), F.col("a").alias("new"), F.col("d").alias("dm"))
        parts = parts.unionByName(merges.select(F.col("b").alias("old"), F.col("a").alias("new"), F.col("d").alias("dm")))

        def fold(table: DataFrame, me: str, other: str) -> DataFrame:
            """Replace merged clusters in column ``me`` (Lance-Williams update for Ward)."""
            n_me, n_other = f"n{me}", f"n{other}"
            renamed = table.join(parts.withColumnRenamed("old", me), me, "left").withColumn(
                me, F.coalesce("new", F.col(me))
            )
            summed = renamed.groupBy(me, other).agg(
                F.sum((F.col(n_me) + F.col(n_other)) * F.col("d") * F.col("d")).alias("w"),
                F.sum(n_me).alias(n_me),
                F.first(n_other).alias(n_other),
                F.coalesce(F.max("dm"), F.lit(0.0)).alias("dm"),
            )
            value = (F.col("w") - F.col(n_other) * F.col("dm") * F.col("dm")) / (F.col(n_me) + F.col(n_other))
            return summed.select("a", "b", F.sqrt(F.greatest(value, F.lit(0.0))).alias("d"), "na", "nb")

        # the merged pairs themselves leave the table
        gone = merges.select("a", "b").unionByName(merges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = cut_lineage(fold(fold(pairs.join(gone, ["a", "b"], "left_anti"), "a", "b"), "b", "a"))
    if done is None:
        return spark.createDataFrame([], "step int, topic_a int, topic_b int, distance double, size long")
    steps = running_number(done, [F.col("d"), F.col("a"), F.col("b")], "step")
    return steps.select(
        F.col("step").cast("int").alias("step"), F.col("a").alias("topic_a"), F.col("b").alias("topic_b"), F.col("d").alias("distance"),
        (F.col("na") + F.col("nb")).alias("size"),
    )

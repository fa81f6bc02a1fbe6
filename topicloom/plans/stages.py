"""The four stages: prepare, embed, fit, describe.  Each one takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import fixed_values as fv
from topicloom.operators import cluster as cl
from topicloom.operators import encode as en
from topicloom.operators import prepare as pr
from topicloom.operators import reduce as rd
from topicloom.operators import terms as tm
from topicloom.operators import topics as tp
from topicloom.operators.language import LanguageProfiles, detect_language
from topicloom.plans.metrics import StageMetrics, watched
from topicloom.session import cut_lineage


def prepare(
    posts: DataFrame,
    profiles: LanguageProfiles | None = None,
    code: str | None = fv.DEFAULT_LANGUAGE,
    split_sentences: bool = False,
    split_paragraphs: bool = True,
    abbreviations: Sequence[str] = (),
    metrics: StageMetrics | None = None,
) -> DataFrame:
    """Posts (id, text, ord) to segments (seg_key, label, text, id, idx).

    Language is judged on the text as it came.  Sentence splitting wins over paragraph
    splitting; with neither the cleaned posts are returned.  Apart from numbering the
    posts that share the job-centre id, all of it is one pass without a shuffle.
    """
    posts = watched(pr.disambiguate_ids(posts), metrics, "prepare", posts=F.count(F.lit(1)))
    if profiles is not None:
        posts = detect_language(posts, profiles)
    if code is not None and (profiles is not None or "language" in posts.columns):
        posts = watched(pr.filter_language(posts, code), metrics, "prepare", posts_in_language=F.count(F.lit(1)))
    posts = posts.withColumn("text", pr.tx.clean_text(F.col("text")))
    mode = "sentence" if split_sentences else "paragraph" if split_paragraphs else "none"
    return watched(pr.segment_posts(posts, mode, abbreviations), metrics, "prepare", segments=F.count(F.lit(1)))


def embed(
    segments: DataFrame,
    encoder: Callable | None = None,
    key: str = "seg_key",
    dims: int = 64,
    layout_2d: dict | None = None,
    metrics: StageMetrics | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Vectors (key, embedding) and their 2-D layout (key, reduced)."""
    if encoder is None:
        vectors = en.embed_static(segments, key, "text", dims)
    else:
        vectors = en.embed_texts(segments, encoder, key)
    vectors = cut_lineage(watched(vectors, metrics, "embed", vectors=F.count(F.lit(1))))
    args = {"n_neighbors": 10, "n_components": 2, "min_dist": 0.0, "metric": "cosine", "start": "spectral"} | (layout_2d or {})
    return vectors, rd.reduce_umap(vectors, key=key, **args)


def fit_topics(
    texts: DataFrame,
    embeddings: DataFrame,
    reduction: dict | None = None,
    clustering: dict | None = None,
    seeds: list[list[str]] | None = None,
    stopwords: Sequence[str] = fv.DANISH_STOPWORDS,
    top_n_words: int = 20,
    merge: bool = True,
    probabilities: bool = False,
    key: str = "seg_key",
    dims: int = 64,
    metrics: StageMetrics | None = None,
) -> dict[str, DataFrame]:
    """assignments (key, topic, prob), topic_embeddings (topic, centroid), words, config.

    Seeds pull vectors first; then reduce, cluster, number by size, merge similar topics
    and describe by unigram class TF-IDF.  With ``probabilities`` also a table of the
    share of every topic per text.
    """
    reduction = {"model": "UMAP", "n_neighbors": 60, "n_components": 5} if reduction is None else reduction
    clustering = (
        {"model": "HDBSCAN", "min_cluster_size": 120, "min_samples": 30} if clustering is None else clustering
    )
    vectors = embeddings.select(key, "embedding")
    boost: list[str] = []
    if seeds is not None:
        guided = tp.guide_with_seeds(vectors, tp.seed_embeddings(vectors, seeds, dims), key)
        vectors = cut_lineage(guided.select(key, "embedding"))
        boost = [word for seed in seeds for word in seed]
    reduced = rd.reduce(vectors, key=key, **reduction)
    clustered = cut_lineage(cl.cluster(reduced, key=key, vector="reduced", **clustering))

    def numbered(clusters: DataFrame, step: str) -> DataFrame:
        # topics have the numbers 0, 1, ...
        counts = {"texts": F.count(F.lit(1)), "texts_without_topic": F.count_if(F.col("topic") == -1), "topics": F.max("topic") + 1}
        return cut_lineage(watched(tp.renumber_topics(clusters), metrics, step, **counts))

    def centres(assigned: DataFrame) -> DataFrame:
        return cut_lineage(tp.topic_centroids(tp.align(vectors, assigned, key, check=False)))

    assigned = numbered(clustered, "fit")
    centroids = centres(assigned)
    if merge:
        assigned = numbered(cl.merge_topics_auto(assigned, centroids), "merge")
        centroids = centres(assigned)
    counts = tm.count_terms(tp.align(texts.select(key, "text"), assigned, key, check=False), stopwords=stopwords)
    scored = tm.class_tfidf(counts, boost=boost)
    config = texts.sparkSession.createDataFrame(
        [(k, str(v)) for k, v in {"reduction": reduction, "clustering": clustering, "seeds": seeds, "merge": merge}.items()],
        "name string, value string",
    )
    out = {
        "assignments": assigned,
        "topic_embeddings": centroids,
        "words": tm.rank_terms(scored, top_n_words),
        "config": config,
    }
    if probabilities:
        out["probabilities"] = tp.topic_probabilities(vectors, centroids.where("topic <> -1"), key)
    return out


def update_topics(
    texts: DataFrame,
    stopwords: Sequence[str] = fv.DANISH_STOPWORDS,
    ngram_range: tuple[int, int] = (1, 3),
    min_df: int = 10,
    max_features: int | None = 10_000,
    bm25_weighting: bool = True,
    reduce_frequent_words: bool = True,
    representation: str | None = "MMR",
    diversity: float = 0.2,
    n_words: int = 10,
    dims: int = 64,
    embeddings: DataFrame | None = None,
    key: str = "seg_key",
) -> tuple[DataFrame, DataFrame]:
    """Words (topic, rank, term, score) and all scored terms for texts with topics (key, text, topic)."""
    if representation not in (None, "MMR", "KeyBERTInspired"):
        raise ValueError(f"no representation named {representation!r}; choose MaximalMarginalRelevance, KeyBERTInspired or None")
    counts = tm.count_terms(texts, "text", "topic", stopwords, ngram_range, min_df, max_features)
    counts = cut_lineage(counts)
    if not counts.take(1):
        raise ValueError(f"no term is used by {min_df} or more topics; lower min_df")
    scored = cut_lineage(tm.class_tfidf(counts, bm25_weighting, reduce_frequent_words))
    if representation == "MMR":
        words = tp.rerank_mmr(tm.rank_terms(scored, 30), diversity, n_words, dims)
    elif representation == "KeyBERTInspired":
        docs = tp.representative_docs(texts, scored, key, "text", 5, stopwords, ngram_range, reduce_frequent_words)
        vectors = en.embed_static(texts, key, "text", dims) if embeddings is None else embeddings
        words = tp.rerank_keybert(tm.rank_terms(scored, 100), docs, vectors, key, n_words, dims)
    else:
        words = tm.rank_terms(scored, n_words)
    return words, scored


def describe(
    texts: DataFrame,
    assignments: DataFrame,
    stopwords: Sequence[str] = fv.DANISH_STOPWORDS,
    key: str = "seg_key",
    metrics: StageMetrics | None = None,
    **options,
) -> DataFrame:
    """topic info: size, name, words and representative texts of every topic."""
    joined = tp.align(texts.select(key, "text"), assignments.select(key, "topic"), key, check=False)
    joined = cut_lineage(watched(joined, metrics, "describe", texts=F.count(F.lit(1))))
    words, scored = update_topics(joined, stopwords, key=key, **options)
    docs = tp.representative_docs(
        joined,
        scored,
        key,
        "text",
        3,
        stopwords,
        options.get("ngram_range", (1, 3)),
        options.get("reduce_frequent_words", True),
    )
    # three rows per topic are joined with their texts
    shown = docs.join(joined.select(key, "text"), key).select("topic", "rank", "text")
    return watched(tp.topic_info(joined, tm.top_words(words), shown), metrics, "describe", topics=F.count(F.lit(1)))


def topic_map_data(centroids: DataFrame, assigned: DataFrame) -> DataFrame:
    """topic, x, y, count: two principal components of the topic vectors, and the size."""
    flat = rd.reduce_pca(centroids, 2, "topic", "centroid")
    placed = flat.select("topic", F.element_at("reduced", 1).alias("x"), F.element_at("reduced", 2).alias("y"))
    return placed.join(tp.topic_sizes(assigned), "topic")


def document_map_data(texts: DataFrame, layout: DataFrame, assigned: DataFrame, key: str = "seg_key") -> DataFrame:
    """key, text, topic, x, y"""
    flat = layout.select(key, F.element_at("reduced", 1).alias("x"), F.element_at("reduced", 2).alias("y"))
    return texts.select(key, "text").join(assigned.select(key, "topic"), key).join(flat, key)

"""The registered queries: every operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.functions.fixed_values import DANISH_STOPWORDS
from topicloom.operators import cluster as cl
from topicloom.operators import descent as ds
from topicloom.operators import encode as en
from topicloom.operators import predict as pdn
from topicloom.operators import prepare as pr
from topicloom.operators import reduce as rd
from topicloom.operators import spanning as sp
from topicloom.operators import spectral as sc
from topicloom.operators import terms as tm
from topicloom.operators import topics as tp
from topicloom.operators import vectorjoin as vj
from topicloom.operators.language import detect_language, train_language_profiles
from topicloom.plans import stages
from topicloom.plans.metrics import StageMetrics
from topicloom.session import cut_lineage, spread
from topicloom.sources.posts import first_n, rename_posts

PHRASE = "the thing of all"
SEEDS = [["the", "of and"], ["der", "die und"], ["que", "les des"]]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_posts(read(spark, sf_dir, "documents"), "doc_id", "text")


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the number of their source as the topic."""
    topic = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return read(spark, sf_dir, "documents").select("doc_id", "text", topic.alias("topic"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors with their label as the topic."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("topic"))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, topic, embedding of all documents."""
    return en.embed_static(classed(spark, sf_dir), ["doc_id", "topic"])


def cells(df: DataFrame, keys: list[str], vector: str, digits: int = 6) -> DataFrame:
    """One row per coordinate."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "v")).select(
        *keys, "dim", F.round("v", digits).alias("value")
    )


# --- sources, ids, cleaning --------------------------------------------------------------


@query
def load_rename_notnull(spark, sf_dir):
    return posts(spark, sf_dir).select("id", "text")


@query
def load_texts_column(spark, sf_dir):
    from topicloom.sources.posts import text_column

    return text_column(read(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"])


@query
def first_rows(spark, sf_dir):
    return first_n(posts(spark, sf_dir), 137).select("id", F.length("text").alias("n"))


@query
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.clean_text(F.col("html")).alias("text"))


@query
def disambiguate_ids(spark, sf_dir):
    table = read(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("ord"))
    return pr.disambiguate_ids(table, "src0")


# --- splitting ---------------------------------------------------------------------------


def _paragraph_posts(spark, sf_dir):
    """The documents have single line breaks only; doubled, they separate paragraphs."""
    return posts(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query
def split_paragraphs(spark, sf_dir):
    parts = _paragraph_posts(spark, sf_dir).select("id", F.posexplode(tx.split_paragraphs(F.col("text"))).alias("idx", "part"))
    return parts.select(pr.segment_label(F.col("id"), F.col("idx")).alias("label"), "part")


@query
def split_sentences(spark, sf_dir):
    return posts(spark, sf_dir).select(F.col("ord").alias("doc_id"), F.posexplode(tx.split_sentences(F.col("text"))).alias("idx", "sentence"))


@query
def segment_paragraph(spark, sf_dir):
    return pr.segment_posts(_paragraph_posts(spark, sf_dir), "paragraph").select("seg_key", "label", "text")


@query
def segment_sentence(spark, sf_dir):
    return pr.segment_posts(posts(spark, sf_dir), "sentence").select("seg_key", "label", "text")


@query
def segment_none(spark, sf_dir):
    return pr.segment_posts(posts(spark, sf_dir), "none").select("id", "text")


@query
def sensitive_flags(spark, sf_dir):
    text = F.col("text")
    return posts(spark, sf_dir).select(
        "id",
        tx.has_date(text).alias("date"),
        tx.has_phone(text).alias("phone"),
        tx.has_email(text).alias("email"),
        tx.has_homepage(text).alias("homepage"),
    )


@query
def drop_sensitive(spark, sf_dir):
    return posts(spark, sf_dir).select(
        "id",
        F.size(tx.split_sentences(F.col("text"))).cast("long").alias("sentences"),
        F.size(tx.safe_sentences(F.col("text"))).cast("long").alias("safe"),
    )


@query
def learn_abbreviations(spark, sf_dir):
    found = pr.learn_abbreviations(posts(spark, sf_dir))
    return found.select("word", "n", "dots", F.round("score", 6).alias("score"))


@query
def prepare_counts(spark, sf_dir):
    table = posts(spark, sf_dir)
    segments = pr.segment_posts(table, "sentence")
    return table.agg(F.count(F.lit(1)).alias("n")).select(F.lit("posts").alias("what"), "n").unionByName(
        segments.agg(F.count(F.lit(1)).alias("n")).select(F.lit("segments").alias("what"), "n")
    )


@query
def stage_metrics(spark, sf_dir):
    """Counts that came with the one pass that wrote the segments."""
    table = read(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    metrics = StageMetrics()
    cut_lineage(stages.prepare(
        table.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("ord"), F.col("lang").alias("language")),
        code="fr", split_sentences=True, metrics=metrics,
    ))
    return metrics.table(spark)


# --- language ----------------------------------------------------------------------------


def _detected(spark, sf_dir):
    table = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return detect_language(table, train_language_profiles(table))


@query
def detect_languages(spark, sf_dir):
    return _detected(spark, sf_dir).select("doc_id", "language")


@query
def filter_language(spark, sf_dir):
    return pr.filter_language(_detected(spark, sf_dir), "FRA").select("doc_id", "lang", "language")


@query
def prepare_posts(spark, sf_dir):
    """Ids, language, cleaning and splitting in one chain."""
    table = read(spark, sf_dir, "documents")
    profiles = train_language_profiles(table)
    return stages.prepare(posts(spark, sf_dir), profiles, "FRA", split_sentences=True).select("seg_key", "label", "text")


# --- terms -------------------------------------------------------------------------------


@query
def tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))


@query
def remove_stopwords(spark, sf_dir):
    words = tx.remove_stopwords(tx.tokens(F.col("text")), DANISH_STOPWORDS)
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("pos", "token"))


def _grams(spark, sf_dir, low=1, high=3):
    return tm.class_term_counts(classed(spark, sf_dir), stopwords=DANISH_STOPWORDS, ngram_range=(low, high))


@query
def ngrams(spark, sf_dir):
    return tm.text_term_counts(read(spark, sf_dir, "documents"), "doc_id", "text", DANISH_STOPWORDS, (1, 3))


@query
def class_term_counts(spark, sf_dir):
    return _grams(spark, sf_dir)


@query
def term_totals(spark, sf_dir):
    return tm.term_totals(_grams(spark, sf_dir, 1, 1)).select("term", "total")


@query
def term_doc_freq(spark, sf_dir):
    return tm.term_doc_freq(_grams(spark, sf_dir), 10)


@query
def avg_class_length(spark, sf_dir):
    return tm.avg_class_length(_grams(spark, sf_dir, 1, 1))


@query
def vocab_cap(spark, sf_dir):
    counts = tm.frequent_term_counts(classed(spark, sf_dir), stopwords=DANISH_STOPWORDS, longest=3, max_features=10_000)
    return tm.vocab_cap(tm.term_totals(counts), 10_000).select("term", "total")


@query
def count_terms(spark, sf_dir):
    return tm.count_terms(classed(spark, sf_dir), "text", "topic", DANISH_STOPWORDS, (1, 3), 10, 10_000)


def _plain(spark, sf_dir):
    return tm.class_tfidf(tm.count_terms(classed(spark, sf_dir), stopwords=DANISH_STOPWORDS))


def _bm25(spark, sf_dir):
    counts = tm.count_terms(classed(spark, sf_dir), "text", "topic", DANISH_STOPWORDS, (1, 3), 10, 10_000)
    return tm.class_tfidf(counts, bm25_weighting=True, reduce_frequent_words=True)


@query
def class_tfidf_plain(spark, sf_dir):
    return _plain(spark, sf_dir).select("topic", "term", "tf", F.round("score", 8).alias("score"))


@query
def class_tfidf_bm25(spark, sf_dir):
    return _bm25(spark, sf_dir).select("topic", "term", "tf", F.round("score", 8).alias("score"))


@query
def rank_terms(spark, sf_dir):
    return tm.rank_terms(_bm25(spark, sf_dir), 20).select("topic", "rank", "term", F.round("score", 8).alias("score"))


@query
def top_words_text(spark, sf_dir):
    return tm.top_words_text(tm.top_words(tm.rank_terms(_plain(spark, sf_dir), 10)))


# --- vectors -----------------------------------------------------------------------------


@query
def embed_static(spark, sf_dir):
    return cells(encoded(spark, sf_dir), ["doc_id"], "embedding")


@query
def embed_weighted(spark, sf_dir):
    table = read(spark, sf_dir, "documents")
    weighted = en.embed_static(table, "doc_id", dims=32, weights=en.rank_weights(table, scheme="idf"))
    return cells(weighted, ["doc_id"], "embedding")


@query
def embed_hook(spark, sf_dir):
    """A batch encoder supplied by the caller: here letter, digit and blank counts."""

    def encoder(texts):
        return [[sum(map(str.isalpha, t)), sum(map(str.isdigit, t)), t.count(" ")] for t in texts]

    made = en.embed_texts(read(spark, sf_dir, "documents"), encoder, "doc_id")
    return cells(made, ["doc_id"], "embedding")


@query
def embed_loaded(spark, sf_dir):
    """The same with an encoder that every worker loads once."""

    def load():
        kinds = (str.isalpha, str.isdigit, " ".__eq__)
        return lambda texts: [[sum(map(kind, t)) for kind in kinds] for t in texts]

    return cells(en.embed_loaded(read(spark, sf_dir, "documents"), load, "doc_id"), ["doc_id"], "embedding")


@query
def embed_learned(spark, sf_dir):
    table = read(spark, sf_dir, "documents")
    learned = en.learn_token_vectors(table, dims=16)
    reduced = rd.reduce_pca(learned, 8, "token", "vector").withColumnRenamed("reduced", "vector")
    return en.embed_token_table(table, cut_lineage(reduced), "doc_id", dims=8)


@query
def rescale_init(spark, sf_dir):
    return cells(rd.rescale_init(vectors(spark, sf_dir), "embedding"), ["vec_id"], "embedding", 9)


@query
def reduce_none(spark, sf_dir):
    return cells(rd.reduce_none(vectors(spark, sf_dir), "vec_id"), ["vec_id"], "reduced")


@query
def reduce_pca(spark, sf_dir):
    return cells(rd.reduce_pca(vectors(spark, sf_dir), 5, "vec_id"), ["vec_id"], "reduced")


@query
def reduce_umap(spark, sf_dir):
    return rd.reduce_umap(vectors(spark, sf_dir), 60, 5, key="vec_id")


@query
def reduce_umap_2d(spark, sf_dir):
    return rd.reduce_umap(vectors(spark, sf_dir), 10, 2, key="vec_id", start="spectral")


@query
def spectral_start(spark, sf_dir):
    """Where the two-dimensional layout starts."""
    table = vectors(spark, sf_dir)
    graph = cut_lineage(rd.fuzzy_graph(vj.knn_join(table, 9, "vec_id", metric="cosine"), 10, "vec_id"))
    return sc.spectral_start(graph, cut_lineage(rd.reduce_pca(table, 2, "vec_id")), "vec_id")


@query
def fuzzy_graph(spark, sf_dir):
    knn = vj.knn_join(vectors(spark, sf_dir), 9, "vec_id", "embedding", "cosine")
    return rd.fuzzy_graph(knn, 10, "vec_id")


@query
def knn_exact(spark, sf_dir):
    found = vj.knn_join(vectors(spark, sf_dir), 5, "vec_id")
    return found.select("vec_id", "rank", "neighbor", F.round("distance", 6).alias("distance"))


@query
def knn_cosine(spark, sf_dir):
    found = vj.knn_join(vectors(spark, sf_dir), 9, "vec_id", metric="cosine")
    return found.select("vec_id", "rank", "neighbor", F.round("distance", 6).alias("distance"))


@query
def knn_documents(spark, sf_dir):
    """Neighbours of all documents, many of which are copies of others."""
    found = vj.knn_join(encoded(spark, sf_dir), 3, "doc_id", metric="euclidean")
    return found.select("doc_id", "rank", F.round("distance", 6).alias("distance"))


@query
def knn_descent(spark, sf_dir):
    """Nearly the nearest 60, as the layout of a large collection asks for."""
    return ds.knn_descent(vectors(spark, sf_dir), 60, "vec_id", metric="cosine")


@query
def core_distance(spark, sf_dir):
    knn = vj.knn_join(vectors(spark, sf_dir), 30, "vec_id")
    return sp.core_distance(knn, "vec_id").select("vec_id", F.round("core", 6).alias("core"))


@query
def mst_edges(spark, sf_dir):
    return sp.mst_edges(vectors(spark, sf_dir), 5, "vec_id")


@query
def cluster_kmeans(spark, sf_dir):
    return cl.cluster_kmeans(vectors(spark, sf_dir), 50, "vec_id")


@query
def cluster_hdbscan(spark, sf_dir):
    reduced = rd.reduce_pca(cut_lineage(encoded(spark, sf_dir)), 5, "doc_id")
    return cl.cluster_hdbscan(cut_lineage(reduced), 20, 10, "doc_id", "reduced")


@query
def predict_density(spark, sf_dir):
    """All benchmark texts in the clusters of all documents."""
    model = pdn.fit_density(cut_lineage(en.embed_static(read(spark, sf_dir, "documents"), "doc_id", dims=5)), 20, 10, "doc_id")
    return pdn.predict_density(model, en.embed_static(read(spark, sf_dir, "benchmark"), "item_id", dims=5), "item_id")


# --- topics ------------------------------------------------------------------------------


@query
def align_embeddings(spark, sf_dir):
    table = read(spark, sf_dir, "documents")
    joined = tp.align(table.select("doc_id", "lang"), en.embed_static(table, "doc_id"), "doc_id")
    return joined.select("doc_id", "lang", F.size("embedding").alias("dims"))


@query
def align_topics(spark, sf_dir):
    table = classed(spark, sf_dir)
    joined = tp.align(table.select("doc_id", "text"), table.select("doc_id", "topic"), "doc_id")
    return joined.groupBy("topic").agg(F.sum(F.length("text")).alias("chars"))


@query
def topic_sizes(spark, sf_dir):
    return tp.topic_sizes(vectors(spark, sf_dir))


@query
def topic_count(spark, sf_dir):
    return tp.topic_count(vectors(spark, sf_dir))


@query
def renumber_topics(spark, sf_dir):
    return tp.renumber_topics(vectors(spark, sf_dir).select("vec_id", (F.col("topic") - 1).alias("topic")))


@query
def topic_centroids(spark, sf_dir):
    return cells(tp.topic_centroids(vectors(spark, sf_dir)), ["topic"], "centroid")


@query
def topic_similarity_matrix(spark, sf_dir):
    pairs = tp.topic_similarity_matrix(cut_lineage(tp.topic_centroids(vectors(spark, sf_dir))))
    return pairs.select("topic_a", "topic_b", F.round("similarity", 6).alias("similarity"))


def _similar(spark, sf_dir, n=8):
    centroids = tp.topic_centroids(encoded(spark, sf_dir))
    return tp.find_topics(tp.embed_phrase(centroids, PHRASE), centroids, n)


@query
def find_topics(spark, sf_dir):
    return _similar(spark, sf_dir).select("topic", "rank", F.round("similarity", 6).alias("similarity"))


@query
def restrict_topics(spark, sf_dir):
    return tp.restrict_topics(classed(spark, sf_dir), _similar(spark, sf_dir)).select("doc_id", "topic")


@query
def topic_barchart_data(spark, sf_dir):
    bars = tp.topic_barchart_data(_plain(spark, sf_dir), _similar(spark, sf_dir))
    return bars.select("topic", "rank", "term", F.round("score", 8).alias("score"))


@query
def topic_probabilities(spark, sf_dir):
    table = cut_lineage(vectors(spark, sf_dir))
    shares = tp.topic_probabilities(table, cut_lineage(tp.topic_centroids(table)), "vec_id")
    return shares.select("vec_id", "topic", F.round("probability", 6).alias("probability"))


@query
def guide_with_seeds(spark, sf_dir):
    table = cut_lineage(encoded(spark, sf_dir))
    return tp.guide_with_seeds(table, tp.seed_embeddings(table, SEEDS), "doc_id").select("doc_id", "seed")


@query
def representative_docs(spark, sf_dir):
    table = classed(spark, sf_dir)
    found = tp.representative_docs(table, _plain(spark, sf_dir), "doc_id", stopwords=DANISH_STOPWORDS)
    return found.select("topic", "rank", "doc_id", F.round("similarity", 6).alias("similarity"))


@query
def rerank_mmr(spark, sf_dir):
    return tp.rerank_mmr(tm.rank_terms(_bm25(spark, sf_dir), 30), 0.2)


@query
def rerank_keybert(spark, sf_dir):
    table = classed(spark, sf_dir)
    scored = cut_lineage(_plain(spark, sf_dir))
    docs = tp.representative_docs(table, scored, "doc_id", n=5, stopwords=DANISH_STOPWORDS)
    words = tp.rerank_keybert(tm.rank_terms(scored, 100), docs, en.embed_static(table, "doc_id"), "doc_id")
    return words.select("topic", "rank", "term", F.round("score", 6).alias("score"))


@query
def update_topics(spark, sf_dir):
    words, _ = stages.update_topics(classed(spark, sf_dir), key="doc_id")
    return words


@query
def topic_info(spark, sf_dir):
    table = classed(spark, sf_dir)
    scored = cut_lineage(_plain(spark, sf_dir))
    docs = tp.representative_docs(table, scored, "doc_id", stopwords=DANISH_STOPWORDS)
    shown = docs.select("topic", "rank", F.col("doc_id").cast("string").alias("text"))
    info = tp.topic_info(table, tm.top_words(tm.rank_terms(scored, 10)), shown)
    return info.select(
        "topic",
        "count",
        "name",
        F.array_join("representation", ", ").alias("words"),
        F.array_join("representative_docs", ", ").alias("docs"),
    )


@query
def topic_hierarchy(spark, sf_dir):
    return tp.topic_hierarchy(cut_lineage(tp.topic_centroids(encoded(spark, sf_dir))))


@query
def topic_map_data(spark, sf_dir):
    table = cut_lineage(encoded(spark, sf_dir))
    return stages.topic_map_data(tp.topic_centroids(table), table)


@query
def document_map_data(spark, sf_dir):
    table = cut_lineage(encoded(spark, sf_dir))
    flat = rd.reduce_umap(table, 10, 2, key="doc_id")
    return stages.document_map_data(read(spark, sf_dir, "documents"), flat, table, "doc_id")


@query
def merge_topics_auto(spark, sf_dir):
    table = cut_lineage(encoded(spark, sf_dir))
    merged = cl.merge_topics_auto(table.select("doc_id", "topic"), tp.topic_centroids(table))
    return tp.renumber_topics(merged)


@query
def fit_topics(spark, sf_dir):
    table = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = stages.fit_topics(
        table,
        cut_lineage(en.embed_static(table, "doc_id")),
        reduction={"model": "UMAP", "n_neighbors": 15, "n_components": 5},
        clustering={"model": "HDBSCAN", "min_cluster_size": 20, "min_samples": 10},
        seeds=SEEDS,
        key="doc_id",
    )
    return model["assignments"]


@query
def describe_topics(spark, sf_dir):
    table = classed(spark, sf_dir)
    return stages.describe(table, table, key="doc_id")


@query
def sentence_topics(spark, sf_dir):
    """Flagship: clean, split, drop sensitive sentences, then the top words per source."""
    table = read(spark, sf_dir, "documents")
    source = F.regexp_extract("source", r"(\d+)", 1)
    sources = table.select(F.concat_ws("/", source, F.col("doc_id").cast("string")).alias("id"), "text", F.col("doc_id").alias("ord"))
    clean = sources.withColumn("text", tx.clean_text(F.col("text")))
    segments = pr.segment_posts(clean, "sentence")
    texts = segments.select(F.substring_index("id", "/", 1).cast("int").alias("topic"), "text")
    scored = tm.class_tfidf(tm.count_terms(texts, stopwords=DANISH_STOPWORDS))
    return tm.rank_terms(scored, 10).select("topic", "rank", "term", F.round("score", 8).alias("score"))

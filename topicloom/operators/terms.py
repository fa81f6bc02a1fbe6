"""Term counts per topic and class-based TF-IDF.

All counts are sums, which Spark pre-aggregates before each shuffle: a topic or a
term that holds a large share of the rows costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.operators import grams as gr
from topicloom.session import cut_lineage

# A vocabulary up to this length may be broadcast.
BROADCAST_TERMS = 200_000


def with_terms(
    df: DataFrame,
    text: str = "text",
    stopwords: Iterable[str] = (),
    ngram_range: tuple[int, int] = (1, 1),
    out: str = "terms",
) -> DataFrame:
    """Add ``out``: tokens, then stop words out, then n-grams."""
    words = tx.remove_stopwords(tx.tokens(F.col(text)), stopwords)
    return tx.with_ngrams(df.withColumn("_words", words), "_words", *ngram_range, out=out).drop("_words")


def explode_terms(
    df: DataFrame,
    keep: Iterable[str],
    text: str = "text",
    stopwords: Iterable[str] = (),
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """One row per occurrence of a term, in no order."""
    keep = list(keep)
    terms = with_terms(df.select(*keep, text), text, stopwords, ngram_range)
    # explode() would make Spark test the array for emptiness first, and so build it twice
    exploded = terms.select(*keep, F.explode_outer("terms").alias("term"))
    return exploded.where(F.col("term").isNotNull())


# Characters of the texts whose terms one task counts.
TASK_CHARS = 2_000_000


def text_term_counts(
    df: DataFrame, key: str, text: str = "text", stopwords: Iterable[str] = (), ngram_range: tuple[int, int] = (1, 1)
) -> DataFrame:
    """key, term, n

    Hardly any term comes twice in a text, so texts are dealt by their key and not terms:
    all terms of a key are counted in one task, of a bounded part of the texts.
    """
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    dealt = df.where(F.col(key).isNotNull()).select(key, text).repartition(max(1, -(-chars // TASK_CHARS)), key)
    # texts without a key may be many, so their terms are dealt
    parts = [
        explode_terms(part, [key], text, stopwords, ngram_range).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
        for part in (dealt, df.where(F.col(key).isNull()))
    ]
    return parts[0].unionByName(parts[1])


def class_term_counts(
    df: DataFrame,
    text: str = "text",
    topic: str = "topic",
    stopwords: Iterable[str] = (),
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """topic, term, tf

    Texts are cut into words once.  Longer terms are counted as numbers.
    """
    low, high = ngram_range
    if high < 2 or not 1 <= low <= high:
        occurrences = explode_terms(df.withColumnRenamed(topic, "topic"), ["topic"], text, stopwords, ngram_range)
        return occurrences.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))
    words = _words(df, text, topic, stopwords)
    single = cut_lineage(gr.word_counts(words))
    longer = gr.gram_counts(words, max(low, 2), high, gr.number_words(term_totals(single)))
    return longer if low > 1 else single.unionByName(longer)


def _words(df: DataFrame, text: str, topic: str, stopwords: Iterable[str]) -> DataFrame:
    """topic, _words: written, because they are read for every length of terms."""
    kept = tx.remove_stopwords(tx.tokens(F.col(text)), stopwords)
    return cut_lineage(df.select(F.col(topic).alias("topic"), kept.alias("_words")))


def term_totals(counts: DataFrame) -> DataFrame:
    """term, total (occurrences in all topics) and df (topics that use the term)."""
    return counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))


def term_doc_freq(counts: DataFrame, min_df: int = 1) -> DataFrame:
    """term, df for the terms used by at least ``min_df`` topics."""
    return term_totals(counts).where(F.col("df") >= min_df).select("term", "df")


def avg_class_length(counts: DataFrame) -> DataFrame:
    """One row: mean number of terms per topic, cut to a whole number."""
    sizes = counts.groupBy("topic").agg(F.sum("tf").alias("n"))
    return sizes.agg(F.floor(F.avg("n")).cast("long").alias("avg_len"))


def vocab_cap(totals: DataFrame, max_features: int) -> DataFrame:
    """The most frequent terms; equal totals are ordered by term."""
    return totals.orderBy(F.desc("total"), "term").limit(max_features)


def frequent_term_counts(
    df: DataFrame,
    text: str = "text",
    topic: str = "topic",
    stopwords: Iterable[str] = (),
    longest: int = 1,
    min_df: int = 1,
    max_features: int = 10_000,
) -> DataFrame:
    """topic, term, tf for at least all n-grams, n = 1..longest, that can be among the ``max_features`` most frequent.

    An n-gram is no more frequent than the two shorter ones in it, and in no more topics.  So
    longer ones are counted only where both of these are as frequent as the last of the
    ``max_features`` most frequent so far.  The counts of a term are complete.
    """
    words = _words(df, text, topic, stopwords)
    found, numbered, all_numbered = cut_lineage(gr.word_counts(words)), None, False
    for n in range(2, longest + 1):
        totals = cut_lineage(term_totals(found).where(F.col("df") >= min_df))
        top = totals.orderBy(F.desc("total")).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).first()
        least = top.least if top.n == max_features else 1
        # a term of n - 1 words has n - 2 blanks
        kept = totals.where((F.col("total") >= least) & (F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit(""))) == n - 2))
        many, shorter = kept.count(), None
        if numbered is None:
            numbered, all_numbered = gr.number_words(kept), many <= gr.MAX_WORDS
        # too many to ship: then all longer terms are counted, which costs less than joins of all occurrences
        elif all_numbered and many <= BROADCAST_TERMS and (n - 1) * numbered.bits <= gr.CODE_BITS:
            shorter = numbered.codes([r.term for r in kept.select("term").collect()])
        longer = gr.gram_counts(words, n, n, numbered, all_numbered, shorter)
        found = cut_lineage(found.unionByName(longer))
    return found


def restrict_vocabulary(counts: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """Rows of ``counts`` whose term is in at least ``min_df`` topics and among the top terms."""
    if min_df <= 1 and max_features is None:
        return counts
    # counted once: reading the counts back is much cheaper than the texts
    return _restricted(cut_lineage(counts), min_df, max_features)


def _restricted(counts: DataFrame, min_df: int, max_features: int | None) -> DataFrame:
    vocabulary = term_totals(counts).where(F.col("df") >= min_df)
    if max_features is not None:
        vocabulary = vocab_cap(vocabulary, max_features)
    vocabulary = vocabulary.select("term")
    if max_features is not None and max_features <= BROADCAST_TERMS:
        vocabulary = F.broadcast(vocabulary)
    return counts.join(vocabulary, "term", "left_semi").select("topic", "term", "tf")


def count_terms(
    df: DataFrame,
    text: str = "text",
    topic: str = "topic",
    stopwords: Iterable[str] = (),
    ngram_range: tuple[int, int] = (1, 1),
    min_df: int = 1,
    max_features: int | None = None,
) -> DataFrame:
    """topic, term, tf over the chosen vocabulary.

    The documents of the count are the topics, so ``min_df`` counts topics.
    """
    if max_features is not None and max_features < 1:
        raise ValueError("max_features must be positive")
    if max_features is not None and ngram_range[0] == 1:
        found = frequent_term_counts(df, text, topic, stopwords, ngram_range[1], min_df, max_features)
        return _restricted(found, min_df, max_features)
    counts = class_term_counts(df, text, topic, stopwords, ngram_range)
    return restrict_vocabulary(counts, min_df, max_features)


def class_tfidf(
    counts: DataFrame,
    bm25_weighting: bool = False,
    reduce_frequent_words: bool = False,
    boost: Iterable[str] = (),
    boost_factor: float = 1.2,
) -> DataFrame:
    """topic, term, tf, weight, score; ``weight`` belongs to the term, score = share of tf x weight.

    tf is divided by the topic's total; the weight of a term falls with its total
    over all topics, compared with the average topic length.  Terms in ``boost``
    get their weight multiplied.
    """
    # used four times below, so the texts are not read again
    counts = cut_lineage(counts)
    sizes = counts.groupBy("topic").agg(F.sum("tf").alias("class_total"))
    totals = counts.groupBy("term").agg(F.sum("tf").alias("total"))
    average = avg_class_length(counts).scalar()

    share = F.col("tf") / F.col("class_total")
    if reduce_frequent_words:
        share = F.sqrt(share)
    if bm25_weighting:
        ratio = (F.col("a") - F.col("total") + 0.5) / (F.col("total") + 0.5)
    else:
        ratio = F.col("a") / F.col("total")
    weight = F.log(F.lit(1.0) + ratio)
    boost = sorted(set(boost))
    if boost:
        weight = weight * F.when(F.col("term").isin(boost), F.lit(boost_factor)).otherwise(F.lit(1.0))
    return (
        counts.join(totals, "term")
        .join(sizes, "topic")
        .withColumn("a", average.cast("double"))
        .select("topic", "term", "tf", weight.alias("weight"), (share * weight).alias("score"))
    )


def rank_terms(scored: DataFrame, n: int = 20) -> DataFrame:
    """topic, rank, term, score for the ``n`` best terms; equal scores by term."""
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "term")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("topic", "rank", "term", "score")
    )


def top_words(ranked: DataFrame) -> DataFrame:
    """topic, words: the ranked terms as an ordered list (already cut to n)."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy("topic").agg(F.transform(pairs, lambda p: p["term"]).alias("words"))


def top_words_text(words: DataFrame) -> DataFrame:
    """topic, line: ``# Topic {topic + 1}: word, word``; topic -1 is shown as 0."""
    line = F.concat(
        F.lit("# Topic "), (F.col("topic") + 1).cast("string"), F.lit(": "), F.array_join("words", ", ")
    )
    return words.select("topic", line.alias("line"))

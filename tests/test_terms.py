import math

import numpy as np
import pytest

from topicloom.operators import grams as gr
from topicloom.operators import terms as tm
from topicloom.plans import stages


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, "løn løn ferie"), (0, "løn"), (1, "ferie kontor kontor"), (-1, "kontor")]
    return spark.createDataFrame(rows, "topic int, text string")


def table(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


def test_counts(docs):
    counts = tm.class_term_counts(docs)
    assert table(counts, "topic", "term", "tf") == {(0, "løn"): 3, (0, "ferie"): 1, (1, "ferie"): 1, (1, "kontor"): 2, (-1, "kontor"): 1}
    assert table(tm.term_totals(counts), "term", "total") == {("løn",): 3, ("ferie",): 2, ("kontor",): 3}
    assert table(tm.term_doc_freq(counts, 2), "term", "df") == {("ferie",): 2, ("kontor",): 2}
    assert tm.avg_class_length(counts).first().avg_len == 2  # (4 + 3 + 1) / 3 cut
    assert [r.term for r in tm.vocab_cap(tm.term_totals(counts), 2).collect()] == ["kontor", "løn"]


def test_plain_score(docs):
    got = table(tm.class_tfidf(tm.class_term_counts(docs)), "topic", "term", "score")
    assert got[(0, "løn")] == pytest.approx(3 / 4 * math.log(1 + 2 / 3))
    assert got[(1, "ferie")] == pytest.approx(1 / 3 * math.log(1 + 2 / 2))


def test_bm25_score_may_be_negative(docs):
    scored = tm.class_tfidf(tm.class_term_counts(docs), bm25_weighting=True, reduce_frequent_words=True, boost=["ferie"])
    got = table(scored, "topic", "term", "score")
    assert got[(0, "løn")] == pytest.approx(math.sqrt(3 / 4) * math.log(1 + (2 - 3 + 0.5) / 3.5))
    assert got[(0, "løn")] < 0
    assert got[(0, "ferie")] == pytest.approx(1.2 * math.sqrt(1 / 4) * math.log(1 + 0.5 / 2.5))


def test_rank_and_text(docs):
    ranked = tm.rank_terms(tm.class_tfidf(tm.class_term_counts(docs)), 1)
    lines = {r.topic: r.line for r in tm.top_words_text(tm.top_words(ranked)).collect()}
    assert lines == {0: "# Topic 1: løn", 1: "# Topic 2: kontor", -1: "# Topic 0: kontor"}


def test_vocabulary_limits(docs):
    counts = tm.count_terms(docs, min_df=2, max_features=1)
    assert {r.term for r in counts.collect()} == {"kontor"}


def test_empty_vocabulary_is_an_error(docs):
    with pytest.raises(ValueError, match="min_df"):
        stages.update_topics(docs.selectExpr("topic", "text", "uuid() AS seg_key"), min_df=10)


def test_few_longer_terms_are_counted_and_none_is_lost(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 5), " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, 60), 500))) for i in range(80)] + [(0, None), (1, ""), (2, "w1"), (None, "w1 w2 w3")]
    df = spark.createDataFrame(rows, "topic int, text string")
    every = tm.class_term_counts(df, ngram_range=(1, 3))
    counted = tm.frequent_term_counts(df, longest=3, min_df=2, max_features=40)
    assert counted.count() < every.count() / 2
    for min_df, cap in ((1, 40), (3, 40), (2, 100_000)):
        want = {tuple(r) for r in tm.restrict_vocabulary(every, min_df, cap).collect()}
        assert {tuple(r) for r in tm.count_terms(df, ngram_range=(1, 3), min_df=min_df, max_features=cap).collect()} == want


def test_terms_of_a_text_are_counted_where_the_text_is(spark):
    rows = [(1, "aa bb aa bb"), (1, "aa bb"), (2, "cc"), (None, "aa aa"), (None, "aa"), (3, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    counts = tm.text_term_counts(df, "id", ngram_range=(1, 2))
    assert {tuple(r) for r in counts.collect()} == {
        (1, "aa", 3), (1, "bb", 3), (1, "aa bb", 3), (1, "bb aa", 1), (2, "cc", 1), (None, "aa", 3), (None, "aa aa", 1),
    }
    plan = tm.text_term_counts(df, "id")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert any("hashpartitioning(id#" in line for line in exchanges)
    # only the terms of texts without a key are shuffled
    assert sum("term#" in line for line in exchanges) == 1


@pytest.mark.parametrize("most", [1 << 18, 20, 0])
def test_longer_terms_are_counted_as_numbers_or_as_strings(spark, monkeypatch, most):
    monkeypatch.setattr(gr, "MAX_WORDS", most)
    # codes of three words and topics must not run into each other
    monkeypatch.setattr(gr, "CODE_BITS", 28)
    rng = np.random.default_rng(5)
    rows = [(int(i % 40), " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, 30), 200))) for i in range(60)]
    rows += [(0, None), (1, ""), (2, "w1"), (None, "w1 w2 w1 w2"), (None, "Øl 漢字 w1"), (5, "w3 w3")]
    df = spark.createDataFrame(rows, "topic int, text string").repartition(3)
    for low, high in ((1, 3), (2, 5)):
        plain = tm.explode_terms(df, ["topic"], "text", ["w3"], (low, high)).groupBy("topic", "term").count()
        counts = tm.class_term_counts(df, stopwords=["w3"], ngram_range=(low, high))
        assert sorted(map(repr, map(tuple, counts.collect()))) == sorted(map(repr, map(tuple, plain.collect())))
    every = tm.class_term_counts(df, ngram_range=(1, 3))
    for min_df, cap in ((1, 30), (2, 100_000)):
        want = {tuple(r) for r in tm.restrict_vocabulary(every, min_df, cap).collect()}
        assert {tuple(r) for r in tm.count_terms(df, ngram_range=(1, 3), min_df=min_df, max_features=cap).collect()} == want


def test_longer_terms_are_shuffled_as_numbers(spark, docs):
    plan = tm.class_term_counts(docs, ngram_range=(2, 3))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and all("code#" in line for line in dealt)
    assert tm.class_term_counts(docs.where("false"), ngram_range=(1, 3)).count() == 0

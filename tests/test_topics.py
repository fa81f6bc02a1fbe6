import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import cluster as cl
from topicloom.operators import terms as tm
from topicloom.operators import topics as tp
from topicloom.plans import stages
from topicloom.sources import posts as io

WORDS = {
    "løn": "løn bonus pension tillæg overenskomst provision honorar".split(),
    "it": "python server netværk database kode system cloud".split(),
    "pleje": "omsorg patient sygehus pleje borger hjem medicin".split(),
}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    rows = []
    for name, words in WORDS.items():
        for i in range(40):
            rows.append((f"{name}{i:02d}", name, " ".join(rng.choice(words, 12))))
    return spark.createDataFrame(rows, "seg_key string, kind string, text string")


def test_align_needs_partners(spark):
    a = spark.createDataFrame([("a",), ("b",)], "seg_key string")
    with pytest.raises(ValueError):
        tp.align(a, a.limit(1))
    assert tp.align(a, a.withColumn("topic", F.lit(1))).count() == 2


def test_renumber_keeps_noise(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 2), ("d", -1), ("e", -1), ("f", -1), ("g", 1)], "k string, topic int")
    assert {r.k: r.topic for r in tp.renumber_topics(df).collect()} == {"a": 0, "b": 0, "g": 1, "c": 2, "d": -1, "e": -1, "f": -1}


def test_seeds(spark):
    with pytest.raises(ValueError):
        tp.seed_phrases("x")
    with pytest.raises(ValueError):
        tp.seed_phrases([["a"], "b"])
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.5, 0.6])], "seg_key string, embedding array<double>")
    seeds = spark.createDataFrame([(0, [1.0, 0.1])], "seed int, embedding array<double>")
    got = {r.seg_key: (r.seed, r.embedding) for r in tp.guide_with_seeds(rows, seeds).collect()}
    assert got["a"] == (0, pytest.approx([1.0, 0.025])) and got["b"][0] == -1 and got["c"][0] == -1


def test_mmr(spark):
    rng = np.random.default_rng(1)
    words = [f"ord{i}" for i in range(12)]
    ranked = spark.createDataFrame([(t, i + 1, w, 1.0 / (i + 1)) for t in (0, 1) for i, w in enumerate(rng.permutation(words).tolist())], "topic int, rank int, term string, score double")
    from topicloom.operators.encode import embed_static

    got = tp.rerank_mmr(ranked, 0.2, 4).collect()
    for t in (0, 1):
        mine = [r.term for r in ranked.where(F.col("topic") == t).orderBy("rank").collect()]
        texts = spark.createDataFrame([(w, w) for w in mine] + [("all", " ".join(mine))], "k string, text string")
        v = {r.k: np.array(r.embedding) for r in embed_static(texts, "k").collect()}
        fit, chosen = {w: v[w] @ v["all"] for w in mine}, []
        while len(chosen) < 4:
            value = {w: fit[w] if not chosen else 0.8 * fit[w] - 0.2 * max(v[w] @ v[c] for c in chosen) for w in mine if w not in chosen}
            chosen.append(max(value, key=value.get))
        assert [r.term for r in sorted(got, key=lambda r: r["rank"]) if r.topic == t] == [w for w in mine if w in chosen]


def test_merge_joins_near_topics(spark):
    """Each topic needs two near others, because the core distance looks at the second neighbour."""
    c = [[1, 0.01 * i, 0] for i in range(3)] + [[0, 1, 0.01 * i] for i in range(3)] + [[-1, -1, 1]]
    centroids = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "topic int, centroid array<double>")
    assigned = spark.createDataFrame([(f"d{i}", i % 7) for i in range(14)] + [("n", -1)], "seg_key string, topic int")
    got = {r.seg_key: r.topic for r in cl.merge_topics_auto(assigned, centroids).collect()}
    assert got["n"] == -1 and got["d0"] == got["d1"] == got["d9"] and got["d3"] == got["d4"] == got["d12"]
    assert got["d6"] == 6 and len(set(got.values())) == 4


def test_whole_flow(spark, corpus, tmp_path):
    vectors, flat = stages.embed(corpus)
    model = stages.fit_topics(
        corpus,
        vectors,
        reduction={"model": "PCA", "n_components": 5},
        clustering={"model": "HDBSCAN", "min_cluster_size": 15, "min_samples": 5},
        seeds=[["python", "server"]],
        merge=False,
        probabilities=True,
    )
    io.save_model(model, str(tmp_path / "model"))
    loaded = io.load_model(spark, str(tmp_path / "model"), list(model))
    kinds = corpus.join(loaded["assignments"], "seg_key").where("topic >= 0").groupBy("topic").agg(F.collect_set("kind").alias("k"), F.count("*").alias("n")).collect()
    assert len(kinds) == 3 and all(len(r.k) == 1 and r.n >= 30 for r in kinds)
    total = loaded["probabilities"].groupBy("seg_key").agg(F.sum("probability").alias("p")).select(F.min("p"), F.max("p")).first()
    assert list(total) == [pytest.approx(1), pytest.approx(1)]

    for representation in ("KeyBERTInspired", None):
        info = stages.describe(corpus, loaded["assignments"], min_df=1, ngram_range=(1, 2), representation=representation).collect()
        for r in info:
            assert 1 <= len(r.representation) <= 10 and len(r.representative_docs) <= 3
            assert r.name.startswith(f"{r.topic}_")
    io.write_topic_info(stages.describe(corpus, loaded["assignments"], min_df=1), str(tmp_path / "info"))
    assert spark.read.option("header", True).csv(str(tmp_path / "info")).columns == ["topic", "count", "name", "representation", "representative_docs"]
    shown = stages.document_map_data(corpus, flat, loaded["assignments"])
    assert shown.count() == 120 and shown.columns == ["seg_key", "text", "topic", "x", "y"]
    assert stages.topic_map_data(loaded["topic_embeddings"].where("topic >= 0"), loaded["assignments"]).count() == 3
    with pytest.raises(ValueError):
        stages.update_topics(corpus, representation="other")


def test_representative_docs_score_every_text(spark, corpus):
    table = corpus.withColumn("topic", F.lit(0))
    scored = tm.class_tfidf(tm.count_terms(table))
    docs = tp.representative_docs(table, scored, n=500)
    assert docs.count() == 120


def test_representative_docs_keep_texts_without_known_terms(spark):
    rows = spark.createDataFrame([("a", "python server", 0), ("b", "ukendt", 0), ("c", "", 1)], "seg_key string, text string, topic int")
    scored = tm.class_tfidf(tm.count_terms(rows.where("seg_key = 'a'")))
    got = {(r.topic, r.seg_key): r.similarity for r in tp.representative_docs(rows, scored).collect()}
    assert set(got) == {(0, "a"), (0, "b"), (1, "c")} and got[0, "b"] == got[1, "c"] == 0.0

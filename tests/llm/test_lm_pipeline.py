"""Language-model scores and the pipeline against brute force on small fixtures; queries against SQL."""

import collections
import math
import os
import time
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F
from topicloom.llm import lm

DOCS = "doc_id long, text string, score string"


def rows():
    draw = np.random.default_rng(6)
    a, b = [f"ab{i}er" for i in range(60)], [f"xy{i}on" for i in range(60)]
    made = [(i, " ".join(draw.choice(a if i % 2 else b, draw.integers(1, 120))), "s") for i in range(400)]
    return made + [(900, None, None), (901, "", "s"), (902, " \n", "s"), (None, "no id", "s"), (903, "AB1ER word " * 3000, "s"), (1, "twice", "s")]


@pytest.mark.parametrize("kept", [1 << 20, 10])
def test_scores(spark, monkeypatch, kept):
    monkeypatch.setattr(lm, "BROADCAST_WORDS", kept)
    table = spark.createDataFrame(rows(), DOCS).repartition(3)
    got = lm.score_texts(table).toPandas()
    counts, tokens = collections.Counter(), lambda t: (t or "").encode().lower().split() + [None]
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    for k, t, _ in rows():
        if not out(k):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (-1 if k is None else k, out(k), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for k, t, _ in rows()
    )
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    found = sorted(map(tuple, got[columns].round(6).values.tolist()))
    assert len(found) == len(want)
    assert all(a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 for a, b in zip(found, want))
    new = got[got["held_out"]]
    assert new["score"].sum() > new["base_score"].sum() and (got["score"] < 0).all()
    assert lm.score_texts(table.limit(0)).count() == 0


def test_only_held_out(spark):
    key = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lm.score_texts(spark.createDataFrame([(key, "a b")], "doc_id long, text string")).collect()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and row.score < 0


def test_probabilities_add_up():
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    model = lm.Model(noise)
    draw = np.random.default_rng(0)
    triples = np.unique(draw.integers(0, lm.CLASSES**3, 3000))
    model.train(triples, draw.integers(1, 9, len(triples)).astype(float), 0)
    table = model.log10_table().reshape(-1, lm.CLASSES).astype(float)
    assert np.allclose((10**table).sum(1), 1, atol=1e-4)


def test_training_learns():
    first = np.arange(lm.CLASSES)
    triples, noise = first * lm.CLASSES + (first * 7 + 3) % lm.CLASSES, np.full(lm.CLASSES, 1 / lm.CLASSES)
    model = lm.Model(noise)
    before = model.log10_table()[triples].mean()
    for seed in range(3):
        model.train(triples, np.ones(len(triples)), seed)
    assert model.log10_table()[triples].mean() > before + 0.3


def plainly(model: lm.Model, triples: np.ndarray, counts: np.ndarray, seed: int) -> None:
    """The training of ``lm.Model``, every step written out."""
    draw = np.random.default_rng(seed)
    weights, order, at = counts / counts.mean(), draw.permutation(len(triples)), 0
    log_noise, noise_share = np.log(lm.NOISE * model.noise), np.cumsum(model.noise)
    size = {n: np.full(getattr(model, n).shape, 1e-3) for n in model.NAMES}

    def move(name, index, gradient):
        whole = np.zeros_like(getattr(model, name))
        np.add.at(whole, index, gradient)
        size[name] += whole**2
        getattr(model, name)[...] += 0.1 * whole / np.sqrt(size[name])

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    for _ in range(60 + len(triples) // 500):
        taken = order[np.arange(at, at + lm.BATCH) % len(order)]
        at += lm.BATCH
        chosen, weight = triples[taken], weights[taken]
        own, before, earlier = chosen % lm.CLASSES, chosen // lm.CLASSES % lm.CLASSES, chosen // lm.CLASSES**2
        false = np.minimum(np.searchsorted(noise_share, draw.random(lm.NOISE)), lm.CLASSES - 1)
        q = model.position[0] * model.context[earlier] + model.position[1] * model.context[before]
        up = weight * (1 - sigmoid((q * model.target[own]).sum(1) + model.bias[own] - log_noise[own]))
        down = -weight[:, None] * sigmoid(q @ model.target[false].T + model.bias[false] - log_noise[false])
        dq = (up[:, None] * model.target[own] + down @ model.target[false]) / lm.BATCH
        bias = np.concatenate([up, down.sum(0)]) / lm.BATCH
        position = np.stack([(dq * model.context[earlier]).sum(0), (dq * model.context[before]).sum(0)])
        first, second = dq * model.position[0], dq * model.position[1]
        move("target", np.concatenate([own, false]), np.concatenate([up[:, None] * q / lm.BATCH, down.T @ q / lm.BATCH]))
        move("context", np.concatenate([earlier, before]), np.concatenate([first, second]))
        move("bias", np.concatenate([own, false]), bias)
        move("position", slice(None), position)


def test_training_steps_are_cheap_and_the_same():
    draw = np.random.default_rng(2)
    noise = 1 / np.arange(1.0, lm.CLASSES + 1)
    noise /= noise.sum()
    triples, counts = draw.integers(0, lm.CLASSES**3, 30_000), draw.random(30_000) + 0.1
    models, spent = (lm.Model(noise), lm.Model(noise)), ([], [])
    for seed in range(5):
        for model, seconds, run in zip(models, spent, (lm.Model.train, plainly)):
            start = time.process_time()
            run(model, triples, counts, seed)
            seconds.append(time.process_time() - start)
    assert np.allclose(models[0].vector(), models[1].vector(), rtol=0, atol=1e-9)
    assert min(spent[0]) < 0.85 * min(spent[1])


def test_training_passes_over_all_examples():
    triples, noise = np.arange(450_000), np.full(lm.CLASSES, 1 / lm.CLASSES)
    seen = []

    class Watched(lm.Model):
        def predictions(self, earlier, before):
            seen.append(earlier * lm.CLASSES + before)
            return super().predictions(earlier, before)

    Watched(noise).train(triples, np.ones(len(triples)), 0)
    assert len(seen) * lm.BATCH >= len(triples)
    assert set(np.concatenate(seen)) == set(triples // lm.CLASSES)


def test_parts_are_averaged_in_spark(spark, monkeypatch):
    rng = np.random.default_rng(5)
    triples = np.unique(rng.integers(0, lm.CLASSES**3, 3000))
    table = spark.createDataFrame([(int(t), 5) for t in triples], "triple int, n long")
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    assert np.array_equal(lm.train(table, noise).vector(), lm.train(table.repartition(3), noise).vector())
    assert np.array_equal(lm.train(table.limit(0), noise).vector(), lm.Model(noise).vector())
    monkeypatch.setattr(lm, "PARTS", 1)
    alone = lm.Model(noise)
    for seed in range(lm.ROUNDS):
        alone.train(triples, np.full(len(triples), 5.0), seed)
    assert np.allclose(lm.train(table, noise).vector(), alone.vector(), atol=1e-9)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in seen.collect()}
        seen = spark.createDataFrame(stage(spark, seen, sf_dir).collect(), docs.schema)
        after = {r.doc_id: r.text for r in seen.collect()}
        assert seen.columns == columns and set(after) <= set(before)
        if name != "repeated passages":
            assert all(before[k] == t for k, t in after.items())
        else:
            assert set(after) == set(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir).toPandas()
    assert set(pieces["doc_id"]) == {r.doc_id for r in seen.collect()}
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, pieces.values.tolist()))


def test_stages_on_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c " * 40, "en", "s", 1), (3, "word " * 9, None, "s", 5), (3, "word " * 9, None, "s", 5)]
    for table in (spark.createDataFrame(odd, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    canonical = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_native_plans(spark, sf_dir):
    for name in ("op1_mixing", "op2_chat"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_corpus_queries(spark, sf_dir):
    found = entry.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in found)] == [] and "pipeline" in found


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Extra columns named like helpers and results come through every stage but the last as they are."""
    names = ["n_words", "failed", "kept", "_kept", "_text", "body", "row", "nth", "_nth", "spans", "span_key", "text_hash", "_key",
             "_level_0", "level_0", "topic", "n_tokens", "probability", "sampled", "k", "odd name"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    docs = docs.unionByName(docs.where("doc_id = 3").withColumn("text", F.lit("another text under one id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns, name
        rows = made.collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names), name
    assert corpus_pipeline.packed(spark, docs, sf_dir).count() > 0

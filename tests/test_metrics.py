import os

import pytest
from pyspark.sql import functions as F

from topicloom.operators import encode as en
from topicloom.plans import stages
from topicloom.plans.metrics import StageMetrics


def test_counts_come_with_the_result(spark, tmp_path):
    rows = [("1", "A b. C d.", 1, "x"), ("2", "E f. Mail a@b.dk.", 2, "x"), ("3", "no", 3, "y")]
    posts = spark.createDataFrame(rows, "id string, text string, ord int, language string")
    metrics = StageMetrics()
    with metrics.timed("prepare"):
        segments = stages.prepare(posts, code="x", split_sentences=True, metrics=metrics)
        segments.write.parquet(str(tmp_path / "s"))
    n = spark.read.parquet(str(tmp_path / "s")).count()
    got = {(r.stage, r.metric): r.value for r in metrics.table(spark).collect()}
    assert got.pop(("prepare", "seconds")) > 0
    assert got == {("prepare", "posts"): 3, ("prepare", "posts_in_language"): 2, ("prepare", "segments"): n}


def test_counts_of_no_rows_and_of_nothing_written(spark, monkeypatch):
    empty = spark.createDataFrame([], "a int")
    metrics = StageMetrics()
    metrics.watch(empty, "one", rows=F.count(F.lit(1)), most=F.max("a")).collect()
    assert [(r.metric, r.value) for r in metrics.table(spark).collect()] == [("rows", 0)]
    monkeypatch.setattr("topicloom.plans.metrics.ARRIVAL", 0.2)
    metrics.watch(empty, "two", rows=F.count(F.lit(1)))
    with pytest.raises(ValueError, match="two"):
        metrics.table(spark)


def test_a_worker_loads_its_encoder_once(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(os.path.join(folder, str(os.getpid())), "a") as log:
            log.write("x")
        return lambda texts: [[len(t), t.count("a")] for t in texts]

    rows = [(i, None if i == 7 else "a" * (i % 5) + "b") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(40)
    got = {r.id: r.embedding for r in en.embed_loaded(df, load, "id", batch_size=16).collect()}
    assert got == {i: [len(t or ""), (t or "").count("a")] for i, t in rows}
    loads = [open(os.path.join(folder, f)).read() for f in os.listdir(folder)]
    assert loads and set(loads) == {"x"}

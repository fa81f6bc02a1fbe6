import json

import pytest
from pyspark.sql import functions as F

from topicloom.sources import posts as io


def test_parquet_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("2", 'b "x", y\nz'), ("1", "a"), ("3", None)], "ID string, Text string")
    df.write.parquet(str(tmp_path / "p.parquet"))
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "c.csv"))
    for name in ("p.parquet", "c.csv"):
        got = io.load_posts(spark, str(tmp_path / name))
        assert {(r.id, r.text) for r in got.collect()} == {("1", "a"), ("2", 'b "x", y\nz')}
        assert [r.id for r in io.load_posts(spark, str(tmp_path / name), n_rows=1).collect()] == ["1"]


def test_layouts(spark, tmp_path):
    spark.createDataFrame([(7, "s", 1)], "section_id long, section_text string, other int").write.parquet(str(tmp_path / "s.parquet"))
    got = io.load_posts(spark, str(tmp_path / "s.parquet"), "sections")
    assert got.select("id", "text").collect() == [("7", "s")]
    with pytest.raises(ValueError):
        io.load_posts(spark, str(tmp_path / "s.parquet"), "other")
    with pytest.raises(ValueError):
        io.load_posts(spark, str(tmp_path / "s.docx"))
    with pytest.raises(FileNotFoundError):
        io.load_posts(spark, str(tmp_path / "none.parquet"))


def test_texts_embeddings_stopwords(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", [1.0])], "seg_key string, text string, embedding array<double>")
    io.write_texts(df, str(tmp_path / "t"))
    assert io.load_texts(spark, str(tmp_path / "t")).count() == 1
    with pytest.raises(FileNotFoundError):
        io.load_texts(spark, str(tmp_path / "none"))
    assert io.load_embeddings(spark, str(tmp_path / "none")) is None
    io.write_embeddings(df, str(tmp_path / "e"))
    assert io.load_embeddings(spark, str(tmp_path / "e")).schema["embedding"].dataType.simpleString() == "array<float>"
    assert io.text_column(df.select("seg_key"), "text").first().text == "a"
    (tmp_path / "w.json").write_text(json.dumps(["på", "i"]), encoding="utf-8")
    assert io.load_stopwords(spark, str(tmp_path / "w.json")) == ["på", "i"]
    assert len(io.load_stopwords(spark)) == 170


def test_counts_without_an_extra_pass(spark, tmp_path):
    df, seen = io.observe_count(spark.range(10).where(F.col("id") > 3), "kept")
    df.write.parquet(str(tmp_path / "o"))
    assert seen.get["rows"] == 6
    assert io.run_metrics(spark, [("prepare", "kept", 6)]).collect() == [("prepare", "kept", 6.0)]

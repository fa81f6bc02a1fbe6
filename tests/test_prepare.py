import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicloom.operators import language as la
from topicloom.operators import prepare as pr
from topicloom.operators.language import detect_language, train_language_profiles
from topicloom.operators.ordering import running_number
from topicloom.plans import stages

POST = "A. Ring 12345678 nu. Hej!\n\n\nSe www.x.dk her.\n\n B er\ngod.  Ja? "


def posts(spark, rows):
    return spark.createDataFrame(rows, "id string, ord long, text string")


def test_paragraphs(spark):
    rows = pr.segment_posts(posts(spark, [("k", 0, POST)]), "paragraph").orderBy("idx").collect()
    assert [(r.label, r.text) for r in rows] == [("k_00", "A. Hej!"), ("k_01", "B er god. Ja?")]


def test_sentences(spark):
    rows = pr.segment_posts(posts(spark, [("k", 0, POST)]), "sentence").orderBy("idx").collect()
    assert [r.text for r in rows] == ["A.", "Hej!", "B er god.", "Ja?"]


def test_edges(spark):
    df = posts(spark, [("a", 0, None), ("a", 1, ""), ("a", 2, "Skriv til a@b.dk"), ("a", 3, "x. " * 150), ("a", 4, "x")])
    rows = pr.segment_posts(df, "sentence").collect()
    assert len(rows) == 151 and len({r.seg_key for r in rows}) == 151
    assert "a_149" in {r.label for r in rows}
    assert pr.segment_posts(df, "none").count() == 4
    with pytest.raises(ValueError):
        pr.segment_posts(df, "words")


def test_disambiguate(spark):
    c = pr.fv.JOBCENTER_ID
    df = posts(spark, [(c, 3, "x"), ("b", 2, "y"), (c, 1, "z"), (None, 4, "n"), (c, 9, "w")])
    got = {r.ord: r.id for r in pr.disambiguate_ids(df).collect()}
    assert got == {1: "jobcenter_2", 3: "jobcenter_3", 9: "jobcenter_4", 2: "b", 4: None}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_running_number_over_ranges(spark, kind):
    df = spark.range(500).select(F.pmod(F.col("id") * 7919, F.lit(500)).cast(kind).alias("k"))
    got = running_number(df, [F.col("k")], "n")
    want = [r.k for r in df.orderBy("k").collect()]
    assert [(r.k, r.n) for r in got.orderBy("n").collect()] == [(k, i + 1) for i, k in enumerate(want)]


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hold_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    profiles = train_language_profiles(docs.where(~hold_out))
    names = {"en": "ENG", "fr": "FRA", "de": "DEU", "es": "SPA"}
    rows = detect_language(docs.where(hold_out), profiles).select("lang", "language").collect()
    assert sum(names[r.lang] == r.language for r in rows) / len(rows) > 0.95
    odd = spark.createDataFrame([("12345",), (None,), ("漢字",)], "text string")
    assert {r.language for r in detect_language(odd, profiles).where("text is null or text > 'a'").collect()} == {"unknown"}


@pytest.mark.parametrize("dense", [la.DENSE_STEPS, 0])
@pytest.mark.parametrize("longest", [1, 3])
def test_gram_tree(spark, monkeypatch, dense, longest):
    """The same scores as by the model over counted n-grams."""
    monkeypatch.setattr(la, "DENSE_STEPS", dense)
    monkeypatch.setattr(la, "SCORE_CHARS", 40)
    rows = [("da", "Rødgrød med fløde"), ("en", "a cat, and a dog"), ("en", ""), ("ru", "кот и пёс"), ("x", "𐐀𐐁 b𐐀")]
    profiles = train_language_profiles(spark.createDataFrame(rows, "lang string, text string"), longest=longest)
    texts = ["", "ø", "red med kat", "кот a", "zzz 漢字", "𐐀𐐁", "x" * 100, "!?", "fløde\0and", "cat and"] * 2
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, text string")
    grams = la.with_char_grams(table, F.coalesce("text", F.lit("")), longest)
    model = profiles.bayes.transform(profiles.vectorizer.transform(grams)).orderBy("id").select("rawPrediction").collect()
    wanted = [r[0].toArray() - profiles.bayes.pi.toArray() for r in model]
    clean = [r[0] for r in table.orderBy("id").select(la.letters_only(F.coalesce("text", F.lit("")))).collect()]
    got = la.GramTree(profiles.vectorizer.vocabulary, profiles.bayes.theta.toArray()).score(clean)
    assert abs(got - wanted).max() < 1e-9
    best = [w.argmax() if (w >= w.max() - la.TIE).sum() == 1 else None for w in wanted]
    names = ["unknown" if b is None else profiles.languages[b] for b in best]
    found = detect_language(table, profiles, iso3=False).orderBy("id").collect()
    assert [r.language for r in found] == names


@pytest.mark.parametrize("dense", [la.DENSE_KEYS, 0])
@pytest.mark.parametrize("longest", [1, 3, 4])
def test_char_gram_counts(spark, monkeypatch, dense, longest):
    """Counts in batches equal those of the n-grams as rows."""
    monkeypatch.setattr(la, "DENSE_KEYS", dense)
    monkeypatch.setattr(la, "COUNT_CHARS", 60)
    words = ["Rødgrød", "med fløde", "", "кот и пёс", "𐐀𐐁 b𐐀", "!?", "a", "ab", "漢字漢字", "fløde\0and", "x" * 200]
    rows = [(lang, a + b) for lang in ("da", "en", "x") for a in words for b in words if lang != "en" or a < b]
    table = spark.createDataFrame(rows, "lang string, text string").select("*", la.letters_only(F.col("text")).alias("letters"))
    got = la.count_char_grams(table, longest).collect()
    grams = la.with_char_grams(table, F.col("text"), longest).select("lang", F.explode("grams").alias("gram"))
    want = grams.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_language_learns_from_all_texts(spark):
    """More texts than a sample had, each with a bigram of its own."""
    made = pd.DataFrame({"lang": "x", "text": [chr(0x4E00 + i // 250) + chr(0x4E00 + i % 250) for i in range(60_000)]})
    profiles = train_language_profiles(spark.createDataFrame(made))
    assert sorted(profiles.vectorizer.vocabulary) == sorted({*made["text"], *"".join(made["text"])})


def test_language_is_judged_before_cleaning(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = train_language_profiles(docs)
    table = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("ord"))
    out = stages.prepare(table, profiles, "SPA", split_paragraphs=False)
    assert set(out.columns) >= {"id", "text", "language"}
    assert out.count() == docs.where("lang = 'es'").count()


def test_row_maps_run_on_a_stream(spark, tmp_path):
    posts(spark, [("k", 0, POST), ("l", 1, "<b>Godt</b> job.")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ord long, text string").parquet(str(tmp_path / "in"))
    segments = pr.segment_posts(stream.withColumn("text", pr.tx.clean_text(F.col("text"))), "paragraph")
    run = segments.writeStream.format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert {r.text for r in spark.table("segments").collect()} == {"A. Hej!", "B er\ngod. Ja?".replace("\n", " "), "Godt job."}

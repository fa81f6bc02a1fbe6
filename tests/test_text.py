import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.functions.vectors import cosine, normalise
from topicloom.operators.prepare import segment_label

SENSITIVE = [
    # text, date, phone, e-mail, homepage
    ("1. januar 2024", True, False, False, False),
    ("12. MAJÆ 2024", True, False, False, False),
    ("12.3.2024x", False, False, False, False),
    ("12 34 56 78", False, True, False, False),
    ("1234567", False, False, False, False),
    ("é12345678", False, False, False, False),
    ("12345678ø", False, False, False, False),
    ("æ@b.dk", False, False, True, True),
    ("fooø.dk", False, False, False, True),
    ("foo.dkø", False, False, False, False),
    ("http://a", False, False, False, True),
    ("", False, False, False, False),
]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_sensitive(spark):
    df = spark.createDataFrame(SENSITIVE, "t string, d boolean, p boolean, e boolean, h boolean")
    t = F.col("t")
    rows = df.select("*", tx.has_date(t), tx.has_phone(t), tx.has_email(t), tx.has_homepage(t), tx.is_sensitive(t)).collect()
    for r in rows:
        assert tuple(r[1:5]) == tuple(r[5:9]), r.t
        assert r[9] == any(r[1:5]), r.t


@pytest.mark.parametrize(
    "fn, given, expected",
    [
        (tx.strip, "  a\t", "a"),
        (tx.strip, " a\n", "a"),
        (tx.clean_text, "<p>A</p>_x0009_ \t B", "A B"),
        (tx.clean_text, "a\n\n b", "a\n\n b"),
        (tx.split_paragraphs, "\n\na\n\n\nb\n\n", ["", "a", "b", ""]),
        (tx.split_paragraphs, "a\r\n\r\nb\nc", ["a", "b\nc"]),
        (tx.split_sentences, "Et. To! Tre? Fire", ["Et.", "To!", "Tre?", "Fire"]),
        (tx.split_sentences, "", []),
        (tx.safe_sentences, "Ring 12345678. Hej\nder.", ["Hej der."]),
        (tx.tokens, "Søg STILLINGEN, i-dag: æøå a1 b _x Ærø2 O'Neil", ["søg", "stillingen", "dag", "æøå", "a1", "_x", "ærø2", "neil"]),
    ],
)
def test_functions(spark, fn, given, expected):
    assert one(spark, given, fn) == expected


def test_abbreviations_do_not_end_sentences(spark):
    got = one(spark, "Dr. Bo kom ca. kl. 8. Ja. bodr. Nej", lambda c: tx.split_sentences(c, ["dr", "ca", "kl"]))
    assert got == ["Dr. Bo kom ca. kl. 8.", "Ja.", "bodr.", "Nej"]


def test_ngrams_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],)], "w array<string>")
    got = [r.terms for r in tx.with_ngrams(df, "w", 1, 3).collect()]
    assert got == [["a", "b", "a", "a b", "b a", "a b a"], ["a"], []]
    assert [r.terms for r in tx.with_ngrams(df, "w", 2, 2).collect()] == [["a b", "b a"], [], []]
    with pytest.raises(ValueError):
        tx.with_ngrams(df, "w", 0, 1)


def test_stopwords(spark):
    df = spark.createDataFrame([(["og", "job", "i", "job"],)], "w array<string>")
    assert df.select(tx.remove_stopwords(F.col("w"), ["og", "i"]).alias("x")).first().x == ["job", "job"]


def test_label(spark):
    df = spark.createDataFrame([("k", 100), ("k", 3)], "id string, i int")
    assert [r.x for r in df.select(segment_label(F.col("id"), F.col("i")).alias("x")).collect()] == ["k_100", "k_03"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(normalise(F.col("a")), normalise(F.col("z")), cosine(F.col("a"), F.col("a")), cosine(F.col("a"), F.col("z"))).first()
    assert list(r) == [[0.6, 0.8], [0.0, 0.0], 1.0, 0.0]

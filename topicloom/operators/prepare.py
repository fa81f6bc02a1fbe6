"""Posts to segments: unique ids, language filter, cleaning, splitting, sensitive text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import fixed_values as fv
from topicloom.functions import text as tx
from topicloom.operators.ordering import running_number

MODES = ("sentence", "paragraph", "none")


def disambiguate_ids(
    df: DataFrame,
    constant: str = fv.JOBCENTER_ID,
    prefix: str = fv.JOBCENTER_PREFIX,
    order: str = "ord",
) -> DataFrame:
    """Give every row with the constant id its own id: ``prefix`` + running count + 1.

    The first such row in ``order`` gets number 2.  Other rows are passed on
    without a shuffle.
    """
    hot = F.col("id") == constant
    numbers = running_number(df.where(hot), [F.col(order)], "_n")
    renamed = numbers.withColumn("id", F.concat(F.lit(prefix), (F.col("_n") + 1).cast("string"))).drop("_n")
    # a null id is not the constant
    return df.where(~F.coalesce(hot, F.lit(False))).unionByName(renamed)


def filter_language(df: DataFrame, code: str = fv.DEFAULT_LANGUAGE) -> DataFrame:
    return df.where(F.col("language") == code)


def segment_label(id_col: Column, idx: Column) -> Column:
    return F.format_string("%s_%02d", id_col, idx)


def segment_posts(
    df: DataFrame,
    mode: str = "paragraph",
    abbreviations: Iterable[str] = (),
    key: str = "ord",
) -> DataFrame:
    """Split posts and drop sensitive sentences.

    Surviving segments of a post are numbered 0, 1, 2, ... by array position, so
    nothing is shuffled.  ``seg_key`` is unique as long as ``key`` is unique per post;
    ``label`` is the readable name and may repeat if ids repeat.
    """
    if mode not in MODES:
        raise ValueError(f"Unknown mode: {mode!r}; known are {MODES}")
    if mode == "none":
        return df.where(F.col("text").isNotNull())
    abbreviations = tuple(abbreviations)
    text = F.col("text").cast("string")
    if mode == "paragraph":
        parts = F.transform(
            tx.split_paragraphs(text), lambda p: F.array_join(tx.safe_sentences(p, abbreviations), " ")
        )
        parts = F.filter(parts, lambda p: F.length(p) > 0)
    else:
        parts = tx.safe_sentences(text, abbreviations)
    # posexplode() would make Spark test the array for emptiness first, and so build it twice;
    # a null text gives no pieces here either
    pieces = df.select("id", F.col(key).alias("_key"), F.posexplode_outer(parts).alias("idx", "text"))
    return pieces.where(F.col("idx").isNotNull()).select(
        F.concat_ws("#", F.col("id"), F.col("_key").cast("string"), F.col("idx").cast("string")).alias("seg_key"),
        segment_label(F.col("id"), F.col("idx")).alias("label"),
        "text",
        "id",
        "idx",
    )


def learn_abbreviations(df: DataFrame, text: str = "text", threshold: float = 0.3, max_length: int = 6) -> DataFrame:
    """Words that behave like abbreviations: almost always followed by a dot.

    Dunning's log-likelihood of "word then dot" against the overall rate of dots,
    scaled down for long words and for words also seen without a dot, as in
    unsupervised sentence boundary detection (Kiss & Strunk 2006).
    """
    pieces = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{M}]+\.?"), F.lit(0))
    counted = (
        df.select(F.explode_outer(pieces).alias("piece"))
        .where(F.col("piece").isNotNull())
        .select(
            F.regexp_replace("piece", r"\.$", "").alias("word"),
            F.col("piece").endswith(".").cast("long").alias("dotted"),
        )
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("dotted").alias("dots"))
    )
    rate = counted.select((F.sum("dots") / F.sum("n")).alias("rate")).scalar()

    def log_likelihood(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.col("dots") * F.log(p) + (F.col("n") - F.col("dots")) * F.log(1 - p)

    ratio = 2 * (log_likelihood(F.lit(0.99)) - log_likelihood(F.col("rate")))
    length = F.length("word")
    score = (
        ratio
        * F.exp(-length)
        * F.pow(length, F.lit(-1.0) * (F.col("n") - F.col("dots")))
    )
    return (
        counted.where((F.col("dots") > 0) & (length <= max_length))
        .withColumn("rate", rate)
        .select("word", "n", "dots", score.alias("score"))
        .where(F.col("score") >= threshold)
    )

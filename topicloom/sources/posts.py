"""Sources and sinks of posts, segments, vectors, stop words and metrics."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.fixed_values import DANISH_STOPWORDS

FORMATS = {".parquet": "parquet", ".csv": "csv"}

# Column names of the known post layouts, as (id, text).
LAYOUTS = {
    "posts": ("ID", "Text"),
    "ads": ("ann_id", "annonce_tekst"),
    "sections": ("section_id", "section_text"),
}


def _format_of(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"cannot read {suffix!r}; these endings can be read: {sorted(FORMATS)}")
    return FORMATS[suffix]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whichever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def rename_posts(df: DataFrame, id_col: str, text_col: str, order_col: str | None = None) -> DataFrame:
    """Two string columns ``id`` and ``text``, text not null, plus the order key ``ord``."""
    order = F.col(order_col or id_col).alias("ord")
    return df.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), order
    ).where(F.col("text").isNotNull())


def first_n(df: DataFrame, n: int | None, order: str | Column = "ord") -> DataFrame:
    """The first ``n`` rows in the given order; ``None`` keeps all."""
    return df if n is None else df.orderBy(order).limit(n)


def load_posts(
    spark: SparkSession,
    path: str,
    layout: str | tuple[str, str] = "posts",
    order_col: str | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Posts from Parquet or CSV.

    ``layout`` is a name from ``LAYOUTS`` or an (id column, text column) pair.
    ``order_col`` gives the row order (default: the id column).
    """
    if isinstance(layout, str):
        if layout not in LAYOUTS:
            raise ValueError(f"Unknown layout: {layout!r}; known are {sorted(LAYOUTS)}")
        layout = LAYOUTS[layout]
    fmt = _format_of(path)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"nothing is stored at {path}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return first_n(rename_posts(reader.load(path), *layout, order_col), n_rows)


def write_texts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_texts(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"nothing is stored at {path}")
    return spark.read.parquet(path)


def text_column(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The text column as ``text`` (the first column if the named one is absent)."""
    source = text_col if text_col in df.columns else df.columns[0]
    return df.select(*keep, F.col(source).alias("text"))


def write_embeddings(df: DataFrame, path: str, key: str = "seg_key", vector: str = "embedding") -> None:
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored vectors, or ``None`` if there are none yet."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def load_stopwords(spark: SparkSession, path: str | None = None) -> list[str]:
    """Stop words from a JSON array file, or the built-in Danish list.

    A stop-word list is a parameter of the text expressions, so it is returned
    as a Python list and becomes a literal in the plan.
    """
    if path is None:
        return list(DANISH_STOPWORDS)
    rows = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", T.ArrayType(T.StringType()))).alias("word")
    )
    return [r.word for r in rows.collect()]


def write_topic_info(df: DataFrame, path: str) -> None:
    """CSV sink; arrays are written as JSON."""
    columns = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per part of the model."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(os.path.join(path, name))


def load_model(spark: SparkSession, path: str, names: Sequence[str] = ("assignments", "topic_embeddings", "config")):
    return {name: spark.read.parquet(os.path.join(path, name)) for name in names}


def observe_count(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that fills while another action runs: no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def run_metrics(spark: SparkSession, rows: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Metrics as (stage, metric, value) rows."""
    return spark.createDataFrame(
        [(s, m, float(v)) for s, m, v in rows], "stage string, metric string, value double"
    )

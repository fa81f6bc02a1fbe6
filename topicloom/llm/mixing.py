"""Mixing sources to target weights by iterative proportional fitting.

Token totals per (source, language, topic) cell are raked until the totals of
every source, language and topic stand in the wanted proportions; documents are
then sampled with the calibrated probability of their cell.  Only SQL functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.names import free_name
from topicloom.session import cut_lineage

#: A target for one dimension: shares by value, or an exponent that flattens (below 1) the shares as they are.
Target = Mapping[str, float] | float

#: The kind of a text, in SQL: what it is made of, or how long it is.
KIND = """CASE WHEN 20 * (length(text) - length(replace(text, '|', ''))) > n_tokens THEN 'table'
  WHEN 4 * (length(text) - length(replace(text, '!', ''))) > n_tokens THEN 'shout'
  WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'middle' ELSE 'long' END"""


def with_topic(docs: DataFrame) -> DataFrame:
    """``docs`` with n_tokens (words) and topic, which is the kind of text: what it is made of and how long it is, not what it is about.

    A null text counts as an empty one; the text itself stays.  Columns named like a
    result are replaced.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    counted = docs.withColumn("n_tokens", words.cast("long"))
    return counted.withColumn("topic", F.expr(KIND.replace("text", "coalesce(text, '')")))


def _level(name: str) -> Column:
    """The value as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{name}`").cast("string")), F.lit("null"))


def _shares(cells: DataFrame, dim: str, target: Target) -> DataFrame:
    """dim, target: shares that add up to 1 over the values with tokens.

    Values that a mapping leaves out divide what it leaves of 1 in proportion to
    their tokens; listed values that do not occur are left out.
    """
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("have")).where("have > 0")
    if isinstance(target, Mapping):
        listed = F.create_map(*[F.lit(x) for k, v in target.items() for x in (f"={k}", float(v))]) if target else None
        sums = sums.withColumn("want", F.try_element_at(listed, F.col(dim)) if target else F.lit(None).cast("double"))
        free = max(0.0, 1.0 - sum(target.values()))
        rest = sums.agg(F.sum(F.when(F.col("want").isNull(), F.col("have")))).first()[0] or 1
        sums = sums.withColumn("want", F.coalesce("want", F.lit(free) * F.col("have") / F.lit(float(rest))))
    else:
        sums = sums.withColumn("want", F.pow(F.col("have"), F.lit(float(target))))
    whole = sums.agg(F.sum("want")).first()[0] or 1.0
    return sums.select(dim, (F.col("want") / F.lit(float(whole))).alias(f"{dim}_target"))


#: Sweeps over all dimensions; each shrinks the error of the shares several times.
SWEEPS = 12


def rake(cells: DataFrame, dims: Sequence[str], targets: Sequence[Target], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (dims..., tokens) with ``factor``: tokens * factor has the wanted marginals, up to a common scale.

    A sweep scales every dimension once and is written as one small table.  Sums
    are pre-aggregated, so a value with most of the cells is no burden.  Cells of a
    value without tokens keep their factor.
    """
    cells = cut_lineage(
        reduce(lambda df, pair: df.join(_shares(cells, *pair), pair[0], "left"), zip(dims, targets), cells).withColumn("factor", F.lit(1.0))
    )
    for _ in range(sweeps):
        for dim in dims:
            sums = cells.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("factor")).alias("_sum"))
            scale = F.when(F.col("_sum") > 0, F.col(f"{dim}_target") / F.col("_sum")).otherwise(1.0)
            cells = cells.join(sums, dim).withColumn("_scale", F.coalesce(scale, F.lit(1.0)))
            cells = cells.withColumn("factor", F.col("factor") * F.col("_scale"))
            cells = cells.drop("_sum", "_scale")
        cells = cut_lineage(cells)
    return cells.drop(*[f"{d}_target" for d in dims])


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(
    table: DataFrame,
    targets: Mapping[str, Target],
    tokens: str = "n_tokens",
    budget: float | None = None,
    key: str = "doc_id",
    seed: int = 0,
) -> DataFrame:
    """``table`` with ``probability`` and ``sampled``; one row per row.

    ``targets`` maps dimension columns to their targets.  Expected tokens of the
    sample have the wanted marginals and add up to ``budget``, or to the most that
    leaves every probability at 1 or below, which also bounds a larger budget.
    Null values are a value of their own; null tokens count as 0; equal keys are
    sampled together; an empty table gives an empty one.  Columns of ``table``
    named probability or sampled are replaced.
    """
    table = table.drop("probability", "sampled")
    dims = [free_name(table, f"level_{i}") for i in range(len(targets))]
    levels = table.select("*", *[_level(name).alias(dim) for name, dim in zip(targets, dims)])
    size = F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("double")
    cells = cut_lineage(levels.groupBy(*dims).agg(F.sum(size).alias("tokens")))
    raked = rake(cells, dims, list(targets.values()))
    whole, steepest = raked.where("tokens > 0").agg(F.sum(F.col("tokens") * F.col("factor")), F.max("factor")).first()
    scale = 1.0 / steepest if steepest else 0.0
    if budget is not None and whole:
        scale = min(scale, budget / whole)
    rates = raked.select(*dims, F.least(F.lit(1.0), F.col("factor") * F.lit(scale)).alias("probability"))
    mixed = levels.join(rates, dims).drop(*dims)
    return mixed.withColumn("sampled", uniform(F.col(f"`{key}`"), seed) < F.col("probability"))

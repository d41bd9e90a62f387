"""Mixing sources to target weights by Poisson replication (operator 9)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.llm.common import Scratch, fresh

#: A mean above this is drawn as a sum of independent draws of equal, smaller means, so that exp(-mean) stays normal.
MOST_MEAN = 500.0
#: Bits of the uniform value that is inverted.
UNIFORM_HEX = 13


def uniform(*parts: Column) -> Column:
    """A value in (0, 1) from the md5 of the parts, the same in every engine."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, UNIFORM_HEX), 16, 10).cast("double") + 0.5) / F.lit(float(16**UNIFORM_HEX))


def inverse_poisson(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) >= u for a Poisson X of that mean."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["k"] + F.when(u > acc["c"], 1).otherwise(0)).alias("k"))

    return F.aggregate(steps, start, step, lambda acc: acc["k"])


def poisson_count(seed: int, key: Column, mean: Column) -> Column:
    parts = F.greatest(F.lit(1), F.ceil(mean / MOST_MEAN).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + inverse_poisson(uniform(F.lit(seed), key, i), mean / parts))


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 1, copy_column: str | None = "copy_no"
) -> DataFrame:
    """Each document as often as a Poisson draw of its source's mean repetition rate says, in a global random order.

    A source's rate is epochs * (all characters) * (its share of the weights) / (its characters), so the expected
    characters of the sources stand in the ratio of the weights. `weights` names sources, all others have
    `default_weight`; null is a source of its own under the default, and a source without a character counts as one
    character. The draw is a function of seed and doc_id: rows with equal doc_id get equal counts. A weight of 0
    removes a source. Copies are numbered from 1 in `copy_column`, which replaces a column of that name (None: no
    such column); all other columns of docs stay, whatever their names. An empty table gives an empty one. Rows are dealt by a hash of document and copy and sorted by it within
    each partition, which is a random order over the whole output; a hot source is spread like any other.
    """
    if any(w < 0 for w in [*weights.values(), default_weight]) or epochs < 0:
        raise ValueError("weights and epochs must not be negative")
    scratch = Scratch(docs.sparkSession, "mixing")
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, float(value)).otherwise(weight)
    sizes = docs.groupBy("source").agg(F.greatest(F.sum(F.coalesce(F.length("text"), F.lit(0))), F.lit(1)).alias("_chars"))
    sizes = scratch.write(sizes.select("source", "_chars", weight.alias("_weight")), "sizes")
    total, share = sizes.agg(F.sum("_chars"), F.sum("_weight")).first()
    rate = F.lit(float(epochs * (total or 0))) * F.col("_weight") / F.lit(float(share or 1.0)) / F.col("_chars")
    of, mean, times, copy, place = (fresh(docs, f"_mix_{x}") for x in ("source", "rate", "times", "copy", "place"))
    rates = scratch.small(sizes.select(F.col("source").alias(of), rate.alias(mean)), "sizes")
    counted = docs.join(rates, F.col("source").eqNullSafe(F.col(of))).withColumn(times, poisson_count(seed, F.col("doc_id"), F.col(mean))).where(F.col(times) > 0)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    dealt = copies.withColumn(place, F.xxhash64(F.lit(seed), "doc_id", copy)).repartition(place).sortWithinPartitions(place)
    if copy_column:
        dealt = dealt.withColumn(copy_column, F.col(copy))
    return dealt.drop(of, mean, times, copy, place)


#: Production weights of the query: three times the default for src1, half for the largest source's neighbours.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}
SEED = 20


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS, seed=SEED)


def mixing_sql(documents: str, weights: Mapping[str, float], seed: int) -> str:
    """The same rows in DuckDB; only for means of at most MOST_MEAN."""
    cases = " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in weights.items())
    return f"""
WITH RECURSIVE d AS (SELECT * FROM {documents}),
sizes AS (SELECT source, greatest(sum(coalesce(length(text), 0)), 1)::BIGINT AS chars, CASE source {cases} ELSE 1.0::DOUBLE END AS weight FROM d GROUP BY source),
totals AS (SELECT sum(chars)::BIGINT::DOUBLE AS total, sum(weight) AS share FROM sizes),
rates AS (SELECT source, total * weight / share / chars AS rate FROM sizes, totals),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c, 0.0::DOUBLE AS below FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1), c FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
),
drawn AS (SELECT d.*, rates.rate, (('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|1'), 1, {UNIFORM_HEX}))::BIGINT::DOUBLE + 0.5) / {float(16**UNIFORM_HEX)!r}::DOUBLE AS u
  FROM d JOIN rates ON d.source IS NOT DISTINCT FROM rates.source)
SELECT drawn.* EXCLUDE (rate, u), steps.k AS copy_no FROM drawn JOIN steps ON drawn.source IS NOT DISTINCT FROM steps.source AND steps.k >= 1 AND drawn.u > steps.below
"""


QUERIES = {"op9_source_mixing": op9_source_mixing}
ORACLE_SQL = {"op9_source_mixing": mixing_sql("documents", WEIGHTS, SEED)}

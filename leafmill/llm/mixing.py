"""Mixing sources to target weights.

Sizes are words. Sizes are summed per source first, so what follows the corpus scan is one row per source:
targets come from weights by *filling up*: a source gets its weight's share of the total, but at most
``most`` times its size, and what that leaves over is shared again by weight among the rest. The fixed point
of that rule is ``target = min(cap, level * weight)`` with one level for all, which window sums over the
sources give without iterating.

Each document is then taken floor(rate) times, plus once more with the probability of the fraction. The draw
is a hash of the document's id and a seed, so that reruns agree and no order or partition matters.

Defined results: null sources are one source of their own, the last. Null and empty text has size 0 and is taken 0 words. Rows
with the same id draw alike, repeated rows among them. Sources that fill up at the same level are told apart by name. An empty
table gives no rows. The rows of the mixture have the columns of the table, whatever their names. Texts of any length
are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of, written

#: Weights of the sources in order of their names, repeating (fixed values).
WEIGHTS = (5, 2, 1)


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size`` -> the same with ``target``. One row per source; the windows run over sources only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    by = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("nth").asc())
    before, after, everything = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    return (
        sizes.withColumn("nth", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        # the level if this source and all that fill up later stay below their caps
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # the first source whose cap lies above its level sets it for all; from there on levels only fall
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
        .select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def plan(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, size: Column | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every document.

    The texts are read once: ids, sources and sizes are written to the shared folder, then summed and joined.
    A hot source costs nothing in the sum (partial sums) and is split by AQE in the join.
    """
    sized = written(docs.select("doc_id", "source", (words_of(F.col("text")) if size is None else size).alias("size")), "sizes")
    sums = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor("rate") + (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return (
        sized.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target")
        .withColumn("rate", rate).withColumn("copies", copies.cast("int")).drop("rate")
    )


def mix(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mixture: each row of ``docs`` as often as it is taken, its columns unchanged.

    The rates of the sources (one row each) meet the documents; texts are not shuffled unless the number of
    sources is too large for Spark's own, size-checked broadcast.
    """
    sums = targets(docs.groupBy("source").agg(F.sum(words_of(F.col("text"))).alias("source_size")), share, most, weights)
    rates = written(sums.select(F.col("source").alias("__source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate")), "rates")
    copies = F.floor("__rate") + (draw(F.col("doc_id"), seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    taken = docs.join(rates, docs["source"].eqNullSafe(rates["__source"])).where(copies > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*[docs[c] for c in docs.columns])


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, [5.0::DOUBLE, 2.0, 1.0][nth % 3 + 1] AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sums)),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
filled AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target FROM levels),
rated AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate
  FROM sized d JOIN filled s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated"""

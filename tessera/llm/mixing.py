"""Mixing sources to target weights, with DataFrame functions only.

Word counts are summed per source (pre-aggregated, one row a source and task), the source table is
turned into repetition rates by one window over the sources, and every document is then emitted
``floor(rate)`` times plus one copy more if a draw seeded by its id falls below the fraction.
The source table is joined by broadcast only if it is below ``BROADCAST_SOURCES`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import checkpoint, fresh, table, word_count

#: No document is taken more often than this.
MOST_COPIES = 3
#: Weights of the sources in order of their names (code points, null last), repeating.
WEIGHTS = (1, 2, 3)
#: Above so many sources their table is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def draw(key: Column, seed: int = 42) -> Column:
    """Uniform in [0, 1), the same for the same key and seed on every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, size`` per document -> ``source, source_size, target, rate`` per source.

    The targets share the total size by weight; a target stops at ``most`` times its source's size
    and what it leaves is shared again by weight until none is above. That fixed point is found at
    once: with sources in order of ``most * size / weight``, the capped ones come first.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = per.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    )
    order = W.orderBy((F.col("source_size") * F.lit(most)) / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cap = F.col("source_size") * F.lit(most)
    at = (
        ranked.withColumn("capped_before", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("capped_before")).cast("double") / F.col("weight_left").cast("double"))
        .withColumn("capped", cap.cast("double") <= F.col("level") * F.col("weight"))
        # the level of the first source that is not capped holds for all after it
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct("capped_before", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("level") * F.col("weight"))
    return at.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0)).alias("rate"),
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 42,
) -> DataFrame:
    """All columns of ``docs`` plus a struct ``mix(size, source_size, target, rate, copies, taken)``.

    A null text has size 0, a null source is a source of its own, repeated rows share their draw, a
    source of size 0 has rate 0, an empty table gives an empty result. The struct's name gets
    underscores until it clashes with no column; it is the last column.
    """
    mix, key = fresh(docs, "mix"), fresh(docs, "mix_source")
    sized = docs.withColumn(mix, F.struct(word_count(F.col(text_col)).alias("size")))
    counts = sized.select(F.col(source_col).alias("source"), F.col(f"{mix}.size").alias("size"))
    rates = checkpoint(source_rates(counts, weights, most)).select(
        F.col("source").alias(key), F.struct("source_size", "target", "rate").alias(f"{key}_rate")
    )
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.join(rates, F.col(source_col).eqNullSafe(F.col(key)))
    rate = F.col(f"{key}_rate.rate")
    copies = (F.floor(rate) + (draw(F.col(id_col), seed) < rate - F.floor(rate)).cast("long")).cast("long")
    size = F.col(f"{mix}.size")
    done = F.struct(
        size.alias("size"),
        F.col(f"{key}_rate.source_size").alias("source_size"),
        F.col(f"{key}_rate.target").alias("target"),
        rate.alias("rate"),
        copies.alias("copies"),
        (copies * size).alias("taken"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], done.alias(mix))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``."""
    plan = mix_plan(docs, **options)
    copies = F.col(f"{plan.columns[-1]}.copies")
    again = fresh(plan, "copy")
    repeated = plan.where(copies > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(again))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op1``: one row per document."""
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", *[F.col(f"mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY (source IS NULL), encode(source)) AS rank FROM s),
w AS (SELECT *, 1 + (rank - 1) % 3 AS weight FROM r),
a AS (
  SELECT *,
    coalesce(sum(3 * source_size) OVER b, 0)::BIGINT AS capped_before,
    (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS weight_left,
    (sum(source_size) OVER ())::BIGINT AS total
  FROM w
  WINDOW b AS (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped_before)::DOUBLE / weight_left::DOUBLE AS level FROM a),
c AS (SELECT *, (3 * source_size)::DOUBLE <= level * weight AS capped FROM l),
f AS (SELECT arg_min(level, capped_before) AS level FROM c WHERE NOT capped),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE f.level * weight END AS target
  FROM c LEFT JOIN f ON true),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""

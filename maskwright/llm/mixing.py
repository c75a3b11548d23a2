"""Operator 9: mixing sources to target weights. DataFrame operations only.

Sizes are words (`[^\\x20\\x09-\\x0D]+`). Sources in the order of code points, null last, weigh 1, 2, 3, 1, 2, 3 ...
and share all words by weight; a source's target stops at `most` times its size, and what is above is shared again by
weight among the others until none is above. That has a closed form: with sources ordered by the ratio of cap to
weight, the first few are at their caps and the rest share what is left. A source's rate is target over size; each
document is emitted floor(rate) times, plus once more if a hash of seed and doc_id falls below the fraction.

One row for each source is aggregated first; sums over sources in an order are taken by range, so that a source for each
web domain fits too. Sizes are written once, so that words are counted once.
Documents join the rates by source without a hint: small rates are broadcast by size, large ones meet in a join whose
skewed partitions are split.

Defined cases: null text has size 0; a source without words has target 0 and is emitted 0 times; a null doc_id hashes
as the word null, so such rows share one draw; repeated rows share one draw too; empty tables give no rows. `mix`
carries all columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import WORD, read, text_of, written

MOST, SEED = 3, "mix-1"


def running(rows: DataFrame, order: list, name: str, **sums) -> DataFrame:
    """rows with columns that hold, for each of sums, its total over the rows that come before in the order. No task sees all
    rows: they are sorted by range and written, and what the parts before hold is added to the sums within a part."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), name)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows
    held = parts.groupBy("part").agg(*(F.sum(c).alias(f"in_{k}") for k, c in sums.items()))
    held = held.select("part", *(F.coalesce(F.sum(f"in_{k}").over(before), F.lit(0)).alias(f"in_{k}") for k in sums))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = parts.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(k) for k, c in sums.items()))
    return within.join(held, "part").withColumns({k: F.col(k) + F.col(f"in_{k}") for k in sums}).drop("part", *(f"in_{k}" for k in sums))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate from rows of source and size."""
    by_source = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ranked = running(by_source, [F.col("source").asc_nulls_last()], "mix-ranks", rank=F.lit(1))
    weighed = ranked.withColumn("weight", F.col("rank") % 3 + 1).withColumn("cap", F.lit(most) * F.col("source_size")).drop("rank")
    weighed = written(weighed.withColumn("ratio", F.col("source_size") / F.col("weight")), "mix-weights")
    by_ratio = running(weighed, [F.col("ratio"), F.col("source").asc_nulls_last()], "mix-ratios", capped=F.col("cap"), passed=F.col("weight"))
    all_ = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()  # two numbers
    left = by_ratio.withColumns({"left_words": F.lit(all_["words"]) - F.col("capped"), "left_weight": F.lit(all_["weight"]) - F.col("passed")})
    # the first source, in order of ratio, whose share of what is left is under its cap sets the level; of equal ratios it is
    # the one before which the most is left
    open_ = left.filter(F.col("cap") * F.col("left_weight") >= F.col("left_words") * F.col("weight"))
    level = open_.agg(F.min(F.struct("ratio", (-F.col("left_words")).alias("w"), (-F.col("left_weight")).alias("g"))).alias("level")).first()["level"]  # three numbers
    cap = F.col("cap").cast("double")
    target = F.least(cap, F.col("weight") * F.lit(-level["w"]) / F.lit(-level["g"])) if level else cap
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return weighed.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def copies(rate, id_col: str = "doc_id", seed: str = SEED):
    """How often a document is emitted."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))


def with_rates(docs: DataFrame, rates: DataFrame, source_col: str = "source") -> DataFrame:
    r = rates.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"))
    return docs.join(r, F.col(source_col).eqNullSafe(F.col("__source")))


def mix(docs: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their columns, whatever their names."""
    rates = written(targets(sizes_of(docs), most), "mix-rates")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"))
    n = copies(F.col("__rate"), seed=seed).cast("int")
    return with_rates(rows, rates).select("row", F.explode(F.array_repeat(F.lit(1), n)).alias("copy")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(sizes_of(read(spark, sf_dir, "documents", "doc_id", "source", "text")), "mix-sizes")
    rates = written(targets(sizes), "mix-rates")
    return with_rates(sizes, rates).select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("size") * copies(F.col("__rate"))).cast("long").alias("taken"),
    )


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM b),
o AS (SELECT *, source_size::DOUBLE / weight AS ratio,
        CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_words,
        CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_weight
      FROM w),
f AS (SELECT left_words AS lw, left_weight AS lg FROM o WHERE cap * left_weight >= left_words * weight ORDER BY ratio, left_words DESC, left_weight DESC LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, (weight * lw)::DOUBLE / lg) AS target FROM o, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0 END AS rate FROM t)
SELECT s.doc_id, s.size, r.source_size, r.target,
  CAST(s.size * (floor(r.rate) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
"""

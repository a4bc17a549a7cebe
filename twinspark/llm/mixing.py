"""Mixing sources to target weights.

Tokens (words) are summed per source, targets follow from the weights by water filling under a
repetition cap, and each document is emitted floor(rate) times plus one Bernoulli copy whose
probability is the fraction; the draw is a hash of a seed and the document id, so reruns agree.

Defined results: a null text has size 0 and is emitted like any other document of its source; a null
source is a source of its own, last in the order; a source whose size is 0 has target 0 and rate 0
(its documents hold no words to take); rows that repeat a document id share one draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import n_words, read

#: Weights by the rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Percent of all sizes that the mix holds, and the most repetitions of a source.
SHARE, MOST = 150, 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """sizes(source, source_size), a row a source -> with weight, target, rate.

    Water filling in closed form: with sources in ascending order of cap/weight, a source is held at
    its cap when the level left for it and those after it lies above its own. The windows run over one
    row per source, which partial aggregation has made from any number of documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).cast("long").alias("cap"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    s = s.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        F.sum("weight").over(everything).alias("weight_all"),
        (F.sum("source_size").over(everything) * F.lit(share) / F.lit(100.0)).alias("total"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    s = s.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("weight") < F.col("level"))
    least = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("cap_before"), F.col("level")))).over(everything)
    s = s.withColumn("open_level", least["level"])
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * F.col("open_level"), F.col("cap").cast("double")))
    s = s.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return s.select("source", "source_size", "weight", "target", rate.alias("rate"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", keep: bool = False, **how) -> DataFrame:
    """Per document: id, size, source_size, target, rate, copies; with keep, beside docs' own columns (as struct `doc`).

    The join with the table of sources is left to the planner: it broadcasts that table when its
    measured size is under the session's limit, and else sorts and splits skewed sources.
    """
    size = n_words(F.col(text_col))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if keep else []))
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("source_size"))
    t = targets(sizes, **how).withColumnRenamed("source", "__source")
    joined = own.join(t, own["source"].eqNullSafe(t["__source"])).drop("__source")
    copies = F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' own columns, each row as often as its plan says."""
    p = planned(docs, keep=True, **how).where("copies > 0")
    return p.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    p = planned(read(spark, sf_dir))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM s),
c AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 150 / 100.0::DOUBLE AS total, sum(weight) OVER () AS weight_all,
  coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cap_before,
  coalesce(sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w),
l AS (SELECT *, (total - cap_before) / (weight_all - weight_before) AS level FROM c),
o AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, cap_before LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN ratio < level THEN cap::DOUBLE ELSE least(weight * (SELECT level FROM o), cap::DOUBLE) END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM t),
j AS (SELECT d.doc_id, d.size, r.source_size, r.target, d.source,
  CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM j
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix: each document as often as its source's rate and its draw say."""
    return mixed(docs)

"""Keyed tables on Parquet: upserts, differences, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..storage import written


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def changed(before: DataFrame, now: DataFrame, key: str, stamps: list[str]) -> DataFrame:
    """key and status: added, changed, same or deleted, by null-safe comparison of the stamps."""
    b = before.select(F.col(key).alias("__b"), *[F.col(c).alias(f"__{c}") for c in stamps])
    same = F.lit(True)
    for c in stamps:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    j = now.select(key, *stamps).join(b, F.col(key) == F.col("__b"), "full_outer")
    status = F.when(F.col("__b").isNull(), "added").when(F.col(key).isNull(), "deleted").when(same, "same").otherwise("changed")
    return j.select(F.coalesce(key, "__b").alias(key), status.alias("status"))


def missing(rows: DataFrame, done: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Rows without a result yet; with `version`, results of another one of that column's values don't count."""
    return rows.join(done.select(*key, *([version] if version else [])), key + ([version] if version else []), "left_anti")


def removed(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """rows without those of gone's keys."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def numbered(rows: DataFrame, order: list, name: str = "ord") -> DataFrame:
    """rows with their place from 0 in one order over all: sorted by ranges, so no task sees more than its part."""
    d = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    # a row a partition
    sizes = d.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return d.withColumn("__part", part).join(before, "__part").withColumn(name, F.col("__before") + at).drop("__part", "__id", "__before")


def marked(rows: DataFrame, done: DataFrame, key: list[str], column: str, value) -> DataFrame:
    """rows with `value` in the column where their key is in `done`; others keep what they have."""
    hit = done.select(*key).distinct().withColumn("__hit", F.lit(True))
    d = rows.join(hit, key, "left")
    return d.withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__hit").select(*rows.columns)

"""Keep-one filters and merges on tables without a table format: each gives the whole new state, to be published as a version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``: a window whose row limit Spark pushes below the shuffle, so that a hot key sends one row per task."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def flag_first(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """All rows, with whether each is the first of its key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)


def keep_highest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per key with the highest ``by``, by a pre-aggregated max_by over the whole row."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the source rows whose keys it lacks; stored rows never change."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def conditional(target: DataFrame, source: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Update where the incoming sequence is higher than the stored, insert where the key is new; on equal sequences the stored row stays."""
    both = target.withColumn("__new", F.lit(0)).unionByName(source.withColumn("__new", F.lit(1)))
    return keep_first(both, keys, [F.desc_nulls_last(seq), F.asc("__new")]).drop("__new")


def replace_keys(target: DataFrame, rebuilt: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    """Delete the affected keys, then insert what was rebuilt; an affected key without rebuilt rows is gone."""
    same = reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys))
    return target.alias("t").join(affected.select(*keys).distinct().alias("a"), same, "left_anti").unionByName(rebuilt)


def newer_than(source: DataFrame, target: DataFrame, seq: str, by: str | None = None) -> DataFrame:
    """Source rows above the target's high-water mark; with ``by`` each source has its own mark. An empty target takes all."""
    if by is None:
        return source.where(F.col(seq) > target.agg(F.coalesce(F.max(seq), F.lit(-1))).scalar())
    marks = target.groupBy(by).agg(F.max(seq).alias("__mark"))
    return source.join(marks, by, "left").where(F.col("__mark").isNull() | (F.col(seq) > F.col("__mark"))).drop("__mark")

"""Hot groups: found by counting hash slots, then split by salt.

A slot is one of many hashes of the key, SLOTS_PER_PARTITION for each partition, so that an even slot is a
small part of an even partition at any size.  Counting slots pre-aggregates in every task; a slot is hot if it
alone outgrows an even partition, so that there are fewer hot slots than partitions.  A key that holds a third
of all rows makes its slot hot; keys that share the slot are salted with it, which costs a second fold of their
winners and changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

#: Slots at least, and for each partition.
LEAST_SLOTS, SLOTS_PER_PARTITION = 1 << 16, 16
#: A slot with fewer rows than this is never hot.
LEAST_ROWS = 20_000
#: Up to so many hot slots stand in the plan itself; more are a table, broadcast up to so many rows (16 bytes each).
INLINE, BROADCAST_ROWS = 256, 1 << 20
#: Estimates from here on mean that the size isn't known.
UNKNOWN = 1 << 55


def partitions(df: DataFrame, target_mb: int = 64) -> int:
    """Shuffle partitions for ``df`` by its estimated size, at least the session's number. Where no size is known (streams, rows from RDDs), rows are counted and taken at their type's usual width."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= UNKNOWN:
        estimate = df.count() * int(df._jdf.schema().defaultSize())
    return max(least, estimate // (target_mb << 20))


@dataclass(frozen=True)
class Slots:
    """The slots of a table's keys and which of them are hot, into how many salts each must be split."""

    n: int
    few: dict[int, int]
    many: DataFrame | None = None

    def __bool__(self) -> bool:
        return bool(self.few) or self.many is not None

    def of(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.n)).cast("int")

    def marked(self, df: DataFrame, slot: str, name: str) -> DataFrame:
        """``df`` with the number of salts of each row's slot as ``name``: 1 where it isn't hot."""
        if self.many is not None:
            hot = self.many.select(F.col("slot").alias(slot), F.col("salts").alias(name))
            hot = F.broadcast(hot) if self.many.count() <= BROADCAST_ROWS else hot
            return df.join(hot, slot, "left").withColumn(name, F.coalesce(name, F.lit(1)))
        if not self.few:
            return df.withColumn(name, F.lit(1))
        salts = F.create_map(*[F.lit(x) for kv in self.few.items() for x in kv])
        return df.withColumn(name, F.coalesce(F.element_at(salts, F.col(slot)), F.lit(1)))


def slots(df: DataFrame, keys: list[Column], parts: int) -> Slots:
    """Count the slots of ``df`` and find those with more rows than an even partition."""
    n = max(LEAST_SLOTS, 1 << (SLOTS_PER_PARTITION * parts - 1).bit_length())
    found = Slots(n, {})
    counted = df.select(found.of(*keys).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    # The total is a subquery over the same counts, whose shuffle Spark reuses.
    even = F.greatest(counted.agg(F.sum("n").cast("double")).scalar() / F.lit(float(parts)), F.lit(float(LEAST_ROWS)))
    hot = counted.withColumn("even", even).where(F.col("n") > F.col("even")).select("slot", F.ceil(F.col("n") / F.col("even")).cast("int").alias("salts"))
    few = hot.limit(INLINE + 1).collect()
    if len(few) > INLINE:
        return Slots(n, {}, storage.staged(hot, "hot"))
    return Slots(n, {r["slot"]: r["salts"] for r in few})


def salt(salts: Column, *spread: Column) -> Column:
    """A salt below ``salts``, from columns that differ among the rows of one key."""
    return F.pmod(F.xxhash64(*spread), salts).cast("int")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, where its few files would leave cores idle. With ``keys`` the rows are placed by them, which later groups by these keys reuse."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df

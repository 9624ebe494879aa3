"""Aggregates by event time that are corrected as late events arrive, up to a limit of lateness.

The state of a period is a multiset: each value with its count.  A late event adds to a count, a retraction
takes from one, and counts of nought vanish; medians, distinct counts and extremes are then read again from
cumulative counts, exactly.  Cumulative counts go through coarse bins of values first, so that the values of
a period that holds a third of all rows are never ordered in one task.

The state is stored, with the adjustments that late events made to it, and absorbs only what arrived after it:
a run reads the batches above its high-water mark and the state, never the events of earlier runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage

#: Bits of a value that its coarse bin leaves out.
BIN_BITS = 10


def first_of(rows: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """The first row of each key by ``order``: a minimum with map-side pre-aggregation, so that a hot key stays small. Null keys are dropped."""
    names = [*order, *carry]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*names)).alias("m")).select(key, *[F.col(f"m.{n}").alias(n) for n in names])


def judged(events: DataFrame, built: DataFrame, period: str, seq: str, arrived: str, closes: Column) -> DataFrame:
    """Events with ``standing``: 'in_base' (its batch is within the built figures), 'late' (after them, arrived before the
    period's cut-off ``closes``) or 'too_late'.  Events of a period without built figures, and events with a null period,
    sequence or arrival, have none: null.  ``built`` has one row per period: (period, built_seq)."""
    joined = events.join(built, period, "left")
    standing = F.when(F.col(arrived).isNotNull(), F.when(F.col(seq) <= F.col("built_seq"), "in_base").when((F.col(seq) > F.col("built_seq")) & (F.col(arrived) < closes), "late").when((F.col(seq) > F.col("built_seq")) & (F.col(arrived) >= closes), "too_late"))
    return joined.withColumn("standing", standing)


def multiset(rows: DataFrame, period: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(period..., value, n): the state of ``rows``; null values are kept out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*period, F.col(value).alias("value")).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("n"))


def adjusted(state: DataFrame, changes: DataFrame, period: list[str]) -> DataFrame:
    """The state after ``changes`` (same columns, n may be negative); counts of nought vanish."""
    return state.unionByName(changes).groupBy(*period, "value").agg(F.sum("n").cast("long").alias("n")).where("n <> 0")


class Store:
    """The stored multisets of events and their values: ``absorb`` brings them up to date, the other methods read them.

    Two tables are published together: ``events`` (period, value, base, late, too_late, seq), the multiset of
    event ids, which also says what was taken before (an event without standing counts nowhere); and ``values``
    (period, value, base, late), the multiset of what the events amount to.  ``base`` counts what the figures were
    built with, ``late`` what late events adjust.
    """

    def __init__(self, spark: SparkSession, table: str) -> None:
        self.spark, self.table = spark, table

    def _stored(self, part: str) -> DataFrame | None:
        try:
            return storage.current(self.spark, self.table, part)
        except FileNotFoundError:
            return None

    def mark(self) -> int | None:
        """The last batch that was absorbed; None of an empty store."""
        text = storage.read_text(self.spark, f"{self.table}/CURRENT") and storage.read_text(self.spark, f"{storage.current_folder(self.spark, self.table)}/mark")
        return int(text) if text else None

    def absorb(self, deliveries: DataFrame, key: str, seq: str, judge: Callable[[DataFrame], DataFrame], order: list[str], carry: list[str], period: str, value: str) -> "Store":
        """Take in the deliveries of batches above the mark. Of an event's deliveries the first by ``order`` counts, and
        none if an earlier run had one; ``judge`` gives each first delivery its ``period`` and ``standing`` (see ``judged``).
        ``value`` may be null: the event counts, its value doesn't. Deliveries without a batch count for nothing, and
        without new deliveries the state stays."""
        mark = self.mark()
        fresh = deliveries.where(F.col(seq).isNotNull() if mark is None else F.col(seq) > mark)
        first = first_of(fresh, key, order, carry)
        events, values = self._stored("events"), self._stored("values")
        if events is not None:
            first = first.join(events.select(F.col("value").alias(key)), key, "left_anti")
        n = lambda standing: F.col("standing").eqNullSafe(F.lit(standing)).cast("long")
        new = judge(first).select(F.col(period).alias("period"), F.col(key).alias("value"), F.col(value).alias("amount"), n("in_base").alias("base"), n("late").alias("late"), n("too_late").alias("too_late"), F.col(seq).alias("seq"))
        new = storage.staged(new, "fresh")
        last = new.agg(F.max("seq")).first()[0]
        if last is None and events is not None:
            return self
        per_value = new.where("amount is not null and base + late > 0").groupBy("period", F.col("amount").alias("value")).agg(F.sum("base").alias("base"), F.sum("late").alias("late"))
        new = new.drop("amount")
        parts = {
            "events": new if events is None else events.unionByName(new),
            "values": per_value if values is None else values.unionByName(per_value).groupBy("period", "value").agg(F.sum("base").alias("base"), F.sum("late").alias("late")),
        }
        storage.publish_all(self.spark, parts, self.table, {"mark": str(max(x for x in (last, mark, -(1 << 62)) if x is not None))})
        return self

    def adjustments(self) -> DataFrame:
        """(period, value, n): what late events added to the multiset of events."""
        return self._stored("events").where("late <> 0").select("period", "value", F.col("late").alias("n"))

    def corrected(self) -> DataFrame:
        """(period, value, n): the multiset of values with late events; counts of nought vanish."""
        return self._stored("values").select("period", "value", (F.col("base") + F.col("late")).alias("n")).where("n <> 0")


def period_figures(state: DataFrame, period: list[str]) -> DataFrame:
    """(period..., n, distinct_values, smallest, largest, total, median2): exact figures of whole-number values; median2 is twice the median, which keeps it whole."""
    bins = state.withColumn("bin", F.shiftright("value", BIN_BITS)).groupBy(*period, "bin").agg(F.sum("n").alias("bn"), F.count("*").alias("bd"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum(F.col("value").cast("decimal(38,0)") * F.col("n")).alias("bt"))
    whole = bins.groupBy(*period).agg(F.sum("bn").cast("long").alias("n"), F.sum("bd").cast("long").alias("distinct_values"), F.min("lo").alias("smallest"), F.max("hi").alias("largest"), F.sum("bt").cast("long").alias("total"))
    ordered = W.partitionBy(*period).orderBy("bin")
    before = bins.withColumn("before", F.sum("bn").over(ordered) - F.col("bn")).join(whole, period)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    wanted = before.where(((F.col("before") < low) & (low <= F.col("before") + F.col("bn"))) | ((F.col("before") < high) & (high <= F.col("before") + F.col("bn"))))
    # At most two bins a period are opened.
    inside = state.withColumn("bin", F.shiftright("value", BIN_BITS)).withColumnRenamed("n", "vn").join(wanted.select(*period, "bin", "before", F.col("n").alias("all_n")), [*period, "bin"])
    upto = F.col("before") + F.sum("vn").over(W.partitionBy(*period, "bin").orderBy("value"))
    inside = inside.withColumn("upto", upto)
    low, high = F.floor((F.col("all_n") + 1) / 2), F.floor((F.col("all_n") + 2) / 2)
    hit = lambda rank: (F.col("upto") - F.col("vn") < rank) & (rank <= F.col("upto"))
    medians = inside.groupBy(*period).agg((F.max(F.when(hit(low), F.col("value"))) + F.max(F.when(hit(high), F.col("value")))).cast("long").alias("median2"))
    return whole.join(medians, period)

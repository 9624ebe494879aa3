"""The latest right row at or before each left row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A right side estimated at no more than this is broadcast.
BROADCAST_BYTES = 16 << 20


def asof_left(left: DataFrame, right: DataFrame, on: tuple[str, str], by: list[str] = (), carry: list[str] = (), slice_width: int = 32) -> DataFrame:
    """Left rows with ``carry`` of the right row whose time is the latest at or before theirs; null where there is none.

    ``on`` names the time columns (dates or whole numbers), ``by`` columns of both sides that must be equal.  Rights must
    be unique by ``by`` and time; null times match nothing.  Each right row holds until the next one.  Rows that hold for
    a closed time are copied into the slices of time that they cover and joined by slice; the last row of each ``by``
    holds for ever and is joined by ``by`` alone.  Both are equi-joins: hashed and broadcast where the right side is small
    by its estimate, shuffled otherwise, and never a comparison of all rows with all.
    """
    lt, rt = on
    number = lambda df, c: F.unix_date(c).cast("long") if dict(df.dtypes)[c] == "date" else F.col(c).cast("long")
    small = int(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= BROADCAST_BYTES
    sent = F.broadcast if small else lambda df: df
    # A key of its own for the last rows where there is no ``by``, made of a column so that it isn't folded away.
    keys = [f"__k{i}" for i in range(len(by))]
    l = left.withColumns({"__t": number(left, lt), "__s": F.floor(number(left, lt) / slice_width).cast("long"), "__one": F.when(number(left, lt).isNotNull(), 1)} | {k: F.col(b) for k, b in zip(keys, by, strict=True)})
    r = right.where(F.col(rt).isNotNull()).select(*[F.col(b).alias(k) for k, b in zip(keys, by, strict=True)], F.struct(*[F.col(c).alias(c) for c in carry]).alias("__c"), number(right, rt).alias("__from"))
    r = _held_until(r, keys, slice_width)
    covered = F.sequence(F.floor(F.col("__from") / slice_width).cast("long"), F.floor((F.col("__to") - 1) / slice_width).cast("long"))
    closed = r.where("__to is not null").select(*[F.col(k).alias(f"{k}c") for k in keys], F.explode(covered).alias("__sc"), "__from", "__to", F.col("__c").alias("__closed"))
    last = r.where("__to is null").select(*[F.col(k).alias(f"{k}l") for k in keys], F.when(F.col("__from").isNotNull(), 1).alias("__onel"), F.col("__from").alias("__since"), F.col("__c").alias("__last"))
    same = lambda names, end: [F.col(k) == F.col(f"{k}{end}") for k in names]
    on_slice = [*same([*keys, "__s"], "c"), (F.col("__t") >= F.col("__from")) & (F.col("__t") < F.col("__to"))]
    on_last = [*same([*keys, "__one"], "l"), F.col("__t") >= F.col("__since")]
    joined = l.join(sent(closed), reduce(lambda x, y: x & y, on_slice), "left").join(sent(last), reduce(lambda x, y: x & y, on_last), "left")
    held = F.coalesce("__last", "__closed")
    return joined.select(*left.columns, *[held[c].alias(c) for c in carry])


def _held_until(r: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``__to``: when the next right row of the same keys begins to hold; null for the last."""
    sliced = r.withColumn("__rs", F.floor(F.col("__from") / width).cast("long"))
    firsts = sliced.groupBy(*keys, "__rs").agg(F.min("__from").alias("__first"))
    after = firsts.withColumn("__after", F.lead("__first").over(W.partitionBy(*(keys or [F.lit(1)])).orderBy("__rs")))
    same = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__rs"]))
    joined = sliced.alias("a").join(after.alias("b"), same, "left").select("a.*", "b.__after")
    inside = F.lead("__from").over(W.partitionBy(*keys, "__rs").orderBy("__from"))
    return joined.withColumn("__to", F.coalesce(inside, F.col("__after"))).drop("__rs", "__after")

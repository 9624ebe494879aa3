"""Pairing each left row with the right row nearest in time for the same entity, within a tolerance.

Time is cut into slices; rows meet by (entity, slice, salt).  A right row is copied into every slice from
which it can be reached, so that slices are independent and a hot entity is spread over as many tasks as
its slices and salts need.

Inside a partition both sides are sorted, right rows ahead of their time by the tolerance, and one pass merges
them: the right pointer runs ahead until no later right row can be near enough, the left pointer follows.  All
that is held are the right rows around the left pointer: the last one behind it and those within the tolerance
ahead of it.  No left row ever waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import skew


def _merge(tolerance: int):
    """Rows sorted by (group, place) in, as (group, place, t, record): right rows have no record and stand ``tolerance`` before their time. Out (record, right_t) for each left row with a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_group, held = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_numpy(zero_copy_only=False)
            place, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            left = np.asarray(batch.column(3).is_valid())
            group = np.concatenate([[0], np.cumsum(names[1:] != names[:-1])])
            if names[0] != held_group:
                held = held[:0]
            # Right rows, those held and those of the batch, are in order of group and time.
            r_group, r_t = np.concatenate([np.zeros(len(held), np.int64), group[~left]]), np.concatenate([held, t[~left]])
            if left.any() and len(r_t):
                l_group, l_t = group[left], t[left]
                # Times as ranks, so that group and time make one number.
                times, rank = np.unique(np.concatenate([r_t, l_t]), return_inverse=True)
                both = rank + np.concatenate([r_group, l_group]) * (len(times) + 1)
                after = np.searchsorted(both[: len(r_t)], both[len(r_t) :], side="right")
                behind = after - 1
                ok_behind = (behind >= 0) & (r_group[behind] == l_group)
                ahead = np.minimum(after, len(r_t) - 1)
                ok_ahead = (after < len(r_t)) & (r_group[ahead] == l_group)
                far = np.iinfo(np.int64).max
                back, forth = np.where(ok_behind, l_t - r_t[behind], far), np.where(ok_ahead, r_t[ahead] - l_t, far)
                take = np.minimum(back, forth) <= tolerance
                if take.any():
                    chosen = np.where(back <= forth, r_t[behind], r_t[ahead])[take]
                    yield pa.RecordBatch.from_arrays([batch.column(3).filter(pa.array(left)).filter(pa.array(take)), pa.array(chosen, pa.int64())], names=["record", "right_t"])
            mine = r_t[r_group == group[-1]]
            held_group, held = names[-1], mine[max(0, int(np.searchsorted(mine, place[-1], side="right")) - 1) :]

    return run


def nearest(left: DataFrame, entity: Column, t: Column, record: Column, right: DataFrame, right_entity: Column, right_t: Column, tolerance: int, slice_width: int | None = None) -> DataFrame:
    """(record, right_t): for each left row the nearest right time at most ``tolerance`` away; of two equally near the earlier.

    Times are whole numbers (days, microseconds).  Null entities or times match nothing, repeated right rows
    count once, and a left row without a neighbour gives no row.  ``record`` must not be null.  Other columns
    play no part, and an empty side gives no rows.
    """
    width = slice_width or max(16 * tolerance, 16)
    lefts = left.select(entity.cast("string").alias("e"), t.cast("long").alias("t"), record.cast("string").alias("record")).where("e is not null and t is not null and record is not null")
    lefts = lefts.withColumn("s", F.floor(F.col("t") / width).cast("long"))
    parts = skew.partitions(left)
    slots = skew.slots(lefts, [F.col("e"), F.col("s")], parts)
    marked = lambda df: slots.marked(df.withColumn("slot", slots.of(F.col("e"), F.col("s"))), "slot", "salts")
    lefts = marked(lefts).withColumn("salt", skew.salt(F.col("salts"), F.col("record")))

    rights = right.select(right_entity.cast("string").alias("e"), right_t.cast("long").alias("t")).where("e is not null and t is not null").distinct()
    reach = F.sequence(F.floor((F.col("t") - tolerance) / width).cast("long"), F.floor((F.col("t") + tolerance) / width).cast("long"))
    rights = marked(rights.withColumn("s", F.explode(reach))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    columns = lambda place, record: ["e", "s", "salt", place.alias("place"), "t", record.alias("record")]
    both = lefts.select(*columns(F.col("t"), F.col("record"))).unionByName(rights.select(*columns(F.col("t") - tolerance, F.lit(None).cast("string"))))
    merged = both.repartition(parts, "e", "s", "salt").select(F.concat_ws("\u0001", "e", "s", "salt").alias("g"), "place", "t", "record")
    # At one place right rows come first, so that the pointer has passed all that a left row can reach.
    return merged.sortWithinPartitions("g", "place", F.asc_nulls_first("record")).mapInArrow(_merge(tolerance), "record string, right_t long")

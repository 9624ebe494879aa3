"""Messages delivered at least once: keep one copy of each identifier.

Identifiers are read as a producer and a number of its sequence.  Numbers are cut into blocks of 4,096;
a block's rows meet in one partition in order of delivery, where a set of disjoint seen ranges per
producer accepts each uncovered number once and merges the ranges around it.  Identifiers without a
sequence are malformed and resolved by exact lookup of the whole text.

A hot block (a message delivered so often that it holds a large share of all rows) is never brought
into one task: its rows go through seen ranges salt by salt, and the deliveries that the salts accept go
through the block's own ranges once more.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import skew, storage

BLOCK_BITS = 12
#: Blanks at either end, whatever the script they come from, and zero-width marks.
_ENDS = r"^[\s\p{Z}\x{200b}\x{feff}]+|[\s\p{Z}\x{200b}\x{feff}]+$"
#: The sequence at an identifier's end: decimal after something that isn't a hex digit, else hexadecimal of at most 60 bits.
DECIMAL, HEX = r"(?<=[^0-9a-f])[0-9]{1,18}$", r"[0-9a-f]{1,15}$"


def normal_id(c: Column) -> Column:
    """Identifiers are equal apart from letter case and blanks at either end."""
    return F.lower(F.regexp_replace(c, _ENDS, ""))


def sequence_parts(normal: Column) -> Column:
    """(id, producer, number) of an identifier; producer and number null where it has no sequence. The producer holds the number's width, so that no two identifiers share a pair.

    Each step is bound by a lambda, so that the patterns run once however often the parts are used.
    """

    def parts(x: Column) -> Column:
        dec, hexa = x["dec"], x["hexa"]
        is_dec = F.length(dec) > 0
        digits = F.when(is_dec, dec).otherwise(hexa)
        has = F.length(digits) > 0
        producer = F.concat_ws("#", F.substr(x["id"], F.lit(1), F.length(x["id"]) - F.length(digits)), F.when(is_dec, "d").otherwise("x"), F.length(digits))
        number = F.when(is_dec, dec.cast("long")).otherwise(F.conv(hexa, 16, 10).cast("long"))
        return F.struct(x["id"].alias("id"), F.when(has, producer).alias("producer"), F.when(has, number).alias("number"))

    found = F.transform(F.array(normal), lambda i: F.struct(i.alias("id"), F.regexp_extract(i, DECIMAL, 0).alias("dec"), F.regexp_extract(i, HEX, 0).alias("hexa")))
    return F.transform(found, parts)[0]


class SeenRanges:
    """Disjoint ranges of seen numbers; ``accept`` is True once for each number."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def accept(self, n: int) -> bool:
        at = bisect_right(self.starts, n)
        if at and self.ends[at - 1] >= n:
            return False
        left, right = at > 0 and self.ends[at - 1] == n - 1, at < len(self.starts) and self.starts[at] == n + 1
        if left and right:
            self.ends[at - 1] = self.ends[at]
            del self.starts[at], self.ends[at]
        elif left:
            self.ends[at - 1] = n
        elif right:
            self.starts[at] = n
        else:
            self.starts.insert(at, n)
            self.ends.insert(at, n)
        return True


def _judge(firsts: list[str] | None):
    """The task over rows in order of slot and delivery (slot, producer, number, id, record_key, then ``firsts``).

    Out come the records whose identifier was seen before; with ``firsts`` also the rows that were accepted, with those
    columns, and ``copy`` tells which is which.  State is dropped with each slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ranges, texts = None, {}, set()
        for batch in batches:
            slots, producers, numbers, ids, records = (batch.column(i).to_pylist() for i in range(5))
            copies = []
            for slot, producer, number, normal in zip(slots, producers, numbers, ids, strict=True):
                if slot != now:
                    now, ranges, texts = slot, {}, set()
                if producer is None:
                    copies.append(normal in texts)
                    texts.add(normal)
                else:
                    copies.append(not ranges.setdefault(producer, SeenRanges()).accept(number))
            if firsts is not None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies, pa.bool_())], names=[*batch.schema.names, "copy"])
            elif any(copies):
                yield pa.RecordBatch.from_arrays([pa.array([r for r, c in zip(records, copies, strict=True) if c], pa.string())], names=["record_key"])

    return run


def later_copies(deliveries: DataFrame, message_id: Column, record: Column, order: list[Column]) -> DataFrame:
    """``record_key`` of every delivery but the first of its identifier, by ``order`` (ascending, nulls first).

    Null identifiers are nobody's copy; a blank one is an identifier like others.  Ties in ``order`` keep any
    one row.  Other columns play no part.  An empty table gives no rows.
    """
    names = [f"o{i}" for i in range(len(order))]
    rows = deliveries.where(message_id.isNotNull()).select(sequence_parts(normal_id(message_id)).alias("__p"), record.cast("string").alias("record_key"), *[c.alias(n) for c, n in zip(order, names, strict=True)])
    rows = rows.select("__p.id", "__p.producer", "__p.number", "record_key", *names)
    block = [F.coalesce("producer", "id"), F.coalesce(F.shiftright("number", BLOCK_BITS), F.lit(-1))]
    parts = skew.partitions(deliveries)
    slots = skew.slots(rows, block, parts)
    core = ["slot", "producer", "number", "id", "record_key"]
    rows = rows.withColumn("slot", slots.of(*block)).withColumn("id", F.when(F.col("producer").isNull(), F.col("id")))
    in_order = lambda df, *by: df.repartition(parts, *by).sortWithinPartitions(*by, *[F.asc_nulls_first(n) for n in names])
    if not slots:
        return in_order(rows, "slot").select(*core).mapInArrow(_judge(None), "record_key string")
    marked = slots.marked(rows, "slot", "salts")
    found = in_order(marked.where("salts = 1"), "slot").select(*core).mapInArrow(_judge(None), "record_key string")
    # A hot slot's rows go through seen ranges salt by salt; what each salt accepts, at most one delivery of an
    # identifier, goes through the slot's own ranges once more.
    salted = marked.where("salts > 1").withColumn("salt", skew.salt(F.col("salts"), F.col("record_key")))
    salted = salted.withColumn("at", F.concat_ws("/", "slot", "salt"))
    schema = T.StructType([*salted.select(F.col("at").alias("slot"), *core[1:], *names, F.col("slot").alias("home")).schema.fields, T.StructField("copy", T.BooleanType())])
    once = in_order(salted, "at").select(F.col("at").alias("slot"), *core[1:], *names, F.col("slot").alias("home"))
    once = storage.staged(once.mapInArrow(_judge(names), schema), "once")
    twice = in_order(once.where(~F.col("copy")).drop("slot").withColumnRenamed("home", "slot"), "slot").select(*core).mapInArrow(_judge(None), "record_key string")
    return found.unionByName(once.where("copy").select("record_key")).unionByName(twice)


def first_deliveries(deliveries: DataFrame, message_id: Column, record: str, order: list[Column]) -> DataFrame:
    """One copy of each identifier, with all its columns; null identifiers all stay. ``record`` must be unique."""
    return deliveries.join(later_copies(deliveries, message_id, F.col(record), order).withColumnRenamed("record_key", record), record, "left_anti")

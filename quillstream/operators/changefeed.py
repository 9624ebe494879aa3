"""Applying inserts, updates and deletes to a stored table, whatever their order of arrival.

Changes are shuffled into buckets by key.  In each bucket an embedded DuckDB holds the table state with
the key as primary key; every Arrow batch is folded into it by a conditional upsert that compares the
stored sequence with the incoming one.  Deletes stay as tombstones, so that a late older write can't
bring a row back.  The bucket's state is exported to a new version of the table, and the version becomes
current for all buckets at once by one rename.

A hot key is split by salt first: each part is folded on its own and the winners are folded again, which
gives the same row because taking the highest sequence is associative.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import skew, storage

WRITES, DELETES = ("c", "u", "r"), ("d",)


def changes(feed: DataFrame, key: str, seq: str, op: str, payload: list[str], usable: Column | None = None, tie: str | None = None) -> DataFrame:
    """A feed as (cdc_key, cdc_seq, cdc_deleted, cdc_tie, payload...).

    Rows that aren't usable, have a null key or sequence, or an operation outside c, u, r and d count for
    nothing.  Other columns of the feed are ignored, whatever their names.
    """
    rows = feed if usable is None else feed.where(usable)
    rows = rows.where(F.col(key).isNotNull() & F.col(seq).isNotNull() & F.col(op).isin(*WRITES, *DELETES))
    return rows.select(F.col(key).cast("string").alias("cdc_key"), F.col(seq).cast("long").alias("cdc_seq"), F.col(op).isin(*DELETES).alias("cdc_deleted"), (F.col(tie).cast("string") if tie else F.lit("~")).alias("cdc_tie"), *[F.col(c) for c in payload])


def stored(table: DataFrame, key: str, seq: str, deleted: str, payload: list[str]) -> DataFrame:
    """A stored state as changes; its rows win over equal sequences of the feed."""
    rows = table.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    return rows.select(F.col(key).cast("string").alias("cdc_key"), F.col(seq).cast("long").alias("cdc_seq"), F.coalesce(F.col(deleted), F.lit(False)).alias("cdc_deleted"), F.lit("").alias("cdc_tie"), *[F.col(c) for c in payload])


def _spill_folder(spark: SparkSession) -> str:
    """Where a bucket that outgrows its memory spills: in the shared folder where that is mounted, else nowhere."""
    root = storage.run_dir(spark)
    return f"{root.removeprefix('file://')}/spill" if root.startswith(("file://", "/")) else ""


def _folder(columns: list[str], memory_mb: int, spill: str):
    """The task of one bucket: Arrow batches of changes in, the bucket's state out."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import shutil

        import duckdb

        own = spill and f"{spill}/{uuid.uuid4().hex}"
        names = ", ".join(f'"{c}"' for c in columns)
        con, schema = None, None
        order = "cdc_seq desc, cdc_tie, cdc_deleted desc"
        for batch in batches:
            if not batch.num_rows:
                continue
            incoming = pa.Table.from_batches([batch])
            if con is None:
                if own:
                    os.makedirs(own)
                con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": own, "preserve_insertion_order": False})
                con.execute("set timezone = 'UTC'")
                con.register("incoming", incoming)
                schema = batch.schema
                con.execute(f"create table state as select {names} from incoming limit 0")
                con.execute('alter table state add primary key ("cdc_key")')
            else:
                con.register("incoming", incoming)
            sets = ", ".join(f'"{c}" = excluded."{c}"' for c in columns if c != "cdc_key")
            # One command may touch a key once: the batch is reduced to its winners before it meets the state.
            con.execute(
                f'insert into state select {names} from incoming qualify row_number() over (partition by "cdc_key" order by {order}) = 1 '
                f'on conflict ("cdc_key") do update set {sets} where excluded.cdc_seq > state.cdc_seq or '
                f"(excluded.cdc_seq = state.cdc_seq and (excluded.cdc_tie < state.cdc_tie or (excluded.cdc_tie = state.cdc_tie and excluded.cdc_deleted and not state.cdc_deleted)))"
            )
            con.unregister("incoming")
        if con is not None:
            for part in con.sql(f"select {names} from state").to_arrow_reader(10_000):
                yield from pa.Table.from_batches([part]).cast(schema).to_batches()
            con.close()
            if own:
                shutil.rmtree(own, ignore_errors=True)

    return fold


def fold(all_changes: DataFrame, memory_mb: int = 512) -> DataFrame:
    """The highest change of each key, tombstones included, by the buckets' embedded upserts.

    Equal sequences: the stored row wins, then the smaller ``tie`` as text, then the delete.
    An empty feed gives an empty state.
    """
    columns = all_changes.columns
    parts = skew.partitions(all_changes, target_mb=16)  # compressed; a bucket's state is held in memory
    slots = skew.slots(all_changes, [F.col("cdc_key")], parts)
    task = _folder(columns, memory_mb, _spill_folder(all_changes.sparkSession))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in all_changes.schema.fields])
    if not slots:
        return all_changes.repartition(parts, "cdc_key").mapInArrow(task, schema)
    marked = lambda df: slots.marked(df.withColumn("__slot", slots.of(F.col("cdc_key"))), "__slot", "__salts").drop("__slot")
    salted = marked(all_changes).withColumn("__salt", skew.salt(F.col("__salts"), F.col("cdc_seq"), F.col("cdc_tie")))
    first = salted.repartition(parts, "cdc_key", "__salt").select(*columns).mapInArrow(task, schema)
    winners = storage.staged(marked(first), "fold")
    again = winners.where("__salts > 1").select(*columns).repartition(parts, "cdc_key").mapInArrow(task, schema)
    return winners.where("__salts = 1").select(*columns).unionByName(again)


def apply_changes(state: DataFrame, feed: DataFrame, table: str | None = None) -> DataFrame:
    """Fold ``stored`` and ``changes`` rows together and publish the new state as the current version of ``table``."""
    folded = fold(state.unionByName(feed))
    return storage.publish(folded, table or f"{storage.run_dir(folded.sparkSession)}/state")


def alive(folded: DataFrame) -> DataFrame:
    """The rows that exist: everything but tombstones."""
    return folded.where(~F.col("cdc_deleted"))


class Buckets:
    """A state kept in buckets of keys, of which a small feed reads and writes only those that it touches.

    A version holds the buckets that were written with it and a map of all buckets to the versions that hold them; the
    pointer moves to the new map at the end, for all buckets at once.  Versions that no map needs are removed but for
    the last few.  The number of buckets is decided when the first feed is applied.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 256, keep: int = storage.KEEP) -> None:
        self.spark, self.table, self.keep = spark, table, keep
        stored = self._stored()
        self.buckets = stored["buckets"] if stored else buckets

    def _stored(self) -> dict | None:
        try:
            return json.loads(storage.read_text(self.spark, f"{storage.current_folder(self.spark, self.table)}/map.json"))
        except FileNotFoundError:
            return None

    def _of(self) -> Column:
        return F.pmod(F.xxhash64("cdc_key"), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The state, or some of its buckets; None where they hold nothing."""
        stored = self._stored() or {"where": {}, "schema": None}
        paths = [f"{self.table}/{version}/bucket={b}" for b, version in stored["where"].items() if only is None or int(b) in only]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(stored["schema"]))).parquet(*paths) if paths else None

    def apply(self, feed: DataFrame) -> "Buckets":
        """Fold changes into the buckets that they touch; what is stored wins ties, so that a feed applied again changes nothing."""
        feed = storage.staged(feed, "feed")
        touched = [r[0] for r in feed.select(self._of().alias("bucket")).distinct().collect()]  # at most all buckets
        if not touched:
            return self
        old = self.read(touched)
        folded = fold(feed if old is None else old.withColumn("cdc_tie", F.lit("")).select(*feed.columns).unionByName(feed))
        stored = self._stored() or {"where": {}}
        version = f"v-{uuid.uuid4().hex[:12]}"
        folded.withColumn("bucket", self._of()).repartition(min(len(touched), 10_000), "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.table}/{version}")
        where = stored["where"] | {str(b): version for b in touched}
        schema = json.dumps(feed.schema.jsonValue())
        storage.write_text_atomically(self.spark, f"{self.table}/{version}/map.json", json.dumps({"buckets": self.buckets, "where": where, "schema": schema}))
        storage.point(self.spark, self.table, version, needed=set(where.values()), keep=self.keep)
        return self

"""Landing files to an append-only bronze layer with a commit log.

A file's name says when it arrived.  A batch holds the new files of one source; its Parquet is put in place first and
the log entry, one small file per batch, last: what the log doesn't list doesn't exist.  Files that were taken in before,
by name or by content, are recorded without a batch and never read again.
"""

from __future__ import annotations

import csv
import io
import json
import urllib.parse
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

SOURCES = ("orders", "payments", "fx_rates", "settlements")
BRONZE = "_raw string, _landing_file string, _line int, _file_sha256 string, _arrived_at timestamp, _batch_id string, _batch_seq long, _ingested_at timestamp"
MANIFEST = "source string, batch_id string, batch_seq long, parquet string, ingested_at timestamp, file string, sha256 string"


def arrived_at(path: Column) -> Column:
    """The hour in a landing file's name, in UTC; null where the name has none."""
    return F.try_to_timestamp(F.regexp_extract(path, r"-(\d{8}T\d{2}00)(?:-resend)?\.\w+$", 1), F.lit("yyyyMMdd'T'HHmm"))


def _lines_of_csv(frames):
    for pdf in frames:
        rows = []
        for name, text in zip(pdf["file"], pdf["text"], strict=True):
            for n, row in enumerate(csv.DictReader(io.StringIO(text)), 1):
                rows.append((name, n, json.dumps(row, separators=(",", ":"), ensure_ascii=False)))
        yield pd.DataFrame(rows, columns=["file", "line", "raw"]).astype({"line": "int32"})


def lines(files: DataFrame) -> DataFrame:
    """(file, line, raw): non-blank lines of JSON as they are, rows of CSV as JSON objects of strings. ``files`` has (file, content)."""
    text = files.withColumn("text", F.decode("content", "UTF-8"))
    jsonl = text.where(~F.col("file").endswith(".csv")).select("file", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    jsonl = jsonl.select("file", (F.col("n") + 1).alias("line"), F.rtrim(F.regexp_replace("raw", "\r$", "")).alias("raw")).where("trim(raw) <> ''")
    table = text.where(F.col("file").endswith(".csv")).select("file", "text").mapInPandas(_lines_of_csv, "file string, line int, raw string")
    return jsonl.unionByName(table)


@dataclass
class Batch:
    source: str
    batch_id: str
    batch_seq: int
    files: int
    rows: int
    duplicates: int


class Lake:
    """A lake in one folder: ``landing`` as it comes, ``bronze``, ``log``, and what is built from them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # The commit log -----------------------------------------------------------------------------
    def manifest(self) -> DataFrame:
        if not self._exists(f"{self.path}/log"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/log")

    def _exists(self, path: str) -> bool:
        fs, target = storage.filesystem(self.spark, path)
        return fs.exists(target)

    def _commit(self, name: str, rows: list[dict]) -> None:
        storage.filesystem(self.spark, f"{self.path}/log")[0].mkdirs(storage.filesystem(self.spark, f"{self.path}/log")[1])
        storage.write_text_atomically(self.spark, f"{self.path}/log/{name}.json", "".join(json.dumps(r) + "\n" for r in rows))

    # Taking in ----------------------------------------------------------------------------------
    def names(self, source: str, through: datetime) -> DataFrame:
        """(file, path, arrived): landing files of a source up to a time, from the listing alone; no file is opened."""
        if not self._exists(f"{self.path}/landing/{source}"):
            return self.spark.createDataFrame([], "file string, path string, arrived timestamp")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/landing/{source}").select("path")
        name = F.concat(F.lit(f"{source}/"), F.regexp_extract("path", rf"/landing/{source}/(.*)$", 1))
        return files.select(name.alias("file"), "path", arrived_at(F.col("path")).alias("arrived")).where(F.col("arrived") <= F.lit(through))

    def contents(self, names: DataFrame) -> DataFrame:
        """(file, content, sha256, arrived) of the given files alone, hashed by the tasks that read them."""
        paths = [r["path"] for r in names.select("path").collect()]  # Spark's own listing of them holds no less
        if not paths:
            return self.spark.createDataFrame([], "file string, content binary, sha256 string, arrived timestamp")
        files = self.spark.read.format("binaryFile").load([urllib.parse.unquote(p) if "%" in p else p for p in paths])
        name = F.regexp_extract("path", r"/landing/(.*)$", 1)
        return files.select(name.alias("file"), "content", F.sha2("content", 256).alias("sha256"), arrived_at(F.col("path")).alias("arrived"))

    def sweep_orphans(self) -> int:
        """Delete batch folders that the log doesn't list; how many there were."""
        listed = {r["parquet"] for r in self.manifest().where("parquet is not null").select("parquet").distinct().collect()}  # one per batch
        fs, base = storage.filesystem(self.spark, f"{self.path}/bronze")
        gone = 0
        if fs.exists(base):
            for status in fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bronze/*/ingest_date=*/*")):
                relative = status.getPath().toString().split("/bronze/", 1)[1]
                if f"bronze/{relative}" not in listed:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone

    def ingest(self, through: datetime, now: datetime | None = None) -> list[Batch]:
        """Take in every source's new files; a second call with the same time takes in nothing."""
        self.sweep_orphans()
        now = now or datetime.now(timezone.utc)
        done = []
        for source in SOURCES:
            log = self.manifest()
            new = self.names(source, through).join(log.select("file"), "file", "left_anti")
            new = storage.staged(self.contents(new), "landed")  # read from the landing folder once
            hashes = new.select("file", "sha256", "arrived").join(log.where("batch_id is not null").select("sha256", F.lit(True).alias("__old")).distinct(), "sha256", "left")
            from ..operators.merge import flag_first

            flags = flag_first(hashes, ["sha256"], [F.asc("file")], "first").withColumn("fresh", F.col("first") & F.col("__old").isNull())
            listing = sorted(flags.select("file", "sha256", "fresh").collect())  # the batch's file names: one log line each
            seq = (log.agg(F.max("batch_seq")).first()[0] or 0) + 1
            fresh = [(f, h) for f, h, ok in listing if ok]
            stamp = now.isoformat()
            rows = [{"source": source, "batch_id": None, "batch_seq": None, "parquet": None, "ingested_at": stamp, "file": f, "sha256": h} for f, h, ok in listing if not ok]
            if fresh:
                batch_id = self._batch_id([h for _, h in fresh])
                place = f"bronze/{source}/ingest_date={now:%Y-%m-%d}/{batch_id}"
                n = self._write(new, fresh, place, batch_id, seq, now)
                rows += [{"source": source, "batch_id": batch_id, "batch_seq": seq, "parquet": place, "ingested_at": stamp, "file": f, "sha256": h} for f, h in fresh]
                done.append(Batch(source, batch_id, seq, len(fresh), n, len(listing) - len(fresh)))
            if rows:
                self._commit(f"{seq:012d}-{source}-{uuid.uuid4().hex[:8]}", rows)
        return done

    def _batch_id(self, hashes: list[str]) -> str:
        """An id that only the files' contents decide."""
        df = self.spark.createDataFrame([(h,) for h in hashes], "h string")
        return df.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256), 1, 16)).first()[0]

    def _write(self, new: DataFrame, fresh: list[tuple[str, str]], place: str, batch_id: str, seq: int, now: datetime) -> int:
        names = self.spark.createDataFrame(fresh, "file string, sha256 string").select("file")
        files = new.join(names, "file", "left_semi")
        rows = lines(files).join(files.select("file", "sha256", "arrived"), "file")
        rows = rows.select(F.col("raw").alias("_raw"), F.col("file").alias("_landing_file"), F.col("line").cast("int").alias("_line"), F.col("sha256").alias("_file_sha256"), F.col("arrived").alias("_arrived_at"), F.lit(batch_id).alias("_batch_id"), F.lit(seq).cast("long").alias("_batch_seq"), F.lit(now).cast("timestamp").alias("_ingested_at"))
        rows.repartitionByRange("_arrived_at", "_landing_file", "_line").sortWithinPartitions("_arrived_at", "_landing_file", "_line").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{place}")
        return self.spark.read.parquet(f"{self.path}/{place}").count()

    # Reading ------------------------------------------------------------------------------------
    def bronze(self, source: str) -> DataFrame:
        """All committed rows of a source with their key; typed and empty where there are none."""
        places = sorted(r["parquet"] for r in self.manifest().where(F.col("source") == source).where("parquet is not null").select("parquet").distinct().collect())  # one per batch
        rows = self.spark.read.schema(BRONZE).parquet(*[f"{self.path}/{p}" for p in places]) if places else self.spark.createDataFrame([], BRONZE)
        return rows.withColumn("_bronze_row", F.concat_ws(":", "_landing_file", "_line"))

    def naive_lines(self, source: str, through: datetime) -> DataFrame:
        """Landing lines as somebody in a hurry reads them: every file, malformed lines null."""
        return lines(self.contents(self.names(source, through)).select("file", "content")).withColumn("json", F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")))

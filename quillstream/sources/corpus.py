"""Sources of texts: books as bytes, archive records, canaries, diffs and lines of a repository."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text

READING_FILES = 7


def books(spark: SparkSession, folder: str, assume_utf8: bool = False) -> DataFrame:
    """(book, title, encoding, text): every .txt, decoded strictly, or taken as UTF-8 with replacement characters for what isn't."""
    if assume_utf8:
        raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.lit("assumed utf-8").alias("encoding"))
    else:
        got, encoding = text.decoded(F.col("content"))
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", got.alias("text"), encoding.alias("encoding"))
    book = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return raw.select(book.alias("book"), text.title(F.col("text"), book).alias("title"), "encoding", "text")


def reading_list(spark: SparkSession, folder: str, lake: str, assume_utf8: bool = False) -> int:
    """Write books and passages, then the manifest with the number of passages that were written."""
    all_books = books(spark, folder, assume_utf8)
    passages = all_books.select("book", F.posexplode(text.passages(F.col("text"))).alias("p", "text")).select(F.concat_ws(":", "book", F.col("p") + 1).alias("passage_id"), "book", (F.col("p") + 1).alias("n"), "text")
    passages.repartitionByRange(READING_FILES, "book", "n").write.mode("overwrite").parquet(f"{lake}/reading-list/passages")
    all_books.drop("text").write.mode("overwrite").parquet(f"{lake}/reading-list/books")
    n = spark.read.parquet(f"{lake}/reading-list/passages").count()
    storage.write_text_atomically(spark, f"{lake}/reading-list/_manifest.json", json.dumps({"passages": n}))
    return n


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """(id, title, chapel, kind, dated, superseded_by, current, body, meta) of Markdown records with front matter."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).withColumn("value", F.regexp_replace("value", "\r\n?", "\n"))
    parts = F.split("value", "---", 3)
    pairs = F.filter(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: F.contains(x, F.lit(":")))
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.substr(x, F.instr(x, ":") + 1)))))
    rows = raw.select(meta.alias("meta"), F.trim(F.get(parts, F.lit(2))).alias("body"))
    superseded = F.nullif(F.col("meta")["superseded_by"], F.lit(""))
    return rows.select(*[F.col("meta")[c].alias(c) for c in ("id", "title", "chapel", "kind")], F.col("meta")["dated"].try_cast("int").alias("dated"), superseded.alias("superseded_by"), superseded.isNull().alias("current"), "body", "meta")


def canaries(spark: SparkSession, path: str) -> DataFrame:
    """(word, passage_id): a word that must be found in a passage, by its first token; a word without one is refused."""
    rows = spark.read.schema("given string, passage_id string").option("sep", "\t").csv(path).where("given is not null")
    tokens = text.with_tokens(rows, "given")
    if tokens.where(F.size("tokens") == 0).limit(1).count():
        raise ValueError("a canary has no word")
    return tokens.select(F.element_at("tokens", 1).alias("word"), "passage_id")


def read_lines(repo: DataFrame, path: str, first: int = 1, last: int | None = None, most: int = 200) -> DataFrame:
    """Lines of one file of a table (path, line_no, line), at most ``most`` of them."""
    end = min(last or first + most - 1, first + most - 1)
    return repo.where((F.col("path") == path) & F.col("line_no").between(first, end)).orderBy("line_no")


def find_text(repo: DataFrame, wanted: str, most: int = 40) -> DataFrame:
    """The first ``most`` lines that contain a text as it is."""
    return repo.where(F.contains("line", F.lit(wanted))).orderBy("path", "line_no").limit(most)


def without_file_of(spark: SparkSession, lake: str, new_lake: str, passage_id: str) -> int:
    """For drills: a copy of a reading list that lacks the file of one passage, its manifest unchanged; how many passages are left."""
    rows = spark.read.parquet(f"{lake}/reading-list/passages").withColumn("__file", F.col("_metadata.file_path"))
    lost = [r[0] for r in rows.where(F.col("passage_id") == passage_id).select("__file").distinct().collect()]
    rows.where(~F.col("__file").isin(lost)).drop("__file").write.mode("overwrite").parquet(f"{new_lake}/reading-list/passages")
    spark.read.parquet(f"{lake}/reading-list/books").write.mode("overwrite").parquet(f"{new_lake}/reading-list/books")
    storage.write_text_atomically(spark, f"{new_lake}/reading-list/_manifest.json", storage.read_text(spark, f"{lake}/reading-list/_manifest.json"))
    return spark.read.parquet(f"{new_lake}/reading-list/passages").count()

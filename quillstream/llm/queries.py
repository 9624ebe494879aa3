"""Queries of problems 1, 2, 8, 9 and 10, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import encoding, leakage, nearest, pii, tokenizer


def _restored(spark: SparkSession, sf: str) -> DataFrame:
    passages = table(spark, sf, "passages").select("passage_id", "text", "book")
    return encoding.restored(passages, F.col("passage_id"), F.col("text"), encoding.trained(passages, "passage_id", "text", "book"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _restored(spark, sf).where(F.size("chains") > 0).select(F.col("key").alias("passage_id")).distinct()


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage with its text put back, and the chains of wrong decodings that were undone."""
    return _restored(spark, sf).select(F.col("key").alias("passage_id"), "text", F.array_join("chains", ",").alias("chains"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    payments = table(spark, sf, "fct_payments").where(F.lower("currency") != "cad")
    rates = table(spark, sf, "silver_fx_rates").where((F.upper(F.trim("quote")) == "CAD") & (F.col("rate") > 0))
    day = lambda c: F.unix_date(c).cast("long")
    pairs = nearest.nearest(payments, F.lower("currency"), day("processor_date"), F.col("event_id"), rates, F.lower(F.trim("base")), day("rate_date"), tolerance=2)
    return pairs.select(F.col("record").alias("event_id"), F.date_from_unix_date(F.col("right_t").cast("int")).cast("string").alias("rate_date"))


P2_SQL = """
with r as (select distinct lower(trim(base)) as cur, rate_date from silver_fx_rates where upper(trim(quote)) = 'CAD' and rate > 0),
c as (select p.event_id, r.rate_date, row_number() over (partition by p.event_id order by abs(r.rate_date - p.processor_date), r.rate_date) as k
      from fct_payments p join r on r.cur = lower(p.currency) and r.rate_date between p.processor_date - 2 and p.processor_date + 2 where lower(p.currency) <> 'cad')
select event_id, cast(rate_date as varchar) as rate_date from c where k = 1"""


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return tokenizer.encoded(docs, F.col("doc_id"), F.col("text")).select(F.col("key").alias("doc_id"), "ids")


def p8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens and characters by language label: what the corpus costs a model."""
    docs = table(spark, sf, "documents")
    ids = tokenizer.encoded(docs, F.col("doc_id"), F.col("text")).select(F.col("key").alias("doc_id"), F.size("ids").alias("n"))
    return docs.select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("none")).alias("lang"), F.coalesce("n_chars", F.lit(0)).alias("n_chars")).join(ids, "doc_id").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("tokens"), F.sum("n_chars").cast("long").alias("chars"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    found = leakage.leaks(docs, F.col("doc_id"), F.col("text"), items, "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    names = pii.learn_names(docs, F.col("text"))
    return pii.found_places(docs, F.col("doc_id"), F.col("text"), names).select(F.col("key").alias("doc_id"), "kind", "char_start").distinct()


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with placeholders for the persons in it."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.redacted(docs, F.col("doc_id"), F.col("text"), pii.learn_names(docs, F.col("text"))).select(F.col("key").alias("doc_id"), "text", "places")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p8_ids": p8_ids, "p8_token_counts": p8_token_counts, "p9_found": p9_found, "p10_found": p10_found, "p10_redacted": p10_redacted}
SQL = {"p2_found": P2_SQL}

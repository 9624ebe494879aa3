"""From landing files to published marts, and from books to a published index: build, audit, publish or refuse.

Each model is a function of the tables before it; a small runner materialises them in order.  Gold is built beside
what is published; only if no audit blocks does one pointer move, for all tables at once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, time, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions import search, text
from .operators import asof, checks, merge, parsing, waterfall
from .sources import corpus
from .sources.landing import Lake

BUSINESS_ZONE = "America/Halifax"
GOLD = ("fct_payments", "mart_daily_cash", "mart_order_revenue", "mart_waiting")


@dataclass
class Config:
    """Where the lake is and which payment versions are understood; the environment may say otherwise."""

    lake: str = field(default_factory=lambda: os.environ.get("QUILLSTREAM_LAKE", ""))
    parsers: tuple[str, ...] = field(default_factory=lambda: tuple(x.strip() for x in os.environ.get("QUILLSTREAM_PARSERS", ",".join(parsing.PAYMENT_PARSERS)).split(",")))


def when(moment: str) -> datetime:
    """A day means its end; a moment without a zone is UTC."""
    if "T" in moment:
        t = datetime.fromisoformat(moment)
        return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return datetime.combine(datetime.fromisoformat(moment).date(), time(23, 59, 59), timezone.utc)


def _shown(*figures: dict) -> str:
    """Figures on one line, each by its name; what is null or nought is left out."""
    return "; ".join(", ".join(f"{k} {v}" for k, v in f.items() if v not in (None, 0)) or "nothing" for f in figures) or "nothing"


class Pipeline:
    """ingest, build, grade and publish over one lake."""

    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark, self.config, self.lake = spark, config, Lake(spark, config.lake)
        self.tables: dict[str, DataFrame] = {}

    def _table(self, name: str) -> str:
        return f"{self.config.lake}/tables/{name}"

    def stored(self, name: str) -> DataFrame | None:
        try:
            return storage.current(self.spark, self._table(name))
        except FileNotFoundError:
            return None

    # Silver -------------------------------------------------------------------------------------
    def _incremental(self, name: str, rows: DataFrame, fold: Callable[[DataFrame | None, DataFrame], DataFrame], replay: bool) -> DataFrame:
        old = None if replay else self.stored(name)
        new = rows if old is None else merge.newer_than(rows, old, "_batch_seq")
        return storage.publish(fold(old, new), self._table(name))

    def build(self, as_of: datetime, replay: bool = False) -> dict[str, DataFrame]:
        """Build silver and gold; ``replay`` forgets silver and reads all of bronze again, which is how rows that were held come out."""
        staged_pay = parsing.payment_events(self.lake.bronze("payments"), enabled=list(self.config.parsers))
        staged_ord = parsing.order_changes(self.lake.bronze("orders"))
        lineage = ["_bronze_row", "_batch_seq", "_arrived_at", "_ingested_at"]
        pay_cols = ["event_id", "event_type", "api_version", "charge_id", "refund_id", "order_id", "amount_minor", "currency", "created_at", *lineage]
        delivery = [F.asc("_batch_seq"), F.asc("_arrived_at"), F.asc("_bronze_row")]

        def payments(old, new):
            first = merge.keep_first(new.where("quarantine_reason is null").select(*pay_cols), ["event_id"], delivery)
            return first if old is None else merge.insert_only(old, first, ["event_id"])

        def orders(old, new):
            rows = new.where("quarantine_reason is null").select("order_id", "customer_id", "status", "currency", "total_minor", "ship_region", "created_at", "updated_at", (F.col("op") == "d").alias("is_deleted"), F.col("lsn").alias("_lsn"), "_batch_seq", "_arrived_at", "_ingested_at", "_bronze_row")
            top = merge.keep_first(rows, ["order_id"], [F.desc("_lsn"), F.asc("_bronze_row")])
            return top if old is None else merge.conditional(old, top, ["order_id"], "_lsn")

        def quarantine(old, new):
            return new if old is None else old.unionByName(new)

        held = [df.where("quarantine_reason is not null").select(F.lit(s).alias("source"), "quarantine_reason", "_raw", *lineage) for s, df in (("payments", staged_pay), ("orders", staged_ord))]
        old = None if replay else self.stored("quarantine")
        held_rows = held[0].unionByName(held[1])
        t = {
            "silver_payments": self._incremental("silver_payments", staged_pay, payments, replay),
            "silver_orders": self._incremental("silver_orders", staged_ord, orders, replay),
            "silver_fx_rates": storage.publish(parsing.fx_rates(self.lake.bronze("fx_rates")), self._table("silver_fx_rates")),
            "silver_settlements": storage.publish(parsing.settlements(self.lake.bronze("settlements")), self._table("silver_settlements")),
            "quarantine": storage.publish(held_rows if old is None else quarantine(old, merge.newer_than(held_rows, old, "_batch_seq", by="source")), self._table("quarantine")),
        }
        self.tables = t | {"stg_payments": staged_pay, "stg_orders": staged_ord}
        return self._gold(as_of, replay)

    # Gold ---------------------------------------------------------------------------------------
    def _gold(self, as_of: datetime, replay: bool) -> dict[str, DataFrame]:
        t = self.tables
        usd = t["silver_fx_rates"].where("base = 'USD' and quote = 'CAD'").select(F.lower("base").alias("currency"), F.col("rate_date").alias("fx_rate_date"), F.col("rate").alias("fx_rate"))
        orders = t["silver_orders"].where("not is_deleted").select("order_id", "ship_region", F.to_date(F.from_utc_timestamp("created_at", BUSINESS_ZONE)).alias("order_date"))
        cad = F.col("currency") == "cad"
        signed = F.when(F.col("event_type") == "capture", F.col("amount_minor")).otherwise(-F.col("amount_minor"))
        pay = t["silver_payments"].withColumn("processor_date", F.to_date("created_at")).withColumn("amount_minor", signed)
        pay = asof.asof_left(pay, usd, on=("processor_date", "fx_rate_date"), by=["currency"], carry=["fx_rate_date", "fx_rate"])
        pay = pay.withColumn("fx_rate_date", F.when(cad, F.col("processor_date")).otherwise(F.col("fx_rate_date"))).withColumn("fx_rate", F.when(cad, F.lit(1)).otherwise(F.col("fx_rate")).cast("decimal(12,6)"))
        pay = pay.withColumn("amount_cad", parsing.cents_as_decimal(parsing.cad_cents(F.col("amount_minor"), F.col("fx_rate")))).join(orders, "order_id", "left")
        fact = storage.publish(pay.select("event_id", "event_type", "charge_id", "refund_id", "order_id", "currency", "amount_minor", "created_at", "processor_date", "order_date", "ship_region", "fx_rate_date", "fx_rate", "amount_cad", "_batch_seq", "_ingested_at"), self._table("build_fct_payments"))

        capture, refund = F.col("event_type") == "capture", F.col("event_type") == "refund"
        total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
        cash = fact.groupBy("processor_date", "currency").agg(total(capture, "amount_minor").cast("bigint").alias("captured_minor"), (-total(refund, "amount_minor")).cast("bigint").alias("refunded_minor"), F.sum("amount_minor").cast("bigint").alias("net_minor"), F.count(F.when(capture, 1)).alias("captures"), F.count(F.when(refund, 1)).alias("refunds"), F.sum("amount_cad").cast("decimal(18,2)").alias("net_cad"))

        old = None if replay else self.stored("build_mart_order_revenue")
        seen = fact.where("order_date is not null")
        through = max(x for x in (fact.agg(F.max("_batch_seq")).first()[0], t["silver_orders"].agg(F.max("_batch_seq")).first()[0], 0) if x is not None)
        if old is not None:
            mark = old.agg(F.coalesce(F.max("_built_through_seq"), F.lit(0))).scalar()
            moved = t["silver_orders"].where(F.col("_batch_seq") > mark).select(F.to_date(F.from_utc_timestamp("created_at", BUSINESS_ZONE)).alias("order_date"))
            touched = seen.where(F.col("_batch_seq") > mark).select("order_date").union(moved).distinct()
            seen = seen.join(touched, "order_date", "left_semi")
        priced = asof.asof_left(seen.drop("fx_rate_date", "fx_rate"), usd, on=("order_date", "fx_rate_date"), by=["currency"], carry=["fx_rate"])
        value = parsing.cents_as_decimal(parsing.cad_cents(F.col("amount_minor"), F.when(cad, F.lit(1)).otherwise(F.col("fx_rate")).cast("decimal(12,6)")))
        money = lambda c: c.cast("decimal(18,2)")
        priced = priced.withColumn("v", value)
        revenue = priced.groupBy("order_date", "ship_region").agg(F.countDistinct(F.when(capture, F.col("order_id"))).alias("paid_orders"), money(total(capture, "v")).alias("gross_cad"), money(-total(refund, "v")).alias("refunds_cad"), money(F.sum("v")).alias("net_cad")).withColumn("_built_through_seq", F.lit(through).cast("bigint"))
        if old is not None:
            revenue = merge.replace_keys(old, revenue, touched, ["order_date"])

        label = parsing.waiting_bucket(F.col("updated_at"), F.lit(as_of).cast("timestamp"))
        waiting = t["silver_orders"].where("status = 'paid' and not is_deleted").groupBy(label.alias("waiting")).agg(F.count("*").alias("orders"), F.min("updated_at").alias("oldest_change_at"))
        built = {"mart_daily_cash": cash, "mart_order_revenue": revenue, "mart_waiting": waiting}
        self.tables |= {"fct_payments": fact} | {n: storage.publish(df, self._table(f"build_{n}")) for n, df in built.items()}
        return self.tables

    # Audits and publishing ----------------------------------------------------------------------
    def grade(self, as_of: datetime, since_seq: int = 0) -> list[tuple[str, str, str]]:
        """(name, status, detail) of the four audits."""
        t, out = self.tables, []
        rates = sorted(checks.quarantine_rates({"payments": t["stg_payments"], "orders": t["stg_orders"]}, since_seq).collect())
        worst = max((r["status"] for r in rates), key=["PASS", "WARN", "BLOCK"].index, default="PASS")
        out.append(("quarantine rate", worst, _shown(*[{"source": r["source"], "arrived": r["arrived"], "held": r["held"], "share": round(r["held"] / r["arrived"], 4), "first reason": r["top_reason"]} for r in rates])))
        kept = checks.conservation(t["silver_payments"], t["fct_payments"]).first().asDict()
        out.append(("conservation", kept.pop("status"), _shown(kept)))
        rated = checks.rate_coverage(t["fct_payments"]).first().asDict()
        out.append(("fx coverage", rated.pop("status"), _shown(rated)))
        lines = checks.reconciliation(t["silver_settlements"], t["mart_daily_cash"], as_of).where("state <> 'match'")
        apart = {r["state"]: r["n"] for r in lines.groupBy("state").agg(F.count("*").alias("n")).collect()}
        first = [r.asDict() for r in lines.orderBy("state", "settlement_date", "currency").limit(3).collect()]
        out.append(("reconciliation", "BLOCK" if apart.get("broken") else "WARN" if apart else "PASS", _shown(apart, *first)))
        return out

    def checks(self) -> DataFrame:
        """The row checks of silver and gold."""
        t = self.tables
        return checks.outcome([checks.unique("silver_payments", t["silver_payments"], "event_id"), checks.not_null("silver_payments", t["silver_payments"], "event_id"), checks.positive("silver_payments", t["silver_payments"], "amount_minor"), checks.refers("silver_payments", t["silver_payments"], "order_id", t["silver_orders"], "order_id"), checks.unique("silver_orders", t["silver_orders"], "order_id"), checks.unique("fct_payments", t["fct_payments"], "event_id"), checks.not_null("fct_payments", t["fct_payments"], "fx_rate"), checks.unique("mart_daily_cash", t["mart_daily_cash"], "processor_date", "currency"), checks.unique("mart_order_revenue", t["mart_order_revenue"], "order_date", "ship_region")])

    def published(self, name: str) -> DataFrame:
        """A gold table as readers see it."""
        return storage.current(self.spark, self._gold_table(), name)

    def history(self) -> DataFrame:
        """What was published when; part of the published version, so that neither is there without the other."""
        schema = "as_of string, through_seq long, published_at string, audits string"
        try:
            return self.spark.read.schema(schema).json(f"{storage.current_folder(self.spark, self._gold_table())}/history.json")
        except FileNotFoundError:
            return self.spark.createDataFrame([], schema)

    def _gold_table(self) -> str:
        return f"{self.config.lake}/gold"

    def publish(self, as_of: datetime, results: list[tuple[str, str, str]]) -> bool:
        """Copy the build beside what is published, with the history that includes it, and move one pointer, unless an audit blocks."""
        if any(status == "BLOCK" for _, status, _ in results):
            return False
        marks = [self.tables[n].agg(F.max("_batch_seq")).first()[0] or 0 for n in ("stg_payments", "stg_orders")]
        entry = {"as_of": as_of.isoformat(), "through_seq": max(marks), "published_at": datetime.now(timezone.utc).isoformat(), "audits": "; ".join(f"{n}: {s}" for n, s, _ in results)}
        try:
            before = storage.read_text(self.spark, f"{storage.current_folder(self.spark, self._gold_table())}/history.json") or ""
        except FileNotFoundError:
            before = ""
        storage.publish_all(self.spark, {n: self.tables[n] for n in GOLD}, self._gold_table(), {"history.json": before + json.dumps(entry) + "\n"})
        return True

    # What somebody in a hurry would say -----------------------------------------------------------
    def naive_month(self, through: datetime, month: str) -> DataFrame:
        """A month's captures added up straight from the landing files: repeats, re-sent files and foreign amounts included."""
        rows = self.lake.naive_lines("payments", through)
        taken = rows.where((parsing.at("json", "$.type") == "charge.succeeded") & (F.date_format(F.timestamp_seconds(parsing.whole(parsing.at("json", "$.created"))), "yyyy-MM") == month))
        return taken.agg(F.count("*").alias("events"), F.format_number(F.sum(parsing.whole(parsing.at("json", "$.data.object.amount"))) / 100, 2).alias("amount"))

    def naive_waiting(self, through: datetime) -> DataFrame:
        """Paid orders by the change that arrived last, and those that waited 72 hours or more in elapsed time."""
        rows = self.lake.naive_lines("orders", through).where("json is not null")
        image = F.coalesce(parsing.at("json", "$.after"), parsing.at("json", "$.before"))
        rows = rows.select(F.get_json_object(image, "$.order_id").alias("order_id"), F.struct("file", "line").alias("arrival"), F.get_json_object(image, "$.status").alias("status"), F.get_json_object(image, "$.updated_at").try_cast("timestamp").alias("updated_at"))
        last = rows.groupBy("order_id").agg(F.max_by("status", "arrival").alias("status"), F.max_by("updated_at", "arrival").alias("updated_at")).where("status = 'paid'")
        old = F.unix_timestamp(F.lit(through).cast("timestamp")) - F.unix_timestamp("updated_at") >= 72 * 3600
        return last.agg(F.count("*").alias("waiting"), F.coalesce(F.sum(old.cast("bigint")), F.lit(0)).alias("over_72h"))

    def compare(self, through: datetime, month: str) -> dict:
        """The walk from the naive total of a month to the published one, step by step, whether its end is what was published, and both queues.

        ``steps`` is a table; the other figures are single numbers.
        """
        lines = self.lake.naive_lines("payments", through).where("json is not null")
        rates = self.stored("silver_fx_rates").where("base = 'USD' and quote = 'CAD'").select(F.lit("usd").alias("currency"), F.col("rate_date").alias("fx_rate_date"), F.col("rate").alias("fx_rate"))
        steps = storage.staged(waterfall.waterfall(waterfall.raw_events(lines, "json", "file", "line", month), rates), "steps")
        cents = self.published("mart_daily_cash").where(F.date_format("processor_date", "yyyy-MM") == month).agg(F.coalesce(F.sum("net_cad") * 100, F.lit(0)).cast("bigint")).first()[0]
        queue = self.published("mart_waiting").agg(F.coalesce(F.sum("orders"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("waiting") == "4. over 72h", F.col("orders"))), F.lit(0))).first()
        last = steps.where("step = 5").first()["total_cents"]
        naive = self.naive_waiting(through).first()
        return {"steps": steps, "published_cents": cents, "matches": last == cents, "waiting": (naive["waiting"], queue[0]), "over_72h": (naive["over_72h"], queue[1])}

    def run(self, through: datetime, replay: bool = False) -> bool:
        """ingest, build, grade, publish."""
        self.lake.ingest(through)
        self.build(through, replay)
        last = self.history().agg(F.max("through_seq")).first()[0] or 0
        self.results = self.grade(through, last)
        return self.publish(through, self.results)


# The text index -------------------------------------------------------------------------------
def build_index(spark: SparkSession, lake: str, build: str, shards: int = 4, by_letter: bool = False) -> None:
    """Index, statistics and totals of a lake's reading list, whose manifest must be there."""
    if storage.read_text(spark, f"{lake}/reading-list/_manifest.json") is None:
        raise FileNotFoundError("the reading list isn't finished")
    passages = spark.read.parquet(f"{lake}/reading-list/passages")
    terms = storage.staged(search.slips(text.with_tokens(passages.select("passage_id", "text"), "text"), "passage_id"), "slips")
    shard = text.letter_shard(F.col("word"), shards) if by_letter else text.hash_shard(F.col("passage_id"), shards)
    out = f"{lake}/builds/{build}"
    # In order of words, so that a scan for a few of them skips the rest by the files' statistics.
    search.inverted_index(terms, "passage_id", shard).sortWithinPartitions("shard", "word", "block").write.mode("overwrite").partitionBy("shard").parquet(f"{out}/index")
    search.document_frequencies(terms).sortWithinPartitions("word").write.mode("overwrite").parquet(f"{out}/stats")
    sizes = terms.withColumn("shard", shard).groupBy("shard").agg(F.countDistinct("passage_id").alias("n"), F.sum("tf").alias("tokens"))
    sizes.write.mode("overwrite").parquet(f"{out}/shards")
    row = search.totals(passages, terms, "text").first()
    storage.write_text_atomically(spark, f"{out}/corpus.json", json.dumps(row.asDict()))


def audit_index(spark: SparkSession, lake: str, build: str, canaries: str) -> list[tuple[str, bool, str]]:
    """(name, ok, detail): finished, passages, encoding, conservation, canaries; an unfinished build ends the audit."""
    out = f"{lake}/builds/{build}"
    done = all(storage.filesystem(spark, f"{out}/{p}/_SUCCESS")[0].exists(storage.filesystem(spark, f"{out}/{p}/_SUCCESS")[1]) for p in ("index", "stats"))
    if not done:
        return [("finished", False, _shown())]
    expected = json.loads(storage.read_text(spark, f"{lake}/reading-list/_manifest.json"))["passages"]
    got = json.loads(storage.read_text(spark, f"{out}/corpus.json"))
    index = spark.read.parquet(f"{out}/index")
    sums = index.groupBy("word").agg(F.sum("df").alias("in_shards")).join(spark.read.parquet(f"{out}/stats"), "word", "full_outer")
    counted = sums.agg(F.count("*").alias("words"), F.sum((~F.col("in_shards").eqNullSafe(F.col("df"))).cast("long")).alias("bad")).first()
    wanted = corpus.canaries(spark, canaries)
    found = index.select("word", F.explode("postings").alias("p")).select("word", F.col("p.passage_id").alias("passage_id"))
    dead = [f"{r['word']} in {r['passage_id']}" for r in wanted.join(found, ["word", "passage_id"], "left_anti").collect()]
    return [
        ("finished", True, _shown({"parts": 2})),
        ("passages", got["passages"] == expected, _shown({"expected": expected, "indexed": got["passages"]})),
        ("encoding", got["garbled"] == 0, _shown({"garbled": got["garbled"]})),
        ("conservation", counted["words"] > 0 and counted["bad"] == 0, _shown({"words": counted["words"], "apart": counted["bad"]})),
        ("canaries", not dead, _shown(*[{"lost": d} for d in dead])),
    ]


def publish_index(spark: SparkSession, lake: str, build: str, canaries: str) -> bool:
    """Point readers at a build, unless an audit fails; then they keep the last good one."""
    if not all(ok for _, ok, _ in audit_index(spark, lake, build, canaries)):
        return False
    storage.write_text_atomically(spark, f"{lake}/CURRENT", f"builds/{build}")
    return True


def search_index(spark: SparkSession, lake: str, queries: DataFrame, k: int = 5, local_idf: bool = False) -> DataFrame:
    """(query_id, passage_id, rank, score, title, text) from the published build.

    Of the index and its statistics only the queries' words are read, by a filter that reaches the scan; lengths are in the
    postings and totals in the build's corpus.json.  The shards' own best are gathered into one ranking.
    """
    current = storage.read_text(spark, f"{lake}/CURRENT")
    asked = search.asked_words(text.with_tokens(queries, "text"))
    index = search.of_words(spark.read.parquet(f"{lake}/{current}/index"), asked)
    terms = index.select("shard", "word", F.inline("postings"))
    passages = spark.read.parquet(f"{lake}/reading-list/passages")
    if local_idf:
        size = spark.read.parquet(f"{lake}/{current}/shards")
        scored = search.bm25_scores(terms, "passage_id", size, asked, by=["shard"])
    else:
        whole = json.loads(storage.read_text(spark, f"{lake}/{current}/corpus.json"))
        size = spark.createDataFrame([(whole["passages"], whole["tokens"])], "n long, tokens long")
        scored = search.bm25_scores(terms.drop("shard"), "passage_id", size, asked, stats=search.of_words(spark.read.parquet(f"{lake}/{current}/stats"), asked))
    hits = search.best_of_shards(scored, "query_id", "passage_id", k) if local_idf else search.best(scored, "query_id", "passage_id", k)
    shown = passages.join(spark.read.parquet(f"{lake}/reading-list/books").select("book", "title"), "book")
    return hits.join(shown.select("passage_id", "title", "text"), "passage_id")

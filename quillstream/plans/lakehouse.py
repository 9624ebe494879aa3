"""Queries of the lakehouse operators: parsing, quarantine, folding, merging, as-of conversion, marts, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import asof, checks, merge, parsing, waterfall
from ..session import table

HALIFAX = "America/Halifax"
#: The batch that cuts the season in two for merges, and the time at which queues are looked at.
CUT_SEQ, AS_OF = 310_400, "2026-09-08 12:00:00"
MONTH = "2026-08"


def bronze_payments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bronze_payments").withColumn("_bronze_row", F.concat_ws(":", "_landing_file", "_line"))


def q01_bronze_lines(spark, sf):
    return bronze_payments(spark, sf).select("_bronze_row", "_batch_seq", F.length("_raw").cast("bigint").alias("raw_chars"), F.sha2("_raw", 256).alias("raw_sha"))


def q02_json_extract(spark, sf):
    rows = bronze_payments(spark, sf).where(parsing.valid_json(F.col("_raw")))
    return rows.select("_bronze_row", parsing.at("_raw", "$.id").alias("id"), parsing.at("_raw", "$.type").alias("type"), parsing.whole(parsing.at("_raw", "$.created")).alias("created"), parsing.at("_raw", "$.data.object.refund.id").alias("refund_id"))


def staged_payments(spark, sf):
    return parsing.payment_events(bronze_payments(spark, sf))


def q03_quarantine_payments(spark, sf):
    rows = staged_payments(spark, sf)
    return rows.select("_bronze_row", "event_id", "event_type", "api_version", "charge_id", "refund_id", "order_id", "amount_minor", "currency", F.unix_seconds("created_at").alias("created"), "quarantine_reason")


def staged_orders(spark, sf):
    return table(spark, sf, "stg_order_changes").withColumn("reason", parsing.order_reason(F.col("quarantine_reason").eqNullSafe("unparseable_json")))


def q04_quarantine_orders(spark, sf):
    return staged_orders(spark, sf).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def q05_quarantine_rate(spark, sf):
    orders = staged_orders(spark, sf).select("_batch_seq", F.col("reason").alias("quarantine_reason"))
    return checks.quarantine_rates({"payments": staged_payments(spark, sf), "orders": orders})


def q06_first_delivery(spark, sf):
    rows = table(spark, sf, "silver_payments").where("event_id is not null")
    return merge.keep_first(rows, ["event_id"], [F.asc("_batch_seq"), F.asc("_arrived_at"), F.asc("_bronze_row")]).select("event_id", "_bronze_row", "amount_minor", "currency")


def usable_changes(spark, sf):
    return table(spark, sf, "stg_order_changes").where("quarantine_reason is null")


def q07_fold_by_lsn(spark, sf):
    rows = usable_changes(spark, sf).select("order_id", "lsn", "op", "status", "total_minor")
    return merge.keep_highest(rows.distinct(), ["order_id"], "lsn").select("order_id", "lsn", "status", "total_minor", (F.col("op") == "d").alias("is_deleted"))


def q08_arrival_against_lsn(spark, sf):
    """How many orders end differently when the last arrival wins instead of the highest position."""
    rows = usable_changes(spark, sf)
    last = rows.groupBy("order_id").agg(F.max_by("status", F.struct("_batch_seq", "_bronze_row")).alias("by_arrival"), F.max_by("status", "lsn").alias("by_lsn"))
    return last.agg(F.count("*").alias("orders"), F.sum((~F.col("by_arrival").eqNullSafe(F.col("by_lsn"))).cast("bigint")).alias("disagree"))


def q09_merge_insert_only(spark, sf):
    rows = table(spark, sf, "silver_payments").where("event_id is not null").select("event_id", "_bronze_row", "_batch_seq", "_arrived_at")
    order = [F.asc("_batch_seq"), F.asc("_arrived_at"), F.asc("_bronze_row")]
    old = merge.keep_first(rows.where(F.col("_batch_seq") <= CUT_SEQ), ["event_id"], order)
    new = merge.keep_first(merge.newer_than(rows, old, "_batch_seq"), ["event_id"], order)
    return merge.insert_only(old, new, ["event_id"]).select("event_id", "_bronze_row")


def q10_merge_conditional(spark, sf):
    state = table(spark, sf, "silver_orders").select("order_id", F.col("_lsn").alias("lsn"), "status", "is_deleted")
    feed = merge.keep_highest(usable_changes(spark, sf).select("order_id", "lsn", "status", (F.col("op") == "d").alias("is_deleted")).distinct(), ["order_id"], "lsn")
    return merge.conditional(state, feed.select(*state.columns), ["order_id"], "lsn")


def rates(spark, sf):
    """Usable rates to CAD, the latest arrival of a day and currency."""
    rows = table(spark, sf, "silver_fx_rates").where("rate_date is not null and rate > 0 and quote = 'CAD'").withColumn("currency", F.lower("base"))
    return merge.keep_first(rows, ["rate_date", "currency"], [F.desc("_arrived_at"), F.desc("_batch_seq"), F.desc("_landing_file"), F.desc("rate")])


def q11_latest_rates(spark, sf):
    return rates(spark, sf).select(F.col("rate_date").cast("string").alias("rate_date"), "currency", (F.col("rate") * 1_000_000).cast("bigint").alias("rate_micro"))


def alive_orders(spark, sf):
    rows = table(spark, sf, "silver_orders").where("not is_deleted")
    return rows.select("order_id", "ship_region", F.to_date(F.from_utc_timestamp("created_at", HALIFAX)).alias("order_date"), F.col("_batch_seq").alias("order_seq"))


def payments_fact(spark, sf):
    """Each event once, signed, with both of its dates and its value in cents of CAD at the rate as of the processor's day."""
    rows = table(spark, sf, "silver_payments").where("event_id is not null and currency is not null")
    first = merge.keep_first(rows, ["event_id"], [F.asc("_batch_seq"), F.asc("_arrived_at"), F.asc("_bronze_row")])
    dated = first.withColumn("processor_date", F.to_date("created_at")).withColumn("amount_minor", F.when(F.col("event_type") == "capture", F.col("amount_minor")).otherwise(-F.col("amount_minor")))
    found = rates(spark, sf).select("currency", F.col("rate_date").alias("fx_rate_date"), F.col("rate").alias("fx_rate"))
    priced = asof.asof_left(dated, found, on=("processor_date", "fx_rate_date"), by=["currency"], carry=["fx_rate_date", "fx_rate"])
    cad = F.col("currency") == "cad"
    priced = priced.withColumn("fx_rate_date", F.when(cad, F.col("processor_date")).otherwise(F.col("fx_rate_date"))).withColumn("fx_rate", F.when(cad, F.lit(1)).otherwise(F.col("fx_rate")).cast("decimal(12,6)"))
    return priced.withColumn("cad_cents", parsing.cad_cents(F.col("amount_minor"), F.col("fx_rate"))).join(alive_orders(spark, sf).drop("order_seq"), "order_id", "left")


def q12_payments_fact(spark, sf):
    text = lambda c: F.col(c).cast("string").alias(c)
    return payments_fact(spark, sf).select("event_id", "event_type", "order_id", "currency", "amount_minor", text("processor_date"), text("order_date"), "ship_region", text("fx_rate_date"), (F.col("fx_rate") * 1_000_000).cast("bigint").alias("fx_micro"), "cad_cents")


def daily_cash(fact: DataFrame) -> DataFrame:
    capture, refund = F.col("event_type") == "capture", F.col("event_type") == "refund"
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("bigint")
    return fact.groupBy("processor_date", "currency").agg(
        total(capture, "amount_minor").alias("captured_minor"), (-total(refund, "amount_minor")).alias("refunded_minor"), F.sum("amount_minor").cast("bigint").alias("net_minor"),
        F.count(F.when(capture, 1)).alias("captures"), F.count(F.when(refund, 1)).alias("refunds"), F.sum("cad_cents").cast("bigint").alias("net_cad_cents"),
    )


def q13_daily_cash(spark, sf):
    return daily_cash(payments_fact(spark, sf)).withColumn("processor_date", F.col("processor_date").cast("string")).orderBy("processor_date", "currency")


def order_revenue(fact: DataFrame, found_rates: DataFrame) -> DataFrame:
    priced = asof.asof_left(fact.drop("fx_rate_date", "fx_rate"), found_rates, on=("order_date", "fx_rate_date"), by=["currency"], carry=["fx_rate"])
    cents = parsing.cad_cents(F.col("amount_minor"), F.when(F.col("currency") == "cad", F.lit(1)).otherwise(F.col("fx_rate")).cast("decimal(12,6)"))
    capture, refund = F.col("event_type") == "capture", F.col("event_type") == "refund"
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("c"))), F.lit(0)).cast("bigint")
    return priced.withColumn("c", cents).groupBy("order_date", "ship_region").agg(F.countDistinct(F.when(capture, F.col("order_id"))).alias("paid_orders"), total(capture).alias("gross_cents"), (-total(refund)).alias("refund_cents"), F.sum("c").cast("bigint").alias("net_cents"))


def q14_order_revenue(spark, sf):
    """The mart after a second batch: only days that new events or changed orders touch are built again."""
    needed = ["order_date", "ship_region", "event_type", "order_id", "currency", "amount_minor", "_batch_seq"]
    fact = storage.staged(payments_fact(spark, sf).where("order_date is not null").select(*needed), "fact")  # read three times
    found = rates(spark, sf).select("currency", F.col("rate_date").alias("fx_rate_date"), F.col("rate").alias("fx_rate"))
    before = order_revenue(fact.where(F.col("_batch_seq") <= CUT_SEQ), found)
    touched = fact.where(F.col("_batch_seq") > CUT_SEQ).select("order_date").union(alive_orders(spark, sf).where(F.col("order_seq") > CUT_SEQ).select("order_date")).distinct()
    rebuilt = order_revenue(fact.join(touched, "order_date", "left_semi"), found)
    return merge.replace_keys(before, rebuilt, touched, ["order_date"]).withColumn("order_date", F.col("order_date").cast("string"))


def q15_waiting_hours(spark, sf):
    """Orders by status and whole days of waiting, counted in hour boundaries up to a given time."""
    rows = table(spark, sf, "silver_orders").where("not is_deleted").withColumn("hours", parsing.boundary_hours(F.col("updated_at"), F.lit(AS_OF).cast("timestamp")))
    return rows.groupBy("status", F.floor(F.col("hours") / 24).alias("days")).agg(F.count("*").alias("orders"), F.min("hours").alias("least_hours"), F.unix_micros(F.min("updated_at")).alias("oldest_us"))


def latest_settlements(spark, sf):
    rows = table(spark, sf, "silver_settlements").withColumn("currency", F.lower(F.trim("currency")))
    return merge.keep_first(rows, ["settlement_date", "currency"], [F.desc("_arrived_at"), F.desc("_batch_seq"), F.desc("_landing_file"), F.desc_nulls_last("gross_minor")])


def q16_reconciliation(spark, sf):
    cash = table(spark, sf, "mart_daily_cash").withColumn("currency", F.lower(F.trim("currency")))
    lines = checks.reconciliation(latest_settlements(spark, sf), cash, F.lit("2026-08-20 12:00:00").cast("timestamp"))
    return lines.withColumn("settlement_date", F.col("settlement_date").cast("string"))


def q17_refunds_within_charge(spark, sf):
    """Charges that gave back more than they took, were every tenth order's refunds sent once more, larger."""
    fact = table(spark, sf, "fct_payments").select("charge_id", "event_type", "amount_minor", "order_id")
    more = fact.where((F.col("event_type") == "refund") & F.col("order_id").endswith("7")).withColumn("amount_minor", F.col("amount_minor") * 3)
    return checks.over_refunded(fact.unionByName(more))


def q18_conservation(spark, sf):
    rows = table(spark, sf, "silver_payments").where("event_id is not null")
    return checks.conservation(merge.keep_first(rows, ["event_id"], [F.asc("_batch_seq"), F.asc("_arrived_at"), F.asc("_bronze_row")]), table(spark, sf, "fct_payments"))


def q19_rate_coverage(spark, sf):
    return checks.rate_coverage(table(spark, sf, "fct_payments"))


def q20_waterfall(spark, sf):
    """A naive monthly total, corrected one mistake at a time."""
    found = rates(spark, sf).where("currency = 'usd'").select("currency", F.col("rate_date").alias("fx_rate_date"), F.col("rate").alias("fx_rate"))
    events = waterfall.raw_events(bronze_payments(spark, sf), "_raw", "_landing_file", "_line", MONTH)
    return waterfall.waterfall(events, found)


def q61_order_changes_parsed(spark, sf):
    """Usable changes written as the events they came from and parsed again: a delete's image is what was before."""
    rows = usable_changes(spark, sf).where("op is not null and order_id is not null and lsn is not null")
    image = F.struct("order_id", "customer_id", "status", F.upper("currency").alias("currency"), "total_minor", "ship_region", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"))
    event = F.struct("op", F.struct("lsn").alias("source"), F.when(F.col("op") == "d", image).alias("before"), F.when(F.col("op") != "d", image).alias("after"))
    parsed = parsing.order_changes(rows.select("_bronze_row", F.to_json(event).alias("_raw")))
    return parsed.select("_bronze_row", "op", "lsn", "order_id", "customer_id", "status", "currency", "total_minor", "ship_region", F.unix_seconds("updated_at").alias("updated"), "quarantine_reason")


def q62_waiting_buckets(spark, sf):
    """Paid orders by how long they had waited when the last change came."""
    orders = table(spark, sf, "silver_orders")
    rows = orders.where("status = 'paid' and not is_deleted").withColumn("now", orders.agg(F.max("updated_at")).scalar())
    return rows.groupBy(parsing.waiting_bucket(F.col("updated_at"), F.col("now")).alias("waiting")).agg(F.count("*").alias("orders"), F.unix_micros(F.min("updated_at")).alias("oldest_us"))


def q63_settlement_totals(spark, sf):
    """What a processor would report of each day and currency."""
    fact = table(spark, sf, "fct_payments")
    capture, refund = F.col("event_type") == "capture", F.col("event_type") == "refund"
    total = lambda test, sign: F.coalesce(F.sum(F.when(test, sign * F.col("amount_minor"))), F.lit(0)).cast("bigint")
    sums = fact.groupBy(F.to_date("created_at").cast("string").alias("settlement_date"), "currency")
    return sums.agg(total(capture, 1).alias("gross_minor"), total(refund, -1).alias("refunds_minor"), F.sum("amount_minor").cast("bigint").alias("net_minor"), F.count_if(capture).alias("charge_count"), F.count_if(refund).alias("refund_count"))


def q64_new_files(spark, sf):
    """Files that a second run would take in: known neither by name nor by content, of equal contents the first by name."""
    log = table(spark, sf, "manifest")
    known, landed = log.where("batch_seq is not null and batch_seq <= 310400"), log.where("batch_seq is null or batch_seq > 310400")
    new = landed.join(known.select("file"), "file", "left_anti").join(known.select("sha256"), "sha256", "left_anti")
    return merge.keep_first(new, ["sha256"], [F.asc("file")]).select("source", "file", "sha256")


def q65_money_shown(spark, sf):
    """Monthly totals as they are printed."""
    rows = table(spark, sf, "mart_daily_cash").groupBy(F.date_format("processor_date", "yyyy-MM").alias("month")).agg(F.sum("net_cad").alias("net"), F.sum("captures").alias("captures"), F.sum("refunds").alias("refunds"))
    return rows.select("month", F.concat(F.lit("C$"), F.format_number("net", 2)).alias("net"), F.concat(F.format_number(100 * F.col("refunds") / F.col("captures"), 2), F.lit("%")).alias("refund_rate"))


def row_checks(spark, sf):
    pay, orders, fx, fact = (table(spark, sf, t) for t in ("silver_payments", "silver_orders", "silver_fx_rates", "fct_payments"))
    cash, revenue = table(spark, sf, "mart_daily_cash"), table(spark, sf, "mart_order_revenue")
    return [
        checks.unique("silver_payments", pay, "event_id"), checks.not_null("silver_payments", pay, "event_id"), checks.accepted("silver_payments", pay, "event_type", ["capture", "refund"]), checks.accepted("silver_payments", pay, "currency", ["cad", "usd"]),
        checks.not_null("silver_payments", pay, "amount_minor"), checks.positive("silver_payments", pay, "amount_minor"), checks.refers("silver_payments", pay, "order_id", orders, "order_id"),
        checks.unique("silver_orders", orders, "order_id"), checks.not_null("silver_orders", orders, "order_id"), checks.accepted("silver_orders", orders, "status", ["placed", "paid", "shipped", "cancelled", "returned"]),
        checks.unique("silver_fx_rates", fx, "rate_date", "base", "quote"), checks.unique("fct_payments", fact, "event_id"), checks.not_null("fct_payments", fact, "event_id"), checks.not_null("fct_payments", fact, "fx_rate"),
        checks.unique("mart_daily_cash", cash, "processor_date", "currency"), checks.unique("mart_order_revenue", revenue, "order_date", "ship_region"),
    ]


def q21_row_checks(spark, sf):
    return checks.outcome(row_checks(spark, sf))


def q48_naive_month(spark, sf):
    rows = bronze_payments(spark, sf).where(parsing.valid_json(F.col("_raw")))
    rows = rows.where((parsing.at("_raw", "$.type") == "charge.succeeded") & (F.date_format(F.timestamp_seconds(parsing.whole(parsing.at("_raw", "$.created"))), "yyyy-MM") == MONTH))
    return rows.agg(F.count("*").alias("events"), F.sum(parsing.whole(parsing.at("_raw", "$.data.object.amount"))).cast("bigint").alias("naive_minor"))


def q49_latest_batches(spark, sf):
    """The six latest batches of the commit log, as a log of publishes is shown."""
    rows = table(spark, sf, "manifest").where("batch_id is not null").groupBy("source", "batch_seq").agg(F.count("*").alias("files"), F.unix_micros(F.max("ingested_at")).alias("ingested_us"))
    return rows.orderBy(F.desc("batch_seq"), F.asc("source")).limit(6)


def q50_projection(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") > 40)).drop("l_tax", "l_shipdate", "l_linestatus")
    parts = table(spark, sf, "part").where(F.col("p_name").like("%ring%") | F.col("p_type").like("%PROMO")).select(F.col("p_partkey").alias("l_partkey"))
    return rows.join(parts, "l_partkey", "left_semi")


# SQL ------------------------------------------------------------------------------------------
_R = "_landing_file || ':' || _line"
_J = "json_extract_string(_raw, '{}')"
_WHOLE = "try_cast(floor(abs(try_cast({0} as decimal(38, 6))) + 0.5) as bigint) * (case when try_cast({0} as decimal(38, 6)) < 0 then -1 else 1 end)"


def _at(p: str) -> str:
    return f"json_extract_string(_raw, '{p}')"


def _whole(x: str) -> str:
    return _WHOLE.format(x)


_STAGED = f"""
with r as (select {_R} as _bronze_row, case when json_valid(_raw) then _raw end as _raw, json_valid(_raw) as ok, _batch_seq from bronze_payments),
e as (select *, {_at('$.id')} as event_id, {_at('$.type')} as t, {_at('$.api_version')} as api_version, {_whole(_at('$.created'))} as created from r),
p as (select *, case api_version when '2025-11-01' then {_at('$.data.object.id')} when '2026-08-01' then coalesce({_at('$.data.object.charge')}, {_at('$.data.object.id')}) end as charge_id,
  case api_version when '2025-11-01' then {_at('$.data.object.refund.id')} when '2026-08-01' then case when {_at('$.data.object.object')} = 'refund' then {_at('$.data.object.id')} end end as refund_id,
  case api_version when '2025-11-01' then {_at('$.data.object.order_id')} when '2026-08-01' then {_at('$.data.object.metadata.order_id')} end as order_id,
  case api_version when '2025-11-01' then coalesce({_at('$.data.object.refund.amount')}, {_at('$.data.object.amount')}) when '2026-08-01' then {_at('$.data.object.amount.value')} end as amount,
  lower(case api_version when '2025-11-01' then {_at('$.data.object.currency')} when '2026-08-01' then {_at('$.data.object.amount.currency')} end) as currency from e),
s as (select *, {_whole('amount')} as amount_minor from p),
q as (select _bronze_row, event_id, case t when 'charge.succeeded' then 'capture' when 'charge.refunded' then 'refund' end as event_type, api_version, charge_id, refund_id, order_id, amount_minor, currency, created, _batch_seq,
  case when not ok then 'unparseable_json' when api_version not in ('2025-11-01', '2026-08-01') then 'unsupported_api_version' when t not in ('charge.succeeded', 'charge.refunded') then 'unknown_event_type'
    when event_id is null or created is null then 'missing_envelope' when order_id is null then 'missing_order_id' when amount_minor is null or amount_minor <= 0 then 'bad_amount'
    when currency not in ('cad', 'usd') then 'unknown_currency' when t = 'charge.refunded' and refund_id is null then 'missing_refund_id' end as quarantine_reason from s)
"""
_O = """o as (select *, case when quarantine_reason = 'unparseable_json' then 'unparseable_json' when op not in ('c', 'u', 'd', 'r') then 'unknown_op' when lsn is null then 'missing_lsn' when order_id is null then 'missing_order_id' end as reason from stg_order_changes)"""
_FIRST = "select * from silver_payments where event_id is not null{} qualify row_number() over (partition by event_id order by _batch_seq, _arrived_at, _bronze_row) = 1"
_RATES = """rates as (select rate_date, lower(base) as currency, rate, cast(rate * 1000000 as bigint) as micro from silver_fx_rates where rate_date is not null and rate > 0 and quote = 'CAD'
  qualify row_number() over (partition by rate_date, lower(base) order by _arrived_at desc, _batch_seq desc, _landing_file desc, rate desc) = 1)"""
_CENTS = "(case when {0} * {1} < 0 then -1 else 1 end) * ((abs({0} * {1}) * 2 + 1000000) // 2000000)"
_FACT = f"""{_RATES},
d as (select *, cast(created_at at time zone 'UTC' as date) as processor_date, case event_type when 'capture' then amount_minor else -amount_minor end as signed from ({_FIRST.format(' and currency is not null')})),
ord as (select order_id, ship_region, cast(created_at at time zone 'America/Halifax' as date) as order_date, _batch_seq as order_seq from silver_orders where not is_deleted),
x as (select d.*, case when d.currency = 'cad' then d.processor_date else r.rate_date end as fx_rate_date, case when d.currency = 'cad' then 1000000 else r.micro end as fx_micro
  from d asof left join rates r on d.currency = r.currency and d.processor_date >= r.rate_date),
fact as (select x.*, ord.order_date, ord.ship_region, {_CENTS.format('signed', 'fx_micro')} as cad_cents from x left join ord using (order_id))"""
_REVENUE = """select order_date, ship_region, count(distinct case when event_type = 'capture' then order_id end) as paid_orders, coalesce(sum(case when event_type = 'capture' then c end), 0)::bigint as gross_cents,
  (-coalesce(sum(case when event_type = 'refund' then c end), 0))::bigint as refund_cents, sum(c)::bigint as net_cents from {} group by 1, 2"""
_LATEST = """select settlement_date, lower(trim(currency)) as currency, gross_minor, refunds_minor, net_minor from silver_settlements
  qualify row_number() over (partition by settlement_date, lower(trim(currency)) order by _arrived_at desc, _batch_seq desc, _landing_file desc, gross_minor desc nulls last) = 1"""


def _check(name: str, count: str, severity: str = "error") -> str:
    return f"select '{name}' as name, '{severity}' as severity, ({count}) as failing"


def _dup(t: str, *cols: str) -> str:
    c = ", ".join(cols)
    return f"select count(*) from (select {c} from {t} where {' and '.join(f'{x} is not null' for x in cols)} group by {c} having count(*) > 1)"


_CHECKS = " union all ".join([
    _check("silver_payments.event_id unique", _dup("silver_payments", "event_id")), _check("silver_payments.event_id not_null", "select count(*) from silver_payments where event_id is null"), _check("silver_payments.event_type accepted", "select count(*) from silver_payments where event_type not in ('capture', 'refund')"),
    _check("silver_payments.currency accepted", "select count(*) from silver_payments where currency not in ('cad', 'usd')"), _check("silver_payments.amount_minor not_null", "select count(*) from silver_payments where amount_minor is null"), _check("silver_payments.amount_minor positive", "select count(*) from silver_payments where amount_minor <= 0"),
    _check("silver_payments.order_id refers", "select count(*) from silver_payments p where order_id is not null and not exists (select 1 from silver_orders o where o.order_id = p.order_id)", "warn"), _check("silver_orders.order_id unique", _dup("silver_orders", "order_id")),
    _check("silver_orders.order_id not_null", "select count(*) from silver_orders where order_id is null"), _check("silver_orders.status accepted", "select count(*) from silver_orders where status not in ('placed', 'paid', 'shipped', 'cancelled', 'returned')"),
    _check("silver_fx_rates.rate_date+base+quote unique", _dup("silver_fx_rates", "rate_date", "base", "quote")), _check("fct_payments.event_id unique", _dup("fct_payments", "event_id")), _check("fct_payments.event_id not_null", "select count(*) from fct_payments where event_id is null"),
    _check("fct_payments.fx_rate not_null", "select count(*) from fct_payments where fx_rate is null"), _check("mart_daily_cash.processor_date+currency unique", _dup("mart_daily_cash", "processor_date", "currency")), _check("mart_order_revenue.order_date+ship_region unique", _dup("mart_order_revenue", "order_date", "ship_region")),
])

SQL = {
    "q61_order_changes_parsed": """select _bronze_row, op, lsn, order_id, customer_id, status, lower(currency) as currency, total_minor, ship_region, epoch(date_trunc('second', updated_at))::bigint as updated,
      case when op not in ('c', 'u', 'd', 'r') then 'unknown_op' end as quarantine_reason from stg_order_changes where quarantine_reason is null and op is not null and order_id is not null and lsn is not null""",
    "q62_waiting_buckets": f"""with h as (select updated_at, date_diff('hour', updated_at, (select max(updated_at) from silver_orders)) as h from (select updated_at from silver_orders where status = 'paid' and not is_deleted))
      select case when h < 24 then '1. under 24h' when h < 48 then '2. 24-48h' when h < 72 then '3. 48-72h' else '4. over 72h' end as waiting, count(*) as orders, epoch_us(min(updated_at)) as oldest_us from h group by 1""",
    "q63_settlement_totals": """select cast(cast(created_at as date) as varchar) as settlement_date, currency, coalesce(sum(amount_minor) filter (event_type = 'capture'), 0)::bigint as gross_minor, coalesce(-sum(amount_minor) filter (event_type = 'refund'), 0)::bigint as refunds_minor,
      sum(amount_minor)::bigint as net_minor, count(*) filter (event_type = 'capture') as charge_count, count(*) filter (event_type = 'refund') as refund_count from fct_payments group by 1, 2""",
    "q64_new_files": """with k as (select * from manifest where batch_seq <= 310400), n as (select * from manifest where batch_seq is null or batch_seq > 310400)
      select source, file, sha256 from n where file not in (select file from k) and sha256 not in (select sha256 from k where sha256 is not null) qualify row_number() over (partition by sha256 order by file) = 1""",
    "q65_money_shown": """select strftime(processor_date, '%Y-%m') as month, 'C$' || format('{:,.2f}', sum(net_cad)::double) as net, format('{:,.2f}', 100.0::double * sum(refunds) / sum(captures)) || '%' as refund_rate from mart_daily_cash group by 1""",
    "q01_bronze_lines": f"select {_R} as _bronze_row, _batch_seq, length(_raw)::bigint as raw_chars, sha256(_raw) as raw_sha from bronze_payments",
    "q02_json_extract": f"select {_R} as _bronze_row, {_at('$.id')} as id, {_at('$.type')} as type, {_whole(_at('$.created'))} as created, {_at('$.data.object.refund.id')} as refund_id from bronze_payments where json_valid(_raw)",
    "q03_quarantine_payments": _STAGED + "select _bronze_row, event_id, event_type, api_version, charge_id, refund_id, order_id, amount_minor, currency, created, quarantine_reason from q",
    "q04_quarantine_orders": f"with {_O} select coalesce(reason, 'none') as reason, count(*) as n from o group by 1",
    "q05_quarantine_rate": _STAGED + f", {_O}, u as (select 'payments' as source, quarantine_reason as reason from q union all select 'orders', reason from o), "
    "c as (select source, reason, count(*) as n from u group by 1, 2), h as (select source, reason from c where reason is not null qualify row_number() over (partition by source order by n desc, reason) = 1), "
    "g as (select source, sum(n)::bigint as arrived, coalesce(sum(case when reason is not null then n end), 0)::bigint as held from c group by 1) "
    "select g.source, arrived, held, h.reason as top_reason, case when held / arrived > 0.02 and held >= 10 then 'BLOCK' when held / arrived > 0.005 then 'WARN' else 'PASS' end as status from g left join h using (source)",
    "q06_first_delivery": f"select event_id, _bronze_row, amount_minor, currency from ({_FIRST.format('')})",
    "q07_fold_by_lsn": "select order_id, lsn, status, total_minor, op = 'd' as is_deleted from stg_order_changes where quarantine_reason is null qualify row_number() over (partition by order_id order by lsn desc) = 1",
    "q08_arrival_against_lsn": "with l as (select order_id, arg_max(status, (_batch_seq, _bronze_row)) as a, arg_max(status, lsn) as b from stg_order_changes where quarantine_reason is null group by 1) select count(*) as orders, sum(case when a is distinct from b then 1 else 0 end)::bigint as disagree from l",
    "q09_merge_insert_only": f"select event_id, _bronze_row from ({_FIRST.format('')})",
    "q10_merge_conditional": """with f as (select order_id, lsn, status, op = 'd' as is_deleted from stg_order_changes where quarantine_reason is null qualify row_number() over (partition by order_id order by lsn desc) = 1)
      select coalesce(s.order_id, f.order_id) as order_id, case when s.order_id is null or f.lsn > s._lsn then f.lsn else s._lsn end as lsn, case when s.order_id is null or f.lsn > s._lsn then f.status else s.status end as status,
      case when s.order_id is null or f.lsn > s._lsn then f.is_deleted else s.is_deleted end as is_deleted from silver_orders s full join f on s.order_id = f.order_id""",
    "q11_latest_rates": f"with {_RATES} select cast(rate_date as varchar) as rate_date, currency, micro as rate_micro from rates",
    "q12_payments_fact": f"with {_FACT} select event_id, event_type, order_id, currency, signed as amount_minor, cast(processor_date as varchar) as processor_date, cast(order_date as varchar) as order_date, ship_region, cast(fx_rate_date as varchar) as fx_rate_date, fx_micro, cad_cents from fact",
    "q13_daily_cash": f"""with {_FACT} select cast(processor_date as varchar) as processor_date, currency, coalesce(sum(signed) filter (event_type = 'capture'), 0)::bigint as captured_minor, (-coalesce(sum(signed) filter (event_type = 'refund'), 0))::bigint as refunded_minor, sum(signed)::bigint as net_minor,
      count(*) filter (event_type = 'capture') as captures, count(*) filter (event_type = 'refund') as refunds, sum(cad_cents)::bigint as net_cad_cents from fact group by all order by all""",
    "q14_order_revenue": f"""with {_FACT}, y as (select f.*, {_CENTS.format('signed', "(case when f.currency = 'cad' then 1000000 else r.micro end)")} as c from (select * from fact where order_date is not null) f asof left join rates r on f.currency = r.currency and f.order_date >= r.rate_date),
      touched as (select order_date from y where _batch_seq > {CUT_SEQ} union select order_date from ord where order_seq > {CUT_SEQ}), old as ({_REVENUE.format(f'(select * from y where _batch_seq <= {CUT_SEQ})')}), new as ({_REVENUE.format('(select * from y where order_date in (select order_date from touched))')})
      select * replace (cast(order_date as varchar) as order_date) from (select * from old where order_date not in (select order_date from touched where order_date is not null) union all select * from new)""",
    "q15_waiting_hours": f"""with w as (select *, date_diff('hour', updated_at, timestamptz '{AS_OF}+00') as hours from silver_orders where not is_deleted)
      select status, floor(hours / 24)::bigint as days, count(*) as orders, min(hours) as least_hours, epoch_us(min(updated_at)) as oldest_us from w group by 1, 2""",
    "q16_reconciliation": f"""with s as ({_LATEST}), c as (select processor_date, lower(trim(currency)) as currency, captured_minor, refunded_minor, net_minor from mart_daily_cash)
      select cast(settlement_date as varchar) as settlement_date, s.currency, coalesce(c.net_minor, 0) - s.net_minor as off_minor, case when s.gross_minor is not distinct from coalesce(captured_minor, 0) and s.refunds_minor is not distinct from coalesce(refunded_minor, 0) and s.net_minor is not distinct from coalesce(c.net_minor, 0) then 'match'
      when epoch(timestamptz '2026-08-20 12:00:00+00') - epoch(cast(settlement_date + 1 as timestamp)) < 172800 then 'settling' else 'broken' end as state from s left join c on c.processor_date = s.settlement_date and c.currency = s.currency""",
    "q17_refunds_within_charge": """with a as (select charge_id, event_type, amount_minor from fct_payments union all select charge_id, event_type, 3 * amount_minor from fct_payments where event_type = 'refund' and order_id like '%7'),
      s as (select charge_id, coalesce(sum(amount_minor) filter (event_type = 'capture'), 0)::bigint as captured, coalesce(-sum(amount_minor) filter (event_type = 'refund'), 0)::bigint as refunded, count(*) filter (event_type = 'capture') as taken from a where charge_id is not null group by 1)
      select charge_id, captured, refunded from s where taken > 0 and refunded > captured""",
    "q18_conservation": f"""with s as (select count(*) as silver_rows, sum(case event_type when 'capture' then amount_minor else -amount_minor end)::bigint as silver_net from ({_FIRST.format('')})), g as (select count(*) as gold_rows, sum(amount_minor)::bigint as gold_net from fct_payments)
      select *, case when silver_rows is not distinct from gold_rows and silver_net is not distinct from gold_net then 'PASS' else 'BLOCK' end as status from s, g""",
    "q19_rate_coverage": """with a as (select sum(case when fx_rate is null then 1 else 0 end)::bigint as missing, coalesce(max(case when currency <> 'cad' then date_diff('day', fx_rate_date, processor_date) end), 0)::bigint as oldest_days from fct_payments)
      select *, case when missing > 0 then 'BLOCK' when oldest_days > 4 then 'WARN' else 'PASS' end as status from a""",
    "q20_waterfall": f"""with {_RATES}, e as (select _landing_file like '%-resend.jsonl' as resend, {_at('$.id')} as id, {_at('$.type')} as type, to_timestamp({_whole(_at('$.created'))}) as t, {_whole(_at('$.data.object.amount'))} as naive,
      coalesce({_whole(_at('$.data.object.refund.amount'))}, {_whole(_at('$.data.object.amount.value'))}, {_whole(_at('$.data.object.amount'))}) as amount, lower(coalesce({_at('$.data.object.currency')}, {_at('$.data.object.amount.currency')})) as currency, _landing_file, _line from bronze_payments where json_valid(_raw)),
      f as (select *, row_number() over (partition by id order by _landing_file, _line) = 1 as fd from e), m as (select *, cast(t at time zone 'UTC' as date) as day from f where strftime(t at time zone 'UTC', '%Y-%m') = '{MONTH}'),
      x as (select m.*, case when m.currency = 'usd' then r.micro else 1000000 end as micro, case when type = 'charge.succeeded' then amount else -amount end as signed, type = 'charge.succeeded' as cap, type in ('charge.succeeded', 'charge.refunded') as both_t from m asof left join (select * from rates where currency = 'usd') r on m.day >= r.rate_date),
      s as (select 0 as step, 'naive' as label, coalesce(sum(case when cap then naive end), 0)::bigint as total_cents from x union all select 1, 're-sent files', coalesce(sum(case when cap and not resend then naive end), 0)::bigint from x
      union all select 2, 'repeated deliveries', coalesce(sum(case when cap and not resend and fd then naive end), 0)::bigint from x union all select 3, 'second version''s amounts', coalesce(sum(case when cap and not resend and fd then amount end), 0)::bigint from x
      union all select 4, 'refunds', coalesce(sum(case when both_t and not resend and fd then signed end), 0)::bigint from x union all select 5, 'conversion', coalesce(sum(case when both_t and not resend and fd then {_CENTS.format('signed', 'micro')} end), 0)::bigint from x)
      select *, (total_cents - lag(total_cents) over (order by step))::bigint as delta_cents from s""",
    "q21_row_checks": f"select *, case when failing = 0 then 'PASS' when severity = 'warn' then 'WARN' else 'BLOCK' end as status from ({_CHECKS})",
    "q48_naive_month": f"select count(*) as events, sum({_whole(_at('$.data.object.amount'))})::bigint as naive_minor from bronze_payments where json_valid(_raw) and {_at('$.type')} = 'charge.succeeded' and strftime(to_timestamp({_whole(_at('$.created'))}) at time zone 'UTC', '%Y-%m') = '{MONTH}'",
    "q49_latest_batches": "select source, batch_seq, count(*) as files, epoch_us(max(ingested_at)) as ingested_us from manifest where batch_id is not null group by 1, 2 order by batch_seq desc, source limit 6",
    "q50_projection": "select * exclude (l_tax, l_shipdate, l_linestatus) from lineitem where l_returnflag in ('A', 'R') and l_quantity > 40 and l_partkey in (select p_partkey from part where p_name like '%ring%' or p_type like '%PROMO')",
}
QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}
assert reduce(lambda a, b: a and b in QUERIES, SQL, True)

"""Queries of the data-repair problems 3 to 7, each over its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import changefeed, dedupe, drift, late, reconcile
from ..session import table

HALIFAX = "America/Halifax"
ORDER_PAYLOAD = ["customer_id", "status", "currency", "total_minor", "ship_region", "created_at", "updated_at", "_batch_seq", "_arrived_at", "_ingested_at"]


# 3. Change feed ----------------------------------------------------------------------------------
def current_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The published state of all orders after the feed, tombstones included."""
    feed = changefeed.changes(table(spark, sf, "stg_order_changes"), "order_id", "lsn", "op", ORDER_PAYLOAD, usable=F.col("quarantine_reason").isNull(), tie="_bronze_row")
    state = changefeed.stored(table(spark, sf, "silver_orders"), "order_id", "_lsn", "is_deleted", ORDER_PAYLOAD)
    return changefeed.apply_changes(state, feed)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return changefeed.alive(current_orders(spark, sf)).select(F.col("cdc_key").alias("order_id"), F.col("cdc_seq").alias("lsn"))


def p3_orders_now(spark: SparkSession, sf: str) -> DataFrame:
    now = current_orders(spark, sf)
    return now.select(F.col("cdc_key").alias("order_id"), F.col("cdc_deleted").alias("is_deleted"), F.col("cdc_seq").alias("lsn"), "customer_id", "status", "currency", "total_minor", "ship_region", F.unix_micros("updated_at").alias("updated_us"))


_P3_ALL = """
with a as (
  select order_id, lsn, op = 'd' as is_deleted, customer_id, status, currency, total_minor, ship_region, updated_at, _bronze_row as tie from stg_order_changes
  where quarantine_reason is null and order_id is not null and lsn is not null and op in ('c', 'u', 'r', 'd')
  union all
  select order_id, _lsn, coalesce(is_deleted, false), customer_id, status, currency, total_minor, ship_region, updated_at, '' from silver_orders where order_id is not null and _lsn is not null),
w as (select * from a qualify row_number() over (partition by order_id order by lsn desc, tie, is_deleted desc) = 1)
"""
P3_FOUND_SQL = _P3_ALL + "select order_id, lsn from w where not is_deleted"
P3_NOW_SQL = _P3_ALL + "select order_id, is_deleted, lsn, customer_id, status, currency, total_minor, ship_region, epoch_us(updated_at) as updated_us from w"


# 4. Repeated deliveries --------------------------------------------------------------------------
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    payments = dedupe.later_copies(table(spark, sf, "silver_payments"), F.col("event_id"), F.col("_bronze_row"), [F.col("_batch_seq"), F.col("_arrived_at"), F.col("_bronze_row")])
    files = dedupe.later_copies(table(spark, sf, "manifest"), F.col("sha256"), F.col("file"), [F.col("ingested_at"), F.col("file")])
    return payments.select(F.lit("payment").alias("record_kind"), "record_key").unionByName(files.select(F.lit("file").alias("record_kind"), "record_key"))


P4_SQL = r"""
select 'payment' as record_kind, _bronze_row as record_key from (select _bronze_row, row_number() over (partition by lower(regexp_replace(event_id, '^\s+|\s+$', '', 'g')) order by _batch_seq nulls first, _arrived_at nulls first, _bronze_row) k from silver_payments where event_id is not null) where k > 1
union all
select 'file', file from (select file, row_number() over (partition by lower(regexp_replace(sha256, '^\s+|\s+$', '', 'g')) order by ingested_at nulls first, file) k from manifest where sha256 is not null) where k > 1"""


# 5. Two copies -----------------------------------------------------------------------------------
CASH_FIELDS = {"gross_minor": "captured_minor", "refunds_minor": "refunded_minor", "net_minor": "net_minor", "charge_count": "captures", "refund_count": "refunds"}


def latest_settlements(settlements: DataFrame) -> DataFrame:
    """Of several reports for a day and currency the latest arrival counts: a pre-aggregated maximum."""
    figures = [F.col(c).cast("long").alias(c) for c in CASH_FIELDS]
    rows = settlements.select("settlement_date", F.lower(F.trim("currency")).alias("currency"), F.struct("_arrived_at", "_batch_seq", "_landing_file", *figures).alias("m"))
    return rows.groupBy("settlement_date", "currency").agg(F.max("m").alias("m")).select("settlement_date", "currency", *[F.col(f"m.{c}").alias(c) for c in CASH_FIELDS])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    settled = latest_settlements(table(spark, sf, "silver_settlements"))
    cash = table(spark, sf, "mart_daily_cash").select(F.col("processor_date").alias("settlement_date"), F.lower(F.trim("currency")).alias("currency"), *[F.col(b).cast("long").alias(a) for a, b in CASH_FIELDS.items()])
    found = reconcile.differences(settled, cash, ["settlement_date", "currency"], list(CASH_FIELDS), missing_right="missing_in_mart", missing_left="missing_in_settlements")
    return found.select(F.col("settlement_date").cast("string").alias("settlement_date"), "currency", "issue")


P5_SQL = """
with s as (select settlement_date, lower(trim(currency)) as currency, gross_minor, refunds_minor, net_minor, charge_count, refund_count from silver_settlements
  qualify row_number() over (partition by settlement_date, lower(trim(currency)) order by _arrived_at desc nulls last, _batch_seq desc nulls last, _landing_file desc nulls last, gross_minor desc nulls last, refunds_minor desc nulls last, net_minor desc nulls last, charge_count desc nulls last, refund_count desc nulls last) = 1),
m as (select processor_date, lower(trim(currency)) as currency, captured_minor, refunded_minor, net_minor, captures, refunds from mart_daily_cash),
j as (select coalesce(s.settlement_date, m.processor_date) as d, coalesce(s.currency, m.currency) as c, s.settlement_date is null and s.currency is null as no_s, m.processor_date is null and m.currency is null as no_m,
  s.gross_minor is distinct from m.captured_minor as a1, s.refunds_minor is distinct from m.refunded_minor as a2, s.net_minor is distinct from m.net_minor as a3, s.charge_count is distinct from m.captures as a4, s.refund_count is distinct from m.refunds as a5
  from s full join m on s.settlement_date is not distinct from m.processor_date and s.currency is not distinct from m.currency)
select cast(d as varchar) as settlement_date, c as currency, unnest(case when no_m then ['missing_in_mart'] when no_s then ['missing_in_settlements'] else
  list_filter([case when a1 then 'gross_minor' end, case when a2 then 'refunds_minor' end, case when a3 then 'net_minor' end, case when a4 then 'charge_count' end, case when a5 then 'refund_count' end], lambda x: x is not null) end) as issue from j"""


# 6. Late events ----------------------------------------------------------------------------------
def payment_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of payment events with what the daily figures need of them."""
    j = F.col("j")
    rows = table(spark, sf, "bronze_payments").select(F.try_parse_json("_raw").alias("j"), "_batch_seq", "_arrived_at", F.concat_ws(":", "_landing_file", "_line").alias("_bronze_row"))
    return rows.select(
        F.try_variant_get(j, "$.id", "string").alias("event_id"), F.try_variant_get(j, "$.created", "long").alias("created"), "_batch_seq", "_arrived_at", "_bronze_row",
        F.coalesce(F.try_variant_get(j, "$.data.object.amount", "long"), F.try_variant_get(j, "$.data.object.amount.value", "long")).alias("amount_minor"),
    )


def daily_state(spark: SparkSession, sf: str, folder: str | None = None) -> late.Store:
    """The stored state of the daily figures after all deliveries; ``folder`` keeps it from run to run."""
    built = table(spark, sf, "mart_order_revenue").groupBy("order_date").agg(F.max("_built_through_seq").alias("built_seq"))
    closes = F.to_utc_timestamp(F.date_add("order_date", 1).cast("timestamp"), HALIFAX) + F.expr("interval 72 hours")

    def judge(first: DataFrame) -> DataFrame:
        dated = first.withColumn("order_date", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("created"), HALIFAX)))
        return late.judged(dated, built, "order_date", "_batch_seq", "_arrived_at", closes)

    store = late.Store(spark, folder or f"{storage.run_dir(spark)}/daily-{uuid.uuid4().hex[:12]}")
    return store.absorb(payment_deliveries(spark, sf), "event_id", "_batch_seq", judge, ["_batch_seq", "_arrived_at", "_bronze_row"], ["created", "amount_minor"], "order_date", "amount_minor")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The adjustments that late events made to the stored state."""
    return daily_state(spark, sf).adjustments().select(F.col("period").cast("string").alias("order_date"), F.col("value").alias("event_id"))


def p6_daily_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Exact daily figures of amounts after late events: counts, distincts, extremes and medians from cumulative counts."""
    figures = late.period_figures(daily_state(spark, sf).corrected(), ["period"])
    return figures.withColumn("order_date", F.col("period").cast("string")).drop("period")


_P6_BASE = """
with e as (select json_extract_string(_raw, '$.id') as event_id, try_cast(json_extract_string(_raw, '$.created') as bigint) as created, _batch_seq, _arrived_at, _landing_file || ':' || _line as r,
    coalesce(case when json_type(_raw, '$.data.object.amount') <> 'OBJECT' then trunc(try_cast(json_extract_string(_raw, '$.data.object.amount') as decimal(30, 6)))::bigint end, try_cast(json_extract_string(_raw, '$.data.object.amount.value') as bigint)) as amount_minor
  from bronze_payments where json_valid(_raw)),
f as (select * from e where event_id is not null qualify row_number() over (partition by event_id order by _batch_seq, _arrived_at, r) = 1),
d as (select *, cast(to_timestamp(created) at time zone 'America/Halifax' as date) as order_date from f),
j as (select d.*, b.s from d join (select order_date, max(_built_through_seq) as s from mart_order_revenue group by 1) b using (order_date)),
k as (select *, case when _batch_seq <= s then 'in_base' when _arrived_at < (cast(order_date + 1 as timestamp) at time zone 'America/Halifax') + interval 72 hour then 'late' else 'too_late' end as standing from j)
"""
P6_SQL = _P6_BASE + "select cast(order_date as varchar) as order_date, event_id from k where standing = 'late'"
P6_DAILY_SQL = _P6_BASE + """select cast(order_date as varchar) as order_date, count(amount_minor)::bigint as n, count(distinct amount_minor)::bigint as distinct_values, min(amount_minor) as smallest, max(amount_minor) as largest,
  sum(amount_minor)::bigint as total, (2 * quantile_cont(amount_minor, 0.5))::bigint as median2 from k where standing <> 'too_late' and amount_minor is not null group by 1"""


# 7. Drifting schemas -----------------------------------------------------------------------------
def payload_footers(spark: SparkSession, sf: str) -> DataFrame:
    """Footers as a table: payloads are parsed once, whatever is read from it."""
    rows = table(spark, sf, "bronze_payments").withColumn("bronze_row", F.concat_ws(":", "_landing_file", "_line"))
    producer = F.coalesce(F.get_json_object("_raw", "$.api_version"), F.get_json_object("_raw", "$.apiVersion"), F.lit("unknown"))
    return storage.staged(drift.footers(rows.withColumn("producer", producer), "_raw", ["bronze_row", "producer", "_landing_file"]), "payloads")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(payload_footers(spark, sf), "bronze_row", "producer", "_landing_file").select("bronze_row", "field_name", "change_kind").distinct()


def p7_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    spans = drift.Catalogue(payload_footers(spark, sf), "producer", "_landing_file").lifespans()
    return spans.withColumn("path", F.replace("path", F.lit(drift.DOT), F.lit(".")))


def p7_unified(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "bronze_payments").withColumn("bronze_row", F.concat_ws(":", "_landing_file", "_line"))
    return drift.unified(rows, "_raw", ["bronze_row"])


def _texts(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")"


def _lists(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


_NORM = "regexp_replace(lower({}), '[^0-9a-z]', '', 'g')"
_SHUT = f"(list_contains(k, '[]') or len(list_filter(k[:-2], lambda x: list_contains({_lists(drift.PAYMENTS.closed)}, {_NORM.format('x')}))) > 0)"
_OWN = " ".join(
    f"when not shut and (l = '{f.name}' or n = '{drift._norm(f.name)}') then '{f.name}' when not shut and fresh and n in {_texts(f.aliases)} then '{f.name}'" for f in drift.PAYMENTS.fields
)
_PLACES = " ".join(f"when p = '{'.'.join(f.place)}' then '{f.name}'" for f in drift.PAYMENTS.fields)
#: Every present value of each payload with its path; then what the alias table makes of it and the best holder of each field.
_P7_WALK = r"""
with b as (select _landing_file || ':' || _line as bronze_row, _landing_file as file, _raw, coalesce(json_extract_string(_raw, '$.api_version'), json_extract_string(_raw, '$.apiVersion'), 'unknown') as producer from bronze_payments where json_valid(_raw)),
t as (select bronze_row, producer, file, u.fullkey, replace(regexp_replace(substr(u.fullkey, 3), '\[\d+\]', '.[]', 'g'), '"', '') as p,
  case u.type when 'BIGINT' then 'integer' when 'UBIGINT' then 'integer' when 'DOUBLE' then 'number' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' end as kind from b, json_tree(b._raw) u where u.type <> 'NULL' and u.fullkey <> '$')
"""
_P7 = _P7_WALK + rf""",
s as (select distinct bronze_row, p, kind, fullkey, string_split(p, '.') as k, string_split(p, '.')[-1] as l, {_NORM.format("string_split(p, '.')[-1]")} as n, string_split(p, '.')[-1] not in {_texts(drift.PAYMENTS.known | {'[]'})} as fresh from t),
r as (select *, {_SHUT} as shut from s),
f as (select *, case {_PLACES} {_OWN} end as field, case when p in {_texts('.'.join(f.place) for f in drift.PAYMENTS.fields)} then 0 when {' or '.join(f"l = '{f.name}' or n = '{drift._norm(f.name)}'" for f in drift.PAYMENTS.fields)} then 1 else 2 end as placed from r),
h as (select * from f where field is not null qualify row_number() over (partition by bronze_row, field order by placed, len(k), p) = 1)
"""
P7_FOUND_SQL = _P7 + f"""
, kinds as (select unnest({_lists(f.name for f in drift.PAYMENTS.fields)}) as field),
own as (select distinct bronze_row, p, l from f where fresh and not exists (select 1 from h where h.bronze_row = f.bronze_row and (h.p = f.p or starts_with(h.p, f.p || '.') or starts_with(f.p, h.p || '.'))))
select bronze_row, field as field_name, 'removed' as change_kind from b, kinds where not exists (select 1 from h where h.bronze_row = b.bronze_row and h.field = kinds.field)
union all select bronze_row, field, 'relocated' from h where placed > 0
union all select bronze_row, field, 'retyped' from h where kind <> case field {' '.join(f"when '{f.name}' then '{f.kind}'" for f in drift.PAYMENTS.fields)} end
union all select distinct bronze_row, l, 'added' from own where not exists (select 1 from own o where o.bronze_row = own.bronze_row and starts_with(own.p, o.p || '.'))"""
P7_SPANS_SQL = _P7_WALK + """,
c as (select producer, file, p as path, kind as json_type, count(distinct bronze_row) as n_rows from t group by all),
fs as (select producer, file, row_number() over (partition by producer order by file) as nth, count(*) over (partition by producer) as last_nth from (select distinct producer, file from b)),
g as (select c.*, nth, last_nth, nth - row_number() over (partition by producer, path, json_type order by nth) as island from c join fs using (producer, file)),
a as (select producer, path, json_type, island, min_by(file, nth) as first_file, max_by(file, nth) as last_file, count(*) as n_files, sum(n_rows)::bigint as n_rows, min(nth) > 1 as started, max(nth) < any_value(last_nth) as ended from g group by all)
select producer, path, json_type, row_number() over (partition by producer, path, json_type order by island) as island, first_file, last_file, n_files, n_rows, started, ended from a"""


def _held_text(f: drift.Field) -> str:
    """The text of a field at its holder: itself, the inner key of an object that has one, or an array's first element."""
    inner = _texts(f.inner | {drift._norm(f.name)})
    key = f"(list_filter(list_sort(json_keys(_raw, fullkey)), lambda x: {_NORM.format('x')} in {inner} and json_type(_raw, fullkey || '.\"' || x || '\"') <> 'NULL'))[1]"
    return f"case kind when 'object' then json_extract_string(_raw, fullkey || '.\"' || {key} || '\"') when 'array' then json_extract_string(_raw, fullkey || '[0]') else json_extract_string(_raw, fullkey) end"


_P7_FIELD = "max(case when field = '{0}' then {1} end) as {0}"
P7_UNIFIED_SQL = _P7 + ", v as (select b.bronze_row, " + ", ".join(_P7_FIELD.format(f.name, _held_text(f)) for f in drift.PAYMENTS.fields) + r""" from b left join h using (bronze_row) group by 1)
select bronze_row, order_id, case when regexp_full_match(amount, '-?\d+') then amount else round(try_cast(amount as decimal(30, 6)) * 100)::bigint::varchar end as amount, currency, api_version from v"""

QUERIES = {"p3_found": p3_found, "p3_orders_now": p3_orders_now, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_daily_amounts": p6_daily_amounts, "p7_found": p7_found, "p7_lifespans": p7_lifespans, "p7_unified": p7_unified}
SQL = {"p3_found": P3_FOUND_SQL, "p3_orders_now": P3_NOW_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL, "p6_daily_amounts": P6_DAILY_SQL, "p7_found": P7_FOUND_SQL, "p7_lifespans": P7_SPANS_SQL, "p7_unified": P7_UNIFIED_SQL}

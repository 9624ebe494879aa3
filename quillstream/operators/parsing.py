"""Raw events to typed rows, by version; what can't be used says why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_json(raw: Column) -> Column:
    return F.try_parse_json(raw).isNotNull()


def at(raw: str, path: str) -> Column:
    """Text of a place; JSON null is null, an object or array is its JSON text."""
    return F.get_json_object(F.col(raw), path)


def held(parsed: str, path: str) -> Column:
    """Text of a place of a parsed payload; JSON null is null, an object or array is its JSON text."""
    return F.try_variant_get(F.col(parsed), path, "string")


def whole(text: Column) -> Column:
    """A whole number from text, rounding fractions half up; null where it is none."""
    return F.round(text.try_cast("decimal(38,6)"), 0).try_cast("bigint")


#: Where each payment API version holds a field; a new version is one more entry and a replay.
PAYMENT_PARSERS: dict[str, dict[str, Callable[[str], Column]]] = {
    "2025-11-01": {
        "charge_id": lambda j: held(j, "$.data.object.id"),
        "refund_id": lambda j: held(j, "$.data.object.refund.id"),
        "order_id": lambda j: held(j, "$.data.object.order_id"),
        "amount": lambda j: F.coalesce(held(j, "$.data.object.refund.amount"), held(j, "$.data.object.amount")),
        "currency": lambda j: held(j, "$.data.object.currency"),
    },
    "2026-08-01": {
        "charge_id": lambda j: F.coalesce(held(j, "$.data.object.charge"), held(j, "$.data.object.id")),
        "refund_id": lambda j: F.when(held(j, "$.data.object.object") == "refund", held(j, "$.data.object.id")),
        "order_id": lambda j: held(j, "$.data.object.metadata.order_id"),
        "amount": lambda j: held(j, "$.data.object.amount.value"),
        "currency": lambda j: held(j, "$.data.object.amount.currency"),
    },
}


def by_version(field: str, raw: str, enabled: list[str]) -> Column:
    """The field's expression of the row's version, of enabled versions only."""
    out = F.lit(None).cast("string")
    for version in enabled:
        if version in PAYMENT_PARSERS:
            out = F.when(F.col("api_version") == version, PAYMENT_PARSERS[version][field](raw)).otherwise(out)
    return out


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The first rule that holds; a rule whose test is unknown doesn't."""
    out = None
    for reason, test in rules:
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out


def payment_events(bronze: DataFrame, raw: str = "_raw", enabled: list[str] | None = None) -> DataFrame:
    """Bronze payment lines, parsed, with ``quarantine_reason``; all other columns stay.

    Tests follow SQL's three values: an absent version isn't an unsupported one, an absent currency passes.
    """
    enabled = list(PAYMENT_PARSERS) if enabled is None else enabled
    rows = bronze.withColumn("__j", F.try_parse_json(F.col(raw)))  # parsed once, whatever is read from it
    rows = rows.withColumns({"event_id": held("__j", "$.id"), "__type": held("__j", "$.type"), "api_version": held("__j", "$.api_version"), "created_at": F.timestamp_seconds(held("__j", "$.created").try_cast("bigint"))})
    rows = rows.withColumns({f: by_version(f, "__j", enabled) for f in ("charge_id", "refund_id", "order_id", "amount", "currency")})
    rows = rows.withColumn("amount_minor", whole(F.col("amount"))).withColumn("currency", F.lower("currency"))
    types = ["charge.succeeded", "charge.refunded"]
    reason = first_reason(
        ("unparseable_json", F.col("__j").isNull()),
        ("unsupported_api_version", ~F.col("api_version").isin(*enabled)),
        ("unknown_event_type", ~F.col("__type").isin(*types)),
        ("missing_envelope", F.col("event_id").isNull() | F.col("created_at").isNull()),
        ("missing_order_id", F.col("order_id").isNull()),
        ("bad_amount", F.col("amount_minor").isNull() | (F.col("amount_minor") <= 0)),
        ("unknown_currency", ~F.col("currency").isin("cad", "usd")),
        ("missing_refund_id", (F.col("__type") == types[1]) & F.col("refund_id").isNull()),
    )
    event_type = F.when(F.col("__type") == types[0], "capture").when(F.col("__type") == types[1], "refund")
    return rows.withColumns({"event_type": event_type, "quarantine_reason": reason}).drop("__j", "__type", "amount")


def order_changes(bronze: DataFrame, raw: str = "_raw") -> DataFrame:
    """Bronze change events, parsed once: a delete's row image is its ``before``, any other's its ``after``."""
    rows = bronze.withColumn("__j", F.try_parse_json(F.col(raw)))
    rows = rows.withColumns({"op": held("__j", "$.op"), "lsn": whole(held("__j", "$.source.lsn"))})
    image = lambda f: F.when(F.col("op") == "d", held("__j", f"$.before.{f}")).otherwise(held("__j", f"$.after.{f}"))
    fields = {f: image(f) for f in ("order_id", "customer_id", "status", "ship_region")}
    fields |= {"currency": F.lower(image("currency")), "total_minor": whole(image("total_minor"))}
    fields |= {f: image(f).try_cast("timestamp") for f in ("created_at", "updated_at")}
    rows = rows.withColumns(fields)
    return rows.withColumn("quarantine_reason", order_reason(F.col("__j").isNull())).drop("__j")


def order_reason(unparseable: Column) -> Column:
    return first_reason(("unparseable_json", unparseable), ("unknown_op", ~F.col("op").isin("c", "u", "d", "r")), ("missing_lsn", F.col("lsn").isNull()), ("missing_order_id", F.col("order_id").isNull()))


def fx_rates(bronze: DataFrame, raw: str = "_raw") -> DataFrame:
    """Rates with a date and a value above zero; the latest arrival of a day and pair counts."""
    from .merge import keep_first

    rows = bronze.select(at(raw, "$.rate_date").try_cast("date").alias("rate_date"), at(raw, "$.base").alias("base"), at(raw, "$.quote").alias("quote"), at(raw, "$.rate").try_cast("decimal(12,6)").alias("rate"), "_landing_file", "_arrived_at", "_batch_seq")
    return keep_first(rows.where("rate_date is not null and rate > 0"), ["rate_date", "base", "quote"], [F.desc("_arrived_at"), F.desc("_batch_seq")])


def settlements(bronze: DataFrame, raw: str = "_raw") -> DataFrame:
    """Settlement totals; the latest arrival of a day and currency counts."""
    from .merge import keep_first

    numbers = {c: whole(at(raw, f"$.{c}")).cast(t) for c, t in {"gross_minor": "bigint", "refunds_minor": "bigint", "net_minor": "bigint", "charge_count": "int", "refund_count": "int"}.items()}
    rows = bronze.select(at(raw, "$.settlement_date").try_cast("date").alias("settlement_date"), F.lower(at(raw, "$.currency")).alias("currency"), *[v.alias(k) for k, v in numbers.items()], "_landing_file", "_arrived_at", "_batch_seq")
    return keep_first(rows, ["settlement_date", "currency"], [F.desc("_arrived_at"), F.desc("_batch_seq")])


def cad_cents(amount_minor: Column, rate: Column) -> Column:
    """Minor units times a six-place rate, in whole cents, halves away from zero: exact arithmetic, never a float."""
    n = amount_minor * F.round(rate * F.lit(1_000_000), 0).cast("bigint")
    doubled = F.abs(n) * 2 + 1_000_000
    whole_part = ((doubled - F.pmod(doubled, F.lit(2_000_000))).cast("decimal(20,0)") / F.lit(2_000_000).cast("decimal(7,0)")).cast("bigint")
    return F.when(n < 0, -whole_part).otherwise(whole_part)


def cents_as_decimal(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")


def boundary_hours(a: Column, b: Column) -> Column:
    """Hour boundaries crossed from a to b, which isn't the number of whole hours between them."""
    return ((F.unix_timestamp(F.date_trunc("hour", b)) - F.unix_timestamp(F.date_trunc("hour", a))) / 3600).cast("bigint")


def waiting_bucket(since: Column, now: Column) -> Column:
    """How long something has waited, by hour boundaries crossed."""
    hours = boundary_hours(since, now)
    return F.when(hours < 24, "1. under 24h").when(hours < 48, "2. 24-48h").when(hours < 72, "3. 48-72h").otherwise("4. over 72h")

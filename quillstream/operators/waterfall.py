"""A naive monthly total of raw payment lines, corrected one mistake at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import asof, merge, parsing


def raw_events(lines: DataFrame, raw: str, file: str, line: str, month: str) -> DataFrame:
    """Events of a month as the raw lines tell them, each marked whether its file was re-sent and whether it is the first of its id. Lines that aren't valid JSON are left out."""
    j = lambda p: parsing.held("__j", p)
    rows = lines.withColumn("__j", F.try_parse_json(F.col(raw))).where("__j is not null")
    amount = parsing.whole(j("$.data.object.amount"))
    rows = rows.select(
        F.col(file).like("%-resend.jsonl").alias("resend"),
        j("$.id").alias("id"),
        j("$.type").alias("type"),
        F.timestamp_seconds(parsing.whole(j("$.created"))).alias("at"),
        amount.alias("naive"),
        F.coalesce(parsing.whole(j("$.data.object.refund.amount")), parsing.whole(j("$.data.object.amount.value")), amount).alias("amount"),
        F.lower(F.coalesce(j("$.data.object.currency"), j("$.data.object.amount.currency"))).alias("currency"),
        F.col(file).alias("__file"),
        F.col(line).alias("__line"),
    )
    rows = merge.flag_first(rows, ["id"], [F.asc("__file"), F.asc("__line")], "first_delivery")
    return rows.where(F.date_format("at", "yyyy-MM") == month).withColumn("day", F.to_date("at")).drop("__file", "__line")


def waterfall(events: DataFrame, rates: DataFrame) -> DataFrame:
    """(step, label, total_cents, delta_cents): six totals in one pass, and what each step changed.

    ``rates`` has (currency, fx_rate_date, fx_rate) of US dollars; the latest at or before an event's day counts.
    """
    rows = asof.asof_left(events, rates, on=("day", "fx_rate_date"), by=["currency"], carry=["fx_rate"])
    capture, refund = F.col("type") == "charge.succeeded", F.col("type") == "charge.refunded"
    once = ~F.col("resend")
    first = once & F.col("first_delivery")
    signed = F.when(capture, F.col("amount")).otherwise(-F.col("amount"))
    one = F.lit(1).cast("decimal(12,6)")
    rate = F.when(F.col("currency") == "usd", F.col("fx_rate")).otherwise(one)
    naive, paid = parsing.cad_cents(F.col("naive"), one), parsing.cad_cents(F.col("amount"), one)
    steps = [
        ("naive", capture, naive),
        ("re-sent files", capture & once, naive),
        ("repeated deliveries", capture & first, naive),
        ("second version's amounts", capture & first, paid),
        ("refunds", (capture | refund) & first, parsing.cad_cents(signed, one)),
        ("conversion", (capture | refund) & first, parsing.cad_cents(signed, rate)),
    ]
    total = lambda test, cents: F.coalesce(F.sum(F.when(test, cents)), F.lit(0)).cast("bigint")
    totals = rows.agg(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("label"), total(t, c).alias("total_cents")) for i, (n, t, c) in enumerate(steps)]).alias("s"))
    change = lambda x, i: F.when(i > 0, x["total_cents"] - F.get(F.col("s"), i - 1)["total_cents"])
    return totals.select(F.inline(F.transform("s", lambda x, i: F.struct(x["step"].alias("step"), x["label"].alias("label"), x["total_cents"].alias("total_cents"), change(x, i).alias("delta_cents")))))

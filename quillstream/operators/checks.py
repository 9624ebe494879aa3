"""Row checks and batch audits: each gives one row of (name, status, failing or detail)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A named rule; ``failing`` counts the rows that break it. Warnings don't block."""

    name: str
    failing: DataFrame  # one row, one column: n
    severity: str = "error"


def _count(name: str, df: DataFrame, severity: str = "error") -> Check:
    return Check(name, df.agg(F.count("*").alias("n")), severity)


def not_null(table: str, df: DataFrame, column: str) -> Check:
    return _count(f"{table}.{column} not_null", df.where(F.col(column).isNull()))


def unique(table: str, df: DataFrame, *columns: str) -> Check:
    """Keys that occur more than once; null keys don't count."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return _count(f"{table}.{'+'.join(columns)} unique", df.where(known).groupBy(*columns).agg(F.count("*").alias("k")).where("k > 1"))


def accepted(table: str, df: DataFrame, column: str, values: list[str]) -> Check:
    return _count(f"{table}.{column} accepted", df.where(~F.col(column).isin(values)))


def positive(table: str, df: DataFrame, column: str) -> Check:
    return _count(f"{table}.{column} positive", df.where(F.col(column) <= 0))


def refers(table: str, df: DataFrame, column: str, to: DataFrame, to_column: str, severity: str = "warn") -> Check:
    return _count(f"{table}.{column} refers", df.where(F.col(column).isNotNull()).join(to.select(F.col(to_column).alias(column)), column, "left_anti"), severity)


def outcome(checks: list[Check]) -> DataFrame:
    """(name, severity, failing, status) of each check, in one plan."""
    rows = [c.failing.select(F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"), F.col("n").alias("failing")) for c in checks]
    status = F.when(F.col("failing") == 0, "PASS").when(F.col("severity") == "warn", "WARN").otherwise("BLOCK")
    return reduce(DataFrame.unionByName, rows).withColumn("status", status)


# Audits ---------------------------------------------------------------------------------------
#: Rates and ages of the audits (fixed values).
QUARANTINE_BLOCK, QUARANTINE_WARN, QUARANTINE_ROWS, RATE_DAYS, SETTLING_HOURS = 0.02, 0.005, 10, 4, 48


def quarantine_rates(staged: dict[str, DataFrame], since_seq: int = 0) -> DataFrame:
    """(source, arrived, held, top_reason, status): of the rows since a batch, how many couldn't be used, and mostly why. Ties of reasons go to the first by name."""
    rows = reduce(DataFrame.unionByName, [df.where(F.col("_batch_seq") > since_seq).select(F.lit(s).alias("source"), "quarantine_reason") for s, df in staged.items()])
    counted = rows.groupBy("source", "quarantine_reason").agg(F.count("*").alias("n"))
    held = F.col("quarantine_reason").isNotNull()
    top = F.max_by(F.col("quarantine_reason"), F.when(held, F.struct(F.col("n"), F.transform(F.split("quarantine_reason", ""), lambda c: -F.ascii(c)))))
    out = counted.groupBy("source").agg(F.sum("n").alias("arrived"), F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("held"), top.alias("top_reason"))
    rate = F.col("held") / F.col("arrived")
    return out.withColumn("status", F.when((rate > QUARANTINE_BLOCK) & (F.col("held") >= QUARANTINE_ROWS), "BLOCK").when(rate > QUARANTINE_WARN, "WARN").otherwise("PASS"))


def conservation(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Every silver event reaches gold once and the signed sums agree."""
    signed = F.when(F.col("event_type") == "capture", F.col("amount_minor")).otherwise(-F.col("amount_minor"))
    of = lambda df, net, a, b: df.agg(F.count("*").alias(a), F.sum(net).alias(b))
    g = of(gold, F.col("amount_minor"), "gold_rows", "gold_net")
    s = of(silver, signed, "silver_rows", "silver_net").withColumns({c: g.select(c).scalar() for c in ("gold_rows", "gold_net")})
    return s.withColumn("status", F.when(F.col("silver_rows").eqNullSafe(F.col("gold_rows")) & F.col("silver_net").eqNullSafe(F.col("gold_net")), "PASS").otherwise("BLOCK"))


def rate_coverage(gold: DataFrame) -> DataFrame:
    """Rows without a rate block; a used rate older than RATE_DAYS warns."""
    out = gold.agg(F.sum(F.col("fx_rate").isNull().cast("bigint")).alias("missing"), F.coalesce(F.max(F.when(F.col("currency") != "cad", F.datediff("processor_date", "fx_rate_date"))), F.lit(0)).cast("bigint").alias("oldest_days"))
    return out.withColumn("status", F.when(F.col("missing") > 0, "BLOCK").when(F.col("oldest_days") > RATE_DAYS, "WARN").otherwise("PASS"))


def reconciliation(settled: DataFrame, cash: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Settlement lines against daily cash, line by line: 'match', 'settling' while younger than SETTLING_HOURS after the day, else 'broken'."""
    now = F.lit(as_of) if isinstance(as_of, datetime) else as_of
    c = cash.select(F.col("processor_date").alias("settlement_date"), "currency", "captured_minor", "refunded_minor", F.col("net_minor").alias("cash_net"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    joined = settled.join(c, ["settlement_date", "currency"], "left")
    same = F.col("gross_minor").eqNullSafe(zero("captured_minor")) & F.col("refunds_minor").eqNullSafe(zero("refunded_minor")) & F.col("net_minor").eqNullSafe(zero("cash_net"))
    closed = F.date_add("settlement_date", 1).cast("timestamp")
    young = F.unix_timestamp(now) - F.unix_timestamp(closed) < SETTLING_HOURS * 3600
    state = F.when(same, "match").when(young, "settling").otherwise("broken")
    return joined.select("settlement_date", "currency", (zero("cash_net") - F.col("net_minor")).alias("off_minor"), state.alias("state"))


def over_refunded(fact: DataFrame) -> DataFrame:
    """(charge_id, captured, refunded) of charges whose refunds exceed what was captured; amounts are signed. A refund without a charge isn't judged."""
    total = lambda kind, sign: F.coalesce(F.sum(F.when(F.col("event_type") == kind, sign * F.col("amount_minor"))), F.lit(0)).cast("bigint")
    sums = fact.where("charge_id is not null").groupBy("charge_id").agg(total("capture", 1).alias("captured"), total("refund", -1).alias("refunded"), F.count_if(F.col("event_type") == "capture").alias("taken"))
    return sums.where("taken > 0 and refunded > captured").drop("taken")

"""Secrets in texts and diffs: found, located by file and line, and redacted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of secrets and their patterns, in the order in which they are redacted (fixed values).
SECRETS = {
    "AWS access key ID": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "GitHub token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "Slack token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    "Private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "Hardcoded credential": r"""(?i)\b\w*(?:password|passwd|secret|token|api_?key)\w*\s*[:=]\s*['"]([^'"\s]{8,})['"]""",
}


def kinds(text: Column) -> Column:
    """The kinds of secrets in a text, each once."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SECRETS.items()]), lambda x: x.isNotNull())


def redact(text: Column) -> Column:
    for kind, pattern in SECRETS.items():
        text = F.regexp_replace(text, pattern, f"[REDACTED {kind}]")
    return text


def counts(text: Column) -> dict[str, Column]:
    return {k: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p in SECRETS.items()}


def diff_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line, path, line_no, added): every line of a unified diff with its file and, for added lines, its number there.

    File headers count only outside hunks, so that an added line that looks like one is still read.  The lines of one
    diff are ordered in one task; diffs of any number are spread by their key.
    """
    lines = diffs.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("n", "line"))
    order = W.partitionBy(key).orderBy("n")
    hunk = F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", 0) != ""
    part = lambda g: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", g)
    size = lambda g: F.when(part(g) == "", 1).otherwise(part(g).cast("int"))
    marked = lines.withColumn("hunk", hunk).withColumn("old", F.when(hunk, size(2))).withColumn("new", F.when(hunk, size(4))).withColumn("start", F.when(hunk, part(3).cast("int")))
    marked = marked.withColumn("h", F.sum(F.col("hunk").cast("int")).over(order))
    inside = W.partitionBy(key, "h").orderBy("n")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    first = F.substring("line", 1, 1)
    of_old, of_new = first.isin("-", " ").cast("int"), first.isin("+", " ").cast("int")
    body = (~F.col("hunk")) & (F.col("h") > 0)
    marked = marked.withColumns({"seen_old": F.coalesce(F.sum(F.when(body, of_old).otherwise(0)).over(before), F.lit(0)), "seen_new": F.coalesce(F.sum(F.when(body, of_new).otherwise(0)).over(before), F.lit(0)), "old": F.first("old", True).over(inside), "new": F.first("new", True).over(inside), "start": F.first("start", True).over(inside)})
    open_hunk = body & ((F.col("seen_old") < F.col("old")) | (F.col("seen_new") < F.col("new")))
    header = ~open_hunk & F.col("line").startswith("+++ ")
    path = F.when(header, F.regexp_replace("line", r"^\+\+\+ (?:b/)?", ""))
    added = first.eqNullSafe(F.lit("+")) & ~header & (F.col("h") > 0)
    return marked.withColumn("path", F.coalesce(F.last(path, True).over(order), F.lit("?"))).select(key, "n", "line", "path", F.when(added, F.col("start") + F.col("seen_new")).alias("line_no"), added.alias("added"))


def scan_diffs(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, line_no, kind): one row per secret kind and added line."""
    lines = diff_lines(diffs, key, text).where("added")
    return lines.select(key, "path", "line_no", F.explode(kinds(F.col("line"))).alias("kind"))


def redacted_diffs(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """Diffs whose added lines are redacted; other lines stay."""
    lines = diff_lines(diffs, key, text).withColumn("line", F.when(F.col("added"), redact(F.col("line"))).otherwise(F.col("line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))

"""Answers from sources and reviews of changes with a model that the caller brings.

A model is anything with ``chat(messages) -> str``; an embedder anything with ``embed(texts) -> vectors``.  Retrieval, gates,
provenance and validation are plans; only the model itself is called from Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan, search


class Chat(Protocol):
    def chat(self, messages: list[dict[str, str]]) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embedded(df: DataFrame, key: str, text: str, make: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """(key, vector) by an embedder that each task makes for itself; vectors are brought to unit length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            vectors: list[list[float]] = []
            for at in range(0, len(pdf), batch):
                vectors += model.embed(list(pdf["text"][at : at + batch]))
            yield pd.DataFrame({"key": pdf["key"], "vector": vectors})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, vector array<double>")
    return rows.select(F.col("key").alias(key), search.unit(F.col("vector")).alias("vector"))


RULES = "Answer only from the numbered sources. Cite the source of every sentence like [S1]. If they don't hold the answer, reply NOT_IN_SOURCES."


def answers(hits: DataFrame, questions: DataFrame, model: Chat, threshold: float = 3.0) -> DataFrame:
    """(query_id, outcome, answer): the model is asked only where retrieval is strong; an answer that fails provenance is withheld.

    ``hits`` has (query_id, rank, score, card, text) of the best few chunks; ``questions`` (query_id, text).
    """
    cards = F.transform(F.sort_array(F.collect_list(F.struct("rank", "card", "text"))), lambda x: x)
    grouped = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), cards.alias("cards"))
    asked = questions.select("query_id", F.col("text").alias("question")).join(grouped, "query_id", "left")
    asked = asked.withColumn("prompt", F.when(F.col("best") >= threshold, search.prompt(F.col("question"), F.transform("cards", lambda c: c["card"]))))

    def ask(pdf: pd.DataFrame) -> list[str | None]:
        return [None if p is None else model.chat([{"role": "system", "content": RULES}, {"role": "user", "content": p}]) for p in pdf["prompt"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(draft=ask(pdf))[["query_id", "draft"]]

    drafts = asked.select("query_id", "prompt").mapInPandas(run, "query_id long, draft string")
    full = asked.join(drafts, "query_id")
    problems = search.provenance_problems(F.coalesce("draft", F.lit("")), F.transform("cards", lambda c: c["text"]))
    outcome = search.answer_outcome(F.col("best"), F.coalesce("draft", F.lit("")), problems, threshold)
    return full.select("query_id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("draft")).alias("answer"))


# Reviews --------------------------------------------------------------------------------------
FINDINGS = "findings array<struct<severity string, path string, line int, title string, evidence string>>"


def findings(reports: DataFrame, key: str, report: Column) -> DataFrame:
    """(key, valid, findings) of JSON reports: a report is valid if it parses and every finding has a known severity, a path, a title and evidence."""
    parsed = F.from_json(report, FINDINGS, {"mode": "PERMISSIVE"})["findings"]
    good = F.forall(parsed, lambda f: f["severity"].isin("block", "warn") & f["path"].isNotNull() & f["title"].isNotNull() & f["evidence"].isNotNull())
    return reports.select(key, F.coalesce(parsed.isNotNull() & good, F.lit(False)).alias("valid"), parsed.alias("findings"))


@dataclass(frozen=True)
class Limits:
    """Rounds of tool calls, characters of context, lines of a read, matches of a search, characters of one result, of a diff."""

    rounds: int = 6
    context_chars: int = 73_728
    lines: int = 200
    matches: int = 40
    result_chars: int = 8_000
    diff_chars: int = 40_000


class Tools:
    """What a model may look at: a table (path, line_no, line) of one commit. Mistakes come back as text, secrets redacted."""

    def __init__(self, repo: DataFrame, limits: Limits = Limits()) -> None:
        self.repo, self.limits = repo, limits

    def call(self, name: str, arguments: dict[str, Any]) -> str:
        from ..sources import corpus

        try:
            if name == "read_file":
                rows = corpus.read_lines(self.repo, str(arguments["path"]), int(arguments.get("start_line") or 1), arguments.get("end_line"), self.limits.lines)
                shown = [f"{r['line_no']}: {r['line']}" for r in rows.select("line_no", scan.redact(F.col("line")).alias("line")).orderBy("line_no").collect()]
            elif name == "search_repo":
                if not str(arguments["text"]).strip():
                    return "Error: nothing to search for."
                rows = corpus.find_text(self.repo, str(arguments["text"]), self.limits.matches)
                shown = [f"{r['path']}:{r['line_no']}: {r['line']}" for r in rows.select("path", "line_no", scan.redact(F.col("line")).alias("line")).orderBy("path", "line_no").collect()]
            else:
                return f"Error: there is no tool {name!r}."
        except (KeyError, TypeError, ValueError) as error:
            return f"Error: bad arguments for {name}: {error}"
        out = "\n".join(shown) or "Nothing found."
        return out if len(out) <= self.limits.result_chars else out[: self.limits.result_chars] + "\n[cut]"


def review(spark, diff: str, tools: Tools, step: Callable[[list[dict]], dict], limits: Limits = Limits()) -> list[dict]:
    """Findings of a model about one diff.

    ``step`` takes the messages and gives ``{"content": ..., "calls": [(name, arguments)]}``.  After the rounds, or when the
    context is nearly full, it is asked for its report; a report that isn't valid may be repaired once.
    """
    hits = scan.scan_diffs(spark.createDataFrame([(1, diff)], "id long, text string"), "id", "text")
    if hits.limit(1).count():
        raise PermissionError("the change holds secrets")  # fails closed, before any model sees it
    if len(diff) > limits.diff_chars:
        raise ValueError("the change is too long for a review")
    messages: list[dict] = [{"role": "user", "content": f"Review this change:\n\n{diff}"}]
    for _ in range(limits.rounds):
        turn = step(messages)
        messages.append({"role": "assistant", "content": turn.get("content") or ""})
        if not turn.get("calls"):
            break
        messages += [{"role": "tool", "content": tools.call(name, arguments)} for name, arguments in turn["calls"]]
        if sum(len(m["content"]) for m in messages) > limits.context_chars:
            break
    messages.append({"role": "user", "content": "Report the problems that you verified, as JSON."})
    for _ in range(2):
        report = step(messages).get("content") or ""
        row = findings(spark.createDataFrame([(1, report)], "id long, report string"), "id", F.col("report")).first()
        if row["valid"]:
            return [f.asDict() for f in row["findings"]]
        messages += [{"role": "assistant", "content": report}, {"role": "user", "content": "That report isn't valid. Return corrected JSON only."}]
    raise RuntimeError("no valid report")


def guarded(spark, diffs: DataFrame, tools_of: Callable[[str], Tools], step: Callable[[list[dict]], dict] | None, limits: Limits = Limits()) -> list[dict]:
    """A verdict on each diff (diff_id, base, head, text): ``blocked``, ``secrets`` as (path, line, kind), ``findings`` and a ``note``.

    The scan for secrets fails closed: a hit blocks, whatever follows.  The model sees the redacted diff and fails open: where
    it can't be reached, gives no valid report or the diff is too long for it, a note says so and nothing is blocked by it.
    """
    hits = scan.scan_diffs(diffs, "diff_id", "text").collect()  # few: one for each secret of a push
    clean = {r["diff_id"]: r["text"] for r in scan.redacted_diffs(diffs, "diff_id", "text").collect()}
    out = []
    for row in diffs.select("diff_id", "base", "head").orderBy("diff_id").collect():
        secrets = sorted((h["path"], h["line_no"], h["kind"]) for h in hits if h["diff_id"] == row["diff_id"])
        found, note = [], None if step else "no model"
        if step:
            try:
                found = review(spark, clean[row["diff_id"]], tools_of(row["head"]), step, limits)
            except (OSError, RuntimeError, TimeoutError, ValueError) as error:
                note = f"not reviewed: {error}"
        out.append({"base": row["base"], "head": row["head"], "secrets": secrets, "findings": found, "note": note, "blocked": bool(secrets) or any(f["severity"] == "block" for f in found)})
    return out


@dataclass(frozen=True)
class Command:
    """A model that is a program: it gets the messages as JSON on its input and its output is the reply."""

    arguments: tuple[str, ...]
    seconds: float = 120.0

    def chat(self, messages: list[dict[str, str]]) -> str:
        import subprocess

        return subprocess.run(self.arguments, input=json.dumps(messages), capture_output=True, text=True, timeout=self.seconds, check=True).stdout.strip()


def to_json(found: list[dict]) -> str:
    return json.dumps({"findings": found})


def token_estimate(text: Column) -> Column:
    """A model's tokens, at three characters each."""
    return F.floor(F.length(text) / 3).cast("bigint")


def review_scores(runs: DataFrame) -> DataFrame:
    """(caught, missed, false_blocks, clean_runs, median_s, p95_s) of runs (expected boolean, blocked boolean, seconds double); the 95th percentile by the exclusive method."""
    n = lambda test: F.coalesce(F.sum(test.cast("bigint")), F.lit(0))
    e, b = F.col("expected"), F.col("blocked")
    out = runs.agg(n(e & b).alias("caught"), n(e & ~b).alias("missed"), n(~e & b).alias("false_blocks"), n(~e).alias("clean_runs"), F.median("seconds").alias("median_s"))
    return out.withColumn("p95_s", search.exclusive_quantile(runs, "seconds", 0.95).select("value").scalar())

"""Commands over a lake: season, ingest, build, grade, run, naive, compare, query, status; over a text lake: reading-list, index,
publish, search; over an archive: archive, ask, eval; over a repository: check, pre-push.

A model is a program that gets messages as JSON on its input (``--model``); without one, ``ask`` shows what it would be asked."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .pipeline import Config, Pipeline, build_index, publish_index, search_index, when
from .session import local_session
from .sources.corpus import reading_list


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillstream")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "build", "grade", "run"):
        p = sub.add_parser(name)
        p.add_argument("--lake", required=True)
        p.add_argument("--through", required=True)
        p.add_argument("--replay", action="store_true")
    p = sub.add_parser("season")
    p.add_argument("lake")
    p.add_argument("--seed", type=int, default=22)
    p.add_argument("--days", type=int, default=3)
    p.add_argument("--force", action="store_true")
    for name in ("naive", "compare"):
        p = sub.add_parser(name)
        p.add_argument("--lake", required=True)
        p.add_argument("--through", required=True)
        p.add_argument("--month", required=True)
    p = sub.add_parser("archive")
    p.add_argument("folder")
    p.add_argument("--seed", type=int, default=22)
    p.add_argument("--force", action="store_true")
    p = sub.add_parser("ask")
    p.add_argument("folder")
    p.add_argument("question")
    p.add_argument("--chapel")
    p.add_argument("--shared", default="studio")
    p.add_argument("--threshold", type=float, default=3.0)
    p.add_argument("--model", nargs="+")
    p = sub.add_parser("eval")
    p.add_argument("folder")
    p.add_argument("questions", help="lines of question, tab, record id; no id: can't be answered")
    p.add_argument("--chapel")
    p.add_argument("--shared", default="studio")
    for name in ("check", "pre-push"):
        p = sub.add_parser(name)
        p.add_argument("folder")
        if name == "check":
            p.add_argument("range", nargs="?", default="")
        p.add_argument("--trunk", default=os.environ.get("QUILLSTREAM_TRUNK", "main"))
        p.add_argument("--model", nargs="+")
    p = sub.add_parser("query")
    p.add_argument("--lake", required=True)
    p.add_argument("sql")
    p.add_argument("--rows", type=int, default=40)
    p = sub.add_parser("status")
    p.add_argument("--lake", required=True)
    p = sub.add_parser("reading-list")
    p.add_argument("folder")
    p.add_argument("lake")
    p.add_argument("--assume-utf8", action="store_true")
    p = sub.add_parser("index")
    p.add_argument("lake")
    p.add_argument("build")
    p.add_argument("--shards", type=int, default=4)
    p.add_argument("--by-letter", action="store_true")
    p = sub.add_parser("publish")
    p.add_argument("lake")
    p.add_argument("build")
    p.add_argument("canaries")
    p = sub.add_parser("search")
    p.add_argument("lake")
    p.add_argument("words")
    p.add_argument("--local-idf", action="store_true")
    a = parser.parse_args(argv)
    if a.command == "season":
        from .sources.season import season

        try:
            season(Path(a.lake), a.seed, a.days, a.force)
        except FileExistsError:
            print("there is a season already", file=sys.stderr)
            return 1
        return 0
    if a.command == "archive":
        from .sources.records import write_archive

        try:
            for question, record in write_archive(Path(a.folder), seed=a.seed, force=a.force):
                print(question, record, sep="\t")
        except FileExistsError:
            print("there is an archive already", file=sys.stderr)
            return 1
        return 0
    spark = local_session()
    if a.command == "reading-list":
        print(reading_list(spark, a.folder, a.lake, a.assume_utf8), "passages")
        return 0
    if a.command == "index":
        build_index(spark, a.lake, a.build, a.shards, a.by_letter)
        return 0
    if a.command == "publish":
        return 0 if publish_index(spark, a.lake, a.build, a.canaries) else 1
    if a.command == "search":
        search_index(spark, a.lake, spark.createDataFrame([(1, a.words)], "query_id long, text string"), local_idf=a.local_idf).orderBy("rank").show(truncate=110)
        return 0
    if a.command in ("ask", "eval"):
        return _ask(spark, a) if a.command == "ask" else _eval(spark, a)
    if a.command in ("check", "pre-push"):
        return _check(spark, a)
    pipe = Pipeline(spark, Config(lake=a.lake))
    if a.command == "status":
        pipe.history().orderBy("published_at", ascending=False).show(6, truncate=False)
        return 0
    if a.command == "query":
        from .pipeline import GOLD

        for name in GOLD:
            pipe.published(name).createOrReplaceTempView(name)
        spark.sql(a.sql).show(a.rows, truncate=False)
        return 0
    through = when(a.through)
    if a.command == "naive":
        pipe.naive_month(through, a.month).show()
        pipe.naive_waiting(through).show()
        return 0
    if a.command == "compare":
        got = pipe.compare(through, a.month)
        for r in got["steps"].orderBy("step").collect():
            print(f"{r['label']:28} {(r['delta_cents'] or 0) / 100:>+16,.2f} {r['total_cents'] / 100:>16,.2f}")
        print(f"{'published':28} {'':16} {got['published_cents'] / 100:>16,.2f} {'the same' if got['matches'] else 'NOT the same'}")
        for name in ("waiting", "over_72h"):
            print(f"{name:28} naive {got[name][0]:>9,} published {got[name][1]:>9,}")
        return 0 if got["matches"] else 1
    if a.command == "ingest":
        for b in pipe.lake.ingest(through):
            print(b)
        return 0
    if a.command == "run":
        ok = pipe.run(through, a.replay)
        print(*pipe.results, sep="\n")
        return 0 if ok else 1
    pipe.build(through, a.replay)
    if a.command == "grade":
        results = pipe.grade(through)
        print(*results, sep="\n")
        return 0 if pipe.publish(through, results) else 1
    pipe.checks().show(50, truncate=False)
    return 0


def _records(spark, a):
    from .functions import catalogue
    from .sources.corpus import archive

    return catalogue, archive(spark, a.folder)


def _ask(spark, a) -> int:
    """Answer a question from an archive, or show what a model would be asked."""
    from .functions import answers, search, text

    catalogue, records = _records(spark, a)
    cards = catalogue.cards_of(records)
    asked = spark.createDataFrame([(1, a.question)], "query_id long, text string")
    found = catalogue.Catalogue(cards).look_up(asked.withColumn("text", text.expanded(F.col("text"))), 3, a.chapel, a.shared)
    hits = found.join(cards.select("chunk_id", "card", "text"), "chunk_id").orderBy("rank")
    if not a.model:
        rows = hits.collect()
        for r in rows:
            print(f"#{r['rank']}  {r['score']:6.2f}  {r['chunk_id']}")
        print("gate:", "open" if rows and rows[0]["score"] >= a.threshold else "closed", f"(threshold {a.threshold})")
        print(spark.createDataFrame([(a.question, [r["card"] for r in rows])], "q string, c array<string>").select(search.prompt(F.col("q"), F.col("c"))).first()[0])
        return 0
    row = answers.answers(hits, asked, answers.Command(tuple(a.model)), a.threshold).first()
    print(row["answer"] or "No answer.", f"[{row['outcome']}]", sep="\n")
    return 0 if row["outcome"] == "ok" else 1


def _eval(spark, a) -> int:
    """Recall, reciprocal rank and traps of four ways to look things up, and what thresholds would answer and refuse."""
    from .functions import search, text

    catalogue, records = _records(spark, a)
    rows = [(i, *(line.rstrip("\n").split("\t") + [""])[:2]) for i, line in enumerate(Path(a.questions).read_text().splitlines()) if line.strip()]
    questions = spark.createDataFrame(rows, "query_id long, text string, id string")
    good, bad = questions.where("id <> ''"), questions.where("id = ''")
    pieces, sections = (catalogue.Catalogue(catalogue.cards_of(records, size).select("chunk_id", "ordinal", "chapel", "current", "card")) for size in (300, None))
    for name, cat, filtered, widened in (("pieces", pieces, False, False), ("sections", sections, False, False), ("sections, filtered", sections, True, False), ("sections, filtered, widened", sections, True, True)):
        m = catalogue.evaluated(cat, good, 3, a.chapel, a.shared, filtered, widened).first()
        print(f"{name:28} recall {m['recall']:.2f} mrr {m['mrr']:.2f} traps {m['trap_rate']:.2f}")
    best = lambda qs: sections.look_up(qs.select("query_id", text.expanded(F.col("text")).alias("text")), 1, a.chapel, a.shared)
    for r in search.gate_table(best(good), best(bad), [2.0, 3.0, 4.0, 5.0, 6.0, 7.0]).collect():
        print(f"threshold {r['threshold']:g}: answered {r['answered']}/{good.count()}, refused {r['refused']}/{bad.count()}")
    return 0


def _check(spark, a) -> int:
    """Secrets and, with a model, a review of what a range or a push brings; 1 where it should be stopped, 2 where there is no range."""
    import json

    from .functions import answers
    from .sources.repo import Repo

    repo = Repo(a.folder, a.trunk)
    ranges = repo.ranges_of_push(sys.stdin) if a.command == "pre-push" else [r for r in [repo.range_of(a.range)] if r]
    if not ranges and a.command == "check":
        print(f"no common ancestor with {a.trunk}", file=sys.stderr)
        return 2
    model = a.model and answers.Command(tuple(a.model))
    step = model and (lambda messages: json.loads(model.chat(messages)))
    verdicts = answers.guarded(spark, repo.diffs(spark, ranges), lambda head: answers.Tools(repo.lines(spark, head)), step)
    for v in verdicts:
        for path, line, kind in v["secrets"]:
            print(f"BLOCK {path}:{line} {kind}")
        for f in v["findings"]:
            print(f"{f['severity'].upper()} {f['path']}:{f['line'] or ''} {f['title']}: {f['evidence']}")
        if v["note"]:
            print(v["note"])
    return int(any(v["blocked"] for v in verdicts))


if __name__ == "__main__":
    sys.exit(main())

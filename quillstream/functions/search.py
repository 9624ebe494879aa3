"""An inverted index and ranked retrieval as plans: postings, statistics, BM25, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage

K1, B = 1.2, 0.75


#: Postings of one row of the index, about.
POSTINGS = 1 << 16


def slips(tokens: DataFrame, key: str, words: str = "tokens") -> DataFrame:
    """(key, dl, word, tf): counted with map-side partial sums; dl is the number of the document's words. The outer explode keeps Spark from working out the words once more for a filter on their number."""
    return tokens.select(key, F.size(words).cast("bigint").alias("dl"), F.explode_outer(words).alias("word")).where("word is not null").groupBy(key, "dl", "word").agg(F.count("*").alias("tf"))


def inverted_index(terms: DataFrame, key: str, shard: Column, most: int = POSTINGS) -> DataFrame:
    """(shard, word, block, postings sorted by key, df of the block). Postings hold the document's length, so that scoring reads nothing else.

    A word's postings in a shard are cut into blocks of about ``most`` by a hash of the document, so that no row and no
    task holds an unbounded list; words with fewer have block 0 alone.  ``terms`` should be a table: it is read twice.
    """
    placed = terms.withColumn("shard", shard)
    many = placed.groupBy("shard", "word").agg(F.count("*").alias("n")).where(F.col("n") > most).select("shard", "word", F.ceil(F.col("n") / most).alias("blocks"))
    cut = placed.join(many, ["shard", "word"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(key), "blocks"), F.lit(0)).cast("int"))
    return cut.groupBy("shard", "word", "block").agg(F.sort_array(F.collect_list(F.struct(key, "tf", "dl"))).alias("postings")).withColumn("df", F.size("postings"))


def document_frequencies(terms: DataFrame) -> DataFrame:
    return terms.groupBy("word").agg(F.count("*").alias("df"))


def totals(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(passages, garbled, tokens): one row; an empty corpus gives noughts."""
    a = docs.agg(F.count("*").alias("passages"), F.coalesce(F.sum(F.coalesce(F.instr(F.col(text), "�") > 0, F.lit(False)).cast("bigint")), F.lit(0)).alias("garbled"))
    return a.withColumn("tokens", terms.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("bigint")).scalar())


def idf(n: Column, df: Column) -> Column:
    half = F.lit(0.5)
    return F.log(F.lit(1.0) + (n.cast("double") - df + half) / (df + half))


#: Up to so many of the queries' words stand in the plan, where the scan of the index can skip what has none of them.
WORDS_IN_PLAN = 1_000


def asked_words(queries: DataFrame, query: str = "query_id", words: str = "tokens") -> DataFrame:
    """(query, word, times); a repeated word counts again."""
    return queries.select(query, F.explode_outer(words).alias("word")).where("word is not null").groupBy(query, "word").agg(F.count("*").alias("times"))


def of_words(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The index's rows of the asked words: by a filter that reaches the scan where they are few, else by a semi join."""
    few = [r["word"] for r in asked.select("word").distinct().limit(WORDS_IN_PLAN + 1).collect()]
    return index.where(F.col("word").isin(few)) if len(few) <= WORDS_IN_PLAN else index.join(asked.select("word").distinct(), "word", "left_semi")


def bm25_scores(terms: DataFrame, key: str, size: DataFrame, asked: DataFrame, query: str = "query_id", by: list[str] = (), stats: DataFrame | None = None) -> DataFrame:
    """(query, key, by..., score): every document that shares a word with a query.

    ``terms`` has (key, dl, word, tf), ``asked`` is made by ``asked_words`` and ``size`` has one row (n, tokens), or one
    per ``by``: the number of documents, those without words included, and of words.  ``by`` scores each shard with
    statistics of its own.  ``stats`` has (word, df) where it is stored; else it is counted from the asked words'
    postings.  Only those are looked at: nothing here reads the rest of the index.  A word that a third of all documents
    hold is spread by the document's key.
    """
    by = list(by)
    hit = terms.join(asked.select("word").distinct(), "word", "left_semi")
    df = hit.groupBy(*by, "word").agg(F.count("*").alias("df")) if stats is None else stats.select(*by, "word", "df")
    weighted = asked.join(df, "word")
    if by:
        weighted = weighted.join(size, by)
    else:
        weighted = weighted.withColumns({c: size.select(c).scalar() for c in ("tokens", "n")})
    weighted = weighted.select(query, "word", *by, "times", idf(F.col("n"), F.col("df")).alias("idf"), (F.col("tokens").cast("double") / F.col("n")).alias("avgdl"))
    scored = hit.join(weighted, [*by, "word"])
    tf, k1, b = F.col("tf").cast("double"), F.lit(K1), F.lit(B)
    part = F.col("times") * F.col("idf") * tf * (k1 + 1.0) / (tf + k1 * (F.lit(1.0) - b + b * F.col("dl") / F.col("avgdl")))
    return scored.groupBy(query, key, *by).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """The first k of each query with their rank; Spark cuts each task's rows to k before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def best(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Scores are compared to twelve places, so that sums in another order don't change ties; ties go to the smaller key."""
    return top_k(scored.withColumn("__s", F.round("score", 12)), query, [F.desc("__s"), F.asc(key)], k).drop("__s")


def best_of_shards(scored: DataFrame, query: str, key: str, k: int, shard: str = "shard") -> DataFrame:
    """``best`` by scatter and gather: each shard gives its own k, of which the k best stay."""
    local = scored.withColumn("__s", F.round("score", 12)).withColumn("__r", F.row_number().over(W.partitionBy(query, shard).orderBy(F.desc("__s"), F.asc(key)))).where(F.col("__r") <= k)
    return best(local.drop("__s", "__r"), query, key, k)


def unit(v: Column) -> Column:
    """A vector of length one; a null vector of noughts stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query: str, k: int, block: int = 4096, itself: bool = False) -> DataFrame:
    """The k nearest vectors of each query by cosine: queries in blocks against all rows, k per task, then k per query. A row with the query's own number is left out unless ``itself``.

    The driver and the tasks hold one block of queries at a time, of at most ``block`` vectors; the results of a block are
    written before the next one is read.
    """
    import itertools

    waiting = out = None
    rows = iter(queries.select(query, vector).where(F.col(vector).isNotNull()).toLocalIterator())
    while part := list(itertools.islice(rows, block)):
        if waiting is not None:
            waiting = storage.staged(waiting, "nearest")
            out = waiting if out is None else out.unionByName(waiting)
        waiting = best(_nearest_of_block(vectors, key, vector, part, query, k, itself), query, key, k)
    if waiting is None:
        return vectors.sparkSession.createDataFrame([], f"{query} long, {key} long, score double, rank int")
    return waiting if out is None else out.unionByName(waiting)


def _nearest_of_block(vectors: DataFrame, key: str, vector: str, part: list, query: str, k: int, itself: bool) -> DataFrame:
    import numpy as np
    import pandas as pd

    ids = np.array([r[query] for r in part])
    asked = [np.asarray(r[vector], np.float64) for r in part]
    q = np.stack([v / (np.linalg.norm(v) or 1.0) for v in asked]).T.copy()

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            norms = np.linalg.norm(v, axis=1, keepdims=True)
            s = (v / np.where(norms == 0, 1.0, norms)) @ q
            keys = pdf["k"].to_numpy()
            if not itself:
                s[keys[:, None] == ids[None, :]] = -np.inf
            take = min(k, len(keys))
            # All rows that tie with the k-th stay, so that ties are settled by key in the end.
            least = np.partition(s, len(keys) - take, axis=0)[len(keys) - take]
            r, c = np.nonzero((s >= least - 1e-12) & np.isfinite(s))
            yield pd.DataFrame({query: ids[c], key: keys[r], "score": s[r, c]})

    return vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, f"{query} long, {key} long, score double")


def fused(keyword: DataFrame, vector: DataFrame, query: str, key: str, k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings with ``rank``: the sum of 1/(c + rank); equal sums keep the keyword order."""
    a = keyword.select(query, key, F.col("rank").alias("kw"))
    b = vector.select(query, key, F.col("rank").alias("vec"))
    both = a.join(b, [query, key], "full_outer")
    part = lambda n: F.coalesce(F.lit(1.0) / (F.lit(c) + F.col(n)), F.lit(0.0))
    return top_k(both.withColumn("score", part("kw") + part("vec")), query, [F.desc(F.round("score", 12)), F.asc_nulls_last("kw"), F.asc(key)], k)


def gate(top: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Queries whose best hit reaches the threshold."""
    return top.where((F.col("rank") == 1) & (F.col("score") >= threshold))


def gate_table(answerable: DataFrame, unanswerable: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, answered, refused): answerable queries at or above it, unanswerable ones below; one pass over the best scores."""
    marked = answerable.select(F.lit(True).alias("good"), "score").unionByName(unanswerable.select(F.lit(False).alias("good"), "score"))
    n = lambda test: F.coalesce(F.sum(test.cast("bigint")), F.lit(0))
    rows = [F.struct(F.lit(float(t)).alias("threshold"), n(F.col("good") & (F.col("score") >= t)).alias("answered"), n(~F.col("good") & (F.col("score") < t)).alias("refused")) for t in thresholds]
    return marked.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def retrieval_metrics(hits: DataFrame, queries: DataFrame, query: str, relevant: str, trap: str, k: int) -> DataFrame:
    """(queries, recall, mrr, trap_rate): recall and trap rate within k, mrr nought where nothing relevant is found."""
    first = hits.where(F.col("rank") <= k).groupBy(query).agg(F.min(F.when(F.col(relevant), F.col("rank"))).alias("first"), F.max(F.col(trap).cast("int")).alias("trapped"))
    joined = queries.select(query).join(first, query, "left")
    return joined.agg(F.count("*").alias("queries"), F.avg(F.col("first").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("trapped", F.lit(0)).cast("double")).alias("trap_rate"))


# Answers --------------------------------------------------------------------------------------
def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def provenance_problems(answer: Column, sources: Column) -> Column:
    """Problems of an answer against its numbered sources: a sentence that cites none, one that cites a source that wasn't given, a number that its cited texts don't hold."""
    n = F.size(sources)

    def of(s: Column) -> Column:
        cited = F.transform(F.regexp_extract_all(s, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
        given = F.array_join(F.transform(cited, lambda c: F.get(sources, c - 1)), " ")
        numbers = F.regexp_extract_all(F.regexp_replace(s, r"\[S\d+\]", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
        absent = F.filter(numbers, lambda x: ~F.contains(given, x))
        return F.when(F.size(cited) == 0, F.array(F.concat(F.lit("uncited: "), s))).when(F.exists(cited, lambda c: (c < 1) | (c > n)), F.array(F.concat(F.lit("cites a source that was not given: "), s))).otherwise(F.transform(absent, lambda x: F.concat(x, F.lit(" is not in the cited sources: "), s)))

    return F.flatten(F.transform(sentences(answer), of))


#: What a model answers that finds nothing, and what each refusal is called (fixed values).
REFUSED = "NOT_IN_SOURCES"
REASONS = {"none": "no cards", "weak": "weak retrieval", "refused": "model found no answer in the sources", "failed": "provenance failed: "}


def answer_outcome(best_score: Column, draft: Column, problems: Column, threshold: float = 3.0) -> Column:
    """Why an answer is refused, in fixed order: weak retrieval, the model's own refusal, provenance; else 'ok'."""
    failed = F.concat(F.lit(REASONS["failed"]), F.array_join(problems, "; "))
    return F.when(best_score.isNull(), REASONS["none"]).when(best_score < threshold, REASONS["weak"]).when(F.contains(draft, F.lit(REFUSED)), REASONS["refused"]).when(F.size(problems) > 0, failed).otherwise("ok")


def prompt(question: Column, cards: Column) -> Column:
    """Numbered sources and the question; ``cards`` is an array of card texts in rank order."""
    numbered = F.array_join(F.transform(cards, lambda c, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
    return F.concat(F.lit("Sources:\n"), numbered, F.lit("\n\nQuestion: "), question)


def exclusive_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """(value): a quantile by the exclusive method, which interpolates at rank q (n + 1); the ends are clamped. One count fixes where the exact percentile is taken."""
    n = df.where(F.col(column).isNotNull()).count()
    if n < 2:
        return df.agg(F.max(column).cast("double").alias("value"))
    place = min(max((q * (n + 1) - 1) / (n - 1), 0.0), 1.0)
    return df.agg(F.percentile(column, place).alias("value"))

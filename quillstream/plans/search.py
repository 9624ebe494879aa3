"""Queries of the text index, ranked retrieval, answers, secrets and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import skew, storage
from ..functions import answers, catalogue, scan, search, text
from ..session import table

SHARDS, K = 4, 10


def documents(spark, sf):
    return table(spark, sf, "documents").where("text is not null")


def tokenised(spark: SparkSession, sf: str) -> DataFrame:
    return text.with_tokens(skew.spread(documents(spark, sf).select("doc_id", "text", "lang"), "doc_id"), "text")


def corpus_terms(spark, sf):
    return search.slips(tokenised(spark, sf), "doc_id")


def stored_terms(spark, sf):
    """Words and counts as a table, for plans that read them more than once."""
    return storage.staged(corpus_terms(spark, sf), "terms")


def queries_of(spark, sf, remainder: int = 0):
    """The search's queries: every twentieth held-out item."""
    items = table(spark, sf, "eval_items").where(F.col("item_id") % 20 == remainder).select(F.col("item_id").alias("query_id"), "text")
    return text.with_tokens(items, "text")


def corpus_size(spark, sf, terms, by=()):
    """(n, tokens), or one row per ``by``: documents, those without words included, and their words."""
    n = documents(spark, sf).select("doc_id", shard_of("doc_id")).groupBy(*by).agg(F.count("*").alias("n"))
    words = terms.groupBy(*by).agg(F.sum("tf").alias("tokens"))
    return n.join(words, list(by), "left") if by else n.withColumn("tokens", words.scalar())


def shard_of(key):
    return F.pmod(key, F.lit(SHARDS)).cast("int").alias("shard")


def q22_token_counts(spark, sf):
    return tokenised(spark, sf).select("doc_id", F.size("tokens").cast("bigint").alias("tokens"), F.size(F.array_distinct("tokens")).cast("bigint").alias("words"))


def q23_term_stats(spark, sf):
    return search.document_frequencies(corpus_terms(spark, sf)).orderBy(F.desc("df"), "word").limit(50)


def q24_corpus_totals(spark, sf):
    return search.totals(documents(spark, sf), corpus_terms(spark, sf), "text")


def index(terms):
    return search.inverted_index(terms, "doc_id", shard_of("doc_id"))


def q25_postings(spark, sf):
    """Every word's postings in each shard, as a digest that order and counts go into."""
    rows = index(stored_terms(spark, sf))
    listed = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["tf"], p["dl"])), ",")
    return rows.select("shard", "word", "block", F.col("df").cast("bigint").alias("df"), F.md5(listed).alias("digest"))


def q26_shard_df_conservation(spark, sf):
    """Words with their frequencies added up over the shards and counted over the corpus, and whether they agree; a word that one side lacks doesn't."""
    terms = stored_terms(spark, sf)
    shards = index(terms).groupBy("word").agg(F.sum("df").alias("in_shards"))
    both = shards.join(search.document_frequencies(terms), "word", "full_outer")
    agree = F.col("in_shards").eqNullSafe(F.col("df"))
    return both.groupBy(F.col("df").alias("df")).agg(F.count("*").alias("words"), F.sum("in_shards").alias("in_shards"), F.sum((~agree).cast("bigint")).alias("disagree"))


def q27_letter_shards(spark, sf):
    terms = corpus_terms(spark, sf)
    return terms.groupBy(text.letter_shard(F.col("word"), SHARDS).alias("shard")).agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))


def scored(spark, sf, terms=None, remainder: int = 0):
    terms = terms or stored_terms(spark, sf)
    return search.bm25_scores(terms, "doc_id", corpus_size(spark, sf, terms), search.asked_words(queries_of(spark, sf, remainder)))


def _shown(hits):
    return hits.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def q28_bm25_top10(spark, sf):
    return _shown(search.best(scored(spark, sf), "query_id", "doc_id", K))


def q29_bm25_local_idf(spark, sf):
    """Each shard scores with statistics of its own; the shards' bests are merged."""
    terms = stored_terms(spark, sf).withColumn("shard", shard_of("doc_id"))
    hits = search.bm25_scores(terms, "doc_id", corpus_size(spark, sf, terms, ["shard"]), search.asked_words(queries_of(spark, sf)), by=["shard"])
    return _shown(search.best_of_shards(hits, "query_id", "doc_id", K))


def q30_hits_with_text(spark, sf):
    """The text of a few hits is fetched after the ranking, cut to 110 characters."""
    hits = search.best(scored(spark, sf), "query_id", "doc_id", 3)
    shown = documents(spark, sf).select("doc_id", F.when(F.length("text") > 110, F.concat(F.substring("text", 1, 107), F.lit("..."))).otherwise(F.col("text")).alias("snippet"))
    return hits.join(shown, "doc_id").select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "snippet")


def q31_canaries(spark, sf):
    """Words known to be in a document, its first and one that is in none, and whether the index finds them there."""
    tokens = tokenised(spark, sf).where(F.size("tokens") > 0)
    wanted = tokens.select("doc_id", F.explode(F.array(F.element_at("tokens", 1), F.concat(F.element_at("tokens", 1), F.lit("zzqx")))).alias("word"))
    found = index(stored_terms(spark, sf)).select("word", F.explode("postings").alias("p")).select("word", F.col("p.doc_id").alias("doc_id"), F.lit(True).alias("found"))
    return wanted.join(found, ["word", "doc_id"], "left").groupBy(F.endswith("word", F.lit("zzqx")).alias("planted")).agg(F.count("*").alias("canaries"), F.count_if(F.col("found").isNull()).alias("dead"))


def q32_stems(spark, sf):
    rows = documents(spark, sf).select(F.explode_outer(text.stems(F.col("text"))).alias("stem")).where("stem is not null")
    return rows.groupBy("stem").agg(F.count("*").alias("n"))


def q33_fixed_chunks(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(text.fixed_chunks(F.col("text"), 300, 50)).alias("n", "chunk"))
    return rows.select(F.concat_ws("#c", "doc_id", "n").alias("chunk_id"), F.md5("chunk").alias("digest"), F.length("chunk").cast("bigint").alias("chars"))


def q34_passages(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(text.passages(F.col("text"))).alias("n", "passage"))
    return rows.select(F.concat_ws(":", "doc_id", F.col("n") + 1).alias("passage_id"), F.length("passage").cast("bigint").alias("chars"), F.md5("passage").alias("digest"))


def archive_records(spark, sf):
    """Front matter as fields, the rest as body; a record without front matter has no fields."""
    parts = F.split("text", "---", 3)
    rows = documents(spark, sf).where("kind = 'archive_record'").select("doc_id", "text", parts.alias("parts"))
    pairs = F.filter(F.split(F.get("parts", F.lit(1)), r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.substr(x, F.instr(x, ":") + 1)))))
    return rows.where((F.size("parts") == 3) & (F.trim(F.get("parts", F.lit(0))) == "")).withColumn("meta", meta).withColumn("body", F.get("parts", F.lit(2)))


def q35_heading_chunks(spark, sf):
    rows = archive_records(spark, sf)
    chunks = rows.select("doc_id", F.col("meta")["title"].alias("title"), F.col("meta")["dated"].try_cast("int").alias("dated"), F.inline(text.heading_chunks(F.col("body"))))
    return chunks.select(F.concat_ws("#", "doc_id", "slug").alias("chunk_id"), "dated", F.md5(text.card(F.col("title"), F.col("heading"), F.col("text"))).alias("card_digest"))


def q36_bm25_filtered(spark, sf):
    """Filters narrow the candidates; statistics stay those of the whole corpus."""
    keep = documents(spark, sf).where(F.lower(F.trim("lang")).isin("en", "it")).select("doc_id")
    return _shown(search.best(scored(spark, sf).join(keep, "doc_id", "left_semi"), "query_id", "doc_id", K))


def q37_thesaurus(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", text.expanded(F.col("text")).alias("expanded"))


def q38_cosine_top5(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    hits = search.cosine_top_k(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", 5)
    return hits.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def q39_rank_fusion(spark, sf):
    """BM25 fused with the nearest vectors, both cut at 50: an item asks with its words and with the vector of its number."""
    keyword = search.best(scored(spark, sf), "query_id", "doc_id", 50)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.join(queries_of(spark, sf).select(F.col("query_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("query_id"), "embedding")
    near = search.cosine_top_k(vectors, "doc_id", "embedding", asked, "query_id", 50)
    fused = search.fused(keyword, near, "query_id", "doc_id", K)
    return fused.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 9).alias("score"))


def q40_gate_table(spark, sf):
    """The items as questions that the corpus may answer, and as ones that it can't: every word spelled backwards but the shortest."""
    terms, asked = stored_terms(spark, sf), queries_of(spark, sf)
    good = search.best(scored(spark, sf, terms), "query_id", "doc_id", 1)
    turned = asked.withColumn("tokens", F.transform("tokens", lambda w: F.when(F.length(w) > 3, F.reverse(w)).otherwise(w)))
    hopeless = search.bm25_scores(terms, "doc_id", corpus_size(spark, sf, terms), search.asked_words(turned))
    return search.gate_table(good, search.best(hopeless, "query_id", "doc_id", 1), [5.0, 10.0, 20.0, 40.0, 60.0, 80.0, 100.0, 150.0])


def q41_retrieval_metrics(spark, sf):
    """Recall, reciprocal rank and trap rate within ten: relevant is what holds half of the item's words, a trap is in another language."""
    words = tokenised(spark, sf).select("doc_id", F.array_distinct("tokens").alias("words"), "lang")
    hits = search.best(scored(spark, sf), "query_id", "doc_id", K).join(words, "doc_id")
    asked = queries_of(spark, sf)
    hits = hits.join(asked.select("query_id", F.array_distinct("tokens").alias("of")), "query_id")
    hits = hits.withColumn("relevant", 2 * F.size(F.array_intersect("words", "of")) >= F.size("of")).withColumn("trap", ~F.coalesce(F.lower(F.trim("lang")) == "en", F.lit(False)))
    out = search.retrieval_metrics(hits, asked, "query_id", "relevant", "trap", K)
    return out.select("queries", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "trap_rate")])


def q42_provenance(spark, sf):
    """Every document as an answer: its inner sentences cite it, its last cites nothing or a source that wasn't given, and the source reads 8 for every 7."""
    docs = documents(spark, sf)
    said = F.concat(F.regexp_replace("text", r"([.!?])(\s+[A-Z])", " [S1]$1$2"), F.when(F.col("doc_id") % 2 == 0, " [S3]").otherwise(""))
    problems = search.provenance_problems(said, F.array(F.replace("text", F.lit("7"), F.lit("8"))))
    return docs.select("doc_id", F.size(problems).alias("problems"), F.md5(F.array_join(problems, "; ")).alias("digest"))


def with_credentials(spark, sf):
    """Documents of which every seventh by number gets a credential line of its own."""
    line = F.concat(F.lit("\napi_key = \"k"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("\"\nAKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "0"))
    return documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", line)).otherwise(F.col("text")).alias("text"))


def q43_secret_counts(spark, sf):
    rows = with_credentials(spark, sf)
    per = rows.select(*[c.alias(k) for k, c in scan.counts(F.col("text")).items()])
    return per.agg(*[F.sum(F.col(f"`{k}`")).cast("bigint").alias(k.lower().replace(" ", "_")) for k in scan.SECRETS])


def q44_redact(spark, sf):
    return with_credentials(spark, sf).select("doc_id", F.md5(scan.redact(F.col("text"))).alias("digest"))


def q45_diff_lines(spark, sf):
    """Added lines of the diffs in documents, with file and line number."""
    diffs = documents(spark, sf).where(F.contains("text", F.lit("\n+++ ")))
    return scan.diff_lines(diffs, "doc_id", "text").where("added").select("doc_id", "n", "path", "line_no", F.md5("line").alias("digest"))


def q46_decode(spark, sf):
    """Bytes of even documents are UTF-8, of odd ones ISO-8859-1; which is found by strict decoding."""
    western = F.encode(F.regexp_replace("text", r"[^\x{00}-\x{ff}]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(western)
    got, encoding = text.decoded(F.col("content"))
    return documents(spark, sf).select("doc_id", content.alias("content")).select("doc_id", encoding.alias("encoding"), F.md5(got).alias("digest"))


def q47_percentiles(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


def q51_latency_summary(spark, sf):
    """The 95th percentile by the exclusive method over all events."""
    return search.exclusive_quantile(table(spark, sf, "events"), "value", 0.95).select(F.round("value", 6).alias("p95"))


def q52_encodings(spark, sf):
    return table(spark, sf, "books").groupBy(F.lower(F.trim("encoding")).alias("encoding")).agg(F.count("*").alias("books"))


def q53_titles(spark, sf):
    """A text's first line without blanks and brackets; its number where that is empty."""
    return documents(spark, sf).select("doc_id", text.title(F.col("text"), F.concat(F.lit("document "), "doc_id")).alias("title"))


def cards(spark, sf):
    """Chunks of the archive as cards in corpus order, with the fields that they are filtered by. A record is current unless its number is divisible by 5, the corpus having no successions."""
    rows = archive_records(spark, sf)
    chunks = rows.select("doc_id", F.col("meta")["title"].alias("title"), F.col("meta")["kind"].alias("chapel"), (F.col("doc_id") % 5 != 0).alias("current"), F.posexplode(text.heading_chunks(F.col("body"))).alias("n", "c"))
    return chunks.select(F.concat_ws("#", "doc_id", F.col("n") + 1).alias("chunk_id"), (F.col("doc_id") * 1000 + F.col("n")).alias("ordinal"), "chapel", "current", text.card(F.col("title"), F.col("c.heading"), F.col("c.text")).alias("card"))


def q54_catalogue(spark, sf):
    """The catalogue asked with the widened items: stems, one kind of record and what belongs to all, current ones only; cards without a score in corpus order after the others."""
    asked = table(spark, sf, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), text.expanded(F.col("text")).alias("text"))
    hits = catalogue.Catalogue(cards(spark, sf)).look_up(asked, k=K, chapel="drawing", shared="photo")
    return hits.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def q55_token_estimates(spark, sf):
    return documents(spark, sf).groupBy("kind").agg(F.sum(answers.token_estimate(F.col("text"))).alias("tokens"), F.max(answers.token_estimate(F.col("text"))).alias("most"))


def q56_prompts(spark, sf):
    """Each item as a question over its three best documents, as a model would be asked."""
    hits = search.best(scored(spark, sf), "query_id", "doc_id", 3).join(documents(spark, sf).select("doc_id", F.substring("text", 1, 200).alias("card")), "doc_id")
    per = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "card"))), lambda h: h["card"]).alias("cards"))
    asked = table(spark, sf, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text").join(per, "query_id")
    return asked.select("query_id", F.md5(search.prompt(F.col("text"), F.col("cards"))).alias("digest"))


def q57_review_scores(spark, sf):
    """Events as runs of a review: clicks should be blocked, large values are; how many were and how long they took."""
    runs = table(spark, sf, "events").select((F.col("event_type") == "click").alias("expected"), (F.col("value") > 50).alias("blocked"), F.col("value").alias("seconds"))
    out = answers.review_scores(runs)
    return out.select(*[c for c in out.columns if not c.endswith("_s")], *[F.round(c, 6).alias(c) for c in out.columns if c.endswith("_s")])


# SQL ------------------------------------------------------------------------------------------
def _folded(t: str) -> str:
    for a, b in {**text.LIGATURES, "½": "1 2", "¼": "1 4", "¾": "3 4", "µ": "μ"}.items():
        t = f"replace({t}, '{a}', '{b}')"
    return f"regexp_extract_all(lower(strip_accents({t})), '[\\p{{L}}\\p{{N}}]+')"


_TERMS = f"""docs as (select * from documents where text is not null), tok as (select doc_id, {_folded('text')} as tokens from docs), w as (select doc_id, unnest(tokens) as word from tok), terms as (select doc_id, word, count(*) as tf from w group by all)"""


def _asked(remainder: int, name: str) -> str:
    return f"{name} as (select query_id, word, count(*) as times from (select item_id as query_id, unnest({_folded('text')}) as word from eval_items where item_id % 20 = {remainder}) group by all)"


def _scores(asked: str, name: str, by: str = "") -> str:
    on = f" and h.{by} = m.{by}" if by else ""
    b = f", {by}" if by else ""
    return f"""{name}_dl as (select doc_id{b}, sum(tf) as dl from t group by all), {name}_m as (select d.n{', d.' + by if by else ''}, s.tok / d.n as avgdl from (select count(*)::double as n{b} from dd group by all) d join (select sum(dl)::double as tok{b} from {name}_dl group by all) s on {f's.{by} = d.{by}' if by else 'true'}),
    {name}_df as (select word{b}, count(*) as df from t group by all),
    {name} as (select query_id, h.doc_id, sum(times * ln(1 + (m.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / m.avgdl))) as score from t h join {asked} q using (word) join {name}_dl l on l.doc_id = h.doc_id join {name}_df f on f.word = h.word{f' and f.{by} = h.{by}' if by else ''} join {name}_m m on true{on} group by all)"""


_BM25 = f"with {_TERMS}, dd as (select doc_id from docs), t as (select * from terms), {_asked(0, 'asked')}, {_scores('asked', 'scored')}"
_RANK = "select query_id, doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 12) desc, doc_id) as rank from {}) where rank <= 10"
_CRED = """c as (select doc_id, case when doc_id % 7 = 0 then text || chr(10) || 'api_key = "k' || lpad(doc_id::varchar, 12, '0') || '"' || chr(10) || 'AKIA' || lpad(doc_id::varchar, 16, '0') else text end as text from documents where text is not null)"""
_REDACTED = "text"
for _k, _p in scan.SECRETS.items():
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p.replace(chr(39), chr(39) * 2)}', '[REDACTED {_k}]', 'g')"
_EXPANDED = "concat_ws(' ', text, " + ", ".join(f"case when regexp_matches(lower(text), '{p}') then '{w}' end" for p, w in text.THESAURUS.items()) + ")"
_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP) + "]"

_STEM = "case when length(w) > 4 and w like '%ing' then w[:-4] when length(w) > 4 and (w like '%ed' or w like '%es') then w[:-3] when length(w) > 4 and w like '%s' then w[:-2] else w end"
_STEMMED = f"list_transform(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda w: not list_contains({_STOPS}, w)), lambda w: {_STEM})"
_FIELD = r"(list_transform(list_filter(string_split_regex(mid, '\r?\n'), lambda x: trim(split_part(x, ':', 1)) = '{0}' and contains(x, ':')), lambda x: trim(substr(x, strpos(x, ':') + 1))))[1]"
#: Archive records cut into cards: front matter between the first two rules, sections at their headings.
_CARDS = rf"""with a as (select doc_id, text, strpos(text, '---') as p from documents where kind = 'archive_record' and text is not null), b as (select doc_id, substr(text, 1, p - 1) as pre, substr(text, p + 3) as rest from a where p > 0), c as (select doc_id, substr(rest, 1, strpos(rest, '---') - 1) as mid, substr(rest, strpos(rest, '---') + 3) as body from b where trim(pre) = '' and strpos(rest, '---') > 0),
  f as (select doc_id, {_FIELD.format('title')} as title, {_FIELD.format('kind')} as kind, {_FIELD.format('dated')} as dated, list_transform(string_split(chr(10) || regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10) || '## ')[2:], lambda x: {{'heading': trim(split_part(x, chr(10), 1)), 'body': array_to_string(list_transform(list_filter(case when contains(x, chr(10)) then string_split(substr(x, strpos(x, chr(10)) + 1), chr(10)) else [] end, lambda y: trim(y) <> '' and not starts_with(y, '# ')), lambda y: trim(y)), ' ')}}) as s from c),
  g as (select doc_id, title, kind, dated, list_filter(s, lambda x: x.heading <> '' and x.body <> '') as s from f), cards as (select doc_id, title, kind, dated, n, s[n].heading as heading, s[n].body as body from (select *, unnest(range(1, len(s) + 1)) as n from g))"""

SQL = {
    "q22_token_counts": f"with {_TERMS} select doc_id, len(tokens)::bigint as tokens, len(list_distinct(tokens))::bigint as words from tok",
    "q23_term_stats": f"with {_TERMS} select word, count(*) as df from terms group by 1 order by df desc, word limit 50",
    "q24_corpus_totals": f"with {_TERMS} select (select count(*) from docs) as passages, (select count(*) from docs where contains(text, '�')) as garbled, (select sum(tf)::bigint from terms) as tokens",
    # A word of the test tables has fewer postings than a block holds.
    "q25_postings": f"""with {_TERMS}, dl as (select doc_id, sum(tf)::bigint as dl from terms group by 1)
      select (doc_id % {SHARDS})::int as shard, word, 0 as block, count(*) as df, md5(string_agg(doc_id || ':' || tf || ':' || dl, ',' order by doc_id)) as digest from terms join dl using (doc_id) group by 1, 2""",
    "q26_shard_df_conservation": f"""with {_TERMS}, s as (select word, doc_id % {SHARDS} as shard, count(distinct doc_id) as df from w group by all), a as (select word, sum(df)::bigint as in_shards from s group by 1), b as (select word, count(*) as df from terms group by 1)
      select df, count(*) as words, sum(in_shards)::bigint as in_shards, sum((in_shards is distinct from df)::bigint)::bigint as disagree from a full join b using (word) group by 1""",
    "q27_letter_shards": f"with {_TERMS} select (case when ascii(word) between 97 and 122 then floor((ascii(word) - 97) * {SHARDS} / 26) else 0 end)::int as shard, count(*) as postings, sum(tf)::bigint as tokens from terms group by 1",
    "q28_bm25_top10": f"{_BM25} {_RANK.format('scored')}",
    "q29_bm25_local_idf": f"with {_TERMS}, dd as (select doc_id, (doc_id % {SHARDS})::int as shard from docs), t as (select *, (doc_id % {SHARDS})::int as shard from terms), {_asked(0, 'asked')}, {_scores('asked', 'scored', 'shard')} {_RANK.format('scored')}",
    "q30_hits_with_text": f"{_BM25} select query_id, doc_id, rank, case when length(text) > 110 then substr(text, 1, 107) || '...' else text end as snippet from (select *, row_number() over (partition by query_id order by round(score, 12) desc, doc_id) as rank from scored) join docs using (doc_id) where rank <= 3",
    "q31_canaries": f"""with {_TERMS}, c as (select doc_id, tokens[1] as word, false as planted from tok where len(tokens) > 0 union all select doc_id, tokens[1] || 'zzqx', true from tok where len(tokens) > 0)
      select planted, count(*) as canaries, count(*) filter (not exists (select 1 from w where w.doc_id = c.doc_id and w.word = c.word)) as dead from c group by 1""",
    "q32_stems": f"""with w as (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents where text is not null), k as (select w from w where not list_contains({_STOPS}, w))
      select case when length(w) > 4 and w like '%ing' then w[:-4] when length(w) > 4 and (w like '%ed' or w like '%es') then w[:-3] when length(w) > 4 and w like '%s' then w[:-2] else w end as stem, count(*) as n from k group by 1""",
    "q33_fixed_chunks": "with n as (select doc_id, text, unnest(range(0, ((length(text) - 1) // 250) + 1)) as n from documents where text is not null and length(text) > 0) select doc_id || '#c' || n as chunk_id, md5(substr(text, n * 250 + 1, 300)) as digest, length(substr(text, n * 250 + 1, 300))::bigint as chars from n",
    "q36_bm25_filtered": f"{_BM25}, kept as (select s.* from scored s join docs using (doc_id) where lower(trim(lang)) in ('en', 'it')) {_RANK.format('kept')}",
    "q37_thesaurus": f"select item_id, {_EXPANDED} as expanded from eval_items",
    "q38_cosine_top5": """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v),
      s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.e, b.e) / (case when a.n = 0 then 1 else a.n end * case when b.n = 0 then 1 else b.n end) as score from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
      select query_id, vec_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 12) desc, vec_id) as rank from s) where rank <= 5""",
    "q39_rank_fusion": f"""{_BM25}, kw as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 12) desc, doc_id) as kw from scored) where kw <= 50),
      v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v),
      near as (select a.vec_id as query_id, b.vec_id as doc_id, list_inner_product(a.e, b.e) / (case when a.n = 0 then 1 else a.n end * case when b.n = 0 then 1 else b.n end) as score from u a join u b on a.vec_id <> b.vec_id where a.vec_id in (select item_id from eval_items where item_id % 20 = 0)),
      vec as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 12) desc, doc_id) as vec from near) where vec <= 50),
      f as (select query_id, doc_id, kw, coalesce(1.0::double / (60 + kw), 0) + coalesce(1.0::double / (60 + vec), 0) as score from kw full join vec using (query_id, doc_id))
      select query_id, doc_id, rank, round(score, 9) as score from (select *, row_number() over (partition by query_id order by round(score, 12) desc, kw nulls last, doc_id) as rank from f) where rank <= 10""",
    "q40_gate_table": f"""{_BM25}, asked2 as (select query_id, word, sum(times)::bigint as times from (select query_id, case when length(word) > 3 then reverse(word) else word end as word, times from asked) group by all), {_scores('asked2', 'scored2')}, g as (select query_id, max(score) as s from scored group by 1), b as (select query_id, max(score) as s from scored2 group by 1)
      select t as threshold, (select count(*) from g where s >= t) as answered, (select count(*) from b where s < t) as refused from (select unnest([5.0, 10.0, 20.0, 40.0, 60.0, 80.0, 100.0, 150.0]::double[]) as t)""",
    "q41_retrieval_metrics": f"""{_BM25}, h as (select * from (select *, row_number() over (partition by query_id order by round(score, 12) desc, doc_id) as rank from scored) where rank <= 10),
      i as (select item_id, list_distinct({_folded('text')}) as words from eval_items where item_id % 20 = 0), d as (select doc_id, list_distinct(tokens) as words, lang from tok join documents using (doc_id)),
      x as (select h.query_id, min(case when 2 * len(list_intersect(d.words, i.words)) >= len(i.words) then rank end) as first, max(case when coalesce(lower(trim(d.lang)) = 'en', false) then 0 else 1 end) as trapped from h join d using (doc_id) join i on i.item_id = h.query_id group by 1)
      select count(*) as queries, round(avg(case when first is not null then 1.0::double else 0 end), 9) as recall, round(avg(coalesce(1.0::double / first, 0)), 9) as mrr, round(avg(coalesce(trapped, 0)::double), 9) as trap_rate from i left join x on x.query_id = i.item_id""",
    "q34_passages": r"""with p as (select doc_id, unnest(string_split_regex(text, '\r?\n[ \t\n\x0B\f\r]*\r?\n')) as p, generate_subscripts(string_split_regex(text, '\r?\n[ \t\n\x0B\f\r]*\r?\n'), 1) as k from documents where text is not null),
      c as (select doc_id, k, trim(regexp_replace(p, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') as p from p),
      packed as (select doc_id, k, list_reduce(list_transform(string_split(p, ' '), lambda w: [w]), lambda a, x: case when a[-1] <> '' and length(a[-1]) + length(x[1]) + 1 > 1200 then list_concat(a, x) else list_concat(a[:-2], [case when a[-1] = '' then x[1] else a[-1] || ' ' || x[1] end]) end, ['']) as parts from c),
      e as (select doc_id, k, unnest(list_filter(parts, lambda x: x <> '')) as passage, generate_subscripts(list_filter(parts, lambda x: x <> ''), 1) as j from packed)
      select doc_id || ':' || row_number() over (partition by doc_id order by k, j) as passage_id, length(passage)::bigint as chars, md5(passage) as digest from e""",
    "q35_heading_chunks": _CARDS + """ select doc_id || '#' || replace(lower(heading), ' ', '-') as chunk_id, try_cast(dated as int) as dated, md5(title || ' > ' || heading || chr(10) || body) as card_digest from cards""",
    "q42_provenance": r"""with d as (select doc_id, regexp_replace(text, '([.!?])([ \t\n\x0B\f\r]+[A-Z])', ' [S1]\1\2', 'g') || case when doc_id % 2 = 0 then ' [S3]' else '' end as said, replace(text, '7', '8') as source from documents where text is not null),
      s as (select doc_id, source, unnest(list_filter(list_transform(string_split(regexp_replace(trim(said, ' '), '([.!?])[ \t\n\x0B\f\r]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) > 0)) as s, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(trim(said, ' '), '([.!?])[ \t\n\x0B\f\r]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) > 0), 1) as k from d),
      c as (select *, list_transform(regexp_extract_all(s, '\[S(\d+)\]', 1), lambda x: x::int) as cited, regexp_extract_all(regexp_replace(s, '\[S\d+\]', '', 'g'), '\d+(?:\.\d+)?') as numbers from s),
      p as (select doc_id, k, case when len(cited) = 0 then ['uncited: ' || s] when len(list_filter(cited, lambda x: x < 1 or x > 1)) > 0 then ['cites a source that was not given: ' || s] else list_transform(list_filter(numbers, lambda x: not contains(source, x)), lambda x: x || ' is not in the cited sources: ' || s) end as problems from c),
      a as (select doc_id, flatten(list(problems order by k)) as problems from p group by 1)
      select doc_id, coalesce(len(problems), 0)::int as problems, md5(coalesce(array_to_string(problems, '; '), '')) as digest from documents left join a using (doc_id) where text is not null""",
    "q45_diff_lines": r"""with l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) as line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) - 1 as n from documents where contains(text, chr(10) || '+++ ')),
      h as (select *, regexp_matches(line, '^@@ -(\d+)(,(\d+))? \+(\d+)(,(\d+))? @@') as hunk, coalesce(try_cast(nullif(regexp_extract(line, '^@@ -\d+(,(\d+))? \+', 2), '') as int), 1) as olds, coalesce(try_cast(nullif(regexp_extract(line, '^@@ -\d+(,\d+)? \+\d+(,(\d+))? @@', 3), '') as int), 1) as news, try_cast(nullif(regexp_extract(line, '^@@ -\d+(,\d+)? \+(\d+)', 2), '') as int) as start from l),
      g as (select *, sum(hunk::int) over (partition by doc_id order by n) as h from h),
      w as (select *, substr(line, 1, 1) as c, not hunk and h > 0 as body, first_value(case when hunk then olds end) over b as o, first_value(case when hunk then news end) over b as m, first_value(case when hunk then start end) over b as s from g window b as (partition by doc_id, h order by n)),
      k as (select *, coalesce(sum((body and c in ('-', ' '))::int) over b, 0) as seen_old, coalesce(sum((body and c in ('+', ' '))::int) over b, 0) as seen_new from w window b as (partition by doc_id, h order by n rows between unbounded preceding and 1 preceding)),
      z as (select *, not coalesce(body and (seen_old < o or seen_new < m), false) and starts_with(line, '+++ ') as header from k),
      y as (select *, coalesce(last_value(case when header then regexp_replace(line, '^\+\+\+ (?:b/)?', '') end ignore nulls) over (partition by doc_id order by n), '?') as path from z)
      select doc_id, n::int as n, path, (s + seen_new)::bigint as line_no, md5(line) as digest from y where c = '+' and not header and h > 0""",
    "q51_latency_summary": """with v as (select value, row_number() over (order by value) as r, count(*) over () as n from events where value is not null), k as (select greatest(1, least(any_value(n), 0.95::double * (any_value(n) + 1))) as rank from v)
      select round(max(case when r = floor(rank) then value end) + (any_value(rank) - floor(any_value(rank))) * coalesce(max(case when r = floor(rank) + 1 then value end) - max(case when r = floor(rank) then value end), 0), 6) as p95 from v, k""",
    "q53_titles": r"""with a as (select doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[]') as t from documents where text is not null)
      select doc_id, coalesce(nullif(regexp_replace(t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), ''), 'document ' || doc_id) as title from a""",
    "q54_catalogue": _CARDS + f""", stemmed as (select doc_id || '#' || n as chunk_id, doc_id * 1000 + n - 1 as ordinal, kind as chapel, doc_id % 5 <> 0 as current, title || ' > ' || heading || chr(10) || body as card from cards),
      ct as (select chunk_id, {_STEMMED.format('card')} as tokens from stemmed), t as (select chunk_id as doc_id, unnest(tokens) as word from ct), tt as (select doc_id, word, count(*) as tf from t group by all),
      q as (select query_id, word, count(*) as times from (select item_id as query_id, unnest({_STEMMED.format(_EXPANDED)}) as word from eval_items where item_id % 20 = 0) group by all),
      m as (select count(*)::double as n, sum(len(tokens))::double / count(*) as avgdl from ct), dl as (select chunk_id as doc_id, len(tokens) as dl from ct), dfs as (select word, count(*) as df from tt group by 1),
      sc as (select query_id, doc_id, sum(times * ln(1 + (m.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / m.avgdl))) as score from tt join q using (word) join dl using (doc_id) join dfs using (word) join m on true group by all),
      al as (select i.item_id as query_id, s.chunk_id, s.ordinal, coalesce(sc.score, 0) as score from stemmed s join eval_items i on i.item_id % 20 = 0 left join sc on sc.query_id = i.item_id and sc.doc_id = s.chunk_id where s.chapel in ('drawing', 'photo') and s.current)
      select query_id, chunk_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 12) desc, ordinal) as rank from al) where rank <= 10""",
    "q55_token_estimates": "select kind, sum(length(text) // 3)::bigint as tokens, max(length(text) // 3)::bigint as most from documents where text is not null group by 1",
    "q56_prompts": f"""{_BM25}, h as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 12) desc, doc_id) as rank from scored), c as (select query_id, string_agg('[S' || rank || '] ' || substr(text, 1, 200), chr(10) || chr(10) order by rank) as cards from h join docs using (doc_id) where rank <= 3 group by 1)
      select query_id, md5('Sources:' || chr(10) || cards || chr(10) || chr(10) || 'Question: ' || text) as digest from c join eval_items on item_id = query_id""",
    "q57_review_scores": """with r as (select event_type = 'click' as e, value > 50 as b, value as s from events), p as (select s, row_number() over (order by s) as k, count(*) over () as n from r where s is not null), x as (select greatest(1, least(any_value(n), 0.95::double * (any_value(n) + 1))) as rank from p),
      q as (select max(case when k = floor(rank) then s end) + (any_value(rank) - floor(any_value(rank))) * coalesce(max(case when k = floor(rank) + 1 then s end) - max(case when k = floor(rank) then s end), 0) as p95 from p, x)
      select count(*) filter (e and b) as caught, count(*) filter (e and not b) as missed, count(*) filter (not e and b) as false_blocks, count(*) filter (not e) as clean_runs, round(median(s), 6) as median_s, round(any_value(p95), 6) as p95_s from r, q""",
    "q43_secret_counts": f"with {_CRED} select " + ", ".join(f"sum(len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')))::bigint as {k.lower().replace(' ', '_')}" for k, p in scan.SECRETS.items()) + " from c",
    "q44_redact": f"with {_CRED} select doc_id, md5({_REDACTED}) as digest from c",
    "q46_decode": r"with d as (select doc_id, case when doc_id % 2 = 0 then text else regexp_replace(text, '[^\x{00}-\x{ff}]', '?', 'g') end as t from documents where text is not null) select doc_id, case when doc_id % 2 = 1 and regexp_matches(t, '[\x{80}-\x{ff}]') then 'iso-8859-1' else 'utf-8' end as encoding, md5(t) as digest from d",
    "q47_percentiles": "select event_type, count(*) as n, round(median(value), 6) as median, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1",
    "q52_encodings": "select lower(trim(encoding)) as encoding, count(*) as books from books group by 1",
}
QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}
assert all(n in QUERIES for n in SQL)

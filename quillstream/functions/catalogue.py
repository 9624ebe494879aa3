"""A catalogue over the cards of an archive: stemmed words, filters on fields, a thesaurus, and vectors where there are some."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from . import search, text


class Catalogue:
    """Cards (chunk_id, ordinal, chapel, current, card), ``ordinal`` being their order in the corpus.

    Statistics are those of all cards, whatever a question filters by.  ``vectors`` may add (chunk_id, vector).
    """

    def __init__(self, cards: DataFrame, vectors: DataFrame | None = None) -> None:
        self.cards = storage.staged(cards, "cards")
        tokens = self.cards.select("chunk_id", text.stems(F.col("card")).alias("tokens"))
        self.terms = storage.staged(search.slips(tokens, "chunk_id"), "card_terms")
        self.size = self.cards.agg(F.count("*").alias("n")).withColumn("tokens", self.terms.agg(F.coalesce(F.sum("tf"), F.lit(0))).scalar())
        self.vectors = vectors

    def candidates(self, chapel: str | None, shared: str | None, current_only: bool) -> DataFrame:
        rows = self.cards if chapel is None else self.cards.where(F.col("chapel").isin(*[c for c in (chapel, shared) if c is not None]))
        return (rows.where("current") if current_only else rows).select("chunk_id", "ordinal")

    def look_up(self, questions: DataFrame, k: int = 3, chapel: str | None = None, shared: str | None = None, current_only: bool = True, question_vectors: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, rank, score): the k best candidates of each question (query_id, text); ties and cards without a score keep the corpus's order.

        With vectors, words and vectors are fused by rank; ``question_vectors`` has (query_id, vector).
        """
        asked = search.asked_words(questions.select("query_id", text.stems(F.col("text")).alias("tokens")))
        keep = self.candidates(chapel, shared, current_only)
        scored = search.bm25_scores(self.terms, "chunk_id", self.size, asked).join(keep, "chunk_id")
        # Of the cards without a score only the first k can be among the k best.
        rest = storage.staged(keep.orderBy("ordinal").limit(k), "first_cards")
        missing = questions.select("query_id").withColumn("c", F.explode(rest.agg(F.collect_list(F.struct("chunk_id", "ordinal"))).scalar())).select("query_id", "c.chunk_id", "c.ordinal")
        # A first card that has a score is met twice: the higher counts.
        both = scored.select("query_id", "chunk_id", "ordinal", "score").unionByName(missing.withColumn("score", F.lit(0.0)))
        ranked = both.groupBy("query_id", "chunk_id", "ordinal").agg(F.max("score").alias("score"))
        by_words = search.top_k(ranked, "query_id", [F.desc(F.round("score", 12)), F.asc("ordinal")], k if self.vectors is None else 50)
        if self.vectors is None or question_vectors is None:
            return by_words.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score")
        held = self.vectors.join(keep, "chunk_id").select("chunk_id", F.col("vector").alias("v"), "ordinal")
        near = search.cosine_top_k(held, "ordinal", "v", question_vectors.select("query_id", F.col("vector").alias("v")), "query_id", 50, itself=True).join(keep, "ordinal")
        return search.fused(by_words, near, "query_id", "chunk_id", k).select("query_id", "chunk_id", "rank", "score")


def cards_of(records: DataFrame, fixed: int | None = None) -> DataFrame:
    """Cards of archive records: one for each section, or pieces of ``fixed`` characters."""
    pieces = text.heading_chunks(F.col("body")) if fixed is None else F.transform(text.fixed_chunks(F.col("body"), fixed), lambda t: F.struct(F.lit("").alias("heading"), F.lit("").alias("slug"), t.alias("text")))
    rows = records.select("id", "title", "chapel", "current", F.posexplode(pieces).alias("n", "c"))
    name = F.concat_ws("#", "id", "n") if fixed else F.concat_ws("#", "id", "c.slug")
    return rows.select(name.alias("chunk_id"), F.struct("id", "n").alias("ordinal"), "chapel", "current", "id", F.col("c.heading").alias("heading"), F.col("c.text").alias("text"), text.card(F.col("title"), F.col("c.heading"), F.col("c.text")).alias("card"))


def evaluated(catalogue: Catalogue, questions: DataFrame, k: int = 3, chapel: str | None = None, shared: str | None = None, filtered: bool = True, widened: bool = True) -> DataFrame:
    """(queries, recall, mrr, trap_rate) of questions (query_id, text, id), ``id`` being the record that answers; a trap is a record that isn't current."""
    asked = questions.select("query_id", (text.expanded(F.col("text")) if widened else F.col("text")).alias("text"))
    hits = catalogue.look_up(asked, k, chapel if filtered else None, shared, current_only=filtered)
    hits = hits.join(catalogue.cards.select("chunk_id", F.substring_index("chunk_id", "#", 1).alias("of"), "current"), "chunk_id").join(questions.select("query_id", "id"), "query_id")
    hits = hits.withColumn("relevant", F.col("of") == F.col("id")).withColumn("trap", ~F.col("current"))
    return search.retrieval_metrics(hits, questions, "query_id", "relevant", "trap", k)

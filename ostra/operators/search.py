"""Exact, semantic and combined search over an index."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostra.operators import ltr, spelling
from ostra.operators.features import features, on_the_fly_bm25
from ostra.operators.index import Index, min_tier, tier_counts
from ostra.operators.vector import vector_top_k
from ostra.plans.boolean import PHRASE_BYTES, evaluate
from ostra.plans.query_language import compat_token_count, explain_query, leaves, parse_query, positive_leaves

RADIUS = 100


def snippet(body: Column, position: Column) -> Column:
    """A window of 200 characters about a position, cut to whole words; an empty body gives an empty one."""
    p = F.greatest(F.coalesce(position, F.lit(1)), F.lit(1))
    n = F.length(body)
    start = F.when(p >= RADIUS, p - RADIUS).otherwise(1)
    end = F.when(start + 2 * RADIUS < n, start + 2 * RADIUS).otherwise(n)
    space = F.instr(F.substring(body, start + 1, F.greatest(end - start, F.lit(0))), " ")
    first = F.when((start != 0) & (space > 0), start + space).otherwise(start)
    tail = F.substring(body, first + 2, F.greatest(end - first, F.lit(0)))
    back = F.instr(F.reverse(tail), " ")
    last = F.when((end != n) & (back > 0), first + 1 + F.length(tail) - back).otherwise(end)
    return F.coalesce(F.substring(body, first + 1, F.greatest(last - first, F.lit(0))), F.lit(""))


def body_positions() -> Column:
    """The positions of a posting in the body: those of the title come first in its list."""
    return F.when(F.col("tf_body") > 0, F.slice("positions", F.col("tf_title") + 1, F.col("tf_body"))).otherwise(F.array().cast("array<int>"))


def characters_before(text: Column, byte: Column) -> Column:
    """How many characters of a text stand before a byte of its UTF-8 form."""
    return F.length(F.substring(F.encode(text, "UTF-8"), F.lit(1), byte).cast("string"))


def _followed_by(last: Column, k: int) -> Callable[[Column], Column]:
    """Whether a position has one of ``last`` 0 to ``k`` bytes behind it."""
    return lambda a: F.exists(last, lambda b: (b - a).between(0, k))


def first_places(postings: DataFrame, tree: dict | None, ids: DataFrame, k: int = PHRASE_BYTES) -> DataFrame:
    """(doc_id, at) of a few documents: the first byte in the body at which a leaf stands that the query asks for.

    A phrase stands where its last two words are near each other; words behind ``not`` aren't looked for, nor is the title.
    """
    wanted = positive_leaves(tree)
    tokens = list(dict.fromkeys(t for leaf in wanted for t in leaf))
    if not tokens:
        return ids.select("doc_id", F.lit(None).cast("int").alias("at"))
    rows = postings.where(F.col("token").isin(tokens)).join(F.broadcast(ids.select("doc_id")), "doc_id")
    wide = rows.groupBy("doc_id").agg(*[F.max(F.when(F.col("token") == t, body_positions())).alias(f"b_{i}") for i, t in enumerate(tokens)])
    spots = [F.lit(None).cast("int"), F.lit(None).cast("int")]
    for leaf in wanted:
        last = F.col(f"b_{tokens.index(leaf[-1])}")
        if len(leaf) == 1:
            spots.append(F.get(last, F.lit(0)))
        else:
            spots.append(F.array_min(F.filter(f"b_{tokens.index(leaf[-2])}", _followed_by(last, k))))
    return wide.select("doc_id", F.least(*spots).alias("at"))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best by score, ties to the smaller doc_id: each task keeps k, the driver merges them."""
    return scored.orderBy(F.desc(score), "doc_id").limit(k)


def fetch(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Add url, title, body to a top-k result; at most k rows, so they are broadcast to the scan."""
    return docs.join(F.broadcast(ranked), "doc_id")


class SearchEngine:
    """Search over the index in a folder.

    ``vectors`` (vec_id, embedding) and ``embed`` (text to query vector) serve semantic search, ``model`` re-ranks.
    Without vectors semantic search is an error; without a model the order is by BM25.

    ``compat`` keeps what the surveyed engine does where plain semantics differ: negation by flags, operators among a
    query's tokens, doubled features of documents in both lists, and snippets shifted by the title's length.
    """

    def __init__(self, spark, path: str, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, model: ltr.ListNet | None = None, phrase_bytes: int = 10, compat: bool = False) -> None:
        self.index, self.compat = Index(spark, path), compat
        self.spark, self.vectors, self.embed, self.model, self.phrase_bytes = spark, vectors, embed, model, phrase_bytes
        self._lists: OrderedDict[str, DataFrame] = OrderedDict()
        self._most = 0

    def cache(self, most: int = 64) -> None:
        """Keep the postings of the ``most`` tokens asked for last, for an interactive session; 0 keeps none.

        Only lists that queries read are kept, never the index, and what doesn't fit into memory goes to disk.
        """
        self._most = most
        self._shrink(most)

    def _shrink(self, most: int) -> None:
        while len(self._lists) > most:
            self._lists.popitem(last=False)[1].unpersist()

    def postings_of(self, tokens: list[str]) -> DataFrame:
        """Postings that hold at least those of the tokens: the kept lists, or the index, to be filtered."""
        tokens = list(dict.fromkeys(tokens))
        if not self._most or not tokens:
            return self.index.postings
        for t in tokens:
            if t not in self._lists:
                self._lists[t] = self.index.postings.where(F.col("token") == t).persist()
            self._lists.move_to_end(t)
        self._shrink(max(self._most, len(tokens)))
        return reduce(DataFrame.unionByName, [self._lists[t] for t in tokens])

    @property
    def semantic(self) -> bool:
        """Whether a query's text can be answered by vectors."""
        return self.vectors is not None and self.embed is not None

    def parse(self, query: str) -> dict | None:
        return parse_query(query, self.index.stem)

    def explain(self, query: str) -> str:
        return explain_query(self.parse(query))

    def suggest(self, query: str, min_df: int = spelling.MIN_DF, min_similarity: float = spelling.MIN_SIMILARITY) -> tuple[str, int]:
        return spelling.suggest(spelling.kgram_index(self.index.vocab, min_df), query, min_similarity, self.index.stem)

    def matches(self, query: str, compat: bool | None = None, max_tier: int | None = None) -> DataFrame:
        """(doc_id, score) of all documents that fulfil the query."""
        tree = self.parse(query)
        return evaluate(self.postings_of(leaves(tree)), tree, self.index.forward.select("doc_id"), self.phrase_bytes, self.compat if compat is None else compat, max_tier)

    def tiered(self, query: str, min_k: int, compat: bool | None = None) -> DataFrame:
        """Matches among the best tiers only: as many tiers as it takes for ``min_k`` results. Approximate, and so not the default.

        The leaves' lists grow by a tier at a time; what was read of the tiers before is kept until the result is known.
        """
        tree, compat = self.parse(query), self.compat if compat is None else compat
        tokens = leaves(tree)
        last = self.index.meta["num_tiers"] - 1
        if not tokens:
            return self.matches(query, compat)
        stored = self.postings_of(tokens).where(F.col("token").isin(tokens))
        first = min_tier(tier_counts(stored), tokens, min_k)
        grown = [stored.where(F.col("tier") <= first).persist()]
        while True:
            found = evaluate(reduce(DataFrame.unionByName, grown), tree, self.index.forward.select("doc_id"), self.phrase_bytes, compat)
            tier = first + len(grown) - 1
            if tier == last or len(found.take(min_k)) >= min_k:
                break
            grown.append(stored.where(F.col("tier") == tier + 1).persist())
        found = evaluate(stored, tree, self.index.forward.select("doc_id"), self.phrase_bytes, compat, tier)
        for df in grown:
            df.unpersist()
        return found

    def feature_rows(self, query: str, pairs: DataFrame) -> DataFrame:
        """Features of one query for (doc_id, similarity)."""
        tokens = leaves(self.parse(query))
        n = compat_token_count(query, self.index.stem) if self.compat else len(tokens)
        queries = self.spark.createDataFrame([(0, tokens, n)], "query_id long, tokens array<string>, n_tokens int")
        return features(self.postings_of(tokens), self.index.stats, self.index.num_documents, self.index.averages, queries, pairs.select(F.lit(0).cast("long").alias("query_id"), "doc_id", "similarity"))

    def _features_of(self, query: str, ranked: DataFrame) -> DataFrame:
        """Features of a list; in compat those that add up over tokens count twice for documents that both searches found."""
        rows = self.feature_rows(query, ranked)
        if not self.compat:
            return rows
        twice = F.when(F.col("source") == "exact & semantic", 2.0).otherwise(1.0)
        rows = rows.join(ranked.select("doc_id", twice.alias("_times")), "doc_id")
        return rows.withColumns({c: F.col(c) * F.col("_times") for c in ("bm25_title", "bm25_body", "ratio_query_in_title", "ratio_query_in_body")}).drop("_times")

    def _rerank(self, query: str, ranked: DataFrame) -> DataFrame:
        if self.model is None:
            return ranked
        rows = ltr.score(self._features_of(query, ranked), self.model)
        return ranked.drop("score").join(rows.select("doc_id", F.col("prediction").alias("score")), "doc_id")

    def _present(self, query: str, ranked: DataFrame, k: int) -> DataFrame:
        tree = self.parse(query)
        best = top_k(ranked, k)
        first = first_places(self.postings_of(leaves(tree)), tree, best, self.phrase_bytes)
        rows = fetch(self.index.docs, best).join(first, "doc_id", "left")
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))  # k rows
        at = characters_before(F.col("body"), F.col("at"))
        shown = snippet(F.col("body"), at - F.octet_length("title") if self.compat else at)
        return rows.select(rank.alias("rank"), "doc_id", "score", "source", "similarity", "url", "title", "body", shown.alias("snippet")).orderBy("rank")

    def exact_search(self, query: str, pre_select_k: int = 50, top_k_: int = 10, ltr_enabled: bool = False, by_tiers: bool = False) -> DataFrame:
        """The best exact matches; ``by_tiers`` looks no further than the tiers that ``pre_select_k`` results take."""
        all_ = self.tiered(query, pre_select_k) if by_tiers else self.matches(query)
        found = top_k(all_, pre_select_k).select("doc_id", "score", F.lit("exact").alias("source"), F.lit(-1.0).alias("similarity"))
        return self._present(query, self._rerank(query, top_k(found, top_k_)) if ltr_enabled else found, top_k_)

    def _nearest(self, query: str, k: int, vector: list[float] | None) -> DataFrame:
        if self.vectors is None or (vector is None and self.embed is None):
            raise ValueError("semantic search needs vectors and a query embedding")
        return vector_top_k(self.vectors, vector if vector is not None else self.embed(query), k)

    def semantic_search(self, query: str, pre_select_k: int = 50, top_k_: int = 10, ltr_enabled: bool = False, vector: list[float] | None = None) -> DataFrame:
        near = self._nearest(query, pre_select_k, vector)
        scored = near.join(self.feature_rows(query, near).select("doc_id", on_the_fly_bm25().alias("bm25")), "doc_id")
        found = scored.select("doc_id", F.col("similarity").alias("score"), F.lit("semantic").alias("source"), "similarity")
        return self._present(query, self._rerank(query, top_k(found, top_k_)) if ltr_enabled else found, top_k_)

    def combined_search(self, query: str, exact_preselect_k: int = 50, semantic_preselect_k: int = 50, top_k_: int = 10, vector: list[float] | None = None) -> DataFrame:
        """Both searches' candidates in one list, re-ranked (by the model, or by on-the-fly BM25 plus similarity)."""
        both = hybrid(top_k(self.matches(query), exact_preselect_k), self._nearest(query, semantic_preselect_k, vector))
        if self.model is not None:
            return self._present(query, self._rerank(query, both), top_k_)
        bm25 = self._features_of(query, both).select("doc_id", on_the_fly_bm25().alias("bm25"))
        return self._present(query, both.drop("score").join(bm25, "doc_id").withColumn("score", F.col("bm25") + F.greatest("similarity", F.lit(0.0))), top_k_)


def hybrid(exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """(doc_id, score, source, similarity) of either list: ``exact``, ``semantic`` or ``exact & semantic``."""
    a, b = exact.select(F.col("doc_id").alias("a"), "score"), semantic.select(F.col("doc_id").alias("b"), "similarity")
    source = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "exact & semantic").when(F.col("a").isNotNull(), "exact").otherwise("semantic")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("doc_id"), F.coalesce("score", F.lit(0.0)).alias("score"), source.alias("source"), F.coalesce("similarity", F.lit(-1.0)).alias("similarity"))

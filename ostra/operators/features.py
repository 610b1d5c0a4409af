"""The eight learning-to-rank features of (query, document) pairs, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostra.operators.index import bm25_field

FEATURES = ["bm25_title", "bm25_body", "title_length", "body_length", "ratio_query_in_title", "ratio_query_in_body", "first_occurrence_body", "similarity_score"]


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, n_tokens) of (query_id, tokens): different tokens, and how many the query has in all.

    A column ``n_tokens`` of the queries counts instead, where they have one.
    """
    n = F.col("n_tokens") if "n_tokens" in queries.columns else F.size("tokens")
    return queries.select("query_id", n.alias("n_tokens"), F.explode(F.array_distinct("tokens")).alias("token"))


#: Tokens of queries, each counted once a query, that are looked up in the index; with more the postings are joined by shuffle.
FEW = 1000


def matched_postings(postings: DataFrame, tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Postings of the pairs' documents for their query's tokens.

    A few tokens select their row groups by a filter that reaches the scan, and no other posting is read or moved.
    """
    few = tokens.limit(FEW + 1).collect()
    if len(few) <= FEW:
        postings = postings.where(F.col("token").isin(sorted({r.token for r in few if r.token is not None})))
        tokens = F.broadcast(tokens)
    return postings.join(tokens, "token").join(pairs.select("query_id", "doc_id"), ["query_id", "doc_id"])


def features(postings: DataFrame, stats: DataFrame, n: int, averages: tuple[float, float], queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, the features) for each pair (query_id, doc_id, similarity).

    ``postings`` carry df. Pairs without a match keep 0 scores, ratio 0 and first occurrence -1; a null
    similarity is -1. Both ratios are matched tokens over all tokens of the query, as surveyed.
    """
    tokens = query_tokens(queries)
    number, df = F.lit(float(n)), F.col("df")
    hits = matched_postings(postings, tokens, pairs).groupBy("query_id", "doc_id").agg(
        F.sum(F.when(F.col("tf_title") > 0, bm25_field("title", number, df, F.lit(averages[0]))).otherwise(0.0)).alias("bm25_title"),
        F.sum(F.when(F.col("tf_body") > 0, bm25_field("body", number, df, F.lit(averages[1]))).otherwise(0.0)).alias("bm25_body"),
        (F.count("*") / F.max("n_tokens")).alias("ratio"),
        F.min(F.element_at("positions", 1)).alias("first"),
    )
    out = pairs.join(stats, "doc_id").join(hits, ["query_id", "doc_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        "query_id", "doc_id", zero("bm25_title").alias("bm25_title"), zero("bm25_body").alias("bm25_body"), F.col("len_title").cast("double").alias("title_length"),
        F.col("len_body").cast("double").alias("body_length"), zero("ratio").alias("ratio_query_in_title"), zero("ratio").alias("ratio_query_in_body"),
        F.coalesce(F.col("first"), F.lit(-1)).cast("double").alias("first_occurrence_body"), F.coalesce(F.col("similarity"), F.lit(-1.0)).alias("similarity_score"),
    )


def on_the_fly_bm25() -> Column:
    """Title and body scores by their boosts."""
    return F.col("bm25_title") * 1.0 + F.col("bm25_body") * 0.5

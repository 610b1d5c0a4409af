"""Spelling suggestions by the Jaccard similarity of character bigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostra.functions.analysis import OPERATORS, bigrams, tokenize_text

MIN_DF, MIN_SIMILARITY = 100, 0.75


def kgram_index(vocab: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """(bigram, token, n, df): the bigrams of each token that at least ``min_df`` documents hold, with their counts."""
    rows = vocab.where(F.col("df") >= min_df).select("token", "df", F.explode(bigrams(F.col("token"))).alias("bigram"))
    return rows.groupBy("bigram", "token").agg(F.count("*").alias("n"), F.first("df").alias("df"))


def candidates(index: DataFrame, words: list[str], compat: bool = False) -> DataFrame:
    """(word, token, df, jaccard) of each other token that shares a bigram with a word.

    Joined by bigram; the words are a query's few, so their side is broadcast. Shared bigrams count
    by the smaller number, all others of both sides as misses. ``compat``: of the surplus of the
    token's bigrams every second one counts as a match, as in the surveyed loop.
    """
    spark: SparkSession = index.sparkSession
    asked = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")
    grams = asked.select("word", F.length("word").alias("word_len"), F.explode(bigrams(F.col("word"))).alias("bigram")).groupBy("word", "word_len", "bigram").agg(F.count("*").alias("m"))
    shared = index.join(F.broadcast(grams), "bigram").where("word <> token")
    surplus = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    # of a bigram that the word hasn't, every second one counts as well: the token's own sum, less what is shared
    bonus = F.floor(surplus / 2) - F.floor(F.col("n") / 2) if compat else F.lit(0)
    pairs = shared.groupBy("word", "word_len", "token").agg(F.first("df").alias("df"), F.sum(F.least("n", "m")).alias("common"), F.sum(bonus).alias("bonus"))
    if compat:
        own = index.groupBy("token").agg(F.sum(F.floor(F.col("n") / 2)).alias("own"))
        pairs = pairs.join(own, "token").withColumn("bonus", F.col("bonus") + F.col("own"))
    # a word of n characters has n + 1 bigrams; a bonus match uses up two of the token's
    inter = F.col("common") + F.col("bonus")
    rest = F.col("word_len") + F.length("token") + 2 - 2 * F.col("common") - 2 * F.col("bonus")
    return pairs.select("word", "token", "df", (inter / (inter + rest)).alias("jaccard"))


def suggestions(index: DataFrame, words: list[str], min_similarity: float = MIN_SIMILARITY, compat: bool = False) -> DataFrame:
    """(word, suggestion, df, jaccard): each word's best other token, ties to the more frequent, then by name."""
    w = Window.partitionBy("word").orderBy(F.desc("jaccard"), F.desc("df"), "token")
    found = candidates(index, words, compat).where(F.col("jaccard") >= min_similarity)
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("word", F.col("token").alias("suggestion"), "df", "jaccard")


def suggest(index: DataFrame, query: str, min_similarity: float = MIN_SIMILARITY, stem: bool = True) -> tuple[str, int]:
    """The corrected query and how many of its words were replaced; operators and signs stay."""
    tokens = tokenize_text(query, is_query=True, stem=stem)[0]
    words = [t for t in tokens if t not in (*OPERATORS, "(", ")", '"')]
    best = {r.word: r.suggestion for r in suggestions(index, words, min_similarity).collect()} if words else {}
    return " ".join(best.get(t, t) for t in tokens), sum(t in best for t in tokens)

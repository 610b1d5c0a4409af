"""The inverted index: positional, fielded, scored and tiered postings as Parquet."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostra.functions.analysis import STOPWORDS, plain_tokens, tokenized_documents
from ostra.session import bound_batches, small_splits

BOOSTS, BS, K = (1.0, 0.5), (0.75, 0.75), 1.5
TIERS = (20.0, 15.0, 10.0, 5.0, 2.5, 0.0)
#: Postings of one token that lie together at most, about 100 MB.
PART_ROWS = 2_000_000


def document_postings(docs: DataFrame, stem: bool = False) -> DataFrame:
    """(token, doc_id, tf_title, tf_body, len_title, len_body, positions) of each token of each document, without a shuffle."""
    return explode_terms(tokenized_documents(docs, stem))


def explode_terms(tokenized: DataFrame) -> DataFrame:
    return tokenized.select("doc_id", "len_title", "len_body", F.explode("terms").alias("t")).select("t.token", "doc_id", "t.tf_title", "t.tf_body", "len_title", "len_body", "t.positions")


def doc_stats(tokenized: DataFrame) -> DataFrame:
    return tokenized.select("doc_id", "len_title", "len_body")


def vocabulary(postings: DataFrame) -> DataFrame:
    """(token, df, cf): documents and occurrences of each token."""
    return postings.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.col("tf_title") + F.col("tf_body")).alias("cf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(token, df) of the documents' plain tokens: what the vocabulary says of them, in native expressions and without an index."""
    tokens = F.array_distinct(F.concat(plain_tokens(F.col("title")), plain_tokens(F.col("body"))))
    rows = docs.where("doc_id is not null").select(F.explode(tokens).alias("token")).where(~F.col("token").isin(*STOPWORDS))
    return rows.groupBy("token").agg(F.count("*").alias("df"))


def first_seen_ids(postings: DataFrame) -> DataFrame:
    """(token, token_id): dense ids in the order in which tokens are first seen, by document, field and position."""
    from ostra.operators.ranks import gapless_rank

    place = F.struct("doc_id", (F.col("tf_title") == 0).cast("int").alias("field"), F.element_at("positions", 1).alias("position"))
    seen = postings.groupBy("token").agg(F.min(place).alias("p")).select("token", "p.doc_id", "p.field", "p.position").withColumn("_all", F.lit(0))
    return gapless_rank(seen, ["_all"], [F.col("doc_id"), F.col("field"), F.col("position")], "token_id").select("token", "token_id")


def collection_stats(stats: DataFrame) -> DataFrame:
    """One row: num_documents, avg_title, avg_body."""
    return stats.agg(F.count("*").alias("num_documents"), F.avg("len_title").alias("avg_title"), F.avg("len_body").alias("avg_body"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def _ratio(length: Column, average: Column) -> Column:
    return F.coalesce(length / F.nullif(average, F.lit(0.0)), F.lit(0.0))


def bm25f_index(n: Column, df: Column, avg_title: Column, avg_body: Column, boosts=BOOSTS, bs=BS, k: float = K) -> Column:
    """The index-time score over both fields; its length norm is 1 + b + (1 - b) * len / avg, and idf isn't clamped."""
    tf = sum(
        F.col(f"tf_{f}") * boosts[i] / (1 + bs[i] + (1 - bs[i]) * _ratio(F.col(f"len_{f}"), avg)) for i, (f, avg) in enumerate((("title", avg_title), ("body", avg_body)))
    )
    return idf(n, df) * (tf * (k + 1) / (tf + k))


def bm25_field(field: str, n: Column, df: Column, average: Column, k: float = K, b: float = 0.75) -> Column:
    """The usual BM25 of one field, at query time."""
    tf = F.col(f"tf_{field}")
    return idf(n, df) * (tf * (k + 1) / (tf + k * (1 - b + b * _ratio(F.col(f"len_{field}"), average))))


def tier_of(score: Column, thresholds=TIERS) -> Column:
    """The first tier whose threshold the score reaches; the last one for negative scores."""
    out = F.lit(len(thresholds) - 1)
    for i, t in reversed(list(enumerate(thresholds))):
        out = F.when(score >= t, F.lit(i)).otherwise(out)
    return out.cast("int")


def score_postings(postings: DataFrame, vocab: DataFrame, stats: DataFrame) -> DataFrame:
    """Add ``df``, ``score`` and ``tier``; postings of a token come together, those of a frequent one in several parts by doc_id.

    The collection's numbers are read first and are literals. The parts follow from the counts, so nothing is sampled
    and the rows move once: they meet the vocabulary where they stay. The number of tasks follows from the postings, so each sorts in memory.
    """
    m = collection_stats(stats).first()
    n, avg_title, avg_body = (F.lit(None if x is None else float(x)).cast("double") for x in (m.num_documents, m.avg_title, m.avg_body))
    number = vocab.agg(F.sum("df")).first()[0] or 0
    tasks = max(postings.sparkSession.sparkContext.defaultParallelism, -(-number // PART_ROWS))
    parts = F.ceil(F.col("df") / PART_ROWS).cast("long")
    often = vocab.where(F.col("df") > PART_ROWS).select(F.col("token").alias("_often"), parts.alias("_parts"))  # few: one for PART_ROWS postings at most
    placed = postings.join(F.broadcast(often), F.col("token") == F.col("_often"), "left").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.coalesce("_parts", F.lit(1).cast("long"))))
    counts = vocab.select("token", "df", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    met = placed.drop("_often", "_parts").repartition(tasks, "token", "_part").join(counts.repartition(tasks, "token", "_part").hint("shuffle_hash"), ["token", "_part"])
    scored = met.select(*postings.columns, "df").withColumn("score", bm25f_index(n, F.col("df"), avg_title, avg_body))
    return scored.withColumn("tier", tier_of(F.col("score")))


def laid_out(scored: DataFrame) -> DataFrame:
    """Scored postings sorted where they are: those of a token lie together, so that a query's tokens select few row groups."""
    return scored.sortWithinPartitions("tier", "token", "doc_id")


def tier_counts(scored: DataFrame) -> DataFrame:
    """Length of each token's list in each tier."""
    return scored.groupBy("token", "tier").agg(F.count("*").alias("n"))


def min_tier(counts: DataFrame, tokens: list[str], top_k: int, tiers: int = len(TIERS)) -> int:
    """The first tier whose own list is long enough for every token, else the last."""
    got = {(r.token, r.tier): r.n for r in counts.where(F.col("token").isin(tokens)).collect()}
    return next((t for t in range(tiers) if all(got.get((w, t), 0) >= top_k for w in set(tokens))), tiers - 1)


def save(df: DataFrame, path: str, *by: str) -> None:
    """Write a table of an index: many of its bytes are repeated names and numbers, which zstd packs well; small row groups make small splits."""
    df.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def write_postings(spark: SparkSession, path: str) -> None:
    """The vocabulary and the scored postings of the forward index of a folder."""
    with small_splits(spark):
        forward = spark.read.parquet(f"{path}/forward")
        save(vocabulary(explode_terms(forward)), f"{path}/vocab")
        save(laid_out(score_postings(explode_terms(forward), spark.read.parquet(f"{path}/vocab"), doc_stats(forward))), f"{path}/postings", "tier")


def build_index(docs: DataFrame, path: str, stem: bool = False, max_documents: int | None = None) -> None:
    """Write an index of ``docs`` (doc_id, url, title, body) to a folder.

    The text is analysed once into a forward index; postings are then laid out by token, a
    frequent one over several files, and sorted.
    Null ids have no place in an index and are left out; of several rows with one id each is indexed.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if max_documents is not None:
        docs = docs.orderBy("doc_id").limit(max_documents)
    docs = docs.where("doc_id is not null").select("doc_id", "url", "title", "body")
    save(docs, f"{path}/docs")
    save(tokenized_documents(docs, stem), f"{path}/forward")
    stats = doc_stats(spark.read.parquet(f"{path}/forward"))
    write_postings(spark, path)
    meta = collection_stats(stats).first()
    n_postings = spark.read.parquet(f"{path}/postings").count()
    info = {
        "num_documents": meta.num_documents, "num_postings": n_postings, "num_fields": 2, "bm25_k": K, "bm25_field_boosts": list(BOOSTS), "bm25_bs": list(BS),
        "num_tiers": len(TIERS), "tier_thresholds": list(TIERS), "avg_field_lengths": {"title": meta.avg_title, "body": meta.avg_body}, "stem": stem,
    }
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


class Index:
    """An index on disk; tables are read when they are asked for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.meta = json.loads(spark.read.text(f"{path}/meta").first()[0])

    docs = property(lambda self: self.spark.read.parquet(f"{self.path}/docs"))
    forward = property(lambda self: self.spark.read.parquet(f"{self.path}/forward"))
    vocab = property(lambda self: self.spark.read.parquet(f"{self.path}/vocab"))
    postings = property(lambda self: self.spark.read.parquet(f"{self.path}/postings"))
    stats = property(lambda self: doc_stats(self.forward))
    stem = property(lambda self: self.meta["stem"])
    num_documents = property(lambda self: self.meta["num_documents"])
    averages = property(lambda self: (self.meta["avg_field_lengths"]["title"], self.meta["avg_field_lengths"]["body"]))


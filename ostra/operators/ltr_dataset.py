"""The learning-to-rank dataset: positives, candidates, re-ranking, relevance, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP_N = 50


def build_id_mapping(corpus: DataFrame) -> DataFrame:
    """(doc_id, our_id) of rows (external_id, doc_id) whose external id is D and digits."""
    return corpus.where(F.col("external_id").rlike("^D[0-9]+$")).select(F.col("external_id").alias("doc_id"), F.col("doc_id").alias("our_id"))


def positives(queries: DataFrame, qrels: DataFrame, mapping: DataFrame) -> DataFrame:
    return queries.join(qrels.select("query_id", "doc_id"), "query_id").join(mapping, "doc_id").select("query_id", "query_text", "doc_id", "our_id", F.lit(1).alias("rank"))


def candidate_rows(top: DataFrame, queries: DataFrame, mapping: DataFrame, positive: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Candidates of rank up to 1.5 * top_n that aren't positives of their query."""
    rows = top.where(F.col("rank") <= top_n * 1.5).join(mapping, "doc_id").join(queries, "query_id")
    return rows.select("query_id", "query_text", "doc_id", "our_id", "rank").join(positive.select("query_id", "our_id"), ["query_id", "our_id"], "left_anti")


def build_ltr_ids(queries: DataFrame, qrels: DataFrame, top: DataFrame, mapping: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """(query_id, our_id, query_text, doc_id, rank): positives first, ranks counted anew, the first ``top_n`` kept."""
    positive = positives(queries, qrels, mapping).dropDuplicates(["query_id", "our_id"])
    rest = candidate_rows(top, queries, mapping, positive, top_n)
    both = positive.withColumn("_first", F.lit(0)).unionByName(rest.withColumn("_first", F.lit(1)))
    w = Window.partitionBy("query_id").orderBy("rank", "_first", "our_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select("query_id", "our_id", "query_text", "doc_id", "rank")


def duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy("query_id", "our_id").agg(F.count("*").alias("n")).where("n > 1")


def ranking_dataset(df: DataFrame, n: int = 10) -> DataFrame:
    """Rows of queries with exactly ``n`` documents, with ``query_index`` (dense from 0) and ``relevance`` = max rank - rank + 1."""
    w = Window.partitionBy("query_id")
    full = df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == n).withColumn("relevance", F.max("rank").over(w) - F.col("rank") + 1)
    index = query_index(full)
    return full.join(index, "query_id").drop("_n")


def query_index(df: DataFrame) -> DataFrame:
    """(query_id, query_index): dense from 0 by query_id, ranked over all partitions."""
    from ostra.operators.ranks import gapless_rank

    return gapless_rank(df.select("query_id").distinct().withColumn("_all", F.lit(0)), ["_all"], [F.col("query_id")], "query_index").select("query_id", "query_index")


def split_dataset(df: DataFrame, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Add ``split``: the first 80 % of queries by dense index train, 10 % validate, the rest test."""
    index = query_index(df)
    n = index.count()
    part = F.when(F.col("query_index") < int(n * train), "train").when(F.col("query_index") < int(n * train) + int(n * validation), "validation").otherwise("test")
    return df.join(index.select("query_id", part.alias("split")), "query_id")


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std): population standard deviation, in one pass."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in features])).alias("x")).select("x.*")


def groups(df: DataFrame) -> DataFrame:
    """(query_id, n): what a reader that cuts on changes of query_id would see."""
    return df.groupBy("query_id").agg(F.count("*").alias("n"))

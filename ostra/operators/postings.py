"""Set operations on posting lists, as joins on doc_id.

A list has doc_id, tokens, scores, total, similarity, first_pos and positions; the left side's
document data win where both match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostra.plans.boolean import PHRASE_BYTES, within

COLUMNS = ("tokens", "scores", "total", "similarity", "first_pos", "positions")


def posting_list(postings: DataFrame, token: str, max_tier: int | None = None) -> DataFrame:
    """The list of one token."""
    rows = postings.where(F.col("token") == token)
    if max_tier is not None:
        rows = rows.where(F.col("tier") <= max_tier)
    return rows.select(
        "doc_id", F.array("token").alias("tokens"), F.array("score").alias("scores"), F.col("score").alias("total"), F.lit(-1.0).alias("similarity"),
        F.element_at("positions", 1).alias("first_pos"), "positions",
    )


def _merged(a: str, b: str) -> list[Column]:
    """Concatenated tokens and scores, summed totals, the larger similarity, the left side's places."""
    array = lambda c, kind: F.concat(F.coalesce(F.col(f"{a}.{c}"), F.array().cast(kind)), F.coalesce(F.col(f"{b}.{c}"), F.array().cast(kind)))
    return [
        F.coalesce(F.col(f"{a}.doc_id"), F.col(f"{b}.doc_id")).alias("doc_id"),
        array("tokens", "array<string>").alias("tokens"),
        array("scores", "array<double>").alias("scores"),
        (F.coalesce(F.col(f"{a}.total"), F.lit(0.0)) + F.coalesce(F.col(f"{b}.total"), F.lit(0.0))).alias("total"),
        F.greatest(F.col(f"{a}.similarity"), F.col(f"{b}.similarity")).alias("similarity"),
        F.coalesce(F.col(f"{a}.first_pos"), F.col(f"{b}.first_pos")).alias("first_pos"),
        F.coalesce(F.col(f"{a}.positions"), F.col(f"{b}.positions")).alias("positions"),
    ]


def _same() -> Column:
    return F.col("a.doc_id") == F.col("b.doc_id")


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.alias("a").join(right.alias("b"), _same()).select(*_merged("a", "b"))


def intersection_phrase(left: DataFrame, right: DataFrame, k: int = PHRASE_BYTES) -> DataFrame:
    """Documents with a position of ``right`` at most ``k`` bytes behind one of ``left``; first_pos is the first such place of ``left``."""
    at = F.array_min(F.filter(F.col("a.positions"), lambda x: F.exists(F.col("b.positions"), lambda y: (y - x).between(0, k))))
    columns = [c if i != 5 else at.alias("first_pos") for i, c in enumerate(_merged("a", "b"))]
    columns[6] = F.col("b.positions").alias("positions")
    return left.alias("a").join(right.alias("b"), _same()).where(within(F.col("a.positions"), F.col("b.positions"), k)).select(*columns)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.alias("a").join(right.alias("b"), _same(), "full_outer").select(*_merged("a", "b"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("doc_id"), "doc_id", "left_anti").select(*left.columns)

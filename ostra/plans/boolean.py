"""A query tree compiled into one aggregation over postings and one column for match and score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostra.plans.query_language import leaves

PHRASE_BYTES = 10


def within(first: Column, then: Column, k: int = PHRASE_BYTES) -> Column:
    """Whether some position of ``then`` is 0 to ``k`` bytes behind one of ``first``."""
    return F.exists(first, lambda a: F.exists(then, lambda b: (b - a).between(0, k)))


def _phrases(tree: dict | None) -> list[list[str]]:
    if not tree or tree["type"] == "token":
        return []
    return [tree["values"]] if tree["type"] == "phrase" else _phrases(tree["left"]) + _phrases(tree["right"])


def compile_tree(tree: dict, tokens: list[str], k: int = PHRASE_BYTES, compat: bool = False) -> tuple[Column, Column, bool]:
    """(matches, score, negated) of a tree over columns ``s_i`` (score or null) and ``p_i`` (positions) of each token.

    Strict: plain Boolean algebra, where ``negated`` is always False. ``compat``: sets with a negation flag, whose combination
    keeps what the surveyed evaluation keeps; the root's flag is then ignored by the caller.
    """
    if tree["type"] == "token":
        s = F.col(f"s_{tokens.index(tree['value'])}")
        return s.isNotNull(), F.coalesce(s, F.lit(0.0)), False
    if tree["type"] == "phrase":
        at = [tokens.index(t) for t in tree["values"]]
        present = reduce(lambda a, b: a & b, [F.col(f"s_{i}").isNotNull() for i in at])
        near = [F.coalesce(within(F.col(f"p_{i}"), F.col(f"p_{j}"), k), F.lit(False)) for i, j in zip(at, at[1:], strict=False)]
        return reduce(lambda a, b: a & b, near, present), reduce(lambda a, b: a + b, [F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) for i in at]), False
    op = tree["operator"]
    m2, s2, n2 = compile_tree(tree["right"], tokens, k, compat)
    if op == "not":
        return (m2, s2, not n2) if compat else (~m2, F.lit(0.0), False)
    m1, s1, n1 = compile_tree(tree["left"], tokens, k, compat)
    both = F.when(m1, s1).otherwise(0.0) + F.when(m2, s2).otherwise(0.0)
    if not n1 and not n2:
        return (m1 & m2, s1 + s2, False) if op == "and" else (m1 | m2, both, False)
    if n1 and n2:
        return (m1 | m2, both, True) if op == "and" else (m1 & m2, s1 + s2, True)
    if op == "and":  # what is negated is taken away; with the negation on the right the flag stays set
        return (m2 & ~m1, s2, False) if n1 else (m1 & ~m2, s1, True)
    return (m1 & ~m2, s1, True) if n1 else (m2 & ~m1, s2, True)


def _true_of_nothing(tree: dict) -> bool:
    """Whether a document without any leaf matches."""
    if tree["type"] != "operator":
        return False
    if tree["operator"] == "not":
        return not _true_of_nothing(tree["right"])
    sides = [_true_of_nothing(tree["left"]), _true_of_nothing(tree["right"])]
    return all(sides) if tree["operator"] == "and" else any(sides)


def evaluate(postings: DataFrame, tree: dict | None, doc_ids: DataFrame | None = None, k: int = PHRASE_BYTES, compat: bool = False, max_tier: int | None = None) -> DataFrame:
    """(doc_id, score) of every matching document.

    Only the leaves' postings are read (a pushed-down filter on token and tier), positions only for
    phrases; one shuffle by doc_id. A tree that documents without any leaf fulfil needs ``doc_ids``.
    """
    if tree is None:
        return postings.where("false").select("doc_id", "score")
    tokens = list(dict.fromkeys(leaves(tree)))
    placed = {t for p in _phrases(tree) for t in p}
    rows = postings.where(F.col("token").isin(tokens))
    if max_tier is not None:
        rows = rows.where(F.col("tier") <= max_tier)
    aggregates = [F.max(F.when(F.col("token") == t, F.col("score"))).alias(f"s_{i}") for i, t in enumerate(tokens)]
    aggregates += [F.max(F.when(F.col("token") == t, F.col("positions"))).alias(f"p_{i}") for i, t in enumerate(tokens) if t in placed]
    wide = rows.groupBy("doc_id").agg(*aggregates)
    if not compat and _true_of_nothing(tree):
        if doc_ids is None:
            raise ValueError("this query also matches documents without any of its words: doc_ids is needed")
        wide = doc_ids.select("doc_id").join(wide, "doc_id", "left")
    matches, score, _ = compile_tree(tree, tokens, k, compat)
    return wide.where(matches).select("doc_id", score.alias("score"))

"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. On these counts alone, each source's budget is
fitted: whole passes over the source, then a share of every length that follows the length
distribution, and for the remaining budget a bounded-knapsack dynamic program whose reachable
sums are the bits of one integer. Only then are documents chosen: of each length as many as the
plan says, in the order of a seeded hash.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostra.operators.ranks import gapless_rank
from ostra.session import settle

WEIGHTS = (5, 2, 1)
MOST = 3  #: a source, and so a document, is repeated so often at most
SEED = 7
#: Words left to the dynamic program, whatever the size of a source.
REMAINDER = 4096
#: A plan of up to so many rows (about 40 bytes each) is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Each source's target: its weight's share of all sizes, at most ``most`` times its own size.

    Sources are taken by code point, null last, and weigh ``weights`` in turn. What a source can't
    take is shared by weight among the others until none is above its bound.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict[str | None, float] = {}
    left, free = float(sum(size.values())), [s for s, _ in order]
    while free:
        whole = sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        above = [s for s in free if share[s] > most * size[s]]
        if not above:
            out |= share
            break
        for s in above:
            out[s] = float(most * size[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def subset_sum(lengths: dict[int, int], budget: int, seed: int = SEED) -> dict[int, int]:
    """How many of each length to take so that the sum is the largest one not above ``budget``.

    Bounded knapsack: bit s of an integer says that the sum s can be reached; a length's count is
    split into powers of two, each one shift. It stops as soon as the budget itself is reached.
    """
    items = [(n, min(c, budget // n)) for n, c in sorted(lengths.items()) if 0 < n <= budget and c > 0]
    random.Random(seed).shuffle(items)
    full, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for n, c in items:
        k = 1
        while c > 0 and not reach >> budget & 1:
            k = min(k, c)
            steps.append((n, k, reach))
            reach = (reach | reach << n * k) & full
            c, k = c - k, k * 2
        if reach >> budget & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + k
            at -= n * k
    return out


def fit(counts: dict[int, int], target: float, most: int = MOST, seed: int = SEED) -> dict[int, tuple[int, int]]:
    """For each length (whole passes, documents taken once more), so that all words taken come near ``target``."""
    size = sum(n * c for n, c in counts.items())
    if size <= 0 or target <= 0:
        return {n: (0, 0) for n in counts}
    wanted = min(round(target), most * size)
    passes = wanted // size
    rest = wanted - passes * size
    extra = dict.fromkeys(counts, 0)
    if rest:
        reserve = min(rest, max(REMAINDER, 2 * min(n for n in counts if n)))
        # longest first; what rounding down leaves is carried on to the shorter ones
        seen = taken = 0
        for n in sorted((n for n in counts if n), reverse=True):
            seen += n * counts[n]
            extra[n] = max(0, min(counts[n], ((rest - reserve) * seen // size - taken) // n))
            taken += n * extra[n]
        for n, k in subset_sum({n: counts[n] - extra[n] for n in counts}, rest - taken, seed).items():
            extra[n] += k
    return {n: (passes, extra[n]) for n in counts}


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(source, size, source_size, target, passes, extra) for each source and size of ``sized``; a source's counts are fitted by one task."""
    counts = settle(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = [(r.source, int(r.words)) for r in counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]
    aim, words = targets(per_source, weights, most), dict(per_source)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf.source.iloc[0]
        source = None if pd.isna(source) else source
        fitted = fit(dict(zip(pdf["size"].tolist(), pdf.n.tolist(), strict=True)), aim[source], most, seed)
        return pdf.assign(source_size=words[source], target=aim[source], passes=[fitted[n][0] for n in pdf["size"]], extra=[fitted[n][1] for n in pdf["size"]])[["source", "size", "n", "source_size", "target", "passes", "extra"]]

    return settle(counts.groupBy("source").applyInPandas(one, "source string, size long, n long, source_size long, target double, passes int, extra long"))


def sized(docs: DataFrame, text: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with ``size`` (its words; null text: 0) and ``_order``, the seeded hash of doc_id and text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")).withColumn("_order", F.xxhash64(F.col("doc_id"), F.col(text), F.lit(seed)))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of ``docs`` (doc_id, text, source, ...).

    ``taken`` = copies * size. A null source is a source; null and empty texts have size 0 and
    take nothing. Repeated rows count each and may be taken differently. The same input gives the
    same sums again, and the same rows wherever doc_ids or texts differ. An empty table gives an empty result.
    """
    rows = settle(sized(docs.select("doc_id", "source", "text"), "text", seed).select("doc_id", "source", "size", "_order"))
    planned = plan(rows, weights, most, seed).drop("n")
    ranked = gapless_rank(rows, ["source", "size"], [F.col("_order"), F.col("doc_id")], "_rank", planned)
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("_rank") < F.col("extra")).cast("int")).otherwise(0)
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "_order", "passes")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The documents of the mix themselves: every row as often as it is taken, with the columns of ``docs``.

    The rows are chosen by the hash up to which each source and size is taken, so texts are never
    shuffled. Only rows that are equal in doc_id and text share the hash and go together.
    """
    chosen = mix(docs, weights, most, seed)
    cuts = settle(
        chosen.groupBy("source", "size").agg(F.max("passes").alias("_passes"), F.max(F.when(F.col("copies") > F.col("passes"), F.col("_order"))).alias("_cut"))
        .select(F.col("source").alias("_source"), F.col("size").alias("_size"), "_passes", "_cut")
    )
    if cuts.count() <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    rows = sized(docs.select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(docs.columns)], docs["doc_id"], docs["text"], docs["source"]), "text", seed)
    copies = F.col("_passes") + F.coalesce(F.col("_order") <= F.col("_cut"), F.lit(False)).cast("int")
    out = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")), "inner").where(F.col("size") > 0)
    out = out.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])

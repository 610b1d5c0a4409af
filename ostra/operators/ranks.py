"""Ranks and joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostra.session import settle

#: A key with more than this share of all rows is joined by broadcast; so at most 1,000 keys are.
HOT_SHARE = 1000


def gapless_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str, extra: DataFrame | None = None) -> DataFrame:
    """Add a rank from 0 within ``keys`` by ``order``, without ever gathering a key's rows in one task.

    The rows are sorted over all partitions by keys and order, so a hot key is spread over many
    of them. A row's rank is its place among its key's rows in its partition plus the number of
    that key's rows in the partitions before; only those counts are aggregated. Null keys are a
    key like any other. ``extra`` has one row for each key (and columns of other names), whose
    columns are added on the way, by the same join.

    Ties are broken arbitrarily, but the ranks have no gap and no double. An empty table stays empty.
    """
    spots = settle(
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    runs = spots.groupBy(part.alias("_part"), *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a window over a key sees one row for each partition the key is in, not the key's rows
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0)))
    if extra is not None:
        names = {k: f"_x_{i}" for i, k in enumerate(keys)}
        side = extra.select(*[F.col(k).alias(names[k]) for k in keys], *[c for c in extra.columns if c not in keys])
        same = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
        runs = runs.join(side, same, "left").drop(*names.values())
    runs = runs.select("_part", *[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)], *[c for c in runs.columns if c not in (*keys, "_part", "_n")])
    same = [part == F.col("_part")] + [F.col(k).eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)]
    out = spots.join(runs, same).withColumn(rank, F.col("_at") - F.col("_first") + F.col("_before"))
    return out.drop("_at", "_part", "_first", "_before", *[f"_r_{i}" for i in range(len(keys))])


def hot_split_join(big: DataFrame, small: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """Join ``big`` with ``small`` (one row a key, ``count`` = rows of ``big`` with that key).

    Keys with more than ``total / 1000`` rows (so at most 1,000 of them) are joined by broadcast
    and never shuffled; the others are joined by shuffle, where no key is large.
    ``how`` is ``left`` or ``inner``; ``count`` is not returned. Null keys match nothing.
    """
    hot = small.where(F.col(count) > max(1, total // HOT_SHARE)).drop(count)
    columns = [c for c in hot.columns if c != key]
    tagged = big.join(F.broadcast(hot.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_h_{c}") for c in columns])), F.col(key) == F.col("_k"), "left")
    known = tagged.where("_k is not null").select(*big.columns, *[F.col(f"_h_{c}").alias(c) for c in columns])
    cold = small.where(F.col(count) <= max(1, total // HOT_SHARE)).drop(count)
    rest = tagged.where("_k is null").select(*big.columns).join(cold, key, how).select(*big.columns, *columns)
    return known.unionByName(rest)

"""Sharding by longest-processing-time scheduling: groups that must stay together go, largest
first, to the least-loaded shard.

Only the counts of groups by size are scheduled; a run of equal sizes is dealt out in one step
that ends as the heap would. Which group of a size goes where follows from its rank.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostra.operators.ranks import gapless_rank, hot_split_join
from ostra.session import checkpoint_dir, settle

SHARDS = 8
#: Runs of up to so many groups of one size go through the heap one by one, longer ones in bulk.
ONE_BY_ONE = 64
#: Rows of the plan that the driver makes at a time; a longer plan is written to the shared folder in such pieces.
PIECE = 250_000


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard gets from a heap that always serves the least loaded.

    The heap serves the ``count`` smallest of all (load + m * size, shard), m = 0, 1, ...: the level
    up to which they are taken is found by bisection.
    """
    if count <= ONE_BY_ONE:
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        got = [0] * len(loads)
        for _ in range(count):
            load, s = heap[0]
            got[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        return got
    below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]  # noqa: E731 -- steps with load + m * size < level
    low, high = min(loads), max(loads) + size * (count + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= count else (low, mid)
    got = below(low)
    for s, load in enumerate(loads):  # those at the level itself, by shard
        if sum(got) < count and (low - load) % size == 0 and low >= load:
            got[s] += 1
    return got


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int = SHARDS, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In pieces of the sizes, largest first: the sizes, and for each how many groups go to shards up to this one (sizes x shards)."""
    order = np.argsort(sizes, kind="stable")[::-1]
    loads = [0] * shards
    for at in range(0, len(order), piece):
        some = order[at : at + piece]
        ends = np.zeros((len(some), shards), np.int64)
        for k, i in enumerate(some.tolist()):
            size, count = int(sizes[i]), int(counts[i])
            if count == 1:  # most of the large sizes are of one group
                s = loads.index(min(loads))
                loads[s] += size
                ends[k, s] = 1
            else:
                got = deal(loads, size, count)
                loads = [load + g * size for load, g in zip(loads, got, strict=True)]
                ends[k] = got
        yield sizes[some], ends.cumsum(axis=1)


def plan(spark: SparkSession, counts: pa.Table, shards: int, piece: int = PIECE) -> DataFrame:
    """(_size, _ends) of the schedule for ``counts`` (_size, n): the driver holds one piece besides two numbers for each size."""
    path = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    sizes, n = counts["_size"].to_numpy(), counts["n"].to_numpy()
    frame = None
    for some, ends in schedule(sizes, n, shards, piece):
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ends.size + 1, shards, dtype=np.int32)), pa.array(ends.ravel()))
        frame = spark.createDataFrame(pa.table({"_size": pa.array(some), "_ends": lists}))
        if len(sizes) > piece:
            frame.write.mode("append").parquet(path)
    if frame is None:
        return spark.createDataFrame([], "_size long, _ends array<long>")
    return spark.read.parquet(path) if len(sizes) > piece else frame


def shard(docs: DataFrame, text: str = "text", shards: int = SHARDS, seed: int = 11, piece: int = PIECE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs`` (doc_id, text, ...).

    Size: UTF-8 bytes plus 1. Rows with equal texts go to one shard (null counts as the empty
    text); sizes of shards are near equal, as far as the largest group lets them. ``slot`` counts a
    shard's rows from 0 without gap, in seeded order. Repeated rows are rows like others; an
    empty table gives an empty result.

    The driver holds 16 bytes for each different size of a group: for S bytes of text no more sizes
    than the square root of 2 S, as so many different ones already sum up to S.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = settle(docs.select("doc_id", (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(value).alias("text_crc32"), F.unhex(F.md5(value)).alias("_group")))
    groups = settle(rows.groupBy("_group").agg(F.sum("size").alias("_size"), F.count("*").alias("_rows")))
    total = groups.agg(F.sum("_rows")).first()[0] or 0
    counts = groups.groupBy("_size").agg(F.count("*").alias("n")).toArrow()
    planned = plan(docs.sparkSession, counts, shards, piece)
    # ranks within a size: a size of a third of all groups is spread over many tasks
    placed = gapless_rank(groups, ["_size"], [F.col("_group")], "_rank", planned)
    placed = settle(placed.select("_group", "_rows", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).alias("shard")))
    out = hot_split_join(rows, placed, "_group", "_rows", total, "inner")
    return gapless_rank(out.drop("_group"), ["shard"], [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")

"""Exact top-k by inner product over a pivot-distance index.

Vectors get one more component that makes all of them equally long; then the largest inner product
is the smallest distance. Each vector is keyed by its nearest pivot and its distance to it; the
rows, sorted by this key, are cut into blocks, each an annulus about its pivot, whose distances to
all pivots are bounded. A query takes the blocks in the order of the least distance that the
triangle inequality allows, |d(q, p) - d(x, p)| <= d(q, x) for every pivot p. It scans them in rounds of growing
size and stops at the first block that can't beat its k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostra.session import settle

SCALE, K, QUERY_EVERY = 1024, 10, 100
#: Pivots, and the most rows on which they are fitted.
PIVOTS, FIT_ROWS = 64, 4096
#: The directory of blocks (PIVOTS * 8 bytes each) has so many entries at most: blocks grow with the table.
MOST_BLOCKS, BLOCK = 1 << 16, 256
#: Queries in a block of queries, blocks that a query scans in its first round, and how much larger each further round is.
QUERIES, FIRST, GROWTH = 256, 4, 8


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * x) as float64, shorter vectors filled up with 0."""
    flat, ends = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets)
    ends = ends - ends[0]
    n = np.diff(ends)
    out = np.zeros((len(n), dim))
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1], n)] = np.floor(SCALE * flat)
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: as float64 where no sum can pass 2**53, else by Python's integers, cut to a long."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    a, b = np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(x)
    return np.clip(a.dot(b.T), -(2**63), 2**63 - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.lexsort((ids, -scores))[:k]


class Index:
    """What every task knows: pivots and the length to which vectors are filled up."""

    def __init__(self, pivots: np.ndarray, square: float, dim: int) -> None:
        self.pivots, self.square, self.dim = pivots, square, dim

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """To each pivot, of vectors with their added component (queries have 0 there)."""
        own = (x * x).sum(axis=1)
        added = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.square - own))
        p, pa_ = self.pivots[:, :-1], self.pivots[:, -1]
        d = own[:, None] + (p * p).sum(axis=1)[None] - 2 * x @ p.T + (added[:, None] - pa_[None]) ** 2
        return np.sqrt(np.maximum(0, d))


def fit_pivots(sample: np.ndarray, square: float, pivots: int = PIVOTS, seed: int = 5) -> np.ndarray:
    """Pivots by a few rounds of k-means over the sample."""
    rng = np.random.default_rng(seed)
    added = np.sqrt(np.maximum(0, square - (sample * sample).sum(axis=1)))
    x = np.unique(np.c_[sample, added], axis=0)
    p = x[rng.permutation(len(x))[:pivots]]
    for _ in range(8):
        near = ((p * p).sum(axis=1)[None] - 2 * x @ p.T).argmin(axis=1)
        p = np.array([x[near == i].mean(axis=0) if (near == i).any() else p[i] for i in range(len(p))])
    return p


def pivot_top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, block: int = BLOCK, first: int = FIRST, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with vec_id divisible by ``every`` the ``k`` other rows of highest score.

    Score: inner product of floor(1024 * component); ties to the smaller vec_id. Rows whose vector
    or id is null, or that hold a null or non-finite component, take no part. Vectors of different
    lengths are filled up with 0. Rows of equal id aren't candidates of each other, and only the smallest of them is a query. Scores beyond a
    long are cut to it. Fewer than k candidates: all of them. An empty table gives an empty result.

    In a round the vectors move once, to join the queries that still need them; a query moves
    once for each part (a task's share of the sorted rows) in which it has a block to scan, whatever
    the number of blocks there. ``report``, if given, gets the rounds and the share of (query, block) pairs scanned.
    """
    spark = vectors.sparkSession
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where("vec_id is not null and embedding is not null").where(finite).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.transform("embedding", lambda x: F.floor(x * SCALE).cast("double"))
    square = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.max(square).alias("square"), F.max(F.array_max(F.transform(whole, lambda x: F.abs(x)))).alias("most")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not facts.n:
        return spark.createDataFrame([], result)
    dim, top = max(1, facts.dim), float(facts.square or 0)
    kind = np.float32 if (facts.most or 0) < 1 << 24 else np.float64  # either holds the whole numbers exactly
    # the sample: the rows of smallest hash, so many at most
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toArrow()["embedding"].combine_chunks()
    index = Index(fit_pivots(_matrix(sample, dim), top, min(PIVOTS, max(1, round(facts.n**0.5)))), top, dim)
    block = max(block, -(-facts.n // MOST_BLOCKS))

    def load(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            d = index.distances(x, False)
            near = d.argmin(axis=1)
            raw = [r.tobytes() for r in x.astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), pa.array(raw, pa.binary())], names=["vec_id", "pivot", "dist", "x"])

    keyed = settle(rows.mapInArrow(key, "vec_id long, pivot int, dist double, x binary"))
    at_pivot = ["pivot", "dist", "vec_id"]

    def pack(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(ids, x):
                d = index.distances(x, False)
                return pa.RecordBatch.from_pydict({"low": [d.min(axis=0).tobytes()], "high": [d.max(axis=0).tobytes()], "ids": [ids.tobytes()], "x": [x.astype(kind).tobytes()]})

            ids, pivot, x = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, dim))
            for batch in batches:
                ids = np.r_[ids, np.asarray(batch.column(0))]
                pivot = np.r_[pivot, np.asarray(batch.column(1))]
                x = np.concatenate([x, load(b"".join(batch.column(3).to_pylist()))])
                while len(ids):
                    n = min(size, int(np.searchsorted(pivot, pivot[0], "right")))
                    if n == len(ids) < size:
                        break  # the next batch may go on with this block
                    yield out(ids[:n], x[:n])
                    ids, pivot, x = ids[n:], pivot[n:], x[n:]
            if len(ids):
                yield out(ids, x)

        return run

    packed = "low binary, high binary, ids binary, x binary"
    blocks = settle(keyed.repartitionByRange(*at_pivot).sortWithinPartitions(*at_pivot).mapInArrow(pack(block), packed).withColumn("block", F.monotonically_increasing_id()))
    # of several query rows with one id the smallest stays
    asking = keyed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("pivot", "dist", "x")).alias("r")).select("vec_id", "r.pivot", "r.dist", "r.x")
    asked = settle(asking.repartitionByRange(*at_pivot).sortWithinPartitions(*at_pivot).mapInArrow(pack(QUERIES), packed).select(F.monotonically_increasing_id().alias("ask"), "ids", "x"))
    directory = blocks.select("block", "low", "high").orderBy("block").toArrow()  # MOST_BLOCKS + pivots + partitions rows at most
    names = directory["block"].to_numpy()
    if not len(names):
        return spark.createDataFrame([], result)
    edges = [np.frombuffer(b"".join(directory[c].to_pylist()), np.float64).reshape(len(names), -1).astype(np.float32) for c in ("low", "high")]
    shipped = spark.sparkContext.broadcast((np.ascontiguousarray(edges[0].T), np.ascontiguousarray(edges[1].T)))
    # rounding of the edges to float32 and of the distances themselves
    slack = 1e-5 * (float(np.abs(edges[1]).max()) + 1)
    parts = names >> 33

    def bounds(x: np.ndarray) -> np.ndarray:
        """Least possible distance from each query to each block."""
        low, high = shipped.value
        d, out = index.distances(x, True), np.zeros((len(x), len(names)), np.float32)
        for p in range(d.shape[1]):
            np.maximum(out, np.maximum(low[p][None] - d[:, p : p + 1], d[:, p : p + 1] - high[p][None]), out=out)
        return out

    def wanted(since: int, until: int):
        """The requests of a round, a row for each block of queries and part: the queries that have blocks there
        among their ``since``-th to ``until``-th nearest and within reach of their k-th score."""

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for ids, raw, kth in zip(pdf.ids, pdf.x, pdf.kth, strict=True):
                    own, x, known = np.frombuffer(ids, np.int64), load(raw), dict(kth) if kth is not None else {}
                    least = np.array([-np.inf if known.get(int(i)) is None else float(known[int(i)]) for i in own])
                    far = bounds(x)
                    order = np.argsort(far, axis=1, kind="stable")[:, since:until]
                    # a score s means the squared distance |q|^2 + square - 2 s
                    reach = np.sqrt(np.maximum(0, (x * x).sum(axis=1) + top - 2 * least)) * (1 + 1e-9) + slack
                    q, place = np.nonzero(np.take_along_axis(far, order, axis=1) <= reach[:, None])
                    at = order[q, place]
                    for part in np.unique(parts[at]).tolist():
                        here = parts[at] == part
                        some, number = np.unique(q[here], return_inverse=True)
                        order_ = np.lexsort((number, at[here]))
                        block_, number = at[here][order_], number[order_].astype(np.int32)
                        cut = np.flatnonzero(np.r_[True, np.diff(block_) != 0])
                        yield pd.DataFrame(
                            {
                                "part": [part], "qids": [own[some].tobytes()], "q": [x[some].astype(kind).tobytes()], "least": [least[some].tobytes()],
                                "wanted": [names[block_[cut]].tolist()], "askers": [[n.tobytes() for n in np.split(number, cut[1:])]], "n": [len(number)],
                            }
                        )

        return run

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for qids, q, least, mine, ids, x in zip(pdf.qids, pdf.q, pdf.least, pdf.mine, pdf.ids, pdf.x, strict=True):
                mine, ids = np.frombuffer(mine, np.int32), np.frombuffer(ids, np.int64)
                qids, scores = np.frombuffer(qids, np.int64)[mine], _products(load(q)[mine], load(x))
                # what is below the k-th so far can't be an answer
                good = (ids[None] != qids[:, None]) & (scores >= np.frombuffer(least, np.float64)[mine][:, None])
                for row in np.flatnonzero(good.sum(axis=1) > k):
                    some = np.flatnonzero(good[row])
                    good[row] = False
                    good[row, some[_best(ids[some], scores[row, some], k)]] = True
                r, c = np.nonzero(good)
                if len(r):
                    yield pd.DataFrame({"query_id": qids[r], "vec_id": ids[c], "score": scores[r, c]})

    def best(df: DataFrame) -> DataFrame:
        # a query's candidates: k at most from each block that it scanned
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)

    body = blocks.select((F.shiftright("block", 33)).alias("at"), "block", "ids", "x")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ask, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_pydict({"ask": pa.array([ask] * len(own), pa.int64()), "query_id": pa.array(own)})

    members = asked.select("ask", "ids").mapInArrow(listed, "ask long, query_id long")
    askers = asked.agg(F.sum(F.length("ids") / 8)).first()[0] or 0
    known, answers, since, until, scanned = None, None, 0, first, []
    while since < len(names):
        asks = asked.withColumn("kth", F.lit(None).cast("map<long,long>")) if known is None else asked.join(known, "ask", "left")
        requests = settle(asks.mapInPandas(wanted(since, until), "part long, qids binary, q binary, least binary, wanted array<long>, askers array<binary>, n long"))
        size = requests.agg(F.sum("n")).first()[0]
        if not size:
            break
        scanned.append(size)
        pairs = body.join(requests, (F.col("at") == F.col("part")) & F.array_contains("wanted", F.col("block"))).select("qids", "q", "least", F.element_at("askers", F.array_position("wanted", F.col("block")).cast("int")).alias("mine"), "ids", "x")
        found = pairs.mapInPandas(scan, "query_id long, vec_id long, score long")
        answers = settle(best(found if answers is None else answers.select("query_id", "vec_id", "score").unionByName(found)))
        # where the bounds exclude next to nothing, further rounds would only read the table again: the rest at once
        hardly = since > 0 and size > 0.9 * askers * (min(until, len(names)) - since)
        since, until = until, len(names) if hardly else until * GROWTH
        if since < len(names):
            kth = answers.where(F.col("rank") == k).select("query_id", "score")
            known = kth.join(members, "query_id").groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("kth"))
    if report is not None:
        report |= {"rounds": len(scanned), "share": sum(scanned) / (len(names) * max(1, askers))}
    return spark.createDataFrame([], result) if answers is None else answers.select("query_id", "rank", "vec_id", "score")

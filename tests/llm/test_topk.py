import numpy as np
import pytest
from ostra.llm.queries import op9_top_k
from ostra.llm.topk import pivot_top_k

from tests_data import SMALL


def brute(rows, every=100, k=10):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in ok), default=0)
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v] + [0] * (dim - len(v))) for i, v in ok]
    out = set()
    for q, a in {i: v for i, v in whole if i % every == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert got(op9_top_k(spark, SMALL)) == brute(rows)


@pytest.mark.parametrize("block", [7, 64])
def test_small_blocks_and_ties(spark, block):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 3) / 8]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(pivot_top_k(df, every=20, block=block)) == brute(rows, 20)


def test_odd_vectors(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (6, []), (7, [1e6, -1e6]), (8, [0.5, 0.25]), (8, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    found = sorted(tuple(r) for r in pivot_top_k(df).select("query_id", "rank", "vec_id", "score").collect())
    assert {r[0] for r in found} == {0, 100} and [r[2] for r in found if r[0] == 0] == [7, 8, 8, 1, 6, 100]
    assert [r[3] for r in found if r[0] == 100] == [0] * 6
    assert pivot_top_k(df.limit(0)).count() == 0 and pivot_top_k(df.where("vec_id = 0")).count() == 0


def test_clustered_vectors_stop_early(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 16))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.05, (4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    report = {}
    found = got(pivot_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, block=32, report=report))
    assert found == brute(rows, 100)
    assert report["rounds"] > 1 and report["share"] < 0.5


def test_unclustered_vectors_scan_what_they_must(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(0, 1, (1500, 24)))]
    report = {}
    assert got(pivot_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, block=16, report=report)) == brute(rows, 50)
    assert report["share"] <= 1


def test_large_components_stay_exact(spark):
    rows = [(k, [float(10**6 + k), float(-(10**6) - 3 * k), 0.5]) for k in range(40)]
    assert got(pivot_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, block=8)) == brute(rows, 20)

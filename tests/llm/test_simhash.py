import random

import numpy as np
import pytest
import xxhash
from ostra.llm.queries import op7_simhash
from ostra.llm.simhash import components, covering_masks, keep_one, linked, near_duplicates

from tests_data import SMALL, documents


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    near = [[j for j, (_, g) in enumerate(fps) if j != k and (f ^ g).bit_count() <= 3] for k, (_, f) in enumerate(fps)]
    out = []
    for k, (i, f) in enumerate(fps):
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [fps[j][0] for j in seen if fps[j][0] is not None]
        out.append((i, f"{f:016x}", len(near[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.n_near, r.component_id) for r in df.collect()), key=str)


def test_every_pair_in_the_radius_collides():
    masks = covering_masks()
    assert len(masks) == 15 and all(20 < int(m).bit_count() < 44 for m in masks)
    rng = random.Random(6)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(x & int(m) == 0 for m in masks)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SMALL).collect()]
    assert got(op7_simhash(spark, SMALL)) == brute(rows)


def test_odd_rows(spark, nasty, empty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    assert got(near_duplicates(nasty)) == brute(rows)
    assert near_duplicates(empty).count() == 0
    kept = keep_one(nasty)
    assert kept.columns == nasty.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in [1, 3, None, 6, 8, 9, 10])


@pytest.mark.parametrize("split", [4096, 5])
def test_links_of_crowded_buckets(spark, split):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(40)} | {0, 1, 7, 2**63}
    fps = sorted(fps)
    n = {f: rng.randint(1, 5) for f in fps}
    signed = lambda f: int(np.uint64(f).astype(np.int64))
    reps = spark.createDataFrame([(signed(f), n[f]) for f in fps], "fp long, n long")
    rows = linked(reps, split=split).collect()
    sums, edges = {}, []
    for r in rows:
        sums[r.fp] = sums.get(r.fp, 0) + r.n
        if r.other is not None:
            edges.append((r.fp, r.other))
    near = {f: [g for g in fps if g != f and (f ^ g).bit_count() <= 3] for f in fps}
    assert {f: s for f, s in sums.items() if s} == {signed(f): sum(n[g] for g in g_) for f, g_ in near.items() if g_}
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for f in fps:
        seen, todo = {f}, [f]
        while todo:
            for g in near[todo.pop()]:
                if g not in seen:
                    seen.add(g)
                    todo.append(g)
        if len(seen) > 1:
            assert roots[signed(f)] == min(map(signed, seen))


def test_components_by_joins(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 560)]
    df = spark.createDataFrame(edges, "a long, b long")
    small, large = ({r.node: r.root for r in components(df, local).collect()} for local in (10**6, 0))
    assert small == large and small[60] == 0 and small[559] == 500


def test_rows_of_one_id_are_decided_apart(spark):
    a, b, c = (" ".join(f"{x}{i * i % 97}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (7, c), (7, c), (8, a + " "), (None, a), (None, "only here without an id"), (None, "only here without an id"), (9, "five"), (9, "six")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = [(5, a), (3, b), (7, c), (None, "only here without an id"), (9, "five"), (9, "six")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, wanted))


def test_ids_joined_by_shuffle_keep_the_same_rows(spark, nasty):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(keep_one(nasty, broadcast=0)) == rows(keep_one(nasty))
